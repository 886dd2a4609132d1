"""Importance resampling towards a target: hashed word n-grams by an Aho-Corasick scan, Gumbel top-k.

The distinct words of a block of text, each between two delimiters, are the dictionary of an
Aho-Corasick automaton. A word carries its CRC and its length, so a scan that meets the words of a text
in order gives all that its n-grams need: crc(a b) = shift(crc(a), 1 + len(b)) xor crc(" b"), where
shifting over n bytes is linear in the bits and looked up in tables. No n-gram is ever spelled out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import documents, table, written
from rollmill.operators.scan import ranked_by_ranges

BUCKETS = 10_000
SIZE = 3  # words of the longest feature
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
BLOCK = 2 << 20  # bytes of text that share a dictionary, and of a piece of a long text
LONGEST = 1_024  # bytes of a dictionary word; a longer word's payload is computed where it stands
# Bytes of UTF-8: A-Z to a-z, all delimiters to a blank; digits, a-z and all beyond ASCII are parts of words.
PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
OVERLONG = re.compile(rb"([^ ]{%d,})" % (LONGEST + 1))


def _applied(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as four tables by byte."""
    return (
        tables[0][value & 255] ^ tables[1][(value >> 8) & 255] ^ tables[2][(value >> 16) & 255] ^ tables[3][value >> 24]
    )


class Shift:
    """What a CRC-32 becomes when so many zero bytes follow it."""

    def __init__(self):
        byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        low = [np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)], np.uint32)]
        for _ in range(256):
            low.append((low[-1] >> np.uint32(8)) ^ byte[low[-1] & 255])
        self.low = np.array(low[:256])  # by length up to 255
        self.high = [low[256]]  # 256, 512, 1024, ... bytes
        while len(self.high) < 24:
            self.high.append(_applied(self.high[-1], self.high[-1]))

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        n = length & 255
        done = np.zeros(len(crc), np.uint32)
        for j in range(4):
            done ^= self.low[n, j, (crc >> np.uint32(8 * j)) & 255]
        more, bit = length >> 8, 0
        while more.any():
            at = np.flatnonzero(more & 1)
            done[at] = _applied(self.high[bit], done[at])
            more, bit = more >> 1, bit + 1
        return done


def pieces(data: bytes) -> Iterator[bytes]:
    """A text with words and blanks only, in pieces of about BLOCK bytes that cut no word."""
    plain, at = data.translate(PLAIN), 0
    while len(plain) - at > BLOCK:
        end = plain.find(b" ", at + BLOCK)
        if end < 0:
            break
        yield plain[at:end]
        at = end
    yield plain[at:] if at else plain


class Dictionary:
    """The distinct words of some texts, their payloads, and the automaton that finds them."""

    def __init__(self, texts: list[bytes]):
        words = list(set().union(*[t.split() for t in texts]))
        self.has_overlong = any(len(w) > LONGEST for w in words)
        words = [w for w in words if len(w) <= LONGEST]
        self.crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        self.automaton.make_automaton()

    def _scanned(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.crc):
            return self.crc, self.length
        met = np.fromiter((number for _, number in self.automaton.iter(f" {text.decode('latin-1')} ")), np.int64)
        return self.crc[met], self.length[met]

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each word of the text, in order."""
        if not self.has_overlong:
            return self._scanned(text)
        parts = []
        for k, part in enumerate(OVERLONG.split(text)):
            parts.append((np.array([zlib.crc32(part)], np.uint32), np.array([len(part)], np.int64)) if k % 2 else self._scanned(part))
        crc, length = map(np.concatenate, zip(*parts, strict=True))
        return crc, length


class Featuriser:
    """Buckets of all runs of 1 to `size` words of many texts."""

    def __init__(self, buckets: int = BUCKETS, size: int = SIZE):
        self.buckets, self.size, self.shift = buckets, size, Shift()

    def _composed(self, crc, length, text, old):
        """(bucket, text) of the features that end in a word after the first `old`."""
        spaced = self.shift(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
        found, value = [(crc[old:], text[old:])], crc
        for n in range(1, self.size):
            value = self.shift(value[:-1], length[n:] + 1) ^ spaced[n:]
            same = text[n:] == text[:-n]
            same[: max(old - n, 0)] = False
            found.append((value[same], text[n:][same]))
        value, text = map(np.concatenate, zip(*found, strict=True))
        return value % np.uint32(self.buckets), text

    def __call__(self, texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts of the words, buckets and texts of the features), a block at a time; texts by number."""
        held: list[tuple[int, bytes]] = []
        none = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        tail, size = none, 0

        def block():
            dictionary = Dictionary([p for _, p in held])
            met = [(*dictionary.payloads(p), k) for k, p in held]
            crc = np.concatenate([tail[0], *[c for c, _, _ in met]])
            length = np.concatenate([tail[1], *[n for _, n, _ in met]])
            text = np.concatenate([tail[2], *[np.full(len(c), k) for c, _, k in met]])
            behind = max(len(crc) - self.size + 1, 0)
            bucket, of = self._composed(crc, length, text, len(tail[0]))
            return (text[len(tail[0]) :], bucket, of), (crc[behind:], length[behind:], text[behind:])

        for k, data in enumerate(texts):
            for piece in pieces(data):
                held.append((k, piece))
                size += len(piece)
                if size >= BLOCK:
                    done, tail = block()
                    yield done
                    held, size = [], 0
        if held:
            yield block()[0]


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    column = batch.column(text).cast(pa.binary())
    return ((column[i].as_py() or b"") for i in range(len(column)))


def feature_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, size: int = SIZE) -> DataFrame:
    """`bucket` and `n`, how many features of all texts fall into it; a row for each bucket.

    A task adds up its own texts and passes on one row per bucket, whatever it reads.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featuriser, total = Featuriser(buckets, size), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in featuriser(_texts(batch, text)):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    counts = rows.select(text).mapInArrow(count, "bucket long, n long")
    every = rows.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log of the smoothed share of each bucket in the target over that in the source)."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket")
    rows = both.orderBy("bucket").toArrow()  # a row per bucket
    s, t = (rows.column(c).to_numpy().astype(np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance(docs: DataFrame, gains: np.ndarray, text: str = "text", size: int = SIZE) -> DataFrame:
    """All rows and columns with `n_words`, `n_features` and `weight`, the sum of their features' gains."""
    keep = docs.drop("n_words", "n_features", "weight")
    schema = T.StructType([*keep.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        featuriser = Featuriser(len(own), size)
        for batch in batches:
            sums = np.zeros((3, len(batch)), np.int64)
            for word, bucket, of in featuriser(_texts(batch, text)):
                sums[0] += np.bincount(word, minlength=len(batch))
                sums[1] += np.bincount(of, minlength=len(batch))
                sums[2] += np.bincount(of, own[bucket], len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], [*batch.schema.names, "n_words", "n_features", "weight"])

    return keep.mapInArrow(weigh, schema)


def gumbel_milli(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of an id, from its seeded hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, keep: list[str] | None = None, seed: int = SEED,
) -> DataFrame:
    """Columns `keep` (all by default) with n_words, n_features, weight, score and rank.

    Each row's features are all runs of one to three words, repeats counted. Their buckets weigh what the
    target's texts hold more of them than `docs` do, counted over all rows of both. Score is weight plus
    seeded Gumbel noise, and of the rows with at least `least_words` words the best `percent` per cent by
    score are drawn, ties to smaller ids; `rank` numbers them from 1 and is null for all others. Drawing
    so is sampling without replacement with odds proportional to exp(weight / 1000).

    Texts are read twice and never moved; a text of any length is scanned in pieces. Ranks come from
    range partitions of the narrow rows. A null or empty text has no features and weight 0. A row
    without an id has no score and is not drawn; rows that repeat an id have their own ranks, in an order of
    their own. An empty target leaves the weights to the documents' counts; no rows give no rows. Columns
    of the input with the names that are added are replaced.
    """
    added = ("n_words", "n_features", "weight", "score", "rank")
    keep = [c for c in (keep or docs.columns) if c not in added]
    gains = bucket_gains(feature_counts(docs, text), feature_counts(target, text))
    key = "_resampled_id"
    narrow = docs.select(*keep, F.col(doc_id).alias(key), F.col(text).alias("_resampled_text"))
    weighed = importance(narrow, gains, "_resampled_text").drop("_resampled_text")
    score = F.col("weight") + gumbel_milli(key, seed)
    stored = written(weighed.withColumn("score", score), "resampling")
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = stored.where(may).agg(F.floor(F.count(F.lit(1)) * percent / 100)).scalar()
    eligible = stored.withColumn("_may", may)
    placed = ranked_by_ranges(eligible, [], [F.col("_may").desc(), F.col("score").desc_nulls_last(), F.col(key).asc()], "rank")
    return placed.select(*keep, *added[:-1], F.when(F.col("_may") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op13_importance_resampling(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    done = resampled(docs, table(spark, sf_dir, "benchmark").select("text"), keep=["doc_id"])
    return done.select("doc_id", "n_features", "weight", "score", "rank")
