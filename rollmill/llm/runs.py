"""Periodic runs: stretches of words that repeat with a period, by an online sparse diagonal DP.

A word that equals the word `lag` places before it lengthens the match of that lag, the cell above it on
the lag's diagonal. A diagonal that the next word does not lengthen ends there, and is a run if it was
long enough. Only earlier occurrences that can belong to a run are followed. A run of period q and at
least four periods matches 3q words at lag q, so for lags from 2^k to 2^(k+1) - 1 an occurrence counts
only with the 3 * 2^k - 1 words before it, its context. Of those, the nearest suffices: were a nearer
one at lag d inside a run of smallest period q, then q and d both were periods of a stretch of
3 * 2^k + d words or more, hence so was their divisor (q <= 3 * 2^k), and q were not the smallest. So a
word lengthens one lag of each scale at most, whatever the text repeats, and each lag that is followed
is the smallest period of its stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import documents

LEAST = 6  # words of a run, at least
REPEATS = 4  # periods of a run, at least
CHUNK = 4 << 20  # bytes of text that are searched together
SEGMENT = 1 << 20  # bytes of a text that are split into words together
GAP = re.compile(rb"[\x20\x09-\x0D]")
WORDS = r"[\x20\x09-\x0D]+"
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def segments(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time; `bytes.split` splits at 09-0D and 20."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + SEGMENT)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, words matched) of the earlier occurrences to follow, by place.

    `words` are numbers that agree where words do. Windows of 2^k words are numbered by the pair of
    their halves; a window that stands once in the text is left out of all longer ones.
    """
    _, ids, n = np.unique(words, return_inverse=True, return_counts=True)
    ids = np.where(n[ids] > 1, ids, -1)
    found = [(np.empty(0, np.int64),) * 3]
    size = 1
    while 4 * size <= len(words):
        first = np.flatnonzero((ids[:-size] >= 0) & (ids[size:] >= 0))
        if not len(first):
            break
        _, pair, n = np.unique(ids[first] * (ids.max() + 1) + ids[first + size], return_inverse=True, return_counts=True)
        twice = np.full(len(words), -1, np.int64)
        twice[first] = np.where(n[pair] > 1, pair, -1)
        # contexts of 3 * size words: a window of 2 * size and one of size behind it
        head = np.flatnonzero((twice[: len(words) - 2 * size] >= 0) & (ids[2 * size :] >= 0))
        key = twice[head] * (ids.max() + 1) + ids[head + 2 * size]
        order = np.argsort(key, kind="stable")
        place, key = head[order], key[order]
        lag = np.diff(place)
        near = (np.diff(key) == 0) & (lag >= size) & (lag < 2 * size)
        end = place[1:][near] + 3 * size - 1
        found.append((end, lag[near], np.full(len(end), 3 * size)))
        ids, size = twice, 2 * size
    place, lag, matched = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order], matched[order]


def diagonals(place: np.ndarray, lag: np.ndarray, matched: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every diagonal, each as soon as a word does not lengthen it."""
    active: dict[int, list[int]] = {}  # lag: words matched, place of the last of them

    def ended(before: int) -> Iterator[tuple[int, int, int]]:
        for q in [q for q, (_, last) in active.items() if last < before]:
            n, last = active.pop(q)
            yield last - n - q + 1, n + q, q

    at = -1
    for j, q, n in zip(place.tolist(), lag.tolist(), matched.tolist(), strict=True):
        if j != at:
            yield from ended(j - 1)
            at = j
        if q in active:
            active[q][0] += 1
            active[q][1] = j
        else:
            active[q] = [n, j]
    yield from ended(at + 1)


def runs_of(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Runs of at least `least` words and `repeats` periods, by start and then period."""
    return sorted(r for r in diagonals(*occurrences(words)) if r[1] >= max(least, repeats * r[2]))


def _searched(texts: list[bytes], least: int, repeats: int) -> Iterator[tuple[int, list, bytes]]:
    """(number of words, runs, text without the repetitions) of each text, searched in one pass."""
    numbers = _Numbers()
    ids = [
        np.concatenate([np.fromiter(map(numbers.__getitem__, part), np.int64, len(part)) for part in segments(t)] or [np.empty(0, np.int64)])
        for t in texts
    ]
    sizes = np.array([len(i) for i in ids], np.int64)
    starts = np.cumsum(sizes) - sizes
    # the number of the text goes into that of the word, so nothing matches across texts
    every = np.concatenate([i + len(numbers) * k for k, i in enumerate(ids)])
    runs: list[list] = [[] for _ in texts]
    for start, length, period in runs_of(every, least, repeats):
        k = int(np.searchsorted(starts, start, "right")) - 1
        runs[k].append((start - int(starts[k]), length, period))
    for data, n, own in zip(texts, sizes.tolist(), runs, strict=True):
        change = np.zeros(n + 1, np.int64)
        for start, length, period in own:
            change[start + period] += 1
            change[start + length] -= 1
        keep, at, parts = np.cumsum(change)[:n] == 0, 0, []
        for part in segments(data):
            kept = compress(part, keep[at : at + len(part)]) if own else part
            parts.append(b" ".join(kept))
            at += len(part)
        yield n, own, b" ".join(p for p in parts if p)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """All rows and columns with `n_words`, `runs` and `collapsed`.

    A run is a stretch of words with smallest period q and at least max(least, repeats * q) words that no
    neighbouring word extends; `runs` lists (start, length, period) by start and then period, counting
    words from 0. `collapsed` is the text without the words that some run holds behind its first q, words
    joined by a blank. `repeats` is four or more.

    Every text is searched whole where it lies: no shuffle, and n log n steps for n words whatever they
    repeat. A null or empty text has no words, no runs and an empty `collapsed`. Repeated rows give the
    same again, no rows give none. Columns of the input named n_words, runs or collapsed are replaced.
    """
    if repeats < 4:
        raise ValueError("the scales of lags hold for four repeats or more")
    keep = docs.drop("n_words", "runs", "collapsed")
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def found(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        n, runs, collapsed = zip(*_searched(texts, least, repeats), strict=True)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, runs)])
        structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], RUN.names)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs).cast(run_type)
        columns = [pa.array(n, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.binary())
            first, size, texts = 0, 0, []
            for at in range(len(column)):
                texts.append(column[at].as_py() or b"")
                size += len(texts[-1])
                if size >= CHUNK or at + 1 == len(column):
                    yield found(batch.slice(first, len(texts)), texts)
                    first, size, texts = at + 1, 0, []

    return keep.mapInArrow(search, T.StructType([*keep.schema.fields, *added]))


def with_repetitions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of one row in ten made periodic from some word on, as the id's hash says; others unchanged."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), WORDS), lambda w: w != "")
    made = docs.withColumns({"_g": g, "_words": F.when(h % 10 == 0, words)})
    made = made.withColumns({"_n": F.size("_words").cast("long")}).withColumn("_a", F.try_mod("_g", F.nullif("_n", F.lit(0))))
    period = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))
    made = made.withColumn("_p", period)

    def word(i):
        back = F.col("_a") + (i - F.col("_a")) % F.col("_p")
        return F.get("_words", F.when(i < F.col("_a"), i).otherwise(back).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), word), " ")
    changed = F.when(F.col("_n") > 0, repeated).otherwise(F.col(text))
    return made.withColumn(text, changed).select(*docs.columns)


def op11_periodic_runs(spark, sf_dir):
    docs = with_repetitions(documents(spark, sf_dir).select("doc_id", "text"))
    found = periodic_runs(docs)

    def greater(best, run):
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast(RUN), greater)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
