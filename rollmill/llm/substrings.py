"""Substring dedup: word windows that occur again, by prefix-partitioned suffix trees.

The suffixes that matter begin within reach of an anchor: of each `window` words the place with the
least hash of `PREFIX` words. Equal windows have the same anchor at the same place, so the windows of a
repeat meet under the prefix that begins at their anchor. A prefix seen once in the corpus holds no
repeat, and its windows never move. The windows under a prefix seen more often form a group, whose
suffix tree, cut at depth `window`, has an inner node for each window with two leaves or more.

Groups stay small whatever the data: a block sends each of its windows under a prefix once, with the
mark "twice here" if that is so. A group holds as many copies of a window as there are blocks, not as
there are documents; a prefix that a third of all rows share is no exception. Prefixes are as long as
they need to be: where a prefix of `PREFIX` words stands in more than `SPLIT` blocks, its windows are
dealt by their prefix of full depth instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import blocks, documents, numbered_blocks, shielded, side_rows, store_side

WINDOW = 35
PREFIX = 8  # words
SPLIT = 10_000  # blocks
PARTS = 1024  # groups that a split prefix is dealt to
MEMO = 1 << 19
PLACES = 64  # a power of two
SLICE = 1 << 20  # bytes hashed at once
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Hasher:
    """64-bit hashes of words, remembered within a task."""

    def __init__(self):
        self.memo = _Memo()

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each `n` consecutive words, in about 2 log2(n) steps over the array."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    power, size, done, result = _mixed(words + MIX), 1, 0, None
    while True:
        if n & size:
            result = power[: len(words) - n + 1] if result is None else _mixed(result * MIX + power[done : done + len(words) - n + 1])
            done += size
        if size * 2 > n:
            return result
        power = _mixed(power[:-size] * MIX + power[size:])
        size *= 2


def anchors(prefixes: np.ndarray, window: int) -> np.ndarray:
    """For each window, where in the text its anchor is: the first of its least prefix hashes."""
    reach = window - PREFIX + 1
    least, at, size = prefixes, np.arange(len(prefixes)), 1
    while size < reach:  # minima over 2, 4, ... places, the last step overlapping
        step = min(size, reach - size)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        size += step
    return at


def _table() -> np.ndarray:
    x = np.arange(PLACES * 256, dtype=np.uint64) * MIX + ODD
    for _ in range(3):
        x = _mixed(x + MIX)
    return x


BYTES = _table()  # a number for each byte value at each of the first places of a word


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word in UTF-8 bytes; white space is that of `WORD`.

    A hash is a sum over the word's bytes, so a slice of bounded size may end within a word.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.r_[True, space] != np.r_[space, True])
    starts, ends = edges[::2], edges[1::2]
    sums = (ends - starts).astype(np.uint64) * MIX
    for low in range(0, len(data), SLICE):
        high = min(low + SLICE, len(data))
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        if first == last:
            continue
        sizes = np.minimum(ends[first:last], high) - np.maximum(starts[first:last], low)
        inside = ~space[low:high]
        at = np.flatnonzero(inside).astype(np.int32)
        place = at - np.repeat((starts[first:last] - low).astype(np.int32), sizes)
        values = BYTES[((place & (PLACES - 1)) << 8) | data[low:high][inside]]
        if place.max() >= PLACES:
            values *= _mixed((place // PLACES).astype(np.uint64) * MIX) | np.uint64(1)
        sums[first:last] += np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return starts, ends, _mixed(sums)


def texts_at_once(column: pa.ChunkedArray, limit: int = SLICE) -> Iterator[list[bytes]]:
    """The texts as UTF-8, a few at a time: as many as pass `limit` bytes together; null is empty."""
    held, size = [], 0
    for value in column:
        held.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
        size += len(held[-1])
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, one text behind the other, and where each text's words begin and end."""
    starts, _, hashes = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def inner_windows(bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether the window that starts at a word ends within the word's text."""
    n = bounds[-1] - window + 1
    return np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n) >= window


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each window, the prefixes at their anchors, and for each window the number of its prefix."""
    hashes, bounds = hashed(texts)
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    prefixes = sequence_hashes(hashes, PREFIX)
    inner = inner_windows(bounds, window)
    at = anchors(prefixes, window)[inner]
    heads = np.r_[True, at[1:] != at[:-1]][: len(at)]
    return sequence_hashes(hashes, window)[inner], prefixes[at[heads]], np.cumsum(heads) - 1


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _known(path: str, block: int, column: str) -> np.ndarray:
    rows = side_rows(path, block)
    found = np.empty(0, np.int64) if rows is None else rows.column(column).to_numpy()
    return np.unique(found.view(np.uint64))


def _inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in `known`, a sorted array."""
    found = np.zeros(len(values), bool)
    if not len(known):
        return found
    # leading bits first: a search in a large array costs more
    shift = np.uint64(64 - min(max(len(known).bit_length() + 3, 12), 24))
    some = np.zeros(1 << (64 - int(shift)), bool)
    some[known >> shift] = True
    maybe = np.flatnonzero(some[values >> shift])
    near = values[maybe]
    found[maybe] = known[np.minimum(np.searchsorted(known, near), len(known) - 1)] == near
    return found


def repeated_windows(docs: DataFrame, window: int = WINDOW, text: str = "text") -> str:
    """Hashes of the windows that start in two places or more, stored by the blocks of `numbered_blocks`."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches):
            seen = [_windows(texts, window)[1] for texts in texts_at_once(rows.column(text))]  # each anchor once
            if seen:
                keys, n = np.unique(np.concatenate(seen), return_counts=True)
                for i in range(0, len(keys), 100_000):
                    part = keys[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [_long(part), pa.array(np.full(len(part), block)), pa.array(np.minimum(n[i : i + 100_000], 2).astype(np.int32))],
                        ["prefix", "block", "n"],
                    )

    texts = docs.select(text, "_block")
    places = texts.mapInArrow(prefixes, "prefix long, block long, n int")
    shared = places.groupBy("prefix").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")).where("n > 1")
    wanted = store_side(
        shared.select("prefix", (F.size("blocks") > SPLIT).alias("split"), F.explode("blocks").alias("block")), "prefixes"
    )

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches):
            side = side_rows(wanted, block)
            if side is None:
                continue
            known = np.sort(side.column("prefix").to_numpy().view(np.uint64))
            split = np.sort(side.filter(side.column("split")).column("prefix").to_numpy().view(np.uint64))
            found = []
            for texts in texts_at_once(rows.column(text)):
                hashes, keys, own = _windows(texts, window)
                mine = _inside(keys, known)[own]
                found.append(np.stack([keys[own[mine]], hashes[mine]]))
            if not found:
                continue
            pairs = np.concatenate(found, axis=1)
            pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
            new = np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)] if pairs.shape[1] else np.empty(0, bool)
            at = np.flatnonzero(new)
            twice = np.diff(np.r_[at, pairs.shape[1]]) > 1
            keys, hashes = pairs[0, at], pairs[1, at]
            part = np.where(_inside(keys, split), hashes % np.uint64(PARTS), np.uint64(0)).astype(np.int32)
            order = np.lexsort((hashes, part, keys))
            keys, hashes, part, twice = keys[order], hashes[order], part[order], twice[order]
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])]) if len(keys) else np.empty(0, int)
            ends = np.r_[cuts, len(keys)].astype(np.int32)
            for i in range(0, len(cuts), 10_000):
                few = ends[i : i + 10_001]
                inner = slice(few[0], few[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(keys[few[:-1]]),
                        pa.array(part[few[:-1]]),
                        pa.array(np.full(len(few) - 1, block)),
                        pa.ListArray.from_arrays(few - few[0], _long(hashes[inner])),
                        pa.ListArray.from_arrays(few - few[0], pa.array(twice[inner])),
                    ],
                    ["prefix", "part", "block", "leaves", "twice"],
                )

    leaves = texts.mapInArrow(suffixes, "prefix long, part int, block long, leaves array<long>, twice array<boolean>")
    dealt = leaves.repartition("prefix", "part").sortWithinPartitions("prefix", "part")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Inner nodes at depth `window`: the leaves of a group in order, those with an equal neighbour."""

        def nodes(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if len(rows) == 1 and not rows[0][2].any():
                return
            labels = np.concatenate([r[1] for r in rows])
            marks = np.concatenate([r[2] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            order = np.argsort(labels, kind="stable")
            labels, marks, owner = labels[order], marks[order], owner[order]
            same = labels[1:] == labels[:-1]
            inner = marks | np.r_[False, same] | np.r_[same, False]
            if inner.any():
                block = np.array([r[0] for r in rows])[owner[inner]]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(labels[inner])], ["block", "window"])

        group, held = None, []
        for batch in batches:
            keys, parts = batch.column("prefix").to_numpy(), batch.column("part").to_numpy()
            own = batch.column("block").to_numpy()
            leaf, mark = batch.column("leaves"), batch.column("twice")
            ends = leaf.offsets.to_numpy()
            labels = leaf.values.to_numpy()
            marks = mark.values.to_numpy(zero_copy_only=False)
            first = mark.offsets.to_numpy()
            for i in range(len(keys)):
                if group != (keys[i], parts[i]):
                    if held:
                        yield from nodes(held)
                    group, held = (keys[i], parts[i]), []
                held.append((own[i], labels[ends[i] : ends[i + 1]], marks[first[i] : first[i + 1]]))
        if held:
            yield from nodes(held)

    return store_side(dealt.mapInArrow(trees, "block long, window long"), "repeats")


def drop_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All rows and columns with `kept`, the words that no repeated window covers, and two counts.

    Words are runs without white space, unchanged. A window is `window` consecutive words of one text;
    it is repeated if the same words start anywhere else, in the same text too. All are judged on the
    input, so every copy loses them. `kept` joins the words that stay by one blank; n_words and
    n_removed count. A null text has no words; texts shorter than a window keep all of theirs. Equal
    rows repeat each other. Columns of the input with the three names are replaced. Blocks are numbered
    once, in a stored copy that is read three times. No rows give none.
    """
    docs, own = shielded(docs.drop("kept", "n_words", "n_removed"), "_block")
    fields = docs.schema.fields
    docs = numbered_blocks(docs, text, "numbered")
    repeats = repeated_windows(docs, window, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches):
            known = _known(repeats, block, "window")
            kept, sizes, removed = [], [], []
            for texts in texts_at_once(rows.column(text)):
                hashes, bounds = hashed(texts)
                edge = np.zeros(len(hashes) + 1, np.int32)
                if len(hashes) >= window and len(known):
                    inner = np.flatnonzero(inner_windows(bounds, window))
                    starts = inner[_inside(sequence_hashes(hashes, window)[inner], known)]
                    edge += np.bincount(starts, minlength=len(edge))[: len(edge)].astype(np.int32)
                    edge -= np.bincount(starts + window, minlength=len(edge))[: len(edge)].astype(np.int32)
                covered = np.cumsum(edge[:-1]) > 0
                for t, low, high in zip(texts, bounds[:-1], bounds[1:], strict=True):
                    gone = covered[low:high]
                    sizes.append(int(high - low))
                    removed.append(int(gone.sum()))
                    words = t.split()  # bytes part at the white space of `WORD`
                    kept.append(b" ".join(compress(words, ~gone) if removed[-1] else words))
            added = [pa.chunked_array([pa.array(kept, pa.binary()).cast(pa.string())]), pa.chunked_array([pa.array(sizes, pa.int64())]), pa.chunked_array([pa.array(removed, pa.int64())])]
            done = pa.table([*rows.columns, *added], names=[*rows.column_names, "kept", "n_words", "n_removed"])
            yield from done.combine_chunks().to_batches(max_chunksize=1000)

    added = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return docs.mapInArrow(cut, T.StructType([*fields, *added])).withColumnsRenamed(own)


def op5_substring_dedup(spark, sf_dir):
    done = drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
