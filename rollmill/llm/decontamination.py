"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import documents, stored, table, written

WORD = re.compile(r"\w+")
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS  # hashed terms
RANK = 48
CHUNK = 16  # words; passages start at chunks
PASSAGES = (1, 2, 4)  # chunks in a passage
GAP = PASSAGES[-1]  # empty chunks between texts: what the longest passage reaches beyond its start
REACH = 2  # chunks searched on either side of a passage, or as many as the item is long
SECTION = 64  # words; a longer item is sought by sections of about equal size, none longer
FIT = 32  # words of a passage of the fit
CORPUS = 20_000  # passages that those of all texts weigh as much as in the fit, beside the benchmark's
ITEM_WEIGHT = 8.0  # of a benchmark item among the passages of the fit
COSINE = 0.2  # far below what planted copies reach, see the README
OVERLAP = 0.6  # of an item's words, in order
ANSWER = 5  # words of an item that tell it from others
ANSWERED = 0.5  # share of them that a copy must have
ITEM_BLOCK = 2_000  # items searched for at once
SEGMENT = 1 << 17  # bytes hashed at once
RUN_BYTES = 1 << 20
PROJECTION = 4096  # words projected at once
FITTED = 1 << 18  # words fitted at once
KEPT = 1 << 10  # words of a stored row, or as many as its last passage ends with
BEGINS = 1 << BUCKET_BITS  # marks the stored bucket of a word that begins a passage
SUMMED = 1 << 9  # buckets whose products move together
SELDOM = 16  # occurrences of a bucket from which on they are summed by bucket, not turn by turn
STARTS = 256  # passages compared at once
ODD_CHARACTERS = 16  # of a text that are replaced one by one


_ASCII = bytes(range(128))
_ODD = re.compile(r"[^\w\x00-\x7f]+")  # what is not ASCII and in no word
_BASE = 0x9E3779B97F4A7C15
_WORDY = np.zeros(256, bool)
_WORDY[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True
_WORDY[128:] = True
_VALUES = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base below `n`, and their inverses."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def plain(text: str | None) -> bytes:
    """The text in bytes whose runs of word bytes are its words, in either case."""
    text = text or ""
    if text.isascii():
        return text.encode()
    text = text.lower()
    odd = [c for c in set(text.encode().translate(None, _ASCII).decode()) if not WORD.match(c)]
    if len(odd) > ODD_CHARACTERS:
        return _ODD.sub(" ", text).encode()
    for c in odd:
        text = text.replace(c, " ")
    return text.encode()


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, bucket) of each word; the bucket is a hash of its bytes, without regard to case."""
    every, found, low = np.frombuffer(data, np.uint8), [], 0
    while low < len(every):
        high = min(low + SEGMENT, len(every))
        while high < len(every) and _WORDY[every[high]]:
            high += 1
        part = every[low:high]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = _WORDY[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[::2], edges[1::2]
        power, back = _powers(1 << max(18, len(part).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
        mixed = (sums[stop] - sums[start]) * back[start]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found.append((start + low, stop + low, (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)))
        low = high
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*found, strict=True)))


@dataclass(frozen=True)
class Run:
    """The words of some texts, one after the other."""

    data: bytes
    start: np.ndarray
    stop: np.ndarray
    bucket: np.ndarray
    first: np.ndarray  # word of each text, and one beyond the last

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def texts_with_bucket(self) -> np.ndarray:
        """In how many of the texts each bucket occurs."""
        kind = np.int32 if len(self.first) <= (1 << 31) // BUCKETS else np.int64
        both = self.text_of_words().astype(kind) * kind(BUCKETS) + self.bucket.astype(kind)
        both.sort()
        return np.bincount(both[np.diff(both, prepend=kind(-1)) != 0] & kind(BUCKETS - 1), minlength=BUCKETS)

    def words(self, low: int, high: int) -> list[str]:
        return WORD.findall(self.data[self.start[low] : self.stop[high - 1]].decode().lower()) if low < high else []


def runs(column: pa.Array) -> Iterator[Run]:
    """The texts in their order, in runs of about RUN_BYTES; a longer text is a run of its own."""
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(column, 1):
        held.append(plain(t.as_py()))
        size += len(held[-1]) + 1
        if size >= RUN_BYTES or i == len(column):
            data = b"\n".join(held)
            start, stop, bucket = words_at(data)
            ends = np.cumsum([len(h) + 1 for h in held])
            yield Run(data, start, stop, bucket, np.r_[0, np.searchsorted(start, ends)])
            held, size = [], 0


def kept_words(run: Run, begin: np.ndarray) -> Iterator[bytes]:
    """The buckets of a run's words, in rows of about KEPT words that end with a passage; `begin` has the first word of each."""
    words = run.bucket.astype("<i4")
    words[begin] |= BEGINS
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + KEPT)))
        yield words[begin[low] : begin[high] if high < len(begin) else None].tobytes()
        low = high


def words_and_frequencies(docs: DataFrame, text: str = "text") -> tuple[DataFrame, np.ndarray, int, int]:
    """`words`, what `kept_words` makes of all texts, read from a stored table; in how many of all documents
    each bucket occurs, the number of documents and of passages of the fit.

    Texts are cut into words once; the passes of the fit read the stored buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(BUCKETS, np.int64), 0, 0
        for batch in batches:
            for run in runs(batch.column(text)):
                held += run.texts_with_bucket()
                begin = passages(run)
                total += len(begin)
                if rows := list(kept_words(run, begin)):
                    none = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(rows, pa.binary())], ["bucket", "n", "words"])
            n += batch.num_rows
        at = np.flatnonzero(held)
        bucket, sums = pa.array(np.r_[-2, -1, at]), pa.array(np.r_[total, n, held[at]])
        yield pa.RecordBatch.from_arrays([bucket, sums, pa.nulls(len(bucket), pa.binary())], ["bucket", "n", "words"])

    both = stored(docs.select(text).mapInArrow(count, "bucket long, n long, words binary"), "words")
    # a row for each bucket at most
    sums = both.where("words is null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[bucket[bucket >= 0]] = n[bucket >= 0]
    return both.where("words is not null").select("words"), frequency, int(n[bucket == -1].sum()), int(n[bucket == -2].sum())


def item_words(items: DataFrame) -> DataFrame:
    """`words` of the items' sections, as in `words_and_frequencies`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(list(kept_words(run, item_sections(run))), pa.binary())], ["words"])

    return items.select("text").mapInArrow(cut, "words binary")


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int, int]:
    """In how many of all documents each bucket occurs, the number of documents and of passages of the fit."""
    return words_and_frequencies(docs, text)[1:]


def idf(frequency: np.ndarray, total: int) -> np.ndarray:
    """Weight of each bucket; above 0 for those in all documents too, so that no passage is without words."""
    return np.log1p((1 + total) / (1 + frequency)).astype(np.float32)


def passages(run: Run) -> np.ndarray:
    """Where the passages of FIT words begin in all texts of a run."""
    place = np.arange(len(run.bucket)) - run.first[run.text_of_words()]
    return np.flatnonzero(place % FIT == 0)


def item_sections(run: Run) -> np.ndarray:
    """Where the sections of the items of a run begin."""
    return np.concatenate([np.empty(0, np.int64), *[low + sections(high - low)[:-1] for low, high in zip(run.first, run.first[1:], strict=False) if high > low]])


def matrix() -> np.ndarray:
    """BUCKETS x RANK numbers, not set, in Arrow's memory: the driver gives that back, where freed arrays of this size stay its own."""
    return np.frombuffer(pa.allocate_buffer(BUCKETS * RANK * 4), np.float32).reshape(BUCKETS, RANK)


def add_products(sums: np.ndarray, own: np.ndarray, bucket: np.ndarray, begin: np.ndarray, of: np.ndarray) -> None:
    """Adds to the row of each word's bucket the sum of the rows of `own` over the words of its passage."""
    seen = np.zeros((len(begin), RANK), np.float32)
    size = np.diff(begin, append=len(bucket))
    # by falling length, so that each turn adds to the first rows in place
    order = np.argsort(-size, kind="stable")
    at, size = begin[order], size[order]
    turn = np.empty_like(seen)
    for i in range(int(size[0])):
        n = int(np.searchsorted(-size, -i))
        seen[:n] += np.take(own, bucket[at[:n] + i], axis=0, out=turn[:n], mode="clip")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    order = np.argsort(bucket)
    bucket, of = bucket[order], place[of[order]]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    count = np.diff(first, append=len(bucket))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    often = int(np.searchsorted(-count, -SELDOM))
    total = np.take(seen, of[first], axis=0)
    for k in range(often):
        total[k] = seen[of[first[k] : first[k] + count[k]]].sum(axis=0)
    seldom, turn = total[often:], np.empty_like(total[often:])
    for i in range(1, int(count[often]) if often < len(count) else 0):
        n = int(np.searchsorted(-count[often:], -i))
        seldom[:n] += np.take(seen, of[first[often : often + n] + i], axis=0, out=turn[:n], mode="clip")
    sums[bucket[first]] += total


def multiplied(words: DataFrame, scale: float, shared, weight: np.ndarray) -> DataFrame:
    """(part, at, sums): the TF-IDF passages of all rows of `kept_words` times the present basis, and back, summed by task.

    A row has the buckets of its part that occur, 32 bits each, and their RANK sums, in single precision.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared else np.random.default_rng(5).standard_normal((BUCKETS, RANK), np.float32)
        own = own * weight[:, None]
        sums = np.zeros((BUCKETS, RANK), np.float32)
        for batch in batches:
            held, size = [], 0
            for i, row in enumerate(batch.column("words"), 1):
                held.append(np.frombuffer(row.as_buffer(), "<i4"))
                size += len(held[-1])
                if size >= FITTED or i == batch.num_rows:
                    marked = np.concatenate(held)
                    of = np.cumsum(marked >= BEGINS) - 1
                    add_products(sums, own, marked & (BUCKETS - 1), np.flatnonzero(marked >= BEGINS), of)
                    held, size = [], 0
        del own
        some = sums.any(axis=1)
        for low in range(0, BUCKETS, SUMMED):
            at = low + np.flatnonzero(some[low : low + SUMMED])
            if len(at):
                matrix = (sums[at] * weight[at, None] * scale).astype("<f4")
                row = [pa.array([low // SUMMED], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<i4"), matrix))]
                yield pa.RecordBatch.from_arrays(row, ["part", "at", "sums"])

    return words.mapInArrow(multiply, "part int, at binary, sums binary")


def products(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the rows of a part and the sums of their products."""
    at = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("at")]
    bucket, place = np.unique(np.concatenate(at), return_inverse=True)
    total, low = np.zeros((len(bucket), RANK)), 0
    for some, x in zip(at, rows.column("sums"), strict=True):
        total[place[low : low + len(some)]] += np.frombuffer(x.as_buffer(), "<f4").reshape(-1, RANK)
        low += len(some)
    return bucket, total.astype("<f4")


def latent_space(docs: DataFrame, items: DataFrame, weight: np.ndarray, n_passages: int, text: str = "text", words: DataFrame | None = None) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages, by randomised subspace iteration; buckets x RANK.

    The passages are the items' sections and all passages of all texts, which together weigh as much as
    CORPUS passages at most. Each task multiplies its passages with the present basis and back; the
    products of a bucket are summed before and after the shuffle, and the driver orthogonalises a matrix
    of BUCKETS x RANK numbers. A core has one task, so that the sums do not grow with the input; they move
    in rows of SUMMED buckets, four bytes a number, and a group holds one such row of each task. `words`
    are those of the texts, if they are stored already.
    """
    spark = docs.sparkSession
    words = words_and_frequencies(docs, text)[0] if words is None else words
    words = words.coalesce(spark.sparkContext.defaultParallelism)

    def add(rows: pa.Table) -> pa.Table:
        part, (bucket, total) = rows.column("part")[:1], products(rows)
        return pa.table([part, *(pa.array([x.tobytes()], pa.binary()) for x in (bucket.astype("<i4"), total))], ["part", "at", "sums"])

    basis = None  # the first one is random; each task draws it from the seed
    for _ in range(2):
        shared = None if basis is None else spark.sparkContext.broadcast(basis)  # BUCKETS x RANK numbers
        corpus = multiplied(words, min(1.0, CORPUS / max(n_passages, 1)), shared, weight)
        asked = multiplied(item_words(items), ITEM_WEIGHT**2, shared, weight)
        total = corpus.unionByName(asked).groupBy("part").applyInArrow(add, "part int, at binary, sums binary").toArrow()
        if shared:
            shared.destroy()
        product = matrix()
        product[:] = 0
        for at, sums in zip(total.column("at"), total.column("sums"), strict=True):
            product[np.frombuffer(at.as_buffer(), "<i4")] = np.frombuffer(sums.as_buffer(), "<f4").reshape(-1, RANK)
        del total
        basis = orthogonal(product, matrix())
        del product
        pa.default_memory_pool().release_unused()
    return basis


def orthogonal(product: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """In `out`, an orthonormal basis of the columns' span, from their RANK x RANK inner products; null columns where it has fewer."""
    gram = np.zeros((product.shape[1],) * 2)
    for low in range(0, len(product), 4096):  # a block of rows at a time in double precision
        block = product[low : low + 4096].astype(np.float64)
        gram += block.T @ block
    value, vector = np.linalg.eigh(gram)
    some = value > value[-1] * 1e-10
    scale = np.where(some, 1 / np.sqrt(np.where(some, value, 1)), 0)
    return np.matmul(product, (vector * scale).astype(np.float32), out=out)


def sections(n: int) -> np.ndarray:
    """Where the sections of an item of `n` words begin, and its end."""
    return np.linspace(0, n, max(1, -(-n // SECTION)) + 1).astype(np.int64)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in one integer."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if match := where.get(w):
            both = row & match
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Space:
    """The latent space: what each bucket adds to a passage."""

    basis: np.ndarray  # buckets x rank, each row times its idf

    @staticmethod
    def of(basis: np.ndarray, weight: np.ndarray) -> Space:
        return Space(np.multiply(basis, weight[:, None], out=matrix()))

    def chunks(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vector of each chunk, its text, its place there, chunk of each word); GAP empty ones after each text."""
        n = -(-np.diff(run.first) // CHUNK)
        first = np.r_[0, np.cumsum(n + GAP)]
        of_text = np.repeat(np.arange(len(n)), n + GAP)
        place = np.arange(first[-1]) - first[of_text]
        text = run.text_of_words()
        chunk = first[text] + (np.arange(len(text)) - run.first[text]) // CHUNK
        vectors = np.zeros((first[-1], RANK), np.float32)
        for i in range(0, len(chunk), PROJECTION):
            of = chunk[i : i + PROJECTION]
            begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            vectors[of[begin]] += np.add.reduceat(self.basis[run.bucket[i : i + PROJECTION]], begin, axis=0)
        return vectors, of_text, np.where(place < n[of_text], place, -1), chunk


@dataclass(frozen=True)
class Items:
    """A block of benchmark items."""

    ids: list[int | None]
    words: list[list[str]]
    answers: list[list[str]]
    vectors: np.ndarray  # of each section
    section: np.ndarray  # the first one of each item, and one beyond the last
    reach: np.ndarray  # chunks on either side of a passage in which the rest of the item may stand
    telling: np.ndarray  # buckets of answer words, ascending
    owner: np.ndarray  # the item of each of them
    bit: np.ndarray  # its place among the item's answer words

    @staticmethod
    def of(space: Space, weight: np.ndarray, ids: list, texts: list[str | None]) -> Items:
        words, answers, vectors, told = [], [], [], []
        for k, t in enumerate(texts):
            found = WORD.findall((t or "").lower())
            at = words_at(plain(t))[2]
            bucket = dict(zip(found, at.tolist(), strict=True))
            words.append(found)
            rare = sorted(bucket, key=lambda w: (-weight[bucket[w]], w))
            answers.append(rare[:ANSWER])
            told += [(bucket[w], k, 1 << i) for i, w in enumerate(rare[:ANSWER])]
            v = np.add.reduceat(space.basis[at], sections(len(at))[:-1], axis=0)
            vectors.append(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))
        section = np.r_[0, np.cumsum([len(v) for v in vectors])].astype(np.int64)
        reach = np.array([max(REACH, -(-len(w) // CHUNK)) for w in words], np.int64)
        telling, owner, bit = np.array(sorted(told), np.int64).reshape(-1, 3).T
        return Items(ids, words, answers, np.concatenate(vectors or [np.empty((0, RANK), np.float32)]), section, reach, telling, owner, bit.astype(np.uint8))

    def answered(self, run: Run, chunk: np.ndarray, n: int) -> np.ndarray:
        """n x items: the answer words, as bits, that each chunk may hold by their buckets."""
        bits = np.zeros((n, len(self.ids)), np.uint8)
        told = np.bincount(self.telling, minlength=BUCKETS)
        at = np.flatnonzero((told > 0)[run.bucket])
        count, low = told[run.bucket[at]], (np.cumsum(told) - told)[run.bucket[at]]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        np.bitwise_or.at(bits, (np.repeat(chunk[at], count), self.owner[entry]), self.bit[entry])
        return bits

    def nearby(self, bits: np.ndarray, few: np.ndarray, some: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
        """The answer words of a few items, as bits, in each passage and the item's reach on either side within the text."""
        reach = self.reach[few]
        most = int(reach.max())
        low = max(0, int(some[0]) - most)
        part = bits[low : int(some[-1]) + size + most, few]
        near = part[some - low]
        for i in range(-most, size + most):
            at, far = np.clip(some + i, first, last) - low, max(-i, i - size + 1)
            if far <= REACH:
                near |= part[at]
            else:
                wide = np.flatnonzero(reach >= far)
                near[:, wide] |= part[at[:, None], wide]
        return near

    def cosines(self, passages: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of each pair of a passage and an item the highest cosine with a section of the item."""
        best = np.empty(len(p), np.float32)
        for low in range(0, len(p), PROJECTION):
            some = slice(low, low + PROJECTION)
            n = np.diff(self.section)[k[some]]
            begin = np.cumsum(n) - n
            of = np.repeat(self.section[k[some]] - begin, n) + np.arange(n.sum())
            best[some] = np.maximum.reduceat(np.einsum("ij,ij->i", passages[np.repeat(p[some], n)], self.vectors[of]), begin)
        return best

    def search(self, run: Run, vectors: np.ndarray, of_text: np.ndarray, place: np.ndarray, chunk: np.ndarray) -> dict[int, list[tuple[int, float, float]]]:
        """(item number, overlap, highest cosine) of the items that each text of the run holds.

        The answer words of a candidate are first counted by bucket, all candidates at once: a
        collision lets one through to the exact count, none is lost. A neighbourhood within one that
        was compared before can hold no more of the item.
        """
        found: dict[tuple[int, int], tuple[float, float]] = {}
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if not self.ids or not len(run.bucket):
            return {}
        n = len(vectors)
        bits = self.answered(run, chunk, n)
        least = np.array([ANSWERED * len(a) for a in self.answers])
        length = np.bincount(of_text, place >= 0).astype(np.int64)
        most = int(self.reach.max())
        for size in reversed(PASSAGES):
            starts = np.flatnonzero((place >= 0) & (place <= np.maximum(0, length[of_text] - size)))
            for low in range(0, len(starts), STARTS):
                some = starts[low : low + STARTS]
                all_near = np.bitwise_or.reduce(bits[max(0, some[0] - most) : some[-1] + size + most], axis=0)
                few = np.flatnonzero(np.bitwise_count(all_near) >= least)
                if not len(few):
                    continue
                first = some - place[some]
                near = self.nearby(bits, few, some, first, first + length[of_text[some]] - 1, size)
                p, k = np.nonzero(np.bitwise_count(near) >= least[few])
                k = few[k]
                passage = sum(vectors[some + i] for i in range(size))
                passage /= np.maximum(np.linalg.norm(passage, axis=1, keepdims=True), 1e-9)
                cosine = self.cosines(passage, p, k)
                close = np.flatnonzero(cosine >= COSINE)
                for p, k, c in zip(p[close].tolist(), k[close].tolist(), cosine[close].tolist(), strict=True):
                    text = int(of_text[some[p]])
                    begin, end = int(run.first[text]), int(run.first[text + 1])
                    at, reach = begin + int(place[some[p]]) * CHUNK, int(self.reach[k])
                    from_, to = max(begin, at - reach * CHUNK), min(end, at + (size + reach) * CHUNK)
                    best = found.get((text, k), (0.0, 0.0))
                    before = seen.setdefault((text, k), [])
                    known = best[0] == 1.0 or any(a <= from_ and to <= b for a, b in before)
                    overlap = 0.0 if known else self.overlap(k, run.words(from_, to))
                    if not known:
                        before.append((from_, to))
                    if max(best[0], overlap) > 0:
                        found[text, k] = max(best[0], overlap), max(best[1], c)
        by_text: dict[int, list[tuple[int, float, float]]] = {}
        for (text, k), (overlap, cosine) in sorted(found.items()):
            by_text.setdefault(text, []).append((k, overlap, cosine))
        return by_text

    def overlap(self, k: int, near: list[str]) -> float:
        """Share of the item's words that stand in order near a passage; 0 if too few or not its answer."""
        item, there = self.words[k], set(near)
        if sum(w in there for w in self.answers[k]) < ANSWERED * len(self.answers[k]):
            return 0.0
        if sum(w in there for w in item) < OVERLAP * len(item):
            return 0.0
        share = common_subsequence(item, near) / len(item)
        return share if share >= OVERLAP else 0.0


LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("cosine", T.DoubleType())])
)


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns with `leaks`, the benchmark items that the text holds.

    Terms are hashed words; their document frequencies and the latent space come from all documents. Passages of 16, 32 and
    64 words, a new one every 16 words over the whole text, are projected into the latent space and
    compared with the items there, those of more than 64 words by sections. Where the cosine reaches
    0.2, at least 0.6 of the item's words must stand in the item's order in the passage and on either
    side of it as many words as the item has, 32 at least, and half of the five words that tell the
    item from others.

    Items are a stated query set; they go to the tasks in one broadcast and are searched in blocks of 2,000. Items without words
    are never found. A null or empty text holds none. Repeated rows and items are each searched; of an
    item with several passages the best counts. A column named leaks is replaced. No rows give no rows.
    """
    docs = docs.drop("leaks")
    words, frequency, total, n_passages = words_and_frequencies(docs, text)
    weight = idf(frequency, total)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"\w"))
    basis = latent_space(docs, items, weight, n_passages, text, words)
    numbered = written(items.orderBy("item_id", "text").withColumn("_n", F.monotonically_increasing_id()), "items")
    listed = numbered.orderBy("_n").toArrow()
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", LEAKS)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64()), ("cosine", pa.float64())]))
    space, parts = Space.of(basis, weight), []
    del basis
    pa.default_memory_pool().release_unused()
    for start in range(0, listed.num_rows, ITEM_BLOCK):
        few = listed.slice(start, ITEM_BLOCK)
        parts.append(Items.of(space, weight, few.column("item_id").to_pylist(), few.column("text").to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast((space, parts))  # BUCKETS x RANK numbers and the items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, parts = shared.value
        for batch in batches:
            leaks: list[list[dict]] = []
            for run in runs(batch.column(text)):
                told: list[list[dict]] = [[] for _ in run.first[1:]]
                chunks = space.chunks(run)
                for own in parts:
                    for t, some in own.search(run, *chunks).items():
                        told[t] += [{"item_id": own.ids[k], "overlap": o, "cosine": c} for k, o, c in some]
                leaks += told
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, kind)], [*batch.schema.names, "leaks"])

    return docs.mapInArrow(search, schema)


def op9_decontamination(spark, sf_dir):
    found = with_leaks(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", F.round("l.overlap", 6).alias("overlap"), F.round("l.cosine", 4).alias("cosine"))
