"""SentencePiece encoding and decoding: a lattice over the distinct words of the corpus.

A word is a run of blanks and what follows it up to the next blank; no piece goes beyond that, so words
are encoded on their own. Each block of texts names its distinct words once, and equal words of all blocks
meet in one task. There the distinct ones are cut into substrings of bounded length, these meet the piece
table in an equi-join, and Viterbi's recursion runs as a fold over the places of all words together. What
comes back to the blocks that have the word is a bit for each place where a piece of its path ends; a second
scan takes the same words from the texts again and replaces them by ids. Texts never move, and words move once.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import BLOCKS_PER_PARTITION, block_folders, blocks, documents, shielded, side_rows, store_side

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
WORD = re.compile(r" +[^ ]*")
WORD_END = re.compile(r"[^ ] ")
STRETCH = 1 << 16  # code points split at once
LONGEST = 64  # code points of a word in the table; longer ones are folded where they stand
BLOCK = 6 << 20  # bytes of text whose words and paths a task holds together
END = "\0"  # between the words of a lane
LANES = 1 << 10  # that the words of a block are dealt into
TOGETHER = 1 << 10  # input partitions whose words meet
MEET = 1 << 20  # bytes of words, compressed and in whole lanes, that a task compares at once
CHARACTERS = 1 << 18  # code points of the words whose substrings a task holds together
UNKNOWN = 0
PENALTY = 10.0  # what an unknown character costs beyond the worst piece


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; bytes stand for characters that no piece has."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]  # neither control, unknown nor byte
    byte_ids: tuple[int, ...]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in n)
        plain = tuple(not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in n)
        return Vocabulary(pieces, tuple(model.get_score(i) for i in n), plain, tuple(pieces.index(f"<0x{b:02X}>") for b in range(256)))

    @cached_property
    def known(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, ok) in enumerate(zip(self.pieces, self.scores, self.plain, strict=True)) if ok}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.known))

    @cached_property
    def unknown_score(self) -> float:
        return min(s for _, s in self.known.values()) - PENALTY

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        done = [p.replace(BLANK, " ").encode() if ok else b"" for p, ok in zip(self.pieces, self.plain, strict=True)]
        for b, i in enumerate(self.byte_ids):
            done[i] = bytes([b])
        return done

    @cached_property
    def packed(self) -> dict[str, bytes]:
        """The bytes of each piece's id."""
        return {p: i.to_bytes(4, "little") for p, (i, _) in self.known.items()}

    def lattice_text(self, word: str) -> str:
        """The word as pieces spell it; a literal blank mark becomes a character that no piece has."""
        return word.replace(BLANK, "￿").replace(" ", BLANK)

    def spelled(self, word: str, path: list[tuple[int, int]]) -> list[int]:
        """Ids of a path of (start, id), bytes for unknown characters."""
        ids: list[int] = []
        for start, i in path:
            ids += [i] if i != UNKNOWN else [self.byte_ids[b] for b in word[start].encode("utf-8", "surrogatepass")]
        return ids

    def joined(self, word: str, ends: int) -> bytes:
        """The bytes of the ids of a word whose pieces end at the bits of `ends` and at its end."""
        text, packed, start, ids = self.lattice_text(word), self.packed, 0, b""
        while start < len(text):
            low = ends & -ends
            end = low.bit_length() - 1 if low else len(text)
            own = packed.get(text[start:end])
            ids += b"".join(self.byte_ids[b].to_bytes(4, "little") for b in word[start].encode("utf-8", "surrogatepass")) if own is None else own
            ends, start = ends ^ low, end
        return ids

    def best_path(self, word: str) -> list[tuple[int, int]]:
        """(start, id) of the best path through one word; of equal ones that with the longest last piece."""
        text, known, reach = self.lattice_text(word), self.known, self.longest
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(text) + 1):
            top = None
            for start in range(max(0, end - reach), end):
                piece = known.get(text[start:end])
                if piece is None and end - start == 1:
                    piece = UNKNOWN, self.unknown_score
                if piece and (top is None or best[start][0] + piece[1] > top[0]):
                    top = best[start][0] + piece[1], start, piece[0]
            best.append(top)
        path, at = [], len(text)
        while at:
            path.append((best[at][1], best[at][2]))
            at = best[at][1]
        return path[::-1]


def stretches(text: str | None) -> Iterator[str]:
    """The text with the blank that the encoding puts before it, in parts that end with a word."""
    if not text:
        return
    text, at = " " + text, 0
    while cut := WORD_END.search(text, at + STRETCH):
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def words_in(stretch: str) -> list[str]:
    """The words of a stretch, each without its first blank."""
    if "  " in stretch or stretch[-1] == " ":
        return [w[1:] for w in WORD.findall(stretch)]
    return stretch[1:].split(" ")


def words_of(text: str | None) -> list[str]:
    """Words of a text with the blanks before them; none for an empty text."""
    return [" " + w for part in stretches(text) for w in words_in(part)]


class Paths(dict):
    """Word, without its first blank, to the bytes of its ids; words that the table lacks are folded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        own, word = self.vocabulary, " " + word
        return np.array(own.spelled(word, own.best_path(word)), "<i4").tobytes()


def in_table(word: str) -> bool:
    """Whether the lattice of rows has the word, given without its first blank; others are folded where they stand."""
    return len(word) < LONGEST and END not in word


def dealt(texts: pa.ChunkedArray) -> dict[int, list[str]]:
    """The distinct words of the texts that are in the table, without their first blank, by lane and in order."""
    seen: set[str] = set()
    for t in texts:
        for part in stretches(t.as_py()):
            seen.update(words_in(part))
    lanes: dict[int, list[str]] = defaultdict(list)
    for w in sorted(filter(in_table, seen)):
        lanes[xxhash.xxh3_64_intdigest(w) % LANES].append(w)
    return lanes


def viterbi(words: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """For each word of at most 64 code points the bits of the places, from 1, where a piece of its best path ends.

    The end of the word is left out. Words of like length are taken together.
    """
    texts = pc.replace_substring(pc.replace_substring(words, BLANK, "￿"), " ", BLANK)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    part = np.cumsum(sizes[order]) // CHARACTERS
    done = np.zeros(len(words), np.uint64)
    for few in np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1):
        if len(few):
            done[few] = follow(texts.take(pa.array(few)), sizes[few], vocabulary)
    return done


def follow(texts: pa.Array, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The bits that `viterbi` gives, for words as pieces spell them, the longest first."""
    most, n = int(sizes[0]), len(texts)
    live = np.searchsorted(-sizes, -np.arange(most + 1), "right").tolist()  # words that reach a place
    spans = [(start, end) for end in range(1, most + 1) for start in range(max(0, end - vocabulary.longest), end)]
    cut = pa.chunked_array([pc.utf8_slice_codeunits(texts.slice(0, live[end]), start, end) for start, end in spans])
    # the equi-join of substrings and pieces; what no piece equals is no edge, unless it is one character
    table = pa.array(list(vocabulary.known))
    scores = np.array([s for _, s in vocabulary.known.values()] + [-np.inf])
    edges = pc.fill_null(pc.index_in(cut, table), len(table)).to_numpy()
    best, came = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int64)
    first = 0
    for start, end in spans:
        score = scores[edges[first : first + live[end]]]
        first += live[end]
        if end - start == 1:
            score[np.isinf(score)] = vocabulary.unknown_score
        score += best[start, : live[end]]
        top, origin = best[end, : live[end]], came[end, : live[end]]
        # edges come by start: a later, shorter piece must be better, not as good
        taken = score > top if start > max(0, end - vocabulary.longest) else np.ones(live[end], bool)
        np.copyto(top, score, where=taken)
        origin[taken] = start
    ends, at, every = np.zeros(n, np.uint64), sizes, np.arange(n)
    while (at := came[at, every]).any():
        ends |= np.where(at > 0, np.uint64(1) << at.astype(np.uint64), np.uint64(0))
    return ends


def narrow(bits: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as the largest needs."""
    return bits.astype(next(f"<u{n}" for n in (2, 4, 8) if int(bits.max()) < 1 << 8 * n))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", decoded: str | None = None) -> DataFrame:
    """All rows and columns with `ids`, the best pieces of the whole text.

    With the name `decoded`, also what `decode` makes of the ids, in the same pass.

    The path has the greatest sum of scores; of equal ones that whose pieces are longer from the end.
    Characters without a piece become their bytes. A blank goes before the text, and blanks are kept as
    they are, so decoding returns the text. A null or empty text has no ids. Repeated rows are encoded
    alike, a word that many texts share once per 1,024 input partitions. A word of more than 64 code
    points or with a null character is folded where it stands, in a time that grows with its length. A
    column named ids is replaced. No rows give no rows. Blocks are numbered once, in a stored copy with a
    folder per block: a scan may see a block in parts, but its words are those of the whole folder, in the
    same order each time.
    """
    spark = docs.sparkSession
    docs, own_names = shielded(docs.drop("ids", *filter(None, [decoded])), "_block")
    fields = docs.schema.fields
    docs, folders = block_folders(docs, text, "numbered", BLOCK)
    shared = spark.sparkContext.broadcast(vocabulary)

    def words_by_lane(block: int) -> dict[int, list[str]]:
        return dealt(side_rows(folders, block, "_block", [text]).column(text))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("_block").to_pylist():
                first = block // (BLOCKS_PER_PARTITION * TOGETHER) * LANES
                for few in batched(words_by_lane(block).items(), 1_000):
                    numbers = pa.array([first + lane for lane, _ in few], pa.int64())
                    joined = pa.array([zlib.compress(END.join(words).encode(), 1) for _, words in few], pa.binary())
                    yield pa.RecordBatch.from_arrays([numbers, pa.array([block] * len(few), pa.int64()), joined], ["lane", "block", "words"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the bits of their words in place of the words; equal words of the batches held are folded once."""
        own = shared.value

        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = pc.split_pattern(pa.array([zlib.decompress(w.as_buffer()) for w in rows.column("words")], pa.binary()).cast(pa.string()), END)
            every = pc.binary_join_element_wise("", lists.flatten(), " ").dictionary_encode()
            bits = viterbi(every.dictionary, own)[every.indices.to_numpy()]
            packed = pa.array([narrow(bits[a:b]).tobytes() for a, b in pairwise(lists.offsets.to_pylist())], pa.binary())
            for few in rows.drop_columns("words").append_column("ends", packed).to_batches(max_chunksize=1_000):
                yield few

        held, size, last = [], 0, None
        for batch in batches:
            lanes = batch.column("lane").to_numpy()
            edges = np.flatnonzero(np.r_[True, lanes[1:] != lanes[:-1], True]) if len(lanes) else []
            for a, b in pairwise(edges):
                if size > MEET and lanes[a] != last:
                    yield from found(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + int(pc.sum(pc.binary_length(held[-1].column("words"))).as_py()), lanes[a]
        if held:
            yield from found(held)

    # a fixed count: what a lane holds is far less than the substrings that come from it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select("_block").distinct().repartition(parts).mapInArrow(deal, "lane long, block long, words binary")
    lanes = named.repartition(parts, "lane").sortWithinPartitions("lane")
    side = store_side(lanes.mapInArrow(meet, "lane long, block long, ends binary"), "pieces")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block, rows in blocks(batches):
            table, found = Paths(own), side_rows(side, block)
            words = words_by_lane(block) if found is not None else {}
            for batch in found.to_batches(max_chunksize=500) if found is not None else ():
                for lane, ends in zip(batch.column("lane").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                    few = words.pop(lane % LANES)
                    for w, e in zip(few, np.frombuffer(ends, f"<u{len(ends) // len(few)}").tolist(), strict=True):
                        table[w] = own.joined(" " + w, e)
            del found, words
            for few in rows.to_batches(max_chunksize=500):
                parts, sizes = [], [0]
                for t in few.column(text):
                    ids = b"".join([b"".join(map(table.__getitem__, words_in(part))) for part in stretches(t.as_py())])
                    parts.append(ids)
                    sizes.append(sizes[-1] + len(ids) // 4)
                values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [*few.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], [*few.schema.names, "ids"]
                )

    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded is None:
        return docs.mapInArrow(replace, schema).withColumnsRenamed(own_names)
    spelt = docs.mapInArrow(lambda batches: spell(replace(batches), shared.value, "ids", decoded), schema.add(decoded, T.StringType()))
    return spelt.withColumnsRenamed(own_names)


def spell(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, ids: str, name: str) -> Iterator[pa.RecordBatch]:
    """The batches with the texts of their ids."""
    pieces = pa.array(vocabulary.bytes_of, pa.large_binary())
    for batch in batches:
        for few in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            texts = []
            for row in few.column(ids):
                # one buffer holds what the ids stand for, end to end
                told = pieces.take(row.values) if row.is_valid and len(row.values) else None
                whole = b"" if told is None else told.buffers()[2].to_pybytes()
                texts.append(whole.decode("utf-8", "replace").removeprefix(" ") if row.is_valid else None)
            yield pa.RecordBatch.from_arrays([*few.columns, pa.array(texts, pa.string())], [*few.schema.names, name])


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All rows and columns with the text of `ids`; null for null ids.

    The blank that encoding put before the text is taken off. Ids outside the vocabulary raise; bytes
    that are no UTF-8 become replacement characters. A column of that name is replaced.
    """
    keep = tokens.drop(name)
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    return keep.mapInArrow(lambda batches: spell(batches, shared.value, ids, name), T.StructType([*keep.schema.fields, T.StructField(name, T.StringType())]))


def op2_pieces(spark, sf_dir):
    vocabulary = Vocabulary.load()
    done = encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary, decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
