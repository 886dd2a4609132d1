"""Document fingerprints: SimHash by counted votes, and a search within a Hamming radius.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.llm.common import documents, numbered, written

BITS = 64
LANES = 16  # sums; each holds the votes for four bits, 16 binary digits apart
EACH_16TH = 0x0001000100010001
PIECE = 16_384  # code points a text is cut at: the weights of 8,193 words must stay below 32,768, or the topmost digits overflow a long
MAX_WEIGHT = 3
RADIUS = 3
SPACE = r"[\x20\x09-\x0D]+"
PIECES = r"(?s)(.{1,%d}+[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+)(?=([^\x20\x09-\x0D]*+))" % PIECE


def pieces(text: str) -> Column:
    """An array of structs: a piece of the text, and in `after` the word that follows it, null at the end.

    After 16,384 code points a piece takes the rest of the word there or the next word, and the spaces behind it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    piece, after = (F.regexp_extract_all(whole, F.lit(PIECES), F.lit(i)) for i in (1, 2))
    cut = F.zip_with(piece, after, lambda p, a: F.struct(p.alias("piece"), F.nullif(a, F.lit("")).alias("after")))
    uncut = F.array(F.struct(whole.alias("piece"), F.lit(None).cast("string").alias("after")))
    return F.when(F.length(whole) > PIECE, cut).otherwise(uncut)


def term_hashes(text: str, after: Column | None = None) -> Column:
    """A long for each word with the word after it, the last word with `after` or alone; no words, no terms.

    Its low two bits are the term's weight: 3 where its words have 16 bytes or more, 2 from 8, else 1.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")

    def term(a: Column, b: Column) -> Column:
        b = b if after is None else F.coalesce(b, after)
        size = F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0))
        weight = F.least(F.lit(MAX_WEIGHT), 1 + F.shiftright(size, 3)).cast("long")
        return F.xxhash64(a, b).bitwiseAND(F.lit(~3)).bitwiseOR(weight)

    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), term)


def simhash(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """`key` and `fingerprint`, a long, of each row; `key` must be unique.

    The terms of a text are its pairs of neighbouring words. A term's hash votes for a bit where it has
    it and against it where not, with the term's weight every time it occurs; long words say more than
    short ones. A bit is set when the votes for it are the majority. Votes for four
    bits share one sum, 16 digits each; sums are taken over pieces of a text, at most 8,193 terms each,
    and then unpacked: even where all terms vote for the topmost bit, no sum overflows. A very long text
    is split into words piece by piece. A text without words has fingerprint 0.
    """
    cut = rows.select(*key, F.posexplode(pieces(text)).alias("_chunk", "_p")).select(*key, "_chunk", F.col("_p.piece").alias("_piece"), F.col("_p.after").alias("_after"))
    terms = cut.select(*key, "_chunk", F.explode_outer(term_hashes("_piece", F.col("_after"))).alias("_hash"))
    weight, hashed = F.col("_hash").bitwiseAND(F.lit(3)), F.xxhash64("_hash")
    votes = [
        F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(EACH_16TH)) * weight).alias(f"_s{i}") for i in range(LANES)
    ]
    parts = terms.groupBy(*key, "_chunk").agg(F.sum(weight).alias("_all"), *votes)
    counts = parts.groupBy(*key).agg(
        F.sum("_all").alias("_all"),
        *[F.sum(F.shiftrightunsigned(f"_s{b % LANES}", 16 * (b // LANES)).bitwiseAND(F.lit(0xFFFF))).alias(f"_c{b}") for b in range(BITS)],
    )
    # without words the sums are null and no bit is set
    bit = [F.when(2 * F.col(f"_c{b}") > F.col("_all"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    quarters = [sum(bit[i + 1 : i + 16], bit[i]) for i in range(0, BITS, 16)]  # distinct bits add up
    counts = counts.select(*key, *[q.alias(f"_q{i}") for i, q in enumerate(quarters)])
    return counts.select(*key, (F.col("_q0") + F.col("_q1") + F.col("_q2") + F.col("_q3")).alias("fingerprint"))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal bits."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _tables(radius: int) -> list[tuple[int, int]]:
    """(mask of a table's key, number): two of radius + 2 blocks, of which at least two hold no difference."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(radius + 2)]
    both = [a | b for a, b in combinations(masks, 2)]
    return [(m - (1 << 64) if m >> 63 else m, n) for n, m in enumerate(both)]


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (query, fingerprint, distance) of distinct fingerprints at most `radius` bits apart.

    Both inputs have a column `fingerprint`; repeated and null ones are dropped first. The bits are cut
    into radius + 2 blocks; each table keys the fingerprints by one pair of blocks. Two fingerprints
    within the radius agree on two blocks at least, so some table has both under one key: the search
    is exact. A pair comes from the first table that shows it.
    """
    tables = _tables(radius)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        keys = F.array(*[F.struct(F.lit(n).alias("_table"), F.col(name).bitwiseAND(F.lit(m)).alias("_key")) for m, n in tables])
        return distinct.select(name, F.explode(keys).alias("_k")).select(name, F.col("_k._table").alias("_table"), F.col("_k._key").alias("_key"))

    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(n)) for m, n in tables])
    left, right = keyed(queries, "query").alias("l"), keyed(fingerprints, "fingerprint").alias("r")
    on = (F.col("l._table") == F.col("r._table")) & (F.col("l._key") == F.col("r._key"))
    return left.join(right, on & (F.bit_count(differ) <= radius) & (first == F.col("l._table"))).select(
        "query", "fingerprint", F.bit_count(differ).alias("distance")
    )


def _ranked(docs: DataFrame) -> DataFrame:
    """Rows of `docs` numbered from 0 by doc_id, by partition totals; narrow rows, stored once."""
    ranged = written(docs.repartitionByRange("doc_id", "_uid").withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("doc_id").asc_nulls_first(), "_uid")
    return (
        ranged.withColumn("_in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")  # a row for each shuffle partition
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_part", "_in", "_before")
    )


def edited_texts(docs: DataFrame) -> DataFrame:
    """_uid, _next, doc_id, n_chars, text and the edited text of each row.

    The edited text lacks the last quarter of the code points, rounded down, and has the first as many
    of the next row's text instead, or all of them. Rows follow each other by doc_id, null first, equal
    ids in table order; the first row follows the last. Texts are shuffled once and their heads again:
    both joins read the same exchange, which holds the row's number and its text alone.
    """
    docs = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "numbered")
    texts = docs.select("_uid", "text")
    ranks = written(_ranked(docs.select("_uid", "doc_id", F.length("text").cast("long").alias("n_chars"))), "ranks")
    size = ranks.agg(F.max("_rank").alias("_last"))
    follows = ranks.select(
        F.col("_uid").alias("_before"), F.floor(F.col("n_chars") / 4).cast("int").alias("_gives"), (F.col("_rank") + 1).alias("_to")
    ).join(F.broadcast(size))  # one row
    follows = follows.withColumn("_to", F.when(F.col("_to") > F.col("_last"), F.lit(0).cast("long")).otherwise(F.col("_to")))
    # for each row: the row before it, and how much of this row's text that one gets
    places = written(ranks.join(follows, F.col("_rank") == F.col("_to")).select("_uid", "doc_id", "n_chars", "_before", "_gives"), "places")
    placed = texts.join(places, "_uid")
    heads = placed.select(F.col("_before").alias("_uid"), F.col("_uid").alias("_next"), F.expr("left(text, _gives)").alias("_head"))
    kept = F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))")
    return placed.join(heads, "_uid").select("_uid", "_next", "doc_id", "n_chars", "text", F.concat(kept, "_head").alias("edited"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """A row per row of `docs` with the fingerprints of its text and of its edited text.

    near_edited and near_next are the shares of equal bits with the edited text's and the next row's
    fingerprint. n_near counts the other distinct fingerprints within `radius` bits, for the rows whose
    doc_id is divisible by `every`; it is null for the others. Equal texts have equal fingerprints. A
    null text is an empty one; empty texts have fingerprint 0. Repeated rows and ids each get a row;
    other columns are dropped. No rows give no rows.
    """
    # the digest first, then the texts: what later stages need of a row fits into a few numbers
    pairs = edited_texts(docs).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    both = pairs.select(
        "_uid",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("body"), F.lit(None).cast("string").alias("sha"), F.col("_next").alias("next"), F.col("doc_id").alias("id"), F.col("n_chars").alias("n")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"), F.col("edited_sha256").alias("sha"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n")),
            )
        ).alias("t"),
    ).select("_uid", "t.*")
    prints = written(simhash(both, ["_uid", "which", "sha", "next", "id", "n"], "body"), "fingerprints")
    own = prints.where("which = 0").select("_uid", F.col("next").alias("_next"), F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), "fingerprint")
    edited = prints.where("which = 1").select("_uid", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("_uid").alias("_next"), F.col("fingerprint").alias("_after"))
    asked = own.where(F.pmod("doc_id", F.lit(every)) == 0)
    near = within_radius(asked, own, radius).groupBy("query").agg(F.sum((F.col("distance") > 0).cast("long")).alias("_near"))
    counted = asked.join(near, F.col("fingerprint") == F.col("query")).select("_uid", F.col("_near").alias("n_near"))
    return (
        own.join(edited, "_uid")
        .join(after, "_next")
        .join(counted, "_uid", "left")
        .withColumns({"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "_after")})
        .drop("_uid", "_next", "_after")
    )


def op10_simhash(spark, sf_dir):
    found = fingerprint_documents(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited_fingerprint")), 16, "0").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
    )
