"""PII: personal data by pattern, and terms that reveal it by their co-occurrence in the corpus.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.llm.common import documents, numbered, shielded, written

# The patterns of the base kinds. A match begins where no run of its first class goes on,
# or where the last one ended, and repeated groups are possessive: the spans are those of a plain
# leftmost search, in linear time and without recursion on long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}{4,}"
SUPPORT = 3  # different texts that must show a term and an entity
DISCLOSURE = 0.5  # of the documents with a term, the share with the entity from which it reveals it
LANES = 16  # over which the rows of a term or an entity are spread in a join
COMMON = 10_000  # terms of most documents that are broadcast; any other is in few rows


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass Luhn's check."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    total = F.aggregate(
        F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        size = F.length(_digits(found))
        return size.between(14, 19) & F.when(size.between(14, 19), _luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str) -> Column:
    """(found, start, end) of each match: what lies between matches adds up to their places.

    The running total goes along an array of lengths, so the work is linear but for the copies of a
    short array of numbers.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.aggregate(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNull(), a["all"])
            .otherwise(F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end")))))
            .alias("all"),
        ),
        lambda a: a["all"],
    )
    return F.zip_with(found, start, lambda m, s: F.struct(m.alias("found"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))


def base_spans(text: Column) -> Column:
    """array of (start, order, kind, end, found) by start, then kind as listed; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    # a text without the one symbol that a kind needs is not searched for it
    needs = {"email": text.contains("@"), "ip": text.contains("."), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,found:string>>")

    def of(order: int, kind: str) -> Column:
        placed = F.filter(_placed(text, PATTERNS[kind]), lambda s: _valid(kind, s["found"]))
        rows = F.transform(
            placed,
            lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["found"].alias("found")),
        )
        return F.when(needs[kind], rows).otherwise(empty)

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def _terms(text: Column) -> Column:
    """The different terms of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _marks(text: Column, terms: Column) -> Column:
    """Spans of all occurrences of the listed terms; the array grows by a copy for each of these only."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    words = F.zip_with(
        F.split(text, TERM, -1),
        found,
        lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), F.coalesce(F.array_contains(terms, F.lower(m)), F.lit(False)).alias("hit")),
    )

    def span(a: Column, x: Column) -> Column:
        start = (a["at"] + x["gap"]).cast("bigint")
        return F.struct(start.alias("start"), F.lit(len(KINDS)).alias("order"), F.lit("term").alias("kind"), (start + x["size"]).alias("end"))

    return F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>").alias("all")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.when(x["hit"], F.concat(a["all"], F.array(span(a, x)))).otherwise(a["all"]).alias("all")),
        lambda a: a["all"],
    )


def _spread(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join with one row per key, the rows of a key dealt to LANES tasks by their _uid."""
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64("_uid"), F.lit(LANES)).cast("int"))
    return laned.join(values.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))), [key, "_lane"]).drop("_lane")


def find_pii(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """All rows and columns with `spans`: (start, order, kind, end) by start, then kind.

    Kinds are email, ip, card, phone, and term. A protected entity is a found value. A term (a word of
    four letters or more, lower case) reveals an entity if both stand in `support` different texts or
    more, and the documents with both are at least the share `disclosure` of all documents with the
    term, wherever in the text they stand. That share is p(entity | term), so the test bounds the
    pointwise mutual information of term and entity against the entity's own information. Such a term
    is marked wherever it occurs, in all texts, unless a base span overlaps it; base spans stay.

    A null text is an empty one and has no spans. Repeated rows have the same spans; they count as
    documents but not as different texts. A column named spans is replaced. Every count covers all
    rows. No rows give no rows. Rows are numbered once, in a stored copy.
    """
    docs, own = shielded(docs.drop("spans"), "_uid", "_spans", "_terms", "_marks")
    docs = numbered(docs, "numbered")
    # the first scan leaves only texts with entities
    scanned = docs.where(F.col("text").rlike("[0-9@]")).select("_uid", "text", base_spans(F.col("text")).alias("_spans"))
    hits = written(scanned.where(F.size("_spans") > 0), "entities")
    held = written(docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_held")), "held")
    common = F.broadcast(held.orderBy(F.desc("_held"), "term").limit(COMMON))
    # each different text once, with the number of its documents
    once = hits.groupBy(F.xxhash64("text", F.length("text")).alias("_text")).agg(F.min("_uid").alias("_uid"), F.count(F.lit(1)).alias("_docs"))
    texts = hits.join(once.drop("_text"), "_uid")
    entities = F.array_distinct(F.transform("_spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["found"]))))
    shown = written(texts.select("_uid", "_docs", F.explode(entities).alias("_entity")), "shown")
    # an entity in fewer texts has no term in enough of them, and no term in too many documents can reveal it
    often = shown.groupBy("_entity").agg(F.sum("_docs").alias("_most"), F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") >= support)
    pairs = written(_spread(shown, written(often.drop("_texts"), "often"), "_entity"), "pairs")
    bound = pairs.groupBy("_uid").agg(F.max("_most").alias("_bound"))
    words = texts.join(bound, "_uid").select("_uid", "_bound", F.explode(_terms(F.col("text"))).alias("term"))
    counted = words.join(common, "term").unionByName(words.join(common, "term", "left_anti").join(held, "term"))
    seldom = counted.where(F.col("_bound") >= disclosure * F.col("_held")).select("_uid", "term", "_held")
    reveals = (
        seldom.join(pairs, "_uid").where(F.col("_most") >= disclosure * F.col("_held"))
        .groupBy("_entity", "term").agg(F.sum("_docs").alias("_joint"), F.count(F.lit(1)).alias("_texts"), F.max("_held").alias("_held"))
        .where((F.col("_texts") >= support) & (F.col("_joint") >= disclosure * F.col("_held")))
        .select("term").distinct()
    )
    present = docs.select("_uid", F.explode(_terms(F.col("text"))).alias("term"))
    told = _spread(present, written(reveals, "reveals"), "term").groupBy("_uid").agg(F.collect_set("term").alias("_terms"))
    spans = hits.select("_uid", F.transform("_spans", lambda s: F.struct(s["start"], s["order"], s["kind"], s["end"])).alias("_spans"))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    both = docs.join(spans, "_uid", "left").join(told, "_uid", "left").withColumn("_spans", F.coalesce("_spans", none))
    marked = both.withColumn("_marks", F.when(F.col("_terms").isNotNull(), _marks(F.col("text"), F.col("_terms"))).otherwise(none))
    free = F.filter("_marks", lambda m: ~F.exists("_spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return marked.withColumn("spans", F.array_sort(F.concat("_spans", free))).select(*[c for c in docs.columns if c != "_uid"], "spans").withColumnsRenamed(own)


def sanitised(text: str | Column = "text", spans: str | Column = "spans") -> Column:
    """The text with each span generalised to its kind in brackets; of overlapping spans the first."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        spans,
        zero,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["parts"],
                    F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
                ).alias("parts"),
            )
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of(k) for k in KINDS],
        F.sha2(_told(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        _told(F.col("spans")).alias("spans"),
    )
