"""MinHash near-dedup: BagMinHash signatures of shingle multisets, bands, verified overlap."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.common import documents, group_value, numbered, removed, run_dir, shielded, written
from rollmill.llm.substrings import MIX, ODD, WORD, Hasher, _mixed, sequence_hashes

SHINGLE = 5  # words
SIMILARITY = 0.8  # weighted Jaccard: sum of the lesser counts by sum of the greater
SLOTS = 80
ROWS = 4  # per band: at a similarity of 0.8 a pair shares no band once in 30,000 times
DOCS_AT_ONCE = 64
CENTERS = 4  # of a bucket in each further turn
TURNS = 2
PARITY = 1024


def shingles(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles and their counts; a shorter text is one shingle, an empty one none."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(sequence_hashes(hasher.words(words), min(SHINGLE, len(words))), return_counts=True)


def units(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each occurrence of each shingle: the multiset as a set."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    mixed = _mixed(np.repeat(hashes, counts) + place.astype(np.uint64) * MIX)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signature of each multiset: a row of `slots` numbers, equal with the probability of J.

    Weights are cut at 1, 2, 4, ...: each element has a Poisson process on each interval below its
    weight, whose points carry a time, a height within the interval and a slot. A point counts if its
    height is below the weight; a slot keeps its earliest point. Processes are followed point by point,
    all at once, and given up when their time is past the latest slot, so most are left after a few
    points. Equal elements have equal processes whatever their weights. An empty multiset has infinity
    in all slots.
    """
    signature = np.full((len(bags), slots), np.inf)
    owner, element, height, low = [], [], [], []
    for d, (hashes, counts) in enumerate(bags):
        level = 0
        while len(hashes):  # interval [0, 1), then [1, 2), [2, 4), ...
            owner.append(np.full(len(hashes), d))
            element.append(_mixed(hashes ^ np.uint64(level * 0x2545F491)))
            height.append(counts)
            low.append(np.full(len(hashes), 0 if not level else 1 << (level - 1)))
            keep = counts > (1 << level)
            hashes, counts, level = hashes[keep], counts[keep], level + 1
    if not owner:
        return signature
    owner, element, height, low = map(np.concatenate, (owner, element, height, low))
    width, time, turn = np.maximum(low, 1), np.zeros(len(owner)), np.zeros(1, np.uint64)
    flat = signature.ravel()
    while len(owner):
        turn += np.uint64(1)
        draw = _mixed(element + turn * MIX)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        draw = _mixed(draw ^ ODD)
        slot = ((draw >> np.uint64(40)) * np.uint64(slots)) >> np.uint64(24)
        at = low + (((draw & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        good = at < height
        np.minimum.at(flat, owner[good] * slots + slot[good].astype(np.int64), time[good])
        alive = time < signature.max(axis=1)[owner]
        owner, element, height, low, width, time = (x[alive] for x in (owner, element, height, low, width, time))
    return signature


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    values = signature.view(np.uint64).reshape(len(signature), -1, rows)
    keys = _mixed(values[:, :, 0] + MIX)
    for i in range(1, rows):
        keys = _mixed(keys * MIX + values[:, :, i])
    return keys


def sketches(rows: DataFrame) -> DataFrame:
    """`_uid`, band keys and units of each row that has words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                few = batch.slice(i, DOCS_AT_ONCE)
                bags = [shingles(t, hasher) for t in few.column("text").to_pylist()]
                keys = band_keys(signatures(bags)).view(np.int64)
                have = [d for d, (hashes, _) in enumerate(bags) if len(hashes)]
                if have:
                    yield pa.RecordBatch.from_arrays(
                        [
                            few.column("_uid").take(pa.array(have)),
                            pa.array(list(keys[have]), pa.list_(pa.int64())),
                            pa.array([units(*bags[d]) for d in have], pa.list_(pa.int32())),
                        ],
                        ["_uid", "keys", "units"],
                    )

    return rows.mapInArrow(sketch, "_uid long, keys array<long>, units array<int>")


def _by_row(sketched: DataFrame, path: str, name: str) -> DataFrame:
    """The same rows from a table of that name and folder, bucketed by `_uid`: joins on it move the other side only."""
    spark = sketched.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sketched.repartition(parts, "_uid")
    rows.write.bucketBy(parts, "_uid").option("path", path).saveAsTable(name)
    return spark.table(name)


def _pairs(stars: DataFrame, similarity: float) -> DataFrame:
    """Different pairs a < b of `_uid` and center `c` with their sizes; too different sizes are left out unseen."""
    me, other = F.struct("_uid", "n"), F.struct("c._uid", "c.n")
    ends = stars.where("_uid <> c._uid").select(F.least(me, other).alias("l"), F.greatest(me, other).alias("r"))
    pairs = ends.select(F.col("l._uid").alias("a"), F.col("r._uid").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb"))
    return pairs.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their similarity `j` for each pair of `_pairs`."""
    with_a = pairs.join(sets.select(F.col("_uid").alias("a"), F.col("units").alias("ua")), "a")
    both = with_a.join(sets.select(F.col("_uid").alias("b"), F.col("units").alias("ub")), "b")
    common = F.size(F.array_intersect("ua", "ub"))
    return both.select("a", "b", "na", "nb", common.alias("common")).select(
        "a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("j")
    )


def _with_parity(rows: DataFrame) -> DataFrame:
    """`_uid`, `keys` and PARITY bits: whether an odd number of the units falls on each.

    Where the bits of two sets differ, so do the sets: no more bits differ than units do.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.bincount(u.values.to_numpy().view(np.uint32) % PARITY, minlength=PARITY) & 1).view(np.int64) for u in batch.column("units")]
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("keys"), pa.array(bits, pa.list_(pa.int64()))], ["_uid", "keys", "bits"])

    return rows.select("_uid", "keys", "units").mapInArrow(told, "_uid long, keys array<long>, bits array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id that links reach, for each id in a link (a, b).

    Labels go along links and then to the label's own label, until none changes; each round is stored,
    so the plan stays short and a lost executor costs one round. Only labels that the round before
    changed go along links, as the others have been offered already.
    """
    ways = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    jumped = labels.withColumn("_old", F.col("id"))
    while True:
        labels = jumped.select("id", "label")
        offers = ways.join(jumped.where("label <> _old"), F.col("b") == F.col("id")).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("offer"))
        nearer = labels.join(offers, F.col("id") == F.col("to"), "left").select("id", F.least("label", "offer").alias("label"), F.col("label").alias("_old"))
        own = nearer.select(F.col("id").alias("_at"), F.col("label").alias("_next"))
        jumped = written(
            nearer.join(own, F.col("label") == F.col("_at"), "left").select("id", F.least("label", F.coalesce("_next", "label")).alias("label"), "_old"),
            "labels",
        )
        if not jumped.where("label <> _old").head(1):
            return jumped.select("id", "label")


def _open(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Members of buckets that hold several classes, with `label` and `s`, how many of their `n` units others may share.

    A unit that one open member alone has is shared with none. Members that have too many of these are
    left out, as they can have no link to another class.
    """
    bucket = ["band", "key"]
    classed = members.drop("label", "s").join(labels, F.col("_uid") == F.col("id"), "left").withColumn("label", F.coalesce("label", "_uid")).drop("id")
    several = classed.groupBy(*bucket).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(*bucket)
    some = written(classed.join(several, bucket), "open")
    pool = sets.join(some.select("_uid").distinct(), "_uid").select("_uid", F.explode("units").alias("unit"))
    alone = pool.groupBy("unit").agg(F.count(F.lit(1)).alias("k"), F.min("_uid").alias("_uid")).where("k = 1")
    counts = alone.groupBy("_uid").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    told = some.join(counts, "_uid", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return written(told.where(F.col("s") >= similarity * F.col("n")), "open")


def near_links(sketched: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between rows of at least the similarity, and the classes they form.

    Rows meet in buckets, one per band and key. Pairs are not listed: first each member of a bucket is
    compared with three of its members, and the links give classes. In buckets that hold members of
    several classes, twice more, each member is compared with four others that are not of its class,
    one of them that with the greatest share of units that others may have too.
    What then is left of different classes in one bucket is compared pair by pair, once in the first
    bucket that the two share, where their sizes, the units that others may have, the parity bits
    of the units and the first comparison allow a link at all: the
    distance 1 - J is a metric, so two members whose distances from a center differ by more than the
    limit cannot be linked. Members of one class need no more comparison. So no link that would join
    two classes is lost, and a group of near copies costs a few comparisons a member.
    """
    sets = sketched.select("_uid", "units")
    placed = sketched.select("_uid", F.size("units").alias("n"), F.posexplode("keys").alias("band", "key"))
    bucket = ["band", "key"]
    me, spread = F.struct("_uid", "n"), F.xxhash64("_uid")
    chosen = placed.groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("size"),
        F.min(me).alias("c0"),
        F.min_by(me, spread).alias("c1"),
        F.max_by(me, spread).alias("c2"),
    )
    members = placed.join(chosen.where("size > 1"), bucket).select(*bucket, "_uid", "n", "c0", "c1", "c2")
    members = written(members, "buckets")
    stars = members.select("_uid", "n", F.explode(F.array("c0", "c1", "c2")).alias("c"))
    to_center = written(_verified(_pairs(stars, similarity), sets), "stars")
    seen, labels = to_center, components(to_center.where(F.col("j") >= similarity))
    members = members.select(*bucket, "_uid", "n", F.col("c0._uid").alias("c0"))
    least_common = similarity / (1 + similarity) - 1e-9  # of the sum of both sizes
    for turn in range(TURNS):
        some = members = _open(members, labels, sets, similarity)
        me = F.struct("_uid", "n", "label", "s")
        at = [F.min_by(me, F.xxhash64("_uid", F.lit(turn * CENTERS + i))) for i in range(1, CENTERS)]
        at.append(F.max_by(me, F.struct(F.col("s") / F.col("n"), F.xxhash64("_uid", F.lit(turn)))))
        centers = some.groupBy(*bucket).agg(F.array(*at).alias("centers"))
        stars = some.join(centers, bucket).select("_uid", "n", "label", "s", F.explode("centers").alias("c"))
        stars = stars.where("label <> c.label").where(F.least("s", "c.s") >= least_common * (F.col("n") + F.col("c.n")))
        fresh = _pairs(stars, similarity).join(seen, ["a", "b"], "left_anti")
        more = written(_verified(fresh, sets), "stars")
        seen = seen.unionByName(more)
        if not more.where(F.col("j") >= similarity).head(1):
            break
        labels = components(seen.where(F.col("j") >= similarity))

    some = _open(members, labels, sets, similarity)
    near = F.when(F.col("_uid") == F.col("c0"), 1.0).otherwise(F.coalesce("j", F.lit(0.0)))  # sizes too different: at most the limit
    known = some.withColumns({"a": F.least("_uid", "c0"), "b": F.greatest("_uid", "c0")}).join(to_center, ["a", "b"], "left")
    known = known.select(*bucket, "_uid", "n", "s", "label", near.alias("near"), F.col("j").isNull().alias("unseen"))
    told = _with_parity(sketched.join(some.select("_uid").distinct(), "_uid"))
    # of the keys a row takes those of earlier bands only: where a bucket is large, its rows are read again and again
    known = written(known.join(told, "_uid").withColumn("keys", F.slice("keys", F.lit(1), F.col("band"))), "open")
    left = known.alias("l")
    right = known.alias("r")
    earlier = F.zip_with("l.keys", "r.keys", lambda x, y: x == y)
    differ = F.zip_with("l.bits", "r.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    reach = (
        (F.col("l.band") == F.col("r.band"))
        & (F.col("l.key") == F.col("r.key"))
        & (F.col("l._uid") < F.col("r._uid"))
        & (F.col("l.label") != F.col("r.label"))
        & (F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n"))
        & (F.least("l.s", "r.s") >= least_common * (F.col("l.n") + F.col("r.n")))
        & (F.col("l.unseen") | F.col("r.unseen") | (F.abs(F.col("l.near") - F.col("r.near")) <= 1 - similarity + 1e-9))
        & (F.aggregate(differ, F.lit(0), lambda a, x: a + x) <= (1 - similarity) / (1 + similarity) * (F.col("l.n") + F.col("r.n")) + 1e-9)
        & ~F.exists(earlier, lambda same: same)
    )
    rest = left.join(right, reach).select(F.col("l._uid").alias("a"), F.col("r._uid").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb"))
    rest = rest.join(seen, ["a", "b"], "left_anti")
    more = written(_verified(rest, sets).where(F.col("j") >= similarity), "links")
    links = seen.where(F.col("j") >= similarity).unionByName(more)
    return links, (components(links) if more.head(1) else labels)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns with `class_id`, the least doc_id of the row's class, and `is_first`.

    Two texts are near copies if the multisets of their shingles of five words overlap by `similarity`
    or more; classes are what links connect. Equal texts form one class first and only one of them goes
    on, so copies are never paired. A class has one first row: that with the least doc_id, the earliest
    in the table among equal ids; null ids come last. A null text is an empty one; texts without words
    are copies of their equals only. Texts of less than five words are one shingle. Columns named
    class_id or is_first are replaced. No rows give no rows. Rows are numbered once, in a stored copy.
    """
    docs, own = shielded(docs.drop("class_id", "is_first"), "_uid")
    docs = numbered(docs, "numbered")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("_uid", "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), F.length(text).alias("h3"))
    same = ["h1", "h2", "h3"]
    firsts = written(group_value(keys, same, F.col("_uid"), _first=("min", F.col("_uid"))).select("_uid", "doc_id", "_first"), "equals")
    different = sketches(docs.select("_uid", "text")).join(firsts.where("_uid = _first").select("_uid"), "_uid")
    path, name = run_dir(docs.sparkSession, "sketches"), f"sketches_{uuid.uuid4().hex}"
    _, labels = near_links(_by_row(different, path, name), similarity)
    # the labels are stored, so nothing reads the sketches again
    docs.sparkSession.sql(f"DROP TABLE {name}")
    removed(path)
    labelled = firsts.join(labels, F.col("_first") == F.col("id"), "left").select("_uid", "doc_id", F.coalesce("label", "_first").alias("label"))
    me = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_uid").alias("at"))
    least = group_value(labelled.withColumn("me", me), ["label"], F.col("_uid"), first=("min", F.col("me")))
    found = least.select("_uid", F.col("first.doc_id").alias("class_id"), (F.col("first.at") == F.col("_uid")).alias("is_first"))
    return docs.join(found, "_uid").drop("_uid").withColumnsRenamed(own)


def op6_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "is_first")
