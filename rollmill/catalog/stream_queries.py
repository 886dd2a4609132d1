"""Streams over the test tables, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.batch_queries import POOL, regroup_sql
from rollmill.catalog.registry import query, r6
from rollmill.catalog.token_queries import _EOS
from rollmill.catalog.views import (
    TOKENS, UPLOADS, sequence_rows, sequences, table, uploads as batch_uploads, with_views,
)
from rollmill.operators.joins import enrich_with_ref
from rollmill.session import run_dir
from rollmill.streaming import macro, metrics, pool
from rollmill.streaming import uploads as U


def _stream(spark, sf, name):
    """All rows of a table in one trigger. The table is a file or a folder of files: a pattern names both."""
    return U.rollout_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def _uploads(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("q"), F.col("event_type").alias("answer"), F.col("value").alias("reward"),
        F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("arrival_ts"),
    )


def _done(started):
    started.awaitTermination()


@query(with_views(UPLOADS) + "SELECT q, answer, reward, arrival FROM uploads")
def rollout_stream(spark, sf):
    path = run_dir(spark, "ready")
    rows = _uploads(spark, sf).drop("arrival_ts")
    assert U.read_ready(spark, f"{path}/out", rows.schema).isEmpty()
    _done(U.write_ready(rows, f"{path}/out", f"{path}/checkpoint"))
    return U.read_ready(spark, f"{path}/out", rows.schema)


@query(with_views(UPLOADS) + "SELECT q, answer, reward, arrival FROM uploads")
def once_only(spark, sf):
    path = run_dir(spark, "once")
    rows = _uploads(spark, sf)
    twice = U.once_only(rows.unionByName(_uploads(spark, sf)), ["arrival"])
    _done(U.write_ready(twice, f"{path}/out", f"{path}/checkpoint"))
    return U.read_ready(spark, f"{path}/out", rows.schema).drop("arrival_ts")


_RECEIVED = """SELECT q, answer, reward, arrival, received FROM (SELECT *, count(*) OVER (PARTITION BY q) AS received FROM uploads)
 QUALIFY row_number() OVER (PARTITION BY q ORDER BY arrival DESC) <= 60"""


def _pooled(spark, stream):
    path = run_dir(spark, "pool")
    _done(pool.pool_stream(stream, f"{path}/checkpoint", 60))
    received = pool.received_answers(spark, f"{path}/checkpoint")
    return pool.pooled_answers(spark, f"{path}/checkpoint", 60).join(received, "q")


@query(with_views(UPLOADS) + _RECEIVED)
def question_pool(spark, sf):
    return _pooled(spark, _uploads(spark, sf))


def _in_files(spark, rows, label, file):
    """A stream of the rows from three files, one to a trigger; `file` numbers them from 0.

    Row groups are small, so that a trigger's tasks share a large file.
    """
    path = run_dir(spark, label)
    for k in range(3):
        rows.where(file == k).coalesce(1).write.mode("append").option("parquet.block.size", 8 << 20).parquet(path)
    return U.rollout_stream(spark, path, rows.schema, max_files=1)


# even questions come whole in the first file and do not change any more
_FILE = "CASE WHEN CAST(q AS BIGINT) % 2 = 0 THEN 0 ELSE arrival % 3 END"


def _upload_files(spark, sf):
    rows = batch_uploads(spark, sf)
    return _in_files(spark, rows, "upload-files", F.expr(_FILE))


@query(with_views(UPLOADS) + _RECEIVED)
def question_pool_files(spark, sf):
    return _pooled(spark, _upload_files(spark, sf))


@query(with_views(UPLOADS, POOL, regroup_sql("pool", "0:0")))
def regroup_stream(spark, sf):
    path = run_dir(spark, "regroup")
    _done(pool.regroup_stream(_uploads(spark, sf), f"{path}/out", f"{path}/checkpoint"))
    done = spark.read.parquet(f"{path}/out/groups")
    return done.select("q", "answer", "arrival", r6("advantage").alias("advantage"))


def _drawn_sql(k: int) -> str:
    """The draw of one trigger, from all that came until then."""
    return f"SELECT {k} AS trigger, * FROM (WITH pool AS (SELECT * FROM uploads WHERE {_FILE} <= {k} QUALIFY row_number() OVER (PARTITION BY q ORDER BY arrival DESC) <= 100), {regroup_sql('pool', f'0:{k}')})"


@query(with_views(UPLOADS) + " UNION ALL ".join(_drawn_sql(k) for k in range(3)))
def regroup_stream_files(spark, sf):
    path = run_dir(spark, "regroup-files")
    _done(pool.regroup_stream(_upload_files(spark, sf), f"{path}/out", f"{path}/checkpoint"))
    done = spark.read.parquet(f"{path}/out/groups")
    return done.select(F.col("batch").alias("trigger"), "q", "answer", "arrival", r6("advantage").alias("advantage"))


_ADVANTAGE_SQL = with_views(
    f"""rewarded AS (SELECT *, CASE WHEN valid THEN CASE WHEN {_EOS} THEN seq_reward ELSE 0 END - 0.01::DOUBLE * (gen_logp - ref_logp) ELSE 0 END AS r FROM taken)""",
    """first AS (SELECT *, CASE WHEN valid THEN (r - avg(r) FILTER (valid) OVER g) / (stddev_pop(r) FILTER (valid) OVER g + 1e-5) ELSE 0 END AS z
 FROM rewarded WINDOW g AS (PARTITION BY producer, macro_id))""",
    """returns AS (SELECT *, sum(z) OVER (PARTITION BY rollout_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM first)""",
).removeprefix("WITH ") + """SELECT producer, macro_id, rollout_id, pos, round((ret - avg(ret) FILTER (valid) OVER g) / (stddev_pop(ret) FILTER (valid) OVER g + 1e-5), 6) + 0e0 AS advantage
 FROM returns WINDOW g AS (PARTITION BY producer, macro_id)"""


def _macro_sql(keep: str) -> str:
    return with_views(
        TOKENS,
        """placed AS (SELECT batch_id, batch_id % 3 AS producer, (row_number() OVER (PARTITION BY batch_id % 3 ORDER BY batch_id) - 1) // 4 AS m
 FROM (SELECT DISTINCT batch_id FROM tokens))""",
        f"""macros AS (SELECT *, min(batch_id) OVER (PARTITION BY producer, m) AS first_batch, count(*) OVER (PARTITION BY producer, m) AS size FROM placed)""",
        f"""taken AS (SELECT t.* EXCLUDE (macro_id), producer, first_batch AS macro_id FROM tokens t JOIN macros USING (batch_id) WHERE size = 4 {keep})""",
    ).rstrip() + ", " + _ADVANTAGE_SQL


def _with_sizes(spark, sf, rows):
    """Answers with the number of rows their batch announces."""
    sizes = sequence_rows(table(spark, sf, "embeddings")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_rows"))
    return rows.drop("macro_id", "label").join(sizes, "batch_id")


def _macro(spark, rows, keep):
    path = run_dir(spark, "macro")
    _done(macro.macro_stream(rows, f"{path}/out", f"{path}/checkpoint", 4, keep=keep))
    done = spark.read.parquet(f"{path}/out/macros").select(
        "producer", "macro_id", "rollout_id", F.posexplode("advantages").alias("p", "a")
    )
    return done.select("producer", "macro_id", "rollout_id", (F.col("p") + 1).alias("pos"), r6("a").alias("advantage"))


def _one_file(spark, sf):
    rows = _with_sizes(spark, sf, sequence_rows(_stream(spark, sf, "embeddings")))
    return rows.withColumns({"producer": F.col("batch_id") % 3, "arrival": F.col("batch_id")})


@query(_macro_sql(""))
def macro_stream(spark, sf):
    return _macro(spark, _one_file(spark, sf), None)


@query(_macro_sql("AND first_batch IN (SELECT DISTINCT first_batch FROM macros WHERE size = 4 ORDER BY 1 DESC LIMIT 3)"))
def evict_stale(spark, sf):
    return _macro(spark, _one_file(spark, sf), 3)


def _split_sql() -> str:
    """Three triggers in turn: what waits and what became whole, in order, cut into fours."""
    steps = ["""whole AS (SELECT DISTINCT batch_id, (batch_id // 2) % 3 AS producer, batch_id // 12 AS arrival,
 CASE WHEN batch_id % 5 = 0 THEN 2 ELSE batch_id % 3 END AS due FROM tokens)"""]
    for k in range(3):
        waiting = f" UNION ALL SELECT batch_id, producer, arrival FROM cut{k - 1} WHERE size < 4" if k else ""
        steps.append(f"come{k} AS (SELECT batch_id, producer, arrival FROM whole WHERE due = {k}{waiting})")
        steps.append(f"placed{k} AS (SELECT *, (row_number() OVER (PARTITION BY producer ORDER BY arrival, batch_id) - 1) // 4 AS m FROM come{k})")
        steps.append(f"""cut{k} AS (SELECT *, count(*) OVER g AS size, first(batch_id) OVER (g ORDER BY arrival, batch_id) AS first_batch
 FROM placed{k} WINDOW g AS (PARTITION BY producer, m))""")
    every = " UNION ALL ".join(f"SELECT batch_id, producer, first_batch FROM cut{k} WHERE size = 4" for k in range(3))
    taken = f"taken AS (SELECT t.* EXCLUDE (macro_id), producer, first_batch AS macro_id FROM tokens t JOIN ({every}) USING (batch_id))"
    return with_views(TOKENS, *steps, taken).rstrip() + ", " + _ADVANTAGE_SQL


@query(_split_sql())
def macro_stream_files(spark, sf):
    """Every fifth batch is split over three files, and each producer has batches that arrive together."""
    rows = _with_sizes(spark, sf, sequence_rows(table(spark, sf, "embeddings")))
    rows = rows.withColumns({"producer": F.floor(F.col("batch_id") / 2) % 3, "arrival": F.floor(F.col("batch_id") / 12)})
    file = F.when(F.col("batch_id") % 5 == 0, F.col("rollout_id") % 3).otherwise(F.col("batch_id") % 3)
    return _macro(spark, _in_files(spark, rows, "macro-files", file), None)


@query("""SELECT count(*) AS steps, round(sum(l_linenumber * l_quantity) / sum(l_linenumber), 6) AS avg_output_token_length,
 round(count(*) FILTER (l_returnflag = 'A') / sum(l_linenumber), 6) AS acc_correct_ratio,
 round(count(*) FILTER (l_linestatus = 'O') / sum(l_linenumber), 6) AS format_correct_ratio FROM lineitem""")
def running_training_stream(spark, sf):
    path = run_dir(spark, "metrics")
    steps = _stream(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("n_sequences"), F.col("l_quantity").cast("bigint").alias("padded_length"),
        (F.col("l_returnflag") == "A").cast("int").alias("n_correct"), (F.col("l_linestatus") == "O").cast("int").alias("n_format"),
    )
    _done(metrics.write_metrics(metrics.running_training_stream(steps), f"{path}/out", f"{path}/checkpoint"))
    done = metrics.read_metrics(spark, f"{path}/out")
    return done.select("steps", *[r6(c).alias(c) for c in done.columns if c != "steps"])


@query(with_views(TOKENS) + "SELECT rollout_id, any_value(seq_reward) AS seq_reward, round(sum(ref_logp), 6) + 0e0 AS ref_total FROM tokens GROUP BY rollout_id")
def enrich_with_ref_stream(spark, sf):
    path = run_dir(spark, "refs")
    rows = sequence_rows(_stream(spark, sf, "embeddings")).select("rollout_id", "seq_reward")
    joined = enrich_with_ref(rows, sequences(spark, sf).select("rollout_id", "ref_logps"))
    _done(U.write_ready(joined, f"{path}/out", f"{path}/checkpoint"))
    total = F.aggregate("ref_logps", F.lit(0.0), lambda a, x: a + x)
    return U.read_ready(spark, f"{path}/out", joined.schema).select("rollout_id", "seq_reward", r6(total).alias("ref_total"))
