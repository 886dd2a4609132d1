"""Evaluation results, generation logs and saved rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollmill.functions.rewards import export_rewards
from rollmill.operators.evals import PASS_KS, eval_detail, running_eval
from rollmill.operators.scan import BUCKET_WIDTH
from rollmill.schemas import GENERATION
from rollmill.session import written
from rollmill.sources.tables import read_or_empty

LINE = " "  # between the pieces of a record, as the text sink needs a separator; JSON allows it between tokens


def rollout_lines(
    df: DataFrame, k: int, q: str = "q_idx", order: str = "rollout_idx", ks: Sequence[int] | None = None
) -> DataFrame:
    """The first `k` questions with their answers and rewards, one piece of a JSON record per answer.

    Written one after the other, the pieces of a question make one record on one line, whatever the number of
    its answers: the first piece opens it with question, gold and pass@k, the last one closes it, and no
    task holds more than a piece. `ks` names the pass@k so far, which depends on the questions up to the
    saved one only; unless given, they are those of PASS_KS below the question's number of answers.
    Rows without a question are not saved.
    """
    last = df.select(q).where(F.col(q).isNotNull()).distinct().orderBy(q).limit(k).agg(F.max(q)).scalar()
    kept = df.where(F.col(q) <= last)
    names = PASS_KS if ks is None else tuple(ks)
    whole = Window.partitionBy(q)
    rows = kept.withColumns(
        {"_place": F.row_number().over(whole.orderBy(order, "answer")), "_answers": F.count(F.lit(1)).over(whole)}
    )
    head = [q, "question", "gold"]
    if names:
        scores = F.create_map(*[c for n in names for c in (F.lit(n), F.col(f"pass_at_{n}"))])
        so_far = running_eval(kept, names, (), q, order=order).select(q, scores.alias("_scores"))
        rows = rows.join(so_far, q)
        listed = F.map_filter("_scores", lambda n, _: n < F.col("_answers")) if ks is None else F.col("_scores")
        head.append(listed.alias("pass_at_k"))
    opening = F.to_json(F.struct(*head), {"ignoreNullFields": "false"})
    result = F.to_json(F.struct(F.col(order), F.col("answer"), *export_rewards("correct", "format_ok", "format_strict")))
    piece = F.concat(
        F.when(F.col("_place") == 1, F.concat(F.substring(opening, F.lit(1), F.length(opening) - 1), F.lit(',"results":['))).otherwise(","),
        result,
        F.when(F.col("_place") == F.col("_answers"), "]}\n").otherwise(""),
    )
    return rows.select(q, "_place", piece.alias("value"))


def write_rollouts(df: DataFrame, path: str, k: int, q: str = "q_idx", **where) -> None:
    """One JSON record per question. The answers of a question are sorted on disk and streamed by one task."""
    lines = rollout_lines(df, k, q, **where).repartition(F.col(q)).sortWithinPartitions(q, "_place")
    lines.select("value").write.mode("overwrite").option("lineSep", LINE).text(path)


def write_eval_detail(df: DataFrame, path: str, idx: str = "idx", correct: str = "correct", part_size: int = BUCKET_WIDTH) -> None:
    """One JSON record: the indexes answered right in ascending order, the accuracy and the number of samples.

    The indexes are listed by as many tasks as there are, `part_size` numbers to a list; one task then
    writes the lists one after the other and holds one at a time. No answers give an empty list and zeros.
    """
    parts = written(eval_detail(df, idx, correct, part_size), "detail")
    some = parts.where(F.size("correct") > 0)
    first = some.agg(F.min("part")).scalar()
    numbers = F.to_json("correct")
    lists = some.select(
        F.lit(1).alias("at"), "part",
        F.concat(F.when(F.col("part") == first, "").otherwise(","), F.substring(numbers, F.lit(2), F.length(numbers) - 2)).alias("value"),
    )
    closing = F.to_json(F.struct("acc", "num_samples"))
    closing = F.concat(F.lit("],"), F.substring(closing, F.lit(2), F.length(closing)), F.lit("\n"))
    ends = F.array(
        F.struct(F.lit(0).alias("at"), F.lit('{"correct":[').alias("value")), F.struct(F.lit(2).alias("at"), closing.alias("value"))
    )
    frame = parts.agg(F.max("acc").alias("acc"), F.max("num_samples").alias("num_samples")).select(F.inline(ends))
    record = lists.unionByName(frame.withColumn("part", F.lit(0).cast("bigint")))
    record.repartition(1).sortWithinPartitions("at", "part").select("value").write.mode("overwrite").option("lineSep", LINE).text(path)


def append_eval_result(df: DataFrame, path: str, info: str | None = None, **tags: str) -> None:
    """Append one evaluation row with its tags (model, split, dataset) and an optional remark."""
    extra = dict(tags, **({"info": info} if info is not None else {}))
    df.withColumns({k: F.lit(v) for k, v in extra.items()}).write.mode("append").json(path)


def generation_record(df: DataFrame) -> DataFrame:
    return df.select(
        F.struct(F.col("question").alias("Q"), F.col("gold").alias("A")).alias("question"),
        "answer",
        F.col("acc_score").cast("double"),
        F.col("format_score").cast("double"),
    )


def append_generation_log(df: DataFrame, path: str) -> None:
    """Append scored answers in gzip files; earlier records are not read back."""
    generation_record(df).write.mode("append").option("compression", "gzip").json(path)


def read_generation_log(spark: SparkSession, path: str) -> DataFrame:
    """The log so far; a missing log is empty and unreadable lines are left out."""
    return read_or_empty(spark, path, GENERATION, "json", mode="DROPMALFORMED")


def append_history(new: DataFrame, old: DataFrame) -> DataFrame:
    return old.unionByName(new)


def sample_log(df: DataFrame, every: int = 5, iteration: str = "iteration", first: Sequence[str] = ("draw_pos",)) -> DataFrame:
    """The first answer of every `every`-th iteration, as the log shows it."""
    due = F.col(iteration) % every == 0
    for position in first:
        due = due & (F.col(position) == 0)
    return df.where(due).select(
        iteration, F.concat(F.lit("--------------------\n"), F.col("answer"), F.lit("\n")).alias("value")
    )


def write_sample_log(df: DataFrame, path: str, **where) -> None:
    sample_log(df, **where).select("value").write.mode("append").text(path)
