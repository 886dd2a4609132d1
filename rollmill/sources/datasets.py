"""Question tables: one folder per dataset, partitioned by split."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollmill.functions.text import gold_answer, strip
from rollmill.schemas import CODE_TASK, MATH, QA_JSON, QUESTION


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a dataset by its `split` column."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def _read(spark: SparkSession, path: str, schema: StructType, split: str, ids: tuple[str, ...]) -> DataFrame:
    full = StructType(list(schema.fields))
    for name in ids:
        full = full.add(name, "long")
    full = full.add("split", "string")
    return spark.read.schema(full).parquet(path).where(F.col("split") == split).drop("split")


def read_questions(spark: SparkSession, path: str, split: str, ids: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Math questions of one split with their gold answers; other splits are never listed."""
    return _read(spark, path, QUESTION, split, ids).withColumn("gold", gold_answer("answer"))


def read_math(spark: SparkSession, path: str, split: str, ids: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Competition problems with levels; the gold answer is the stripped answer."""
    return _read(spark, path, MATH, split, ids).withColumn("gold", strip("answer"))


def read_code_tasks(spark: SparkSession, path: str, split: str, ids: tuple[str, ...] = ("idx",)) -> DataFrame:
    return _read(spark, path, CODE_TASK, split, ids)


def read_qa_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Question and detailed answer from JSON arrays, or from JSON lines with `multi_line=False`.

    A JSON array is read by one task per file; large sets should come as many files or as lines.
    """
    return spark.read.schema(QA_JSON).json(path, multiLine=multi_line)


def with_skill_prompt(df: DataFrame, path: str | None, system: str = "system") -> DataFrame:
    """Append a prompt file to the system text behind a blank line; a missing file changes nothing.

    The file is one prompt: it joins the plan as a one-row scalar subquery.
    """
    if not path:
        return df
    try:
        text = df.sparkSession.read.text(path, wholetext=True).scalar()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return df
    return df.withColumn(system, F.concat(F.col(system), F.lit("\n\n"), text))
