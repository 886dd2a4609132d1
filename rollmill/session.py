"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JIT leaves longer methods interpreted; Spark then splits the work into smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rollmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; pass `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only where the setting is unset (local tests) is a temporary folder made and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.mkdtemp(prefix="rollmill-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def removed(path: str) -> None:
    """Delete a folder of `run_dir` that no plan reads any more."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.delete_dir(root)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table in the shared folder.

    For a narrow result of an expensive scan that several branches of a plan read: texts are read
    once, and lost executors cost no more than reading the table again.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
