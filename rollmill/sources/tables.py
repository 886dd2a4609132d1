"""Reading a folder that may not have been written yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """The rows below `path`, or no rows of the same schema while nothing has been written."""
    try:
        return spark.read.schema(schema).format(fmt).options(**options).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
