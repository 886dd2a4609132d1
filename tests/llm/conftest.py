import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau phi".split()


def prose(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((seed * i) % 5) for i in range(n))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A stored table of odd rows: nulls, empty and very long texts, ties, repeats, non-ASCII."""
    long = prose(1, 30_000)
    texts = [None, "", " ", "a", prose(2, 60), prose(2, 60), prose(3, 200), long, "ééé ▁ \U0001d4b3 ä", prose(2, 59) + " end", "x" * 5000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, texts[4], None, None, None), (4, texts[4], None, None, None), (None, prose(5, 80), None, None, None), (None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
