"""The same results whatever the splits of each scan: executors that come or go between scans change them."""

from itertools import cycle

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rollmill.llm.neardup import near_duplicates
from rollmill.llm.pieces import Vocabulary, encode
from rollmill.llm.privacy import find_pii
from rollmill.llm.simhash import fingerprint_documents
from rollmill.llm.substrings import drop_repeats
from rollmill.llm.warc import archive_pages

from tests.llm.conftest import SCHEMA, prose

SPLITS = [("1", "128m"), ("8", "2k"), ("3", "16k"), ("16", "1k")]


@pytest.fixture(scope="module")
def several(spark, tmp_path_factory):
    """400 rows in four files: copies, near copies, shared passages, entities beside a term."""
    shared = prose(3, 45)

    def text(i):
        if i % 10 == 0:
            return prose(7, 80)
        if i % 10 == 1:
            return prose(11, 90) + f" w{i}"
        if i % 10 == 2:
            return f"{prose(100 + i, 20)} {shared} {prose(200 + i, 20)}"
        if i % 10 == 3:
            return f"zanzibar wrote to ann{i % 3}@mail.example.org {prose(300 + i, 12)}"
        return prose(1000 + i, 40 + i % 7)

    rows = [(i, text(i), "en", "s", 0) for i in range(400)]
    path = str(tmp_path_factory.mktemp("several") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def restless(spark, monkeypatch):
    """After each write, the scans that follow are cut otherwise; stored files have row groups of a few rows."""
    confs = ["spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "parquet.block.row.count.limit"]
    ways, write = cycle(SPLITS), DataFrameWriter.parquet

    def cut_otherwise(self, *args, **options):
        write(self, *args, **options)
        least, most = next(ways)
        spark.conf.set(confs[0], least)
        spark.conf.set(confs[1], most)

    def start():
        monkeypatch.setattr(DataFrameWriter, "parquet", cut_otherwise)
        spark.conf.set(confs[2], "1")
        spark.conf.set(confs[3], "7")

    yield start
    for c in confs:
        spark.conf.unset(c)


def _rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))


OPERATORS = {
    "substrings": lambda docs: drop_repeats(docs.select("doc_id", "text")),
    "neardup": lambda docs: near_duplicates(docs.select("doc_id", "text")),
    "simhash": lambda docs: fingerprint_documents(docs, every=10),
    "pii": lambda docs: find_pii(docs.select("doc_id", "text")),
    "pieces": lambda docs: encode(docs.select("doc_id", "text"), Vocabulary.load(), decoded="decoded"),
    "warc": lambda docs: archive_pages(
        docs.sparkSession, docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"))
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_stay_when_splits_change(several, restless, monkeypatch, name):
    monkeypatch.setattr("rollmill.llm.substrings.numbered_blocks.__defaults__", (3000,))
    monkeypatch.setattr("rollmill.llm.pieces.BLOCK", 3000)
    want = _rows(OPERATORS[name](several))
    assert len(want) == 400
    restless()
    assert _rows(OPERATORS[name](several)) == want


def test_stored_row_groups_are_split(several, restless):
    """The premise: a stored block does come in parts."""
    from rollmill.llm.common import numbered_blocks

    restless()
    stored = numbered_blocks(several, "text", "numbered", 1 << 20)
    several.sparkSession.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    parts = stored.select("_block", F.spark_partition_id().alias("p")).distinct()
    assert parts.groupBy("_block").count().agg(F.max("count")).first()[0] > 1


@pytest.mark.parametrize("name", ["substrings", "neardup", "pii", "pieces"])
def test_columns_with_internal_names_stay(spark, several, name):
    own = ["_uid", "_block", "_spans"]
    docs = several.limit(20).select("doc_id", "text", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in own])
    operator = {
        "substrings": drop_repeats,
        "neardup": near_duplicates,
        "pii": find_pii,
        "pieces": lambda d: encode(d, Vocabulary.load()),
    }[name]
    done = operator(docs)
    assert set(docs.columns) <= set(done.columns)
    for row in done.select("doc_id", *own).collect():
        assert tuple(row)[1:] == tuple(f"{c}{row.doc_id}" for c in own)


def test_word_hashes_equal_the_pattern(monkeypatch):
    """Words are those of the pattern, equal exactly where their hashes are, wherever a slice ends."""
    import numpy as np

    from rollmill.llm import substrings

    text = "a b\x0bab ba\x1cc \x85d é è " + "x" * 300 + " " + "x" * 299 + "y\t\n" + "x" * 300 + " ab  a" + "z" * 5000
    want = substrings.WORD.findall(text)
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(substrings, "SLICE", size)
        data = text.encode()
        starts, ends, hashes = substrings.word_hashes(np.frombuffer(data, np.uint8))
        assert [data[a:b].decode() for a, b in zip(starts, ends, strict=True)] == want
        same = {}
        for w, h in zip(want, hashes.tolist(), strict=True):
            assert same.setdefault(w, h) == h
        assert len(set(same.values())) == len(same)
        assert size == 1 << 20 or (hashes == kept).all()
        kept = hashes
    for empty in (b"", b" \n "):
        assert len(substrings.word_hashes(np.frombuffer(empty, np.uint8))[2]) == 0
