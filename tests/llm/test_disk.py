"""What operators store and move; the paths of the encoding in whole arrays against the plain recursion."""

import random
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollmill import session
from rollmill.llm import common, neardup, pieces


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(5, 14))) for _ in range(n)]


def test_words_are_not_stored_and_paths_are_smaller(spark, tmp_path, monkeypatch):
    """Beside the numbered copy no folder holds the words, and the paths take less than the words do."""
    monkeypatch.setattr(common, "run_dir", lambda _, label: f"file://{tmp_path}/{label}-{next(number)}")
    number, rows = count(), [(i, " ".join(words(i, 2000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    done = pieces.encode(docs, pieces.Vocabulary.load(), decoded="decoded")
    assert done.where(F.col("decoded") == F.col("text")).count() == 60
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["numbered", "pieces"]
    own = sum(p.stat().st_size for p in tmp_path.glob("pieces-*/*/*.parquet"))
    assert own < 0.6 * sum(len(w) for _, t in rows for w in set(t.split(" ")))


def test_paths_of_many_words_equal_the_plain_recursion(monkeypatch):
    """Blank marks, characters without a piece, ties, words of 1 to 64 code points, cut into parts of any size."""
    own, rng = pieces.Vocabulary.load(), random.Random(5)
    alphabet = "aabcdeinorsttheth ABC.,é▁\U0001d4b3ä\n1￿"
    every = [" " + "".join(rng.choice(alphabet) for _ in range(rng.randrange(64))) for _ in range(400)]
    every += [" ", " " * 64, " the", " " + "th" * 31, *[" " + w for w in words(3, 200)]]
    want = [own.spelled(w, own.best_path(w)) for w in every]
    for characters in (1 << 18, 300, 1):
        monkeypatch.setattr(pieces, "CHARACTERS", characters)
        ends = pieces.viterbi(pa.array(every), own)
        assert [np.frombuffer(own.joined(w, e), "<i4").tolist() for w, e in zip(every, ends.tolist(), strict=True)] == want
    assert len(pieces.viterbi(pa.array([], pa.string()), own)) == 0


def test_sketches_are_given_back(spark, odd, tmp_path, monkeypatch):
    """Classes are read from what is stored of them; the table of sketches is gone before the rows are asked for."""
    number = count()
    for module in (common, neardup, session):
        monkeypatch.setattr(module, "run_dir", lambda _, label: f"file://{tmp_path}/{label}-{next(number)}")
    tables = {t.name for t in spark.catalog.listTables()}
    done = neardup.near_duplicates(odd)
    assert not list(tmp_path.glob("sketches-*")) and {t.name for t in spark.catalog.listTables()} == tables
    assert done.count() == odd.count()
    assert done.where("class_id is not null").groupBy("class_id").agg(F.sum(F.col("is_first").cast("int")).alias("n")).where("n <> 1").count() == 0


def test_labels_reach_the_ends_of_chains_and_stars(spark):
    """Each component gets its least id, though only labels that changed are handed on."""
    rng = random.Random(2)
    links = [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(3050 - i, 3049 - i) for i in range(30)]
    links += [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b]
    least = {x: x for link in links for x in link}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = neardup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.label for r in found} == least and len(found) == len(least)
