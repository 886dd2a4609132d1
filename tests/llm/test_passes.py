"""What a pass over all texts costs: no regular expression per word, no payload in a shuffle; the sums against plain ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollmill.llm import decontamination, neardup, warc

LETTERS = "abcdé ÄΣİ1_ß—“”日本、。🙂\x00\x80�\U0001d4b3"


decontamination_word = decontamination.WORD


class Once:
    """A pattern that finds no words, but tells whether a character is in one."""

    def match(self, text):
        return decontamination_word.match(text)


def buckets(text):
    return decontamination.words_at(text)[2].tolist()


@pytest.mark.parametrize("most", [16, 0])
def test_texts_are_cut_without_a_list_of_their_words(monkeypatch, most):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(200))) for _ in range(200)]
    want = [buckets(" ".join(decontamination_word.findall(t.lower())).encode()) for t in texts]
    monkeypatch.setattr(decontamination, "WORD", Once())
    monkeypatch.setattr(decontamination, "ODD_CHARACTERS", most, raising=False)
    assert [buckets(decontamination.plain(t)) for t in texts] == want


@pytest.mark.parametrize("n", [300, 20_000])
def test_texts_with_a_bucket_are_counted_once(n):
    rng = random.Random(n)
    (run,) = decontamination.runs(pa.array([" ".join(rng.choices(["a", "b", "c", "d"], k=rng.randrange(4))) for _ in range(n)]))
    both = np.unique(run.text_of_words() * decontamination.BUCKETS + run.bucket) % decontamination.BUCKETS
    assert (run.texts_with_bucket() == np.bincount(both, minlength=decontamination.BUCKETS)).all()


def test_products_are_the_sums_of_passages():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 40, 300)
    begin, bucket = np.cumsum(size) - size, (rng.integers(0, 90, size.sum()) ** 2).astype(np.int32)
    of = np.repeat(np.arange(300), size)
    own = rng.standard_normal((decontamination.BUCKETS, decontamination.RANK), np.float32)
    sums, want = np.ones_like(own), np.ones(own.shape)
    decontamination.add_products(sums, own, bucket, begin, of)
    np.add.at(want, bucket, np.add.reduceat(own[bucket].astype(float), begin, axis=0)[of])
    assert np.allclose(sums, want, rtol=1e-4, atol=1e-3)
    for few in (np.array([7]), np.array([7, 7, 9])):
        sums = np.zeros_like(own)
        decontamination.add_products(sums, own, few.astype(np.int32), np.array([0]), np.zeros(len(few), np.int64))
        assert np.allclose(sums[7], few.tolist().count(7) * own[few].sum(axis=0), atol=1e-5)


def test_pages_get_their_roles_where_they_lie(spark, monkeypatch):
    """No exchange between the stored pages and the archives; ids that repeat or are null, blocks cut anywhere."""
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else f"http://u/{i}", None if i % 13 == 0 else f"page {i % 20} " * (i % 3)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(3)
    for each in (256, 4 << 20):
        monkeypatch.setattr(warc, "ROW_BYTES", each, raising=False)
        for least in (0, 1):
            told = warc.with_revisits(pages, least)
            assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
            found = told.orderBy("uid").collect()
            first = {}
            for r in sorted(found, key=lambda r: (r.page_id is None, r.page_id or 0, r.uid)):
                first.setdefault(r.html or "", r)
            for r in found:
                own = first[r.html or ""]
                again = r is not own and len(r.html or "") >= least
                assert (r.record_type, r.refers_to, r.refers_uid) == (("revisit", own.page_id, own.uid) if again else ("response", None, None))
            key = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
            assert sorted([(r.page_id, r.url, r.html) for r in found], key=key) == sorted(rows, key=key)
    assert warc.with_revisits(pages.where(F.lit(False))).count() == 0


def test_large_matrices_are_given_back():
    """The latent space lies in Arrow's memory, which holds nothing of it once it is done with."""
    before = pa.total_allocated_bytes()
    space = decontamination.Space.of(np.ones((decontamination.BUCKETS, decontamination.RANK), np.float32), np.full(decontamination.BUCKETS, 2, np.float32))
    assert (space.basis == 2).all() and pa.total_allocated_bytes() - before >= space.basis.nbytes
    del space
    assert pa.total_allocated_bytes() == before


def test_rows_of_open_buckets_hold_the_keys_of_earlier_bands(spark, monkeypatch):
    """What the last comparison within large buckets reads again and again is no longer than it needs."""
    seen = {}

    def kept(df, label):
        if "keys" in df.columns:
            seen[label] = df.select("band", F.size("keys").alias("n")).collect()
        return written(df, label)

    written = neardup.written
    monkeypatch.setattr(neardup, "written", kept)
    rng = random.Random(1)
    common = [f"w{i}" for i in range(60)]
    # halves in common: buckets are shared, classes are not
    texts = [" ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(12 + k % 9)]) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.near_duplicates(docs, 0.7).collect()
    assert len(found) == 120 and seen["open"] and all(r.n == r.band for r in seen["open"])
