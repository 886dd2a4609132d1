"""Periodic runs, toxicity and resampling against plain versions, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmill.llm import classifier, common, resampling, runs, toxicity

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=6, repeats=4):
    """Every period at every place, and every smaller period of what it finds."""
    found = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[start : i + q]
            if len(part) >= max(least, repeats * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((start, len(part), q))
    return sorted(found)


def collapsed(w, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least,repeats", [(6, 4), (1, 4), (20, 6)])
def test_runs_equal_brute_force(least, repeats):
    rng = random.Random(least)
    for _ in range(800):
        n, k, w = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 6]), []
        while len(w) < n:
            again = rng.random() < 0.6
            w += [rng.randrange(k) for _ in range(rng.randint(1, 9) if again else 1)] * (rng.randint(1, 7) if again else 1)
        assert runs.runs_of(np.array(w, np.int64), least, repeats) == brute_runs(w, least, repeats), w


def test_runs_of_very_long_texts():
    assert runs.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs.runs_of(np.tile(np.arange(7), 40_000)) == [(0, 280_000, 7)]
    assert runs.runs_of(np.tile(np.arange(70_000), 4)) == [(0, 280_000, 70_000)]


def test_periodic_runs_on_odd_rows(spark, odd, none):
    done = runs.periodic_runs(odd.withColumn("runs", F.lit("clash"))).toPandas()
    assert len(done) == odd.count()
    for text, n, own, rest in zip(done.text, done.n_words, done.runs, done.collapsed):
        words = SPLIT.findall(text or "")
        assert n == len(words)
        found = [(r["start"], r["length"], r["period"]) for r in own]
        if n < 1000:
            assert found == brute_runs(words)
        assert rest == collapsed(words, found)
    assert runs.periodic_runs(none).count() == 0
    rows = [(1, "a\tb\x0ba b\n a b a b x"), (2, "é\xa0é " * 9), (3, "\x85 \x1f \x85 \x1f \x85 \x1f \x85 \x1f")]
    for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = SPLIT.findall(r.text)
        assert [tuple(x) for x in r.runs] == brute_runs(words) and len(r.runs) == 1
        assert r.collapsed == collapsed(words, brute_runs(words))
    with pytest.raises(ValueError):
        runs.periodic_runs(none, repeats=3)


def test_op11_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in runs.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    seen = 0
    for i, text in texts.items():
        w = SPLIT.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        if n > 1500:
            continue
        found = brute_runs(w)
        seen += len(found)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = ["".join(f"{s},{n},{q}\n" for s, n, q in found), collapsed(w, found)]
        want = (i, len(found), *numbers, *[hashlib.sha256(d.encode()).hexdigest() for d in digests])
        assert tuple(got[i]) == want
    assert seen > 0


def test_counts_of_ngrams():
    def plain(text):
        t = f" {' '.join(text.lower().split())} "
        if t == "  ":
            return Counter()
        return Counter(t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1))

    for text in ("", " \n ", "a", "Ab  c", "Straße İx ÄÖ \U0001d4b3", "to be or not to be " * 30):
        at, n = toxicity.counted(text)
        assert sorted(n.tolist()) == sorted(plain(text).values())  # no two n-grams of these share a bucket
        assert len(set(at.tolist())) == len(at)


def test_counts_of_a_text_in_segments(monkeypatch):
    text = "some words " * 400 + "x" * 500
    whole = toxicity.counted(text)
    monkeypatch.setattr(toxicity, "SEGMENT", 64)
    cut = toxicity.counted(text)
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_ratios_are_log_count_ratios():
    rows = common.Counts(np.array([1, 0]), np.array([0, 2]), np.array([2, 3]), np.array([3, 5, 5], np.int32), np.array([2, 1, 4], np.int32))
    r = toxicity.ratios(rows, rows.n.astype(float), smoothing=1.0)
    size = 1 << toxicity.BITS
    share = lambda count, total: (1 + count) / (size + total)
    assert r[3] == pytest.approx(math.log(share(2, 3) / share(0, 4)), abs=1e-6)
    assert r[5] == pytest.approx(math.log(share(1, 3) / share(4, 4)), abs=1e-6)
    assert r[7] == pytest.approx(math.log(share(0, 3) / share(0, 4)), abs=1e-6)


@pytest.mark.parametrize("module,label,floor", [(toxicity, "toxic", 0.93), (classifier, "quality", 0.93)])
def test_held_out_accuracy_on_more_rows(spark, module, label, floor):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(common.held_out())
    done = module.score(held, module.train(docs, labels)).select(label, "predicted").toPandas()
    assert (done[label] == done.predicted).mean() >= floor
    assert done.predicted[done[label] == 1].mean() >= 0.8  # most of label 1 is found


def test_toxicity_on_odd_rows(spark, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    done = toxicity.score(odd.withColumn("score", F.lit("clash")), model).toPandas()
    assert len(done) == odd.count() and done.score.between(0, 1).all()
    empty = done.score[done.text.fillna("").str.strip() == ""]
    assert empty.nunique() == 1 and len(empty) > 2
    assert done.groupby(done.text.fillna("")).score.nunique().max() == 1
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels).score("some words") == 0.5


def test_training_draws_repeated_ids_and_bounds(spark):
    docs = spark.createDataFrame([(7, f"text number {i}") for i in range(50)] + [(7, "same")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, 3)], "doc_id long, toxic int")
    drawn = common.labelled_sample(docs, labels, "toxic", 20).collect()
    assert len(drawn) == 20 and {r._label for r in drawn} == {1} and len({r.text for r in drawn}) == 20
    rows = common.counted_rows(common.labelled_sample(docs, labels, "toxic", 100), toxicity.counted, 500, "few")
    assert 0 < rows.ends[-1] <= 500 and len(rows.at) == rows.ends[-1]
    every = common.counted_rows(common.labelled_sample(docs, labels, "toxic", 100), toxicity.counted, 10**6, "all")
    assert len(every.labels) == 51


def test_shift_of_checksums():
    shift = resampling.Shift()
    rng = random.Random(3)
    for size in (0, 1, 4, 255, 256, 300, 70_000):
        a, b = rng.randbytes(9), rng.randbytes(size)
        got = shift(np.array([zlib.crc32(a)], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_features(text, buckets=10_000):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resampled(docs, target):
    parts = {i: brute_features(t) for i, t in docs.items()}
    s, t = Counter(b for _, f in parts.values() for b in f), Counter(b for x in target for b in brute_features(x)[1])
    total = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total[0] + 10_000) / ((s[b] + 1) * (total[1] + 10_000)))) for b in range(10_000)]
    rows = {}
    for i, (n, features) in parts.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        rows[i] = [n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    best = sorted((i for i in rows if rows[i][0] >= 20), key=lambda i: (-rows[i][3], i))
    rank = {i: k for k, i in enumerate(best[: math.floor(5 * len(best) / 100)], 1)}
    return {i: (i, *rows[i][1:], rank.get(i)) for i in rows}


def test_op13_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in resampling.op13_importance_resampling(spark, sf).collect()}
    assert got == brute_resampled(texts, target)
    assert sum(r[-1] is not None for r in got.values()) > 0


def test_resampling_on_odd_rows(spark, odd, none, monkeypatch):
    target = odd.select("text").limit(3)
    clash = odd.withColumn("rank", F.lit("clash"))
    done = resampling.resampled(clash, target, percent=50).toPandas()
    assert len(done) == odd.count()
    for text, n, features in zip(done.text, done.n_words, done.n_features):
        assert (n, features) == (brute_features(text)[0], len(brute_features(text)[1]))
    assert done["rank"].max() == done["rank"].notna().sum() == math.floor((done.n_words[done.doc_id.notna()] >= 20).sum() / 2)
    assert done["rank"][done.doc_id.isna()].isna().all() and done.score[done.doc_id.isna()].isna().all()
    assert resampling.resampled(none, target).count() == 0
    assert resampling.resampled(odd, none.select("text")).count() == odd.count()


def test_features_of_pieces_and_overlong_words(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 50)
    rng = random.Random(5)
    texts = ["", "A", "x" * 3000 + " b " + "y" * 1025 + "-c", "é Ünï ı\x7fZ9"] + [
        " ".join(rng.choice(["to", "BE", "or-not", " ", "z" * 60]) for _ in range(rng.randrange(200))) for _ in range(40)
    ]
    got = [[] for _ in texts]
    words = [0] * len(texts)
    for word, bucket, of in resampling.Featuriser()(t.encode() for t in texts):
        for k in word:
            words[k] += 1
        for k, b in zip(of, bucket):
            got[k].append(int(b))
    for k, t in enumerate(texts):
        n, features = brute_features(t)
        assert words[k] == n and sorted(got[k]) == sorted(features), t[:60]
