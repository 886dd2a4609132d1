"""Each operator against a plain version, on odd rows, and on an empty table."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollmill.llm import classifier, decontamination, neardup, pieces, privacy, secrets, sharding, simhash, substrings, warc



def test_sharding_is_contiguous_and_balanced(odd, none):
    rows = sharding.balanced_shards(odd.withColumn("shard", F.lit("clash")), shards=3, keep=["doc_id", "shard"]).toPandas()
    assert len(rows) == odd.count()
    total = rows["size"].sum()
    for shard, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
        assert part["size"].sum() <= total / 3 + rows["size"].max()
    ordered = rows.sort_values(["shard", "slot"]).doc_id.fillna(-1).tolist()
    assert ordered == sorted(ordered)
    assert sharding.balanced_shards(none).count() == 0


def brute_secrets(text):
    assign = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_equal_a_backtracking_search(odd, none):
    scanner = secrets.Scanner()
    rng = np.random.default_rng(3)
    parts = ["token", "Secret", "passwd", "api_key", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCD1234EFGH5678", "é", "ſ", "_", "\U0001d4b3"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert [s for s in scanner.spans(text) if s[1] < 3] == brute_secrets(text), text
    done = secrets.secret_spans(odd.withColumn("spans", F.lit(1))).select("text", "spans").toPandas()
    assert len(done) == odd.count() and not any(len(s) for s in done.spans)
    assert secrets.secret_spans(none).count() == 0


def brute_repeats(docs, n):
    words = [substrings.WORD.findall(t or "") for t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    for w in words:
        covered = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                covered[i : i + n] = [True] * n
        yield sum(covered), " ".join(x for x, c in zip(w, covered) if not c)


def test_substrings_equal_brute_force(odd, none):
    rows = odd.select("doc_id", "text")
    done = substrings.drop_repeats(rows.withColumn("kept", F.lit(0))).toPandas()
    expected = list(brute_repeats(done.text.tolist(), 35))
    assert list(zip(done.n_removed, done.kept)) == expected
    assert sum(done.n_removed) > 0
    assert substrings.drop_repeats(none).count() == 0


def overlap(a, b):
    def bag(t):
        w = substrings.WORD.findall(t or "")
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    bags = [(hashes[c > 0], c[c > 0]) for c in (a, b)]
    signature = neardup.signatures(bags, 4000)
    assert abs((signature[0] == signature[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_near_duplicates_equal_brute_force(odd, none):
    done = neardup.near_duplicates(odd.withColumn("class_id", F.lit(1))).toPandas()
    assert len(done) == odd.count()
    rows = done.text.fillna("").tolist()
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if a == b or overlap(a, b) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
    firsts = {}
    for g, first in zip(group, done.is_first):
        firsts[g] = firsts.get(g, 0) + int(first)
    assert set(firsts.values()) == {1}
    for g in set(group):
        ids = done.class_id[[x == g for x in group]]
        assert ids.fillna(-1).nunique() == 1
    assert neardup.near_duplicates(none).count() == 0


def test_pieces_equal_plain_viterbi_and_round_trip(spark, odd, none):
    vocabulary = pieces.Vocabulary.load()
    done = pieces.decode(pieces.encode(odd.withColumn("ids", F.lit(1)), vocabulary), vocabulary).toPandas()
    for text, ids, decoded in zip(done.text, done.ids, done.decoded):
        assert decoded == (text or "")
        if text and len(text) < 3000:
            assert list(ids) == [i for w in pieces.words_of(text) for i in vocabulary.spelled(w, vocabulary.best_path(w))]
    once = pieces.encode(odd, vocabulary, decoded="decoded").toPandas()
    assert sorted(map(str, once.decoded)) == sorted(map(str, done.decoded))
    assert pieces.encode(none, vocabulary).count() == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pii(text):
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PII) for m in re.finditer(p, text) if valid(k, m[0]))


def test_pii_equals_a_backtracking_search(spark, odd, none, tmp_path):
    rng = np.random.default_rng(6)
    bits = ["a@b.c", "..", ".", "@", "x", "1.2.3.4", "256", "0001", "+", "(49) ", "4111 1111 1111 1111", "-", " ", "é", "\U0001d4b3", "d.e", "378282246310005", "5"]
    made = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(400)] + ["a." * 50_000 + "@" + "b." * 50_000 + "c"]
    spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    done = privacy.find_pii(spark.read.parquet(str(tmp_path / "t"))).toPandas()
    for text, spans in zip(done.text, done.spans):
        assert [(s["start"], s["order"], s["kind"], s["end"]) for s in spans if s["kind"] != "term"] == brute_pii(text), text[:80]
    assert all(len(s) == 0 for s in privacy.find_pii(odd.withColumn("spans", F.lit(1))).toPandas().spans)
    assert privacy.find_pii(none).count() == 0


def test_pii_marks_revealing_terms(spark, tmp_path):
    rows = [(i, f"note {i} zanzibar writes to eve@x.org {'more ' * i}") for i in range(5)] + [(9 + i, "writes note more") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    done = privacy.find_pii(spark.read.parquet(str(tmp_path / "t"))).withColumn("clean", privacy.sanitised()).toPandas().set_index("doc_id")
    assert done.clean[0] == "note 0 [TERM] writes to [EMAIL] "
    assert done.clean[9] == "writes note more"


def test_pii_marks_revealing_terms_wherever_they_stand(spark, tmp_path):
    far = "such words are often here " * 10
    rows = [f"zanzibar {i} {far}eve@x.org {far}Zanzibar" for i in range(4)] + ["about zanzibar"] + [f"{far}{i}" for i in range(9)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    done = privacy.find_pii(spark.read.parquet(str(tmp_path / "t"))).withColumn("clean", privacy.sanitised()).toPandas().set_index("doc_id")
    assert done.clean[0] == f"[TERM] 0 {far}[EMAIL] {far}[TERM]"
    assert done.clean[4] == "about [TERM]" and done.clean[5] == rows[5]


def test_simhash_and_edited_texts(odd, none):
    done = simhash.fingerprint_documents(odd).toPandas()
    assert len(done) == odd.count()
    assert done.near_edited.between(0, 1).all() and done.near_next.between(0, 1).all()
    assert done[done.doc_id == 4].fingerprint.nunique() == 1
    assert simhash.fingerprint_documents(none).count() == 0


def plain_simhash(spark, text):
    terms = spark.createDataFrame([(text,)], "text string").select(F.explode(simhash.term_hashes("text")).alias("t"))
    votes = [0] * 64
    for t, h in terms.select("t", F.xxhash64("t")).toPandas().itertuples(index=False):
        for b in range(64):
            votes[b] += (t & 3) if h >> b & 1 else -(t & 3)
    found = sum(1 << b for b in range(64) if votes[b] > 0)
    return found - (1 << 64) if found >> 63 else found


def test_votes_of_long_texts_of_few_words(spark):
    """All terms of a long text may vote for the topmost bits: their sum must not overflow."""
    lines = [f"considerable{k} " for k in range(4)] + ["recognised internationally ", "abcdefgh ", "a line of considerable words\n"]
    rows = [(i, n, line * n) for i, line in enumerate(lines) for n in (50, 20_000)]
    prints = simhash.simhash(spark.createDataFrame(rows, "id long, n long, text string"), ["id", "n"], "text").toPandas()
    found = {(r["id"], r["n"]): r["fingerprint"] for r in prints.to_dict("records")}
    assert len(prints) == len(found) == len(rows)
    assert all(found[i, 50] == found[i, 20_000] for i in range(len(lines)))
    assert all(found[i, n] == plain_simhash(spark, text) for i, n, text in rows if n == 50)


def test_pieces_of_long_texts_lose_no_term(spark):
    most = simhash.PIECE
    texts = [None, "", "a b", " " * most, " " * most + "b", " " * (most - 1) + "b c", "y" * (3 * most) + " z", "z " * (2 * most), " z" * (2 * most)]
    texts += ["w" * (most + k) + " v u" for k in (-2, -1, 0, 1)] + ["a b " + "\n" * (2 * most) + "c d" + " " * (2 * most), "\U0001d4b3 é\xa0 " * most]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    cut = {r["id"]: [(p["piece"], p["after"]) for p in r["p"]] for r in rows.select("id", simhash.pieces("text").alias("p")).collect()}
    prints = {r["id"]: r["fingerprint"] for r in simhash.simhash(rows, ["id"], "text").collect()}
    space = re.compile(r"[\x20\x09-\x0D]+")
    for i, text in enumerate(texts):
        assert "".join(p for p, _ in cut[i]) == (text or "")
        words = [[w for w in space.split(p) if w] for p, _ in cut[i]]
        assert all(len(w) <= most // 2 + 1 for w in words)
        assert [a for _, a in cut[i]] == [next((w for later in words[n + 1 :] for w in later), None) for n in range(len(words))]
        assert prints[i] == plain_simhash(spark, text)


def test_hamming_search_is_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 6), replace=False)) for b in np.repeat(base, 5)]
    prints = spark.createDataFrame([(x,) for x in near], "fingerprint long")
    got = {(r["query"], r["fingerprint"]) for r in simhash.within_radius(prints, prints).toPandas().to_dict("records")}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in near for b in near if ((a ^ b) & mask).bit_count() <= 3}


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "x"), (1, None, "x"), (2, "b", None), (4, "c", ""), (5, "d e", "é" * 100_000), (1, "again", "x"), (None, "n", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    done = warc.archive_pages(spark, pages, limit=1000).toPandas()
    assert len(done) == len(rows)
    x = done[done.payload_bytes == 1]
    assert (x.record_type == "response").sum() == 1 and set(x[x.record_type == "revisit"].refers_to) == {1}
    assert (done[done.payload_bytes == 0].record_type == "revisit").sum() == 1
    big = done[done.page_id == 5].iloc[0]
    assert big.payload_digest == base64.b32encode(hashlib.sha1(("é" * 100_000).encode()).digest()).decode()
    assert bytes(big.payload).decode() == "é" * 100_000
    assert warc.archive_pages(spark, pages.where("false")).count() == 0


def test_classifier_learns_and_scores_odd_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"  # the smallest table has 19 held-out labels, too few for a share
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.train(docs, labels)
    held = classifier.score(docs, model).join(labels, "doc_id").where(classifier.held_out()).toPandas()
    assert (held.predicted == held.quality).mean() >= 0.85
    done = classifier.score(odd.withColumn("score", F.lit("x")), model).toPandas()
    assert done.score.between(0, 1).all() and len(done) == odd.count()
    assert classifier.score(none, model).count() == 0
    assert classifier.train(none, labels).bias is not None


def test_leaks_are_found(spark, sf, odd, none):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {
        (r["doc_id"], k["item_id"])
        for r in decontamination.with_leaks(docs.withColumn("leaks", F.lit(1)), items).toPandas().to_dict("records")
        for k in r["leaks"]
    }
    plain = {i: decontamination.WORD.findall((t or "").lower()) for i, t in docs.select("doc_id", "text").toPandas().itertuples(index=False)}
    expected = set()
    for k, t in items.select("item_id", "text").toPandas().itertuples(index=False):
        w = decontamination.WORD.findall(t.lower())
        expected |= {(i, k) for i, words in plain.items() if f" {' '.join(w)} " in f" {' '.join(words)} "}
    assert expected and got >= expected
    assert decontamination.with_leaks(odd, items).count() == odd.count()
    assert decontamination.with_leaks(none, items).count() == 0


def leak_tables(spark, path, texts, items):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{path}/d")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{path}/b")
    return spark.read.parquet(f"{path}/d"), spark.read.parquet(f"{path}/b")


def leak_pairs(docs, items):
    return {(r.doc_id, k.item_id): k.overlap for r in decontamination.with_leaks(docs, items).collect() for k in r.leaks}


def invented(rng, n, size=4000):
    """Words as they are dealt in a text: few of them often, most of them seldom."""
    return [f"w{int(size ** x)}q" for x in rng.random(n)]


@pytest.mark.parametrize("copies,others", [(1, 0), (2, 2), (30, 60), (60, 30)])
def test_leaks_in_many_rows_are_found(spark, tmp_path, copies, others):
    rng = np.random.default_rng(copies)
    item = invented(rng, 30)
    held = " ".join(invented(rng, 40) + item + invented(rng, 40))
    docs, items = leak_tables(spark, tmp_path, [held] * copies + [" ".join(invented(rng, 120)) for _ in range(others)], [" ".join(item)])
    assert leak_pairs(docs, items) == {(i, 0): 1.0 for i in range(copies)}


def test_all_passages_are_fitted(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{w}{i}" for w in invented(rng, 100)) for i in range(40)]
    docs, items = leak_tables(spark, tmp_path, texts, [" ".join(invented(rng, 30))])
    weight = decontamination.idf(*decontamination.document_frequencies(docs)[:2])
    basis = decontamination.latent_space(docs, items, weight, 20_000_000)
    held = np.concatenate([decontamination.words_at(decontamination.plain(t))[2] for t in texts])
    assert (np.abs(basis[held]).sum(axis=1) > 0).all()


def test_long_items_are_found(spark, tmp_path):
    rng = np.random.default_rng(8)
    items = [invented(rng, n) for n in (400, 130, 1000, 59)]
    texts = [" ".join(invented(rng, 70 + i) + w + invented(rng, 90)) for i, w in enumerate(items)]
    gaps = [" ".join(invented(rng, 50) + [x for v in w for x in (v, *invented(rng, int(rng.random() < 0.3)))] + invented(rng, 50)) for w in items]
    halves = [" ".join(invented(rng, 500) + w[: len(w) // 2] + invented(rng, 500)) for w in items]
    docs, items = leak_tables(spark, tmp_path, texts + gaps + halves, [" ".join(w) for w in items])
    assert leak_pairs(docs, items) == {(i, i % 4): 1.0 for i in range(8)}


def test_recall_of_planted_items(spark, tmp_path):
    """Against the longest common subsequence of every item and the text it was planted in, without the index."""
    rng = np.random.default_rng(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()]
    words = [decontamination.WORD.findall(t.lower()) for t in items]
    short = [k for k, w in enumerate(words) if len(w) < 25]
    hosts = [w for w in (decontamination.WORD.findall((t or "").lower()) for t in texts) if 150 <= len(w) <= 600]
    planted = []
    for share in (1.0, 0.62, 0.62, 0.62):
        for k in short:
            w, host = words[k], hosts[rng.integers(len(hosts))]
            kept = set(rng.permutation(len(w))[: int(np.ceil(share * len(w)))].tolist())
            at = rng.integers(0, len(host))
            planted.append((share, k, host[:at] + [x if i in kept else host[rng.integers(len(host))] for i, x in enumerate(w)] + host[at:]))
    docs, table = leak_tables(spark, tmp_path, [" ".join(w) for _, _, w in planted] + texts, items)
    weight = decontamination.idf(*decontamination.document_frequencies(docs)[:2])
    space = decontamination.Space.of(np.zeros((decontamination.BUCKETS, decontamination.RANK), np.float32), weight)
    listed = decontamination.Items.of(space, weight, list(range(len(items))), items)
    found = leak_pairs(docs, table)
    for share in (1.0, 0.62):
        truth = [(i, k) for i, (s, k, w) in enumerate(planted) if s == share and listed.overlap(k, w) >= decontamination.OVERLAP]
        recall = sum(pair in found for pair in truth) / len(truth)
        print(f"planted with {share} of the words: {len(truth)} pairs, recall {recall:.3f}")
        assert len(truth) > 40 and recall >= 0.97


@pytest.mark.parametrize("a,b", [("", ""), ("abcd", "xaxbxd"), ("aab", "aba")])
def test_common_subsequence(a, b):
    best = {(): 0}
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert best and decontamination.common_subsequence(list(a), list(b)) == table[-1][-1]


def test_pipeline_runs(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "personal_data", "tokens"]
    done = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(done) < spark.read.parquet(f"{sf}/documents.parquet").count() and done.round_trip.all()


def test_texts_are_cut_into_words_once_for_the_fit(spark, monkeypatch):
    """The passes of the fit read stored buckets: passages, their words and frequencies are those of the texts."""
    texts = [None, "", "one two " * 5_000, "Three, four! " * 20, "a", *[f"word{i} and word{i % 7}" for i in range(3_000)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words, frequency, total, n_passages = decontamination.words_and_frequencies(docs)
    rows = [np.frombuffer(r.words, "<i4") for r in words.collect()]
    own = [decontamination.words_at(decontamination.plain(t))[2] for t in texts]
    assert total == len(texts) and n_passages == sum(-(-len(w) // decontamination.FIT) for w in own)
    want = np.zeros(decontamination.BUCKETS, np.int64)
    for w in own:
        want[np.unique(w)] += 1
    assert (frequency == want).all()
    found = sorted(tuple(p) for r in rows for p in np.split(r & (decontamination.BUCKETS - 1), np.flatnonzero(r >= decontamination.BEGINS)[1:]))
    assert found == sorted(tuple(w[i : i + decontamination.FIT]) for w in own for i in range(0, len(w), decontamination.FIT))
    assert max(map(len, rows)) < decontamination.KEPT + decontamination.FIT
    # the fit without tokenising: the texts are not read again
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    weight = decontamination.idf(frequency, total)
    plain = decontamination.latent_space(docs, items, weight, n_passages)
    unread = decontamination.latent_space(docs.where("raise_error('read') is null"), items, weight, n_passages, words=words)
    assert np.allclose(np.abs(plain.T @ unread).sum(), np.abs(plain.T @ plain).sum(), atol=1e-3)


def test_products_of_a_part_are_summed_by_bucket():
    rng = np.random.default_rng(1)
    at = [np.array(x, "<i4") for x in ([3, 5, 9], [5], [0, 9])]
    sums = [rng.random((len(x), decontamination.RANK)).astype("<f4") for x in at]
    rows = pa.table({"part": [0] * 3, "at": [x.tobytes() for x in at], "sums": [x.tobytes() for x in sums]})
    bucket, total = decontamination.products(rows)
    assert bucket.tolist() == [0, 3, 5, 9]
    assert np.allclose(total, [sums[2][0], sums[0][0], sums[0][1] + sums[1][0], sums[0][2] + sums[2][1]])
