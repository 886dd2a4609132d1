"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import Counts, counted_rows, documents, held_out, labelled_sample, table

BUCKETS = 1 << 17
DIMENSIONS = 10
MIN_N, MAX_N = 3, 4
SAMPLE = 4_000  # labelled rows that a model is fitted on, at most
SAMPLE_COUNTS = 24_000_000  # and distinct features of all these rows together
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.3
MEMO = 1 << 19  # words whose share a task remembers


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, the word framed by < and >."""
    framed = f"<{word}>"
    grams = [framed[i : i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(framed) - n + 1)]
    return [xxhash.xxh3_64_intdigest(g) % BUCKETS for g in (f"\0{word}", *grams)]


@dataclass(frozen=True)
class Model:
    """What a document's score needs of the learned vectors: a number per bucket and a bias.

    The output layer is linear in the averaged vector, so the vectors are multiplied with it once:
    logit = bias + mean of `share` over the document's features.
    """

    share: np.ndarray
    bias: float

    def word(self, word: str) -> tuple[float, int]:
        at = word_features(word)
        return float(self.share[at].sum()), len(at)

    def score(self, text: str | None, memo: dict[str, tuple[float, int]]) -> float:
        total, n = 0.0, 0
        for w, times in Counter((text or "").split()).items():
            known = memo.get(w)
            if known is None:
                if len(memo) >= MEMO:
                    memo.clear()
                known = memo[w] = self.word(w)
            total += times * known[0]
            n += times * known[1]
        logit = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def fit(rows: Counts, seed: int = 1) -> Model:
    """Stochastic gradient descent, one document at a time, on the softmax loss of two classes.

    A document's features weigh by how often they occur, one in all. Without rows of both classes the
    model knows only how frequent the labels are.
    """
    labels = rows.labels
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.log(np.array([1 - prior, prior])).astype(np.float32)
    todo = EPOCHS * len(labels)
    for done, i in enumerate(np.concatenate([rng.permutation(len(labels)) for _ in range(EPOCHS)])):
        rate = RATE * (1 - done / todo)
        at, weight = rows.at[rows.starts[i] : rows.ends[i]], rows.n[rows.starts[i] : rows.ends[i]].astype(np.float32)
        weight /= weight.sum()
        hidden = weight @ vectors[at]
        z = out @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[i]] -= 1
        back = p @ out
        out -= rate * np.outer(p, hidden)
        bias -= 0.05 * rate * p
        # the average spreads a step over all features; their number gives it back
        vectors[at] -= rate * np.outer(weight * min(len(at), 50), back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def counted(text: str | None, memo: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a text and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int32)
    for w, times in Counter((text or "").split()).items():
        if len(memo) >= MEMO:
            memo.clear()
        np.add.at(counts, memo.get(w) or memo.setdefault(w, word_features(w)), times)
    seen = np.flatnonzero(counts)
    return seen.astype(np.int32), counts[seen]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, counts: int = SAMPLE_COUNTS) -> Model:
    """Fit on at most `sample` labelled rows with at most `counts` feature counts together; whole texts.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out and never learned from; `labelled_sample` and
    `counted_rows` say how rows are drawn. All features of a drawn row take part. Rows without a feature
    are left aside.
    """
    memo: dict[str, list[int]] = {}
    return fit(counted_rows(labelled_sample(docs, labels, label, sample), lambda text: counted(text, memo), counts, "quality-sample"))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns with `score`, the probability of label 1, and `predicted`.

    The whole text decides and nothing else; a null text is an empty one, and that has the score of the
    bias alone. Columns named score or predicted are replaced. A text of any length is counted word by
    word in its task; there is no shuffle. No rows give no rows.
    """
    keep = docs.drop("score", "predicted")
    schema = T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, {}
        for batch in batches:
            scores = [own.score(t, memo) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return keep.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"
    )
