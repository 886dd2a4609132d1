"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.common import Counts, counted_rows, documents, held_out, labelled_sample, table

BITS = 18  # of a bucket's number
SIZES = (3, 4, 5, 6)  # characters of an n-gram
SAMPLE = 4_000  # labelled rows that a model is fitted on, at most
SAMPLE_COUNTS = 24_000_000  # and distinct n-grams of all these rows together
SEGMENT = 1 << 20  # characters whose n-grams are counted together
SMOOTHING = 5.0
EPOCHS = 8
RATE = 0.3
DECAY = 0.01
POSITIVE = 2.0  # weight of a toxic row in the loss
THRESHOLD = 0.5
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _buckets(chars: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first `starts` characters."""
    found, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(chars) < n:
            break
        h = (h[: len(chars) - n + 1] + chars[n - 1 :]) * ODD
        h ^= h >> np.uint64(29)
        if n in SIZES:
            found.append(((h[:starts] * MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text's n-grams and how often each occurs.

    The text is lower-cased, blanks run together, and one stands at either end, so that n-grams tell
    where words begin and end.
    """
    plain = f" {' '.join((text or '').lower().split())} "
    if plain == "  ":
        return np.empty(0, np.int32), np.empty(0, np.int64)
    total = None
    for at in range(0, len(plain), SEGMENT):
        part = plain[at : at + SEGMENT + max(SIZES) - 1].encode("utf-32-le", "surrogatepass")
        buckets = np.sort(_buckets(np.frombuffer(part, np.uint32).astype(np.uint64), SEGMENT))
        first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.empty(0, np.int64)
        if len(plain) <= SEGMENT:
            return buckets[first], np.diff(np.r_[first, len(buckets)])
        total = np.zeros(1 << BITS, np.int64) if total is None else total
        total[buckets[first]] += np.diff(np.r_[first, len(buckets)])
    seen = np.flatnonzero(total)
    return seen.astype(np.int32), total[seen]


@dataclass(frozen=True)
class Model:
    """Log-odds = bias + sum over n-grams of log(1 + occurrences) * ratio * learned weight."""

    weight: np.ndarray  # ratio and learned weight multiplied, by bucket
    bias: float

    def score(self, text: str | None) -> float:
        at, n = counted(text)
        logit = self.bias + float(np.log1p(n) @ self.weight[at])
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def ratios(rows: Counts, value: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket: log of its smoothed share under label 1 over label 0."""
    totals = np.full((2, 1 << BITS), smoothing)
    for label, start, end in zip(rows.labels, rows.starts, rows.ends, strict=True):
        totals[label, rows.at[start:end]] += value[start:end]
    logs = np.log(totals / totals.sum(axis=1, keepdims=True))
    return (logs[1] - logs[0]).astype(np.float32)


def fit(rows: Counts, seed: int = 1) -> Model:
    """Ratios first, then logistic regression on the scaled features by AdaGrad, one row at a time.

    Without rows of both classes the model knows only how frequent the labels are.
    """
    labels = rows.labels
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    value = np.log1p(rows.n, dtype=np.float32)
    ratio = ratios(rows, value)
    rng = np.random.default_rng(seed)
    weight, squares = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-8, np.float32)
    bias, bias_squares = 0.0, 1e-8
    mean, mean_bias = np.zeros(1 << BITS, np.float32), 0.0  # over the ends of the later half of the epochs
    for done, i in enumerate(np.concatenate([rng.permutation(len(labels)) for _ in range(EPOCHS)]), 1):
        mine = slice(rows.starts[i], rows.ends[i])
        own = rows.at[mine]
        x = ratio[own] * value[mine]
        now = weight[own]
        miss = 1 / (1 + np.exp(-np.clip(bias + float(now @ x), -60, 60))) - labels[i]
        miss *= POSITIVE if labels[i] else 1.0
        slope = np.float32(miss) * x + np.float32(DECAY) * now
        squares[own] += slope * slope
        weight[own] = now - np.float32(RATE) * slope / np.sqrt(squares[own])
        bias_squares += miss * miss
        bias -= RATE * miss / np.sqrt(bias_squares)
        if done % len(labels) == 0 and 2 * done > EPOCHS * len(labels):
            mean += weight / (EPOCHS // 2)
            mean_bias += bias / (EPOCHS // 2)
    return Model(ratio * mean, float(mean_bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, counts: int = SAMPLE_COUNTS) -> Model:
    """Fit on at most `sample` labelled rows with at most `counts` n-gram counts together; whole texts.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out and never learned from; `labelled_sample` and
    `counted_rows` say how rows are drawn. Rows without an n-gram are left aside. Tables without rows give
    a model of even odds.
    """
    return fit(counted_rows(labelled_sample(docs, labels, label, sample), counted, counts, "toxicity-sample"))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns with `score`, the probability of label 1, and `predicted`.

    The whole text decides and nothing else; a null text is an empty one, and that has the score of the
    bias alone. Equal texts have equal scores. Columns named score or predicted are replaced. Every text
    is counted in its task, a long one a segment at a time; there is no shuffle. No rows give no rows.
    """
    keep = docs.drop("score", "predicted")
    schema = T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(text)
            scores = [own.score(column[i].as_py()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return keep.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"
    )
