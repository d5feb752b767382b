"""Toxic answers by a linear classifier on character n-grams.

Each n-gram that a text holds counts once, weighted by the logarithm of how much more
frequent it is in toxic than in other texts (the naive Bayes ratio); a logistic
regression on these values is fitted to labelled answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import CELL_ID, RESPONSE, text_or_empty
from cloudgauge.llm.labelled import Adam, best_logit, held_rows, labelled_sample, sigmoid

BUCKET_BITS = 19
GRAMS = (4, 5)
MULTIPLIER = 0x9E3779B97F4A7C15
# ASCII letters in lower case, other ASCII bytes as blanks, the rest (UTF-8) as they are
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def gram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the folded text, blanks run together."""
    folded = b" " + b" ".join(text.encode().translate(FOLD).split()) + b" "
    value = np.frombuffer(folded, np.uint8).astype(np.uint64) + np.uint64(1)
    out, rolled = [], value
    for size in range(2, max(GRAMS) + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * np.uint64(MULTIPLIER) + value[size - 1 :]
        if size in GRAMS:
            mixed = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(MULTIPLIER)
            out.append(mixed >> np.uint64(64 - BUCKET_BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class RatioModel:
    """Weight of each bucket (regression weight times log-count ratio; most are zero)."""

    weight: np.ndarray
    bias: float

    def logit(self, text: str) -> float:
        bucket = gram_buckets(text)
        bucket = np.unique(bucket[self.weight[bucket] != 0])
        return float(self.weight[bucket].sum(dtype=np.float64)) + self.bias


def class_counts(sample: DataFrame) -> np.ndarray:
    """Texts of each class with each bucket, and at the end all texts: one row of numbers
    per class from each of the few tasks of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BUCKET_BITS) + 1), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label, np.unique(gram_buckets(text))] += 1
                counts[label, -1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    total = np.zeros((2, (1 << BUCKET_BITS) + 1), np.int64)
    for row in sample.select("label", "text").mapInArrow(run, "counts binary").toLocalIterator():
        total += np.frombuffer(row["counts"], np.int32).reshape(total.shape)
    return total


def fit_ratio_model(
    receipts: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    threshold: float = 0.7,
    per_class: int = 6000,
    features: int = 20_000,
    evidence: float = 16.0,
    smoothing: float = 1.0,
    l2: float = 1e-3,
    steps: int = 300,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
) -> RatioModel:
    """Fits to at most `per_class` labelled answers of each class (by hash of the id).

    Of the buckets those are kept whose likelihood ratio statistic against being spread
    like the classes reaches `evidence`, at most `features`. The bias puts the best cut of a held-out quarter at `threshold`.
    Without answers of both classes every score is one half.
    """
    sample = labelled_sample(receipts, labels, label, per_class, cell_id, response_content)
    counts = class_counts(sample)
    texts = counts[:, -1]
    if not texts.all():
        return RatioModel(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    rate = (counts[:, :-1] + smoothing) / (texts[:, None] + 2 * smoothing)
    ratio = np.log(rate[1] / rate[0])
    seen = counts[:, :-1].astype(np.float64)
    expected = seen.sum(axis=0) * (texts / texts.sum())[:, None]
    surprise = 2 * (seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    kept = np.sort(np.argsort(-surprise, kind="stable")[:features])
    kept = kept[surprise[kept] >= evidence]
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    @arrow_udf("array<int>")
    def held_features(column: pa.Array) -> pa.Array:
        found = [place[np.unique(gram_buckets(t))] for t in column.to_pylist()]
        return pa.array([f[f >= 0] for f in found], pa.list_(pa.int32()))

    rows = sample.select(F.xxhash64(F.col("cell_id").cast("string")).alias("h"), "label", held_features("text").alias("f")).collect()
    y = np.array([r["label"] for r in rows], np.float64)
    sizes = np.array([len(r["f"]) for r in rows])
    index = np.concatenate([np.asarray(r["f"], np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    held = held_rows(np.array([r["h"] for r in rows], np.int64))
    r_kept = ratio[kept]
    weight, bias = np.ones(len(kept)) * 0.1, np.zeros(1)
    adam = Adam([weight, bias], 0.02)
    balance = np.where(held, 0.0, np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())))

    def logits() -> np.ndarray:
        return np.bincount(row, (weight * r_kept)[index], len(rows)) + bias[0]

    for _ in range(steps):
        g = (sigmoid(logits()) - y) * balance
        adam.move([np.bincount(index, g[row], len(kept)) * r_kept + l2 * weight / len(kept) ** 0.5, np.array([g.sum()])])
    cut = best_logit(logits()[held], y[held])
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    table[kept] = weight * r_kept
    return RatioModel(table, float(bias[0] - cut + np.log(threshold / (1 - threshold))))


def toxicity_scores(
    receipts: DataFrame, model: RatioModel, score: str = "toxicity", response_content: str = RESPONSE
) -> DataFrame:
    """The answers with one more column, the score from 0 to 1 (a column called like it is
    replaced). Null and empty answers get the score of a text without n-grams."""

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            logit = np.array([model.logit(t) for t in column.to_pylist()], np.float64)
            yield pa.array(sigmoid(logit))

    return receipts.withColumn(score, scored(text_or_empty(response_content)))
