"""What the two text classifiers share: a bounded labelled sample and a calibrated cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import CELL_ID, RESPONSE, text_or_empty, written

SAMPLE_TASKS = 8


def labelled_sample(
    receipts: DataFrame, labels: DataFrame, label: str, per_class: int, cell_id: str = CELL_ID, response_content: str = RESPONSE
) -> DataFrame:
    """(cell_id, label, text) of at most `per_class` labelled ids of each class, the first
    by hash of the id, so that the sample does not depend on how rows are laid out."""
    known = labels.select(F.col(cell_id).alias("cell_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    known = known.groupBy("cell_id").agg(F.max("label").alias("label"))
    classes = [
        known.filter(F.col("label") == c).orderBy(F.xxhash64(F.col("cell_id").cast("string")), "cell_id").limit(per_class)
        for c in (0, 1)
    ]
    chosen = F.broadcast(classes[0].union(classes[1]))  # at most 2 * per_class ids
    texts = receipts.select(F.col(cell_id).alias("cell_id"), text_or_empty(response_content).alias("text"))
    return written(texts.join(chosen, "cell_id").repartition(SAMPLE_TASKS, "cell_id"), f"{label}-sample")


def held_rows(ids: np.ndarray, share: int = 4) -> np.ndarray:
    """A fixed part of the sample (one in `share`) that thresholds are set on."""
    order = np.argsort(ids, kind="stable")
    held = np.zeros(len(ids), bool)
    held[order[::share]] = True
    return held


def best_logit(logit: np.ndarray, label: np.ndarray) -> float:
    """The cut with the best balanced accuracy; in the middle of the gap it lies in, or of
    the widest one if several are as good."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    if not len(x) or y.min() == y.max():
        return 0.0
    below0 = np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    above1 = 1 - np.concatenate([[0], np.cumsum(y)]) / y.sum()
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gap = np.diff(edges)
    quality = np.where(gap > 0, below0 + above1, -1)
    top = np.flatnonzero(quality >= quality.max() - 1e-12)
    at = int(top[np.argmax(gap[top])])
    return float(edges[at] + edges[at + 1]) / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = [np.zeros_like(p) for p in parameters]
        self.square = [np.zeros_like(p) for p in parameters]

    def move(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, s in zip(self.parameters, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)
