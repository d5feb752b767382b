"""Quality of answers by multiple-instance learning with gated attention.

An answer is a bag of passages. Each passage is encoded from its form: which kinds of
characters follow each other, and how words repeat and how long they are. Attention
weights, learned from labels of whole answers, say which passages tell; the weighted mean
of the encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import CELL_ID, RESPONSE, hand_back_memory, text_or_empty
from cloudgauge.llm.labelled import Adam, best_logit, held_rows, labelled_sample, sigmoid

PASSAGE_WORDS = 64
FEW_WORDS = 10
KINDS = 10  # lower, upper, digit, blank, line end, stop, symbol, other mark, first byte of a letter beyond ASCII, its rest


def _kinds() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[9, 11, 12, 13, 32]], table[10] = 3, 4
    table[[ord(c) for c in ".,;:"]] = 5
    table[[ord(c) for c in "#*$%&|<>"]] = 6
    table[192:], table[128:192] = 8, 9
    return table


KIND = _kinds()
FEATURES = KINDS * KINDS + 5


def passages(text: str) -> np.ndarray:
    """Features of each passage of `PASSAGE_WORDS` words; a text without words has one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = KIND[raw]
    blank = (kind == 3) | (kind == 4)
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(begins):
        return np.zeros((1, FEATURES), np.float32)
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    words = len(begins)
    own = np.arange(words) // PASSAGE_WORDS
    n = int(own[-1]) + 1
    # bytes belong to the passage of the last word that has begun
    first = begins[::PASSAGE_WORDS]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(first, len(raw))))
    raw, kind = raw[first[0] :], kind[first[0] :]
    pair = kind[:-1].astype(np.int64) * KINDS + kind[1:]
    out = np.zeros((n, FEATURES), np.float32)
    size = np.bincount(of_byte, minlength=n)
    if len(pair):
        out[:, : KINDS * KINDS] = np.bincount(of_byte[:-1] * (KINDS * KINDS) + pair, minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, : KINDS * KINDS] = np.sqrt(out[:, : KINDS * KINDS] / size[:, None])
    # words by a hash of their bytes
    place = np.arange(len(raw)) - np.repeat(begins - first[0], np.diff(np.append(begins, first[0] + len(raw))))
    inside = place < np.repeat(ends - begins, np.diff(np.append(begins, first[0] + len(raw))))
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0))
    hashes = np.add.reduceat(value, begins - first[0])
    count = np.bincount(own, minlength=n)
    order = np.lexsort((hashes, own))
    o, h = own[order], hashes[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    groups = np.flatnonzero(new)
    run = np.diff(np.append(groups, words))
    most = np.zeros(n)
    np.maximum.at(most, o[groups], run)
    base = KINDS * KINDS
    length = (ends - begins).astype(np.float64)
    out[:, base] = np.bincount(o[groups], minlength=n) / count
    out[:, base + 1] = most / count
    out[:, base + 2] = np.bincount(own[1:], hashes[1:] == hashes[:-1], n) / count
    out[:, base + 3] = np.bincount(own, length, n) / count / 10
    out[:, base + 4] = np.log1p(count) / np.log1p(PASSAGE_WORDS)
    return out


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features x width
    encode_bias: np.ndarray
    gate_tanh: np.ndarray  # width x attention
    gate_sigmoid: np.ndarray
    attend: np.ndarray
    head: np.ndarray
    bias: np.ndarray
    shift: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.gate_tanh, self.gate_sigmoid, self.attend, self.head, self.bias]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Logits of bags whose passages are the rows from each start on."""
        sizes = np.diff(np.append(starts, len(x)))
        # a passage of few words says little: its features are drawn to the mean
        words = np.expm1(x[:, -1] * np.log1p(PASSAGE_WORDS))[:, None]
        u = np.clip((x - self.mean) / self.scale, -8, 8) * words / (words + FEW_WORDS)
        h = np.tanh(u @ self.encode + self.encode_bias)
        t, s = np.tanh(h @ self.gate_tanh), sigmoid(h @ self.gate_sigmoid)
        e = (t * s) @ self.attend
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"u": u, "h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "logit": z @ self.head + self.bias[0]}

    def gradients(self, f: dict, starts: np.ndarray, g: np.ndarray, l2: float) -> list[np.ndarray]:
        sizes = f["sizes"]
        dz = g[:, None] * self.head
        wide = np.repeat(dz, sizes, axis=0)
        da = (wide * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
        dts = de[:, None] * self.attend
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * wide + dt @ self.gate_tanh.T + ds @ self.gate_sigmoid.T
        du = dh * (1 - f["h"] ** 2)
        return [
            f["u"].T @ du + l2 * self.encode,
            du.sum(axis=0),
            f["h"].T @ dt,
            f["h"].T @ ds,
            (f["t"] * f["s"]).T @ de,
            f["z"].T @ g + l2 * self.head,
            np.array([g.sum()]),
        ]

    def scores(self, texts: list[str]) -> np.ndarray:
        bags = [passages(t) for t in texts]
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return sigmoid(self.forward(np.concatenate(bags), starts)["logit"] + self.shift) if bags else np.zeros(0)


def fit_attention_model(
    receipts: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    threshold: float = 0.3,
    per_class: int = 1500,
    width: int = 24,
    attention: int = 12,
    steps: int = 250,
    l2: float = 1e-4,
    seed: int = 11,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
) -> AttentionModel:
    """Fits to at most `per_class` labelled answers of each class (by hash of the id), with
    all their passages. The best cut of a held-out quarter is put at `threshold`; without
    answers of both classes every score is one half."""
    sample = labelled_sample(receipts, labels, label, per_class, cell_id, response_content)

    @arrow_udf("binary")
    def encoded(column: pa.Array) -> pa.Array:
        return pa.array([passages(t).tobytes() for t in column.to_pylist()], pa.binary())

    rows = sample.select(F.xxhash64(F.col("cell_id").cast("string")).alias("h"), "label", encoded("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["h"], r["label"], bytes(r["x"])))
    y = np.array([r["label"] for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    shapes = ((FEATURES, width), (width,), (width, attention), (width, attention), (attention,), (width,), (1,))
    first = [rng.standard_normal(s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s) for s in shapes]
    first[4] = rng.standard_normal(attention) / np.sqrt(attention)
    model = AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), *first)
    if not len(y) or y.min() == y.max():
        return model
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    held = held_rows(np.array([r["h"] for r in rows], np.int64))
    fit = np.flatnonzero(~held)
    x = np.concatenate([bags[i] for i in fit]).astype(np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.02
    adam = Adam(model.parameters(), 0.02)
    balance = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum()))
    for step in range(steps):
        batch = fit[np.arange(step * 256, step * 256 + 256) % len(fit)] if len(fit) > 256 else fit
        if len(fit) > 256 and step * 256 % len(fit) < 256:
            rng.shuffle(fit)
        x = np.concatenate([bags[i] for i in batch]).astype(np.float64)
        starts = np.cumsum([0, *(len(bags[i]) for i in batch[:-1])])
        f = model.forward(x, starts)
        g = (sigmoid(f["logit"]) - y[batch]) * balance[batch]
        adam.move(model.gradients(f, starts, g / balance[batch].sum(), l2))
    at = np.flatnonzero(held)
    starts = np.cumsum([0, *(len(bags[i]) for i in at[:-1])])
    logit = model.forward(np.concatenate([bags[i] for i in at]).astype(np.float64), starts)["logit"]
    model.shift = float(np.log(threshold / (1 - threshold)) - best_logit(logit, y[at]))
    return model


def quality_scores(
    receipts: DataFrame, model: AttentionModel, score: str = "quality_score", response_content: str = RESPONSE
) -> DataFrame:
    """The answers with one more column, the score from 0 to 1 (a column called like it is
    replaced). A null or empty answer has one passage without words."""

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = column.to_pylist()
            parts = [model.scores(texts[low : low + 128]) for low in range(0, len(texts), 128)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
        hand_back_memory()

    return receipts.withColumn(score, scored(text_or_empty(response_content)))
