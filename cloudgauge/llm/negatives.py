"""Hard negatives from an inverted multi-index: rows that look like an anchor but are not.

Both halves of a vector have a codebook; the two codewords of a row are its cell. An inner
product is the sum of two half products, and a half product is at most the one with the
codeword plus the length of the anchor's half times the codeword's radius. Cells are
visited by the sum of these two bounds, largest first, and the walk ends once no cell that
is left can change what was found. So results are exact; how much is skipped depends on
how the vectors cluster.

The index is a table with one row per shard. Rows are dealt to shards by hash, so no cell,
label or repeated vector makes a shard larger than the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.llm.common import key_type, written

LARGEST = 1 << 25  # of a scaled component, so that scores fit into a long
EXACT = 1 << 53


def fit_codebook(half: np.ndarray, codewords: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Means of groups of near rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(half, axis=0)
    book = distinct[rng.choice(len(distinct), min(codewords, len(distinct)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest_codeword(half, book)
        count = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, half)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return book


def nearest_codeword(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * (half @ book.T), axis=1)


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of every pair, by first[i] + second[j], largest first: the pair
    (a, b) in sorted order is put on the heap by (a, b - 1), or by (a - 1, 0)."""
    order1, order2 = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    by1, by2, names1, names2 = first[order1].tolist(), second[order2].tolist(), order1.tolist(), order2.tolist()
    heap = [(-(by1[0] + by2[0]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, names1[a], names2[b]
        if b + 1 < len(by2):
            heapq.heappush(heap, (-(by1[a] + by2[b + 1]), a, b + 1))
        if b == 0 and a + 1 < len(by1):
            heapq.heappush(heap, (-(by1[a + 1] + by2[0]), a + 1, 0))


class Wanted:
    """The first `most` rows with a score from `low` to `high`, by score and then id."""

    def __init__(self, low: float, high: float, most: int):
        self.low, self.high, self.most = low, high, most
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.need()) & (scores <= self.high)
        if not fit.any():
            return
        ids, scores = np.concatenate([self.ids, ids[fit]]), np.concatenate([self.scores, scores[fit]])
        best = np.lexsort((ids, -scores))[: self.most]
        self.ids, self.scores = ids[best], scores[best]

    def need(self) -> float:
        """What scores less can't change the result any more."""
        return max(self.low, self.scores[-1]) if len(self.scores) == self.most else self.low


class Shard:
    """The rows of one shard in order of their cells, and the radius of every codeword."""

    def __init__(self, ids: np.ndarray, labels: list[str], vectors: np.ndarray, cells: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.ids, self.vectors, self.books = ids, vectors, books
        names, self.label = np.unique(np.array(labels, object), return_inverse=True)
        self.label_code = {name: i for i, name in enumerate(names.tolist())}
        self.half = books[0].shape[1]
        n2 = len(books[1])
        self.starts = np.searchsorted(cells, np.arange(len(books[0]) * n2 + 1)).tolist()
        self.present, self.radius = [], []
        for own, part, book in ((cells // n2, vectors[:, : self.half], books[0]), (cells % n2, vectors[:, self.half :], books[1])):
            far = np.zeros(len(book))
            np.maximum.at(far, own, np.linalg.norm(part - book[own], axis=1))
            present = np.unique(own)
            self.present.append(present)
            self.radius.append(far[present])
        self.largest = float(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def half_bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both halves: least and largest half product of each codeword's rows."""
        out = []
        for at, part in enumerate((anchor[: self.half], anchor[self.half :])):
            part = part.astype(np.float64)
            middle = self.books[at][self.present[at]] @ part
            reach = np.linalg.norm(part) * self.radius[at]
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            out.append((middle - reach - slack, middle + reach + slack))
        return out

    def search(self, own: int, anchor: np.ndarray, allowed: np.ndarray, wanted: list[Wanted], first: int = 256, most: int = 4096) -> None:
        """Fill `wanted` from the allowed rows but the anchor's own."""
        (low1, up1), (low2, up2) = self.half_bounds(anchor)
        n2, top = len(self.books[1]), max(w.high for w in wanted)
        need, held, size = min(w.need() for w in wanted), [], 0
        for bound, a, b in cells_by_bound(up1, up2):
            if bound < need:  # of every window all is found, or all that is left lies below
                break
            cell = int(self.present[0][a]) * n2 + int(self.present[1][b])
            start, end = self.starts[cell], self.starts[cell + 1]
            if start == end or low1[a] + low2[b] > top:
                continue
            held.append((start, end))
            size += end - start
            if size >= first:
                self.look(own, anchor, allowed, wanted, held)
                need, held, size, first = min(w.need() for w in wanted), [], 0, min(2 * first, most)
        if held:
            self.look(own, anchor, allowed, wanted, held)

    def look(self, own: int, anchor: np.ndarray, allowed: np.ndarray, wanted: list[Wanted], held: list[tuple[int, int]]) -> None:
        rows = np.concatenate([np.arange(low, high) for low, high in held])
        rows = rows[allowed[rows] & (self.ids[rows] != own)]
        if len(rows):
            scores, ids = self.scores(rows, anchor), self.ids[rows]
            for w in wanted:
                w.add(ids, scores)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).astype(np.int64).reshape(-1, dim)


def packed(rows: DataFrame, number: Column, books: tuple[np.ndarray, np.ndarray], dim: int) -> DataFrame:
    """One row per number: the rows that have it in order of their cells, as lists."""

    def pack(table: pa.Table) -> pa.Table:
        vectors = matrix(table["vec"], dim)
        half = books[0].shape[1]
        cells = nearest_codeword(vectors[:, :half], books[0]) * len(books[1]) + nearest_codeword(vectors[:, half:], books[1])
        order = np.argsort(cells, kind="stable")
        table = table.take(pa.array(order))
        as_list = lambda name: pa.ListArray.from_arrays([0, len(order)], table[name].combine_chunks())
        return pa.table(
            {
                "number": table["number"].slice(0, 1),
                "ids": as_list("id"),
                "labels": as_list("label"),
                "keys": as_list("key"),
                "positive_ids": as_list("positive_ids"),
                "positive_scores": as_list("positive_scores"),
                "cells": pa.array([cells[order].astype("<i4").tobytes()], pa.binary()),
                "vectors": pa.array([vectors[order].astype("<i4").tobytes()], pa.binary()),
            }
        )

    schema = (
        "number int, ids array<bigint>, labels array<string>, keys array<bigint>, positive_ids array<array<bigint>>,"
        " positive_scores array<array<bigint>>, cells binary, vectors binary"
    )
    return rows.withColumn("number", number.cast("int")).groupBy("number").applyInArrow(pack, schema)


def met(packs: DataFrame, shards: DataFrame, n_packs: int, n_shards: int, fn, schema: str) -> DataFrame:
    """fn(pack row, shard row) for every pack of anchors and every shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packs.withColumn("pack", F.col("number")).withColumn("shard", every(n_shards))
    right = shards.withColumn("shard", F.col("number")).withColumn("pack", every(n_packs))
    return left.groupBy("pack", "shard").cogroup(right.groupBy("pack", "shard")).applyInArrow(run, schema)


def opened(table: pa.Table, dim: int) -> dict:
    row = table.slice(0, 1).to_pylist()[0] if table.num_rows else None
    if row is None:
        return {}
    vectors = np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(-1, dim)
    return row | {"vectors": vectors, "cells": np.frombuffer(row["cells"], "<i4").astype(np.int64), "ids": np.array(row["ids"], np.int64)}


def hard_negatives(
    curves: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    codewords: int = 16,
    sample_rows: int = 16_384,
    shard_rows: int = 8_192,
    pack_rows: int = 512,
    seed: int = 7,
    id: str = "id",  # noqa: A002
    descriptor: str = "descriptor",
    vec: str = "vec",
) -> DataFrame:
    """For each anchor and each of its first `positives` other curves of the same
    descriptor, the first `negatives` curves of another descriptor whose score is from
    `window[0]` to `window[1]` hundredths of the positive's: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score.

    A score is the inner product with the anchor of components floor(scale * x), an
    integer; larger ones come first, equal ones by the smaller id. Curves with a null id,
    descriptor or vector, a null or non-finite component, or one beyond 2^25 after
    scaling take no part, nor do those of another length than most (the smaller one if
    two are as frequent). Rows with the same id, descriptor and vector are one curve and an
    anchor if one of them is marked; ids are whole numbers. Of an id with several curves
    each is an anchor of its own, and none of them is a positive or negative of another.
    Anchors without a positive, and positives without a curve in the window, give no rows;
    an empty table gives none. Other columns are not read.

    Codebooks are fitted to at most `sample_rows` curves (by hash of the id); all curves are
    in the index, and the search of a shard is exact. Each pack of `pack_rows` anchors meets each shard of
    about `shard_rows` curves in a task of its own: first for positives, then, with their
    scores known, for the windows.
    """
    spark = curves.sparkSession
    number = F.col(vec).cast("array<double>")
    typed = curves.select(
        F.col(id).cast("long").alias("id"),
        F.col(descriptor).cast("string").alias("label"),
        number.alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    fits = F.forall("vec", lambda x: F.coalesce((F.abs(x * scale) <= LARGEST) & ~F.isnan(x), F.lit(False)))
    good = typed.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & fits & (F.size("vec") > 0))
    common = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "anchor_id {0}, positive_id {0}, rank int, negative_id {0}, positive_score long, negative_score long".format(key_type(curves, id))
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    whole = F.transform("vec", lambda x: F.floor(x * scale).cast("int"))
    rows = written(
        good.filter(F.size("vec") == dim)
        .groupBy("id", "label", "vec")
        .agg(F.max("is_anchor").alias("is_anchor"))
        .select("id", "label", whole.alias("vec"), "is_anchor", F.xxhash64("id", "label", "vec").alias("key")),
        "negatives-curves",
    )
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    if not counts["anchors"]:
        return spark.createDataFrame([], schema)
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id", "key").limit(sample_rows).select("vec").collect()], np.float64)
    half = dim // 2
    books = fit_codebook(sample[:, :half], codewords, seed), fit_codebook(sample[:, half:], codewords, seed + 1)
    n_shards, n_packs = -(-counts["n"] // shard_rows), -(-counts["anchors"] // pack_rows)
    none = F.array().cast("array<bigint>")
    plain = rows.withColumns({"positive_ids": none, "positive_scores": none})
    shards = written(packed(plain, F.pmod("key", F.lit(n_shards)), books, dim), "negatives-index")
    of_pack = F.pmod(F.xxhash64("key"), F.lit(n_packs))

    def first_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, held = opened(left, dim), opened(right, dim)
        out: list[list[np.ndarray]] = []
        if anchors and held:
            shard = Shard(held["ids"], held["labels"], held["vectors"], held["cells"], books)
            for own, label, key, anchor in zip(anchors["ids"], anchors["labels"], anchors["keys"], anchors["vectors"], strict=True):
                allowed = shard.label == shard.label_code.get(label, -1)
                if not allowed.any():
                    continue
                found = Wanted(-np.inf, np.inf, positives)
                shard.search(own, anchor, allowed, [found])
                out.append([np.repeat(key, len(found.ids)), found.ids, found.scores])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["key", "id", "score"])

    asking = packed(plain.filter("is_anchor"), of_pack, books, dim)
    near = met(asking, shards, n_packs, n_shards, first_positives, "key long, id long, score long")
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= positives)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "id", "score")))  # at most `positives`
    pairs = best.groupBy("key").agg(ordered.alias("p"))
    known = rows.filter("is_anchor").join(pairs, "key").withColumns({"positive_ids": F.col("p.id"), "positive_scores": F.col("p.score")}).drop("p")
    least, most = window

    def first_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, held = opened(left, dim), opened(right, dim)
        out: list[list[np.ndarray]] = []
        if anchors and held:
            shard = Shard(held["ids"], held["labels"], held["vectors"], held["cells"], books)
            each = (anchors[c] for c in ("ids", "labels", "keys", "vectors", "positive_ids", "positive_scores"))
            for own, label, key, anchor, ids, scores in zip(*each, strict=True):
                wanted = [Wanted(-(-least * p // 100), most * p // 100, negatives) for p in scores]
                can = [w for w in wanted if w.low <= w.high]
                if not can:
                    continue
                shard.search(own, anchor, shard.label != shard.label_code.get(label, -1), can)
                for i, p, w in zip(ids, scores, wanted, strict=True):
                    k = len(w.ids)
                    out.append([np.repeat(x, k) for x in (own, key, i, p)] + [w.ids, w.scores])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["anchor_id", "key", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = met(
        packed(known, of_pack, books, dim),
        shards,
        n_packs,
        n_shards,
        first_negatives,
        "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    kind = key_type(curves, id)
    return ranked.select(
        F.col("anchor_id").cast(kind),
        F.col("positive_id").cast(kind),
        "rank",
        F.col("negative_id").cast(kind),
        "positive_score",
        "negative_score",
    )
