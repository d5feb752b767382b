"""Nearest curves by inner product: probed lists, scanned a few dimensions at a time.

Curves are put in lists around centres fitted to a bounded sample, and turned by one
random rotation. A curve is a multiple of the query and a part across it, and a turn sends
that part anywhere; so of a curve with a given score the columns seen hold the query's
share of that score, give or take what is as good as a normal variable. After each block
of columns this hypothesis is tested for the least score of the best k, and candidates
that fall short of it do not go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import key_type, written

QUERY_BLOCK = 1 << 16


def taking_part(vec: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of `dim` numbers each."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def fit_centres(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of the sample's directions."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = unit[rng.choice(len(unit), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fall_short(least: float, length: np.ndarray, whole: float, q_left: float, dim: int, sigmas: float) -> np.ndarray:
    """Inner products of the columns seen that curves of these lengths stay above (but for
    `sigmas`) if they score `least` or more with a query of length `whole`, of which
    `q_left` is in the columns not seen.

    With cosine c the mean is c times the query's share seen, and the part across, of
    length sin, adds a coordinate of a random direction in dim - 1 dimensions.
    """
    seen = max(0.0, whole**2 - q_left**2)
    mean, spread = seen / whole, sigmas * np.sqrt(seen) * q_left / whole / np.sqrt(max(1, dim - 1))
    # what scores more has a larger mean and less spread, from the cosine where both meet
    lowest = -mean / max(np.hypot(mean, spread), 1e-300)
    cosine = np.clip(least / np.maximum(whole * length, 1e-300), lowest, 1.0)
    return length * (cosine * mean - np.sqrt(1 - cosine**2) * spread) - 1e-9 * (1 + whole * length)


class Cell:
    """The curves of some lists, turned, with the lengths of what each column block leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, turn: np.ndarray, block: int):
        by = np.argsort(lists, kind="stable")
        self.ids, self.vectors, lists = ids[by], vectors[by], lists[by]
        self.turned = self.vectors @ turn
        self.turn = turn
        self.cuts = list(range(block, turn.shape[0], block))
        self.rest = [np.linalg.norm(self.turned[:, c:], axis=1) for c in self.cuts]
        self.length = np.linalg.norm(self.turned, axis=1)
        self.begun = np.ascontiguousarray(self.turned[:, : self.cuts[0] if self.cuts else 0])
        names, first = np.unique(lists, return_index=True)
        self.slices = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(lists)], strict=True), strict=True))

    def runs(self, probed: list[int], first: int = 256, most: int = 4096) -> Iterator[np.ndarray]:
        """The rows of the lists, nearest lists first, a few lists at a time and then more."""
        held, size = [], 0
        for name in probed:
            low, high = self.slices.get(name, (0, 0))
            held.append(np.arange(low, high))
            size += high - low
            if size >= first:
                yield np.concatenate(held)
                held, size, first = [], 0, min(2 * first, most)
        if size:
            yield np.concatenate(held)

    def search(self, own: object, query: np.ndarray, probed: list[int], k: int, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the best k (by score, then id) of the probed lists."""
        turned = query @ self.turn
        whole = np.linalg.norm(turned)
        ahead = [np.linalg.norm(turned[c:]) for c in self.cuts]
        best_rows, best, least = np.zeros(0, np.int64), np.zeros(0), -np.inf
        begun = self.begun @ turned[: self.begun.shape[1]]
        for rows in self.runs(probed):
            rows = rows[self.ids[rows] != own]
            partial, start = begun[rows], self.begun.shape[1]
            for cut, left, q_left in zip(self.cuts, self.rest, ahead, strict=True):
                if cut > start:
                    partial += self.turned[rows, start:cut] @ turned[start:cut]
                start = cut
                if least > -np.inf:
                    can = partial >= fall_short(least, self.length[rows], whole, q_left, len(turned), sigmas)
                    can &= partial + q_left * left[rows] >= least
                    rows, partial = rows[can], partial[can]
                if not len(rows):
                    break
            if not len(rows):
                continue
            score = (self.vectors[rows] * query).sum(axis=1)
            best_rows, best = np.concatenate([best_rows, rows]), np.concatenate([best, score])
            if len(best) > k:
                order = np.lexsort((self.ids[best_rows], -best))[:k]
                best_rows, best = best_rows[order], best[order]
            if len(best) == k:
                least = best.min() - 1e-9 * (1 + abs(best.min()))
        return best_rows, best


def nearest_curves(
    curves: DataFrame,
    is_query: Column,
    k: int = 20,
    probe_share: float = 0.8,
    sample_rows: int = 16_384,
    most_lists: int = 4_096,
    cell_rows: int = 8_192,
    column_block: int = 16,
    sigmas: float = 4.0,
    seed: int = 7,
    id: str = "id",  # noqa: A002
    vec: str = "vec",
) -> DataFrame:
    """The k curves with the largest inner product for every curve that `is_query` marks:
    query_id, rank (from 1), id, score (double precision, on the vectors as given), and
    query_key, a hash of the vector that asks.

    All curves are candidates but the query's own. Curves that are null, zero, or hold
    null or non-finite components take no part, nor do those of another length than most
    (the smaller one if two are as frequent). Rows with the same id and vector are one
    curve, and a query if one of them is marked; ids are numbers. Of an id with several
    vectors each asks for itself, and has ranks of its own: query_key tells them apart.
    None of the id's vectors is an answer to it. A query looks into the nearest `probe_share` of the lists, and
    more until they hold over k curves, so it gets all there are if they are fewer. Equal
    scores go by id. Centres are fitted to at most `sample_rows` curves (by hash of the
    id); every curve is in a list. Lists of more than `cell_rows` curves are cut by hash.
    """
    spark = curves.sparkSession
    typed = curves.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = typed.filter(taking_part(F.col("vec")) & F.col("id").isNotNull())
    common = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    kind = key_type(typed, "id")
    schema = f"query_id {kind}, rank int, id {kind}, score double, query_key long"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = written(good.filter(F.size("vec") == dim).groupBy("id", "vec").agg(F.max("is_query").alias("is_query")), "curves")
    n = rows.count()
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample_rows).collect()])
    lists = int(min(most_lists, len(sample), max(1, round(n**0.5))))
    centres, turn = fit_centres(sample, lists, seed), rotation(dim, seed)

    @arrow_udf("int")
    def own_list(column: pa.Array) -> pa.Array:
        return pa.array(np.argmax(matrix(column, dim) @ centres.T, axis=1).astype(np.int32))

    listed = written(rows.withColumn("list", own_list("vec")), "listed-curves")
    # one number per list: at most `most_lists`
    sizes = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    # cells: large lists in blocks, small ones together
    blocks = np.maximum(1, -(-sizes // cell_rows))
    cell_of, filled, cells = np.zeros(lists, np.int64), 0, 0
    for i in range(lists):
        if blocks[i] > 1 or filled + sizes[i] > cell_rows:
            cells, filled = cells + (filled > 0), 0
        cell_of[i] = cells
        if blocks[i] > 1:
            cells += int(blocks[i])
        else:
            filled += int(sizes[i])
    cells += filled > 0
    least_lists = max(1, int(np.ceil(probe_share * lists)))

    @arrow_udf("array<struct<cell:bigint,lists:array<int>>>")
    def probes(column: pa.Array) -> pa.Array:
        out = []
        for near in np.argsort(-(matrix(column, dim) @ centres.T), axis=1, kind="stable"):
            enough = int(np.searchsorted(np.cumsum(sizes[near]), k + 1)) + 1
            by_cell: dict[int, list[int]] = {}
            for i in near[: max(least_lists, enough)].tolist():
                for b in range(int(blocks[i])):
                    by_cell.setdefault(int(cell_of[i]) + b, []).append(i)
            out.append([{"cell": c, "lists": ls} for c, ls in by_cell.items()])
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int64()), ("lists", pa.list_(pa.int32()))])))

    queries = listed.filter("is_query").select("id", "vec")
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    numbers = F.array(*[F.lit(int(b)) for b in blocks]), F.array(*[F.lit(int(c)) for c in cell_of])
    placed = listed.select(
        (F.get(numbers[1], F.col("list")) + F.pmod(F.xxhash64("id"), F.get(numbers[0], F.col("list")).cast("long"))).cast("long").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(False).alias("asks"),
        "id",
        "vec",
        F.array("list").alias("lists"),
        F.lit(0).cast("long").alias("query_key"),
    )
    asking = queries.select(
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int").alias("part"), "id", "vec", F.explode(probes("vec")).alias("p")
    ).select("p.cell", "part", F.lit(True).alias("asks"), "id", "vec", "p.lists", F.xxhash64("vec").alias("query_key"))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells * parts, 4096))
    dealt = placed.unionByName(asking).repartition(count, "cell", "part").sortWithinPartitions("cell", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, cell = None, [], None
        for batch in batches:
            where = np.column_stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
            asks = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).astype(bool)
            change = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1) | (asks[1:] != asks[:-1])]))
            for low, high in zip(change.tolist(), [*change[1:].tolist(), len(where)], strict=True):
                part = batch.slice(low, high - low)
                ids, vectors = np.asarray(part.column(3)), matrix(part.column(4), dim)
                if tuple(where[low]) != open_:
                    open_, held, cell = tuple(where[low]), [], None
                if not asks[low]:
                    held.append((ids, vectors, np.asarray(part.column(5).flatten())))
                    continue
                if not held and cell is None:
                    continue
                if cell is None:
                    cell, held = Cell(*[np.concatenate(x) for x in zip(*held, strict=True)], turn, column_block), []
                found = []
                for own, vector, probed, key in zip(ids, vectors, part.column(5).to_pylist(), np.asarray(part.column(6)), strict=True):
                    at, score = cell.search(own, vector, probed, k, sigmas)
                    found.append((np.repeat(own, len(at)), np.repeat(key, len(at)), cell.ids[at], score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "query_key", "id", "score"]
                )

    best = dealt.mapInArrow(run, f"query_id {kind}, query_key long, id {kind}, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score", "query_key")
