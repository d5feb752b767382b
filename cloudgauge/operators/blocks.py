"""Block products: work on all pairs of two clouds without writing the pairs out.

Every cloud is cut by hash into blocks of bounded size. A left block meets a right block
of the same cloud in one task, which reduces the distance matrix to a few numbers per
row. A cloud that holds a third of the table therefore spreads over
(rows/left_rows)*(rows/right_rows) equal tasks, and a row travels once per block of the
other side, which is the least an exact all-pairs job can do with that much task memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudgauge.session import attach, settle

LEFT_ROWS = 1024
RIGHT_ROWS = 4096
SMALL_BLOCKS = 8  # of a cloud; more are made only where blocks would be too large
_TILE_BYTES = 8 << 20


def cloud_sizes(df: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))


def block_product(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: str,
    right_id: str,
    fn: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
    same_cloud: bool = False,
) -> DataFrame:
    """Run `fn(left_block, right_block)` for every pair of blocks of the same cloud.

    Where blocks of the given sizes would be many, they are larger, up to `LEFT_ROWS` and
    `RIGHT_ROWS`: a row is sent as often as the other side has blocks.

    Ids must be unique within a cloud; an empty `on` makes the table one cloud. With `same_cloud` both sides are one table cut the
    same way and only block pairs (i <= j) run; `fn` then sees the columns `__l`, `__r`.
    """
    if same_cloud:
        right_rows = left_rows

    def blocks_in(rows: int, most_rows: int) -> Column:
        n = F.count(F.lit(1))
        few = F.greatest(F.ceil(n / max(rows, most_rows)), F.lit(SMALL_BLOCKS))
        return F.greatest(F.least(F.ceil(n / rows), few), F.lit(1)).cast("int")

    if on:
        shape, small = settle(
            left.groupBy(*on)
            .agg(blocks_in(left_rows, LEFT_ROWS).alias("__nl"))
            .join(right.groupBy(*on).agg(blocks_in(right_rows, LEFT_ROWS if same_cloud else RIGHT_ROWS).alias("__nr")), on)
        )
    else:
        # one cloud for the whole table: its shape is one row
        shape = left.agg(blocks_in(left_rows, LEFT_ROWS).alias("__nl")).join(
            F.broadcast(right.agg(blocks_in(right_rows, LEFT_ROWS if same_cloud else RIGHT_ROWS).alias("__nr")))
        )

    def block_of(id_col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_col)), F.col(n)).cast("int")

    def spread(df: DataFrame, id_col: str, own: str, own_n: str, other: str, others: Column) -> DataFrame:
        # re-aliasing keeps the two sides apart when both come from one table
        return (
            (attach(df, shape, small, on) if on else df.join(F.broadcast(shape)))
            .withColumn(own, block_of(id_col, own_n))
            .withColumn(other, F.explode(others))
            .select(*[F.col(c).alias(c) for c in [*df.columns, "__l", "__r"]])
        )

    if same_cloud:
        l = spread(left, left_id, "__l", "__nl", "__r", F.sequence(F.col("__l"), F.col("__nl") - 1))
        r = spread(right, right_id, "__r", "__nr", "__l", F.sequence(F.lit(0), F.col("__r")))
    else:
        l = spread(left, left_id, "__l", "__nl", "__r", F.sequence(F.lit(0), F.col("__nr") - 1))
        r = spread(right, right_id, "__r", "__nr", "__l", F.sequence(F.lit(0), F.col("__nl") - 1))
    keys = [*on, "__l", "__r"]
    return l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(fn, schema)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """The rows of an array<double> column as a matrix."""
    n = table.num_rows
    flat = table.column(column).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def tiles(a: np.ndarray, b: np.ndarray):
    """Row ranges of `a` whose differences to all of `b` stay within a few megabytes."""
    step = max(1, _TILE_BYTES // max(1, b.size * 8))
    for start in range(0, len(a), step):
        yield slice(start, min(start + step, len(a)))


def rms_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """sqrt(mean((x-y)^2)) of every row pair, by differences.

    The expanded form with dot products is faster but rounds differently from block to
    block, which would break ties between equal curves; here equal rows give equal
    distances wherever they meet.
    """
    out = np.empty((len(a), len(b)))
    for part in tiles(a, b):
        diff = a[part][:, None, :] - b[None, :, :]
        np.multiply(diff, diff, out=diff)
        out[part] = diff.sum(axis=2)
    return np.sqrt(out / a.shape[1])


def near_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances by products, which are fast, and for each row of `a` by how much they
    may be off at most. For what does not depend on the last digits."""
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    squares = a @ b.T
    squares *= -2.0
    squares += size_a[:, None]
    squares += size_b
    np.maximum(squares, 0.0, out=squares)
    squares /= a.shape[1]
    off = 1e-6 * (np.sqrt(size_a) + np.sqrt(size_b.max(initial=0.0))) / np.sqrt(a.shape[1])
    return np.sqrt(squares, out=squares), off


def paired_distances(a: np.ndarray, b: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """`rms_distances` of each row of `a` to the row of `b` beside it, with the same digits."""
    out = np.empty(len(a))
    for part in (slice(low, low + step) for low in range(0, len(a), step)):
        diff = a[part] - b[part]
        out[part] = np.multiply(diff, diff, out=diff).sum(axis=1)
    return np.sqrt(out / a.shape[1])


def self_positions(left_ids: pa.ChunkedArray, right_ids: pa.ChunkedArray) -> np.ndarray:
    """For each left id its place among the right ids, or -1."""
    where = {v: i for i, v in enumerate(right_ids.to_pylist())}
    return np.array([where.get(v, -1) for v in left_ids.to_pylist()], dtype=np.int64)
