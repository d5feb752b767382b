"""Distances of curves to labelled clouds.

A curve table has an id, a cloud key (one or more columns) and `vec array<double>`.
Distance is the root mean square difference over the bins, so the normaliser follows the
vector length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.operators import blocks
from cloudgauge.operators.ranks import running_counts
from cloudgauge.session import settled

# Half-width, in standard errors of a sample quantile, of the bracket around the median.
_BRACKET_SE = 4.0
_PIVOTS = 32
# Brackets that would hold more distances of a row are cut into bins and narrowed first.
_INSIDE_ROWS = 512
_BINS = 64


def pack_curve(long: DataFrame, keys: list[str], pos: str = "bin", value: str = "db", out: str = "vec") -> DataFrame:
    """(key, bin, db) rows to one array per key, ordered by bin."""
    pairs = F.array_sort(F.collect_list(F.struct(pos, value)))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(out))


def unpack_curve(packed: DataFrame, keys: list[str], vec: str = "vec", pos: str = "bin", value: str = "db") -> DataFrame:
    return packed.select(*keys, F.posexplode(vec).alias(pos, value))


def lsd_distance(a: Column, b: Column) -> Column:
    """Root mean square difference of two arrays of one row."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(a))


def mean_curve(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Mean array per group: (by, n, mean_vec). Long form keeps the sums mergeable."""
    per_bin = (
        df.select(*by, F.posexplode(vec).alias("bin", "x"))
        .groupBy(*by, "bin")
        .agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    )
    pairs = F.array_sort(F.collect_list(F.struct("bin", "m")))
    return per_bin.groupBy(*by).agg(
        F.max("n").alias("n"), F.transform(pairs, lambda p: p["m"]).alias("mean_vec")
    )


def _ddl(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _renamed(df: DataFrame, on: list[str], id_col: str, vec: str, new_id: str, *extra: str) -> DataFrame:
    return df.select(*on, F.col(id_col).alias(new_id), F.col(vec).alias("vec"), *extra)


# --- per-row reductions -------------------------------------------------------------


def distances_to_cloud(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: str,
    right_id: str,
    exclude_self: bool = False,
    carry: Sequence[str] = (),
    left_rows: int = blocks.LEFT_ROWS,
    right_rows: int = blocks.RIGHT_ROWS,
) -> DataFrame:
    """Each left row against the whole right cloud of its key.

    One row per left row: (on, left_id, carried left columns, n_pairs, sum_dist, min_dist,
    max_dist). With `exclude_self` a right row with the same id is left out.
    """
    carry = list(carry)
    l = _renamed(left, on, left_id, "vec", "lid", *carry)
    r = _renamed(right, on, right_id, "vec", "rid")
    id_type = left.schema[left_id].dataType.simpleString()
    extra = f", {_ddl(left, carry)}" if carry else ""
    out_schema = f"{_ddl(left, on)}, lid {id_type}{extra}, n long, s double, lo double, hi double"

    def reduce(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _empty(a, b, on, ["n", "s", "lo", "hi"], carry)
        d = blocks.rms_distances(blocks.matrix(a, "vec"), blocks.matrix(b, "vec"))
        lo, hi, n = d.copy(), d.copy(), np.full(len(d), d.shape[1], dtype=np.int64)
        if exclude_self:
            at = blocks.self_positions(a["lid"], b["rid"])
            rows = np.nonzero(at >= 0)[0]
            d[rows, at[rows]] = 0.0
            lo[rows, at[rows]] = np.inf
            hi[rows, at[rows]] = -np.inf
            n[rows] -= 1
        keep = n > 0
        kept = a.filter(pa.array(keep)).select([*on, "lid", *carry])
        return (
            kept.append_column("n", pa.array(n[keep]))
            .append_column("s", pa.array(d.sum(axis=1)[keep]))
            .append_column("lo", pa.array(lo.min(axis=1)[keep]))
            .append_column("hi", pa.array(hi.max(axis=1)[keep]))
        )

    parts = blocks.block_product(l, r, on, "lid", "rid", reduce, out_schema, left_rows, right_rows)
    return parts.groupBy(*on, F.col("lid").alias(left_id), *carry).agg(
        F.sum("n").alias("n_pairs"),
        F.sum("s").alias("sum_dist"),
        F.min("lo").alias("min_dist"),
        F.max("hi").alias("max_dist"),
    )


def _empty(a: pa.Table, b: pa.Table, on: list[str], measures: list[str], carry: Sequence[str] = ()) -> pa.Table:
    kinds = {"n": pa.int64(), "computed": pa.int64()}
    cols = {k: (a if k in a.column_names else b)[k].slice(0, 0) for k in on}
    for c in ("lid", *carry):
        cols[c] = a[c].slice(0, 0)
    cols.update({m: pa.array([], kinds.get(m, pa.float64())) for m in measures})
    return pa.table(cols)


def pairs_to_cloud(pred: DataFrame, gold: DataFrame, on: list[str], pred_id: str, gold_id: str, **sizes) -> DataFrame:
    """Every prediction against every gold curve of its label, reduced per prediction."""
    return distances_to_cloud(pred, gold, on, pred_id, gold_id, **sizes)


def pairs_leave_one_out(cloud: DataFrame, on: list[str], id_col: str, **sizes) -> DataFrame:
    """Every curve against the other curves of its label, reduced per curve."""
    return distances_to_cloud(cloud, cloud, on, id_col, id_col, exclude_self=True, **sizes)


# --- whole-cloud reductions ---------------------------------------------------------


def pairs_unordered(cloud: DataFrame, on: list[str], id_col: str, block_rows: int = blocks.LEFT_ROWS) -> DataFrame:
    """All unordered pairs within a cloud: (on, n_rows, n_pairs, sum_dist, mean_dist).

    Clouds of one curve give zero pairs and a spread of 0.
    """
    c = _renamed(cloud, on, id_col, "vec", "lid")
    out_schema = f"{_ddl(cloud, on)}, n long, s double"

    def reduce(a: pa.Table, b: pa.Table) -> pa.Table:
        first = a if a.num_rows else b
        n, s = 0, 0.0
        if a.num_rows and b.num_rows:
            same = a["__l"][0].as_py() == a["__r"][0].as_py()
            x, y = blocks.matrix(a, "vec"), blocks.matrix(b, "vec")
            d = blocks.rms_distances(x, y)
            if same:
                # both sides hold the same rows: every pair twice, self pairs are 0
                n, s = len(x) * (len(x) - 1) // 2, float(d.sum()) / 2.0
            else:
                n, s = d.size, float(d.sum())
        keys = {k: first[k].slice(0, 1) for k in on}
        return pa.table({**keys, "n": pa.array([n], pa.int64()), "s": pa.array([s], pa.float64())})

    parts = blocks.block_product(c, c, on, "lid", "lid", reduce, out_schema, block_rows, same_cloud=True)
    pairs = parts.groupBy(*on).agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("sum_dist"))
    return (
        blocks.cloud_sizes(cloud, on, "n_rows")
        .join(pairs, on)
        .withColumn(
            "mean_dist", F.when(F.col("n_pairs") > 0, F.col("sum_dist") / F.col("n_pairs")).otherwise(0.0)
        )
    )


# --- exact medians ------------------------------------------------------------------


def median_to_cloud(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: str,
    right_id: str,
    out: str = "centrality",
    exclude_self: bool = False,
    left_rows: int = blocks.LEFT_ROWS,
    right_rows: int = blocks.RIGHT_ROWS,
    computed: str | None = None,
) -> DataFrame:
    """Exact median distance of each left row to the right cloud of its key.

    A first look at a hash sample of `right_rows` of the cloud settles rows whose cloud it
    is, and brackets the median of the others. These then meet the blocks of their cloud.
    A block is cut into cells around pivots; by the triangle inequality a cell may lie
    below or above a row's bracket as a whole, and is counted without its distances. Only
    distances inside the bracket leave the task; of a large cloud the bracket is narrowed
    by counts before. The few rows whose median escapes it are
    done again with an open bracket. Nothing is approximated. `computed` names a column
    for the number of distances that a row has taken after the first look.
    """
    l = _renamed(left, on, left_id, "vec", "lid")
    r = _renamed(right, on, right_id, "vec", "rid")
    base = f"{_ddl(l, on)}, lid {left.schema[left_id].dataType.simpleString()}"
    sizes = blocks.cloud_sizes(r, on, "__n")
    sized = r.join(sizes, on) if on else r.join(F.broadcast(sizes))
    sample = F.pmod(F.xxhash64(F.lit("pilot"), F.col("rid")), F.lit(1 << 20)) * F.col("__n") < F.lit(right_rows << 20)
    look = blocks.block_product(
        l, sized.filter(sample), on, "lid", "rid", _first_look(on, exclude_self), f"{base}, n long, m double, a double, b double", left_rows, right_rows * 4
    )
    # an edge of each block that the sample was cut into: the widest holds
    look = settled(look.groupBy(*on, "lid").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.min("a").alias("a"), F.max("b").alias("b")))
    done = look.filter("m is not null").select(*on, "lid", "n", "m", F.lit(0).cast("long").alias("computed"))
    beyond = sizes.filter(F.col("__n") > right_rows)
    of_large = l.join(beyond.select(*on), on, "left_semi") if on else l.join(F.broadcast(beyond)).drop("__n")
    edges = of_large.join(look.select(*on, "lid", "m", "a", "b"), [*on, "lid"], "left")
    open_ = edges.filter("m is null").drop("m").fillna({"a": -math.inf, "b": math.inf})
    large = sized.filter(F.col("__n") > right_rows).drop("__n")
    most = sizes.agg(F.max("__n")).first()[0] or 0
    inside = most * min(1.0, _BRACKET_SE / math.sqrt(right_rows))
    while inside > _INSIDE_ROWS:  # about as many distances of a row would leave the tasks
        open_ = settled(_narrowed(open_, large, on, base, exclude_self, left_rows, right_rows))
        inside /= _BINS / 2
    counted = _count_inside(open_, large, on, base, exclude_self, left_rows, right_rows)
    first = settled(_pick_median(counted, on))
    missed = first.filter("m is null").select(*on, "lid")
    again = l.join(missed, [*on, "lid"], "left_semi").select("*", F.lit(-math.inf).alias("a"), F.lit(math.inf).alias("b"))
    last = _pick_median(_count_inside(again, large, on, base, exclude_self, left_rows, right_rows), on)
    every = done.unionByName(first.filter("m is not null")).unionByName(last)
    extra = [F.col("computed").alias(computed)] if computed else []
    return every.select(*on, F.col("lid").alias(left_id), F.col("n").alias("n_pairs"), F.col("m").alias(out), *extra)


def _masked(a: pa.Table, b: pa.Table, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distance matrix with self pairs at +inf, and the number of real pairs per row."""
    d = blocks.rms_distances(blocks.matrix(a, "vec"), blocks.matrix(b, "vec"))
    n = np.full(len(d), d.shape[1], dtype=np.int64)
    if exclude_self:
        at = blocks.self_positions(a["lid"], b["rid"])
        rows = np.nonzero(at >= 0)[0]
        d[rows, at[rows]] = np.inf
        n[rows] -= 1
    return d, n


def _row_medians(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    d = np.sort(d, axis=1)
    rows = np.arange(len(d))
    return (d[rows, np.maximum(n - 1, 0) // 2] + d[rows, np.minimum(n // 2, d.shape[1] - 1)]) / 2.0


def _first_look(on: list[str], exclude_self: bool):
    """Per left row, against a sample of its cloud: the median if the sample is all of the
    cloud, and else a bracket that very likely holds it."""

    def look(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _empty(a, b, on, ["n", "m", "a", "b"])
        d, n = _masked(a, b, exclude_self)
        whole = b.num_rows == b["__n"][0].as_py()
        if whole:
            keep = n > 0
            none = pa.nulls(int(keep.sum()), pa.float64())
            kept, m = a.filter(pa.array(keep)).select([*on, "lid"]), pa.array(_row_medians(d, n)[keep])
            return kept.append_column("n", pa.array(n[keep])).append_column("m", m).append_column("a", none).append_column("b", none)
        d = np.sort(d, axis=1)
        rows = np.arange(len(d))
        half = _BRACKET_SE * 0.5 / np.sqrt(np.maximum(n, 1))
        lo_at = np.floor((0.5 - half) * n).astype(int) - 1
        hi_at = np.ceil((0.5 + half) * n).astype(int) + 1
        lo = np.where(lo_at >= 0, d[rows, np.clip(lo_at, 0, d.shape[1] - 1)], -np.inf)
        hi = np.where(hi_at < n, d[rows, np.clip(hi_at, 0, d.shape[1] - 1)], np.inf)
        out = a.select([*on, "lid"]).append_column("n", pa.array(np.maximum(n, 1))).append_column("m", pa.nulls(len(d), pa.float64()))
        return out.append_column("a", pa.array(lo)).append_column("b", pa.array(hi))

    return look


def _cells(y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(pivots, rows of each cell, least and largest distance to the pivot): every row goes
    to the nearest of a few rows that lie far from each other."""
    far, chosen = np.full(len(y), np.inf), [0]
    apart = np.empty((min(_PIVOTS, len(y)), len(y)))
    for i in range(len(apart)):
        apart[i] = blocks.rms_distances(y[chosen[i]][None, :], y)[0]
        far = np.minimum(far, apart[i])
        chosen.append(int(far.argmax()))
    own = apart.argmin(axis=0)
    members = [np.flatnonzero(own == i) for i in range(len(apart))]
    kept = [i for i, m in enumerate(members) if len(m)]
    members = [members[i] for i in kept]
    reach = [apart[i, m] for i, m in zip(kept, members, strict=True)]
    return y[[chosen[i] for i in kept]], members, np.array([x.min() for x in reach]), np.array([x.max() for x in reach])


def _narrowed(l, r, on, base, exclude_self, left_rows, right_rows) -> DataFrame:
    """The left rows with a bracket that is about `_BINS` times as narrow: a task counts
    the distances below the bracket and in each of its bins, and returns a row for each of
    its left rows. Distances are by products; as these are off by no more than `off`, so is
    their median, and the bracket is wider by that on both sides. Brackets that miss the
    median, or are open, stay."""

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _empty(a, b, on, ["below", "n", "off"]).append_column("bins", pa.array([], pa.list_(pa.int32())))
        x, y = blocks.matrix(a, "vec"), blocks.matrix(b, "vec")
        lo, hi = a["a"].to_numpy(), a["b"].to_numpy()
        below, bins, off = np.zeros(len(x)), np.zeros((len(x), _BINS), np.int32), np.zeros(len(x))
        n, own = np.full(len(x), len(y), dtype=np.int64), np.full(len(x), -1)
        if exclude_self:
            own = blocks.self_positions(a["lid"], b["rid"])
            n -= own >= 0
        bounded = np.isfinite(lo) & np.isfinite(hi) & (hi > lo)
        scale = np.where(bounded, _BINS / np.where(bounded, hi - lo, 1.0), 0.0)
        step = max(1, (1 << 20) // len(y))
        for part in (slice(low, min(low + step, len(x))) for low in range(0, len(x), step)):
            d, off[part] = blocks.near_distances(x[part], y)
            here = np.flatnonzero(own[part] >= 0)
            d[here, own[part][here]] = np.inf
            below[part] = (d < lo[part, None]).sum(axis=1)
            row, column = np.nonzero((d >= lo[part, None]) & (d <= hi[part, None]) & bounded[part, None])
            place = np.minimum((d[row, column] - lo[part][row]) * scale[part][row], _BINS - 1).astype(np.int64)
            bins[part] = np.bincount(row * _BINS + place, minlength=len(d) * _BINS).reshape(-1, _BINS)
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * _BINS)
        out = a.select([*on, "lid"]).append_column("below", pa.array(below)).append_column("n", pa.array(n)).append_column("off", pa.array(off))
        return out.append_column("bins", pa.ListArray.from_arrays(offsets, pa.array(bins.ravel())))

    # no cells here, so blocks are of the size that travels
    left_rows, right_rows = max(left_rows, blocks.LEFT_ROWS), max(right_rows, blocks.RIGHT_ROWS)
    schema = f"{base}, below double, n long, off double, bins array<int>"
    parts = blocks.block_product(l, r, on, "lid", "rid", count, schema, left_rows, right_rows)
    summed = parts.groupBy(*on, "lid").agg(
        F.sum("below").alias("below"),
        F.sum("n").alias("n"),
        F.max("off").alias("off"),
        F.array(*[F.sum(F.get("bins", F.lit(i))).cast("double") for i in range(_BINS)]).alias("bins"),
    )

    @F.pandas_udf("struct<a:double,b:double>")
    def bracket(a: pd.Series, b: pd.Series, below: pd.Series, n: pd.Series, off: pd.Series, bins: pd.Series) -> pd.DataFrame:
        lo, hi, slack = (s.to_numpy(float) for s in (a, b, off))
        upto = below.to_numpy(float)[:, None] + np.cumsum(np.stack(bins.to_list()), axis=1)
        size = n.to_numpy(float)
        first, last = ((upto <= np.floor(at)[:, None]).sum(axis=1) for at in ((size - 1) / 2, size / 2))
        held = (below.to_numpy(float) <= np.floor((size - 1) / 2)) & (last < _BINS) & np.isfinite(lo) & np.isfinite(hi) & (hi > lo)
        width = np.where(held, hi - lo, 0.0) / _BINS
        # the places of bins are rounded too
        slack = slack + 1e-9 * width
        low, high = np.where(held, lo, 0.0) + first * width - slack, np.where(held, lo, 0.0) + (last + 1) * width + slack
        return pd.DataFrame({"a": np.where(held, low, lo), "b": np.where(held, high, hi)})

    told = l.join(summed, [*on, "lid"], "left")
    empty = F.coalesce("bins", F.array_repeat(F.lit(0.0), _BINS))
    zero = F.lit(0)
    new = bracket("a", "b", F.coalesce("below", zero.cast("double")), F.coalesce("n", zero.cast("long")), F.coalesce("off", zero.cast("double")), empty)
    return told.withColumn("__new", new).select(*on, "lid", "vec", "__new.a", "__new.b")


def _count_inside(l, r, on, base, exclude_self, left_rows, right_rows) -> DataFrame:
    """Per left row and block: how many distances exist, lie below the bracket and were
    computed (row with d null), and the distinct distances inside it with their counts."""

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _empty(a, b, on, ["d", "c", "below", "n", "computed"])
        x, y = blocks.matrix(a, "vec"), blocks.matrix(b, "vec")
        lo, hi = a["a"].to_numpy(), a["b"].to_numpy()
        n, own = np.full(len(x), len(y), dtype=np.int64), np.full(len(x), -1)
        if exclude_self:
            own = blocks.self_positions(a["lid"], b["rid"])
            n -= own >= 0
        pivots, members, near, far = _cells(y)
        to_pivot = blocks.rms_distances(x, pivots)
        slack = 1e-9 * (to_pivot + far)
        under = to_pivot + far + slack < lo[:, None]
        over = np.maximum(to_pivot - far, near - to_pivot) - slack > hi[:, None]
        below, work = np.zeros(len(x)), np.zeros(len(x), np.int64)
        at, dist, times = [np.arange(len(x))], [np.full(len(x), np.nan)], [np.zeros(len(x))]
        for c, cell in enumerate(members):
            place = np.full(len(y), -1)
            place[cell] = np.arange(len(cell))
            mine = np.where(own >= 0, place[own], -1)
            whole = (under[:, c] | over[:, c]) & (mine < 0)
            below[whole & under[:, c]] += len(cell)
            rows = np.flatnonzero(~whole)
            if not len(rows):
                continue
            d, off = blocks.near_distances(x[rows], y[cell])
            work[rows] += len(cell)
            here = np.flatnonzero(mine[rows] >= 0)
            d[here, mine[rows][here]] = np.inf
            under_it, over_it = d < (lo[rows] - off)[:, None], d > (hi[rows] + off)[:, None]
            below[rows] += under_it.sum(axis=1)
            # what may lie inside is measured exactly
            which, column = np.nonzero(~(under_it | over_it) & np.isfinite(d))
            exact = blocks.paired_distances(x[rows[which]], y[cell[column]])
            below += np.bincount(rows[which], exact < lo[rows[which]], minlength=len(x))
            inside = (exact >= lo[rows[which]]) & (exact <= hi[rows[which]])
            at.append(rows[which[inside]])
            dist.append(exact[inside])
            times.append(np.ones(int(inside.sum())))
        at, dist, times = np.concatenate(at), np.concatenate(dist), np.concatenate(times)
        head = np.arange(len(at)) < len(x)
        return (
            a.select([*on, "lid"])
            .take(pa.array(at))
            .append_column("d", pa.array(dist, mask=head))
            .append_column("c", pa.array(times))
            .append_column("below", pa.array(np.where(head, below[at], 0.0)))
            .append_column("n", pa.array(np.where(head, n[at], 0)))
            .append_column("computed", pa.array(np.where(head, work[at], 0)))
        )

    schema = f"{base}, d double, c double, below double, n long, computed long"
    parts = blocks.block_product(l, r, on, "lid", "rid", count, schema, left_rows, right_rows)
    return parts.groupBy(*on, "lid", "d").agg(*[F.sum(c).alias(c) for c in ("c", "below", "n", "computed")])


def _pick_median(counted: DataFrame, on: list[str]) -> DataFrame:
    row = Window.partitionBy(*on, "lid")
    upto = row.orderBy(F.col("d").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = counted.withColumn("n", F.sum("n").over(row)).withColumn("cum", F.sum(F.col("below") + F.col("c")).over(upto))
    start = F.col("cum") - F.col("c")
    here = F.col("d").isNotNull()

    def pick(p: Column) -> Column:
        return F.max(F.when(here & (start <= p) & (p < F.col("cum")), F.col("d")))

    return w.groupBy(*on, "lid").agg(
        F.max("n").alias("n"),
        ((pick(F.floor((F.col("n") - 1) / 2)) + pick(F.floor(F.col("n") / 2))) / 2.0).alias("m"),
        F.sum("computed").alias("computed"),
    )


def cloud_centrality(
    pred: DataFrame, gold: DataFrame, on: list[str], pred_id: str, gold_id: str, out: str = "centrality", **sizes
) -> DataFrame:
    """Median distance of each prediction to the gold cloud of its label."""
    return median_to_cloud(pred, gold, on, pred_id, gold_id, out, **sizes)


def leave_one_out_centrality(cloud: DataFrame, on: list[str], id_col: str, out: str = "centrality", **sizes) -> DataFrame:
    """Median distance of each curve to the others of its label; needs two of them."""
    return median_to_cloud(cloud, cloud, on, id_col, id_col, out, exclude_self=True, **sizes)


def human_relative_percentile(
    pred: DataFrame, ref: DataFrame, on: list[str], value: str = "centrality", out: str = "hrp"
) -> DataFrame:
    """100 * share of the label's reference values strictly below the prediction's.

    References and predictions are folded to one row per (label, value) first, so equal
    predictions cost one row; labels without references are left out. The predictions are
    written once, as they are ranked and then matched again.
    """
    pred = settled(pred)
    both = ref.select(*on, value, F.lit(True).alias("__ref")).unionByName(
        pred.select(*on, value, F.lit(False).alias("__ref"))
    )
    freq = both.groupBy(*on, value).agg(F.count_if("__ref").alias("ref"))
    ranked = running_counts(freq, on, value, ["ref"]).filter("ref_total > 0")
    percent = ranked.select(*on, value, (100.0 * F.col("ref_below") / F.col("ref_total")).alias(out))
    return pred.join(percent, [*on, value])
