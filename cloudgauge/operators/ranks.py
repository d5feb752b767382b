"""Ranks and running counts that do not put a whole group into one task.

A window over a group sorts that group in a single task. Here every group is first cut
into slices whose order is known (by hash digits, or by value range), the slice counts
give each slice its offset, and only slices are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES_PER_OCTAVE = 1 << 14
FINE_SLICES = 256


COARSE_BITS = 13  # slices of a coarse range


def before_slices(per: DataFrame, by: list[str], slice_col: str, values: dict[str, tuple[str, str]], falling: bool = False) -> DataFrame:
    """`per` (one row per group and slice) with columns of what lies before each slice, or
    after it with `falling`: `values` maps a name to ("sum" or "min", column). Nothing
    before is null.

    Done in two levels: coarse ranges of 2^13 slices first, of which a group has few, then the slices of
    each range. So no task orders all slices of the table, even if it is one group.
    """
    wide = f"__coarse_{slice_col}"
    at = per.withColumn(wide, F.shiftright(F.col(slice_col).cast("long"), COARSE_BITS))
    fold = {"sum": F.sum, "min": F.min}
    towards = F.desc if falling else F.asc

    def earlier(keys: list[str], order: str) -> Window:
        window = Window.partitionBy(*keys) if keys else Window.partitionBy()
        return window.orderBy(towards(order)).rowsBetween(Window.unboundedPreceding, -1)

    ranges = at.groupBy(*by, wide).agg(*[fold[kind](c).alias(f"__r_{n}") for n, (kind, c) in values.items()])
    ranges = ranges.select(*by, wide, *[fold[kind](f"__r_{n}").over(earlier(by, wide)).alias(f"__w_{n}") for n, (kind, _) in values.items()])
    inner = at.select("*", *[fold[kind](c).over(earlier([*by, wide], slice_col)).alias(f"__i_{n}") for n, (kind, c) in values.items()])
    joined = inner.join(ranges, [*by, wide])
    zero = F.lit(0)
    both = {
        "sum": lambda n: F.coalesce(F.col(f"__w_{n}"), zero) + F.coalesce(F.col(f"__i_{n}"), zero),
        "min": lambda n: F.least(f"__w_{n}", f"__i_{n}"),
    }
    return joined.select(*per.columns, *[both[kind](n).alias(n) for n, (kind, _) in values.items()])


def _slice_offsets(df: DataFrame, by: list[str], slice_col: str, sums: dict[str, Column]) -> DataFrame:
    """Per (by, slice): each sum over all earlier slices, and over the whole group."""
    per = df.groupBy(*by, slice_col).agg(*[c.alias(f"__s_{n}") for n, c in sums.items()])
    if not by:
        offsets = before_slices(per, by, slice_col, {f"__off_{n}": ("sum", f"__s_{n}") for n in sums})
        whole = per.agg(*[F.sum(f"__s_{n}").alias(f"__all_{n}") for n in sums])
        return offsets.join(F.broadcast(whole)).select(slice_col, *[f"__off_{n}" for n in sums], *[f"__all_{n}" for n in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *by,
        slice_col,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(group).alias(f"__all_{n}") for n in sums],
    )


def ordered_row_number(
    df: DataFrame, by: list[str], slice_col: Column, order: list[Column], rank: str, total: str | None = None
) -> DataFrame:
    """Exact row number per group; `slice_col` must never fall along `order`."""
    cut = df.withColumn("__slice", slice_col)
    offsets = _slice_offsets(cut, by, "__slice", {"n": F.count(F.lit(1))})
    inside = Window.partitionBy(*by, "__slice").orderBy(*order)
    out = (
        cut.join(offsets, [*by, "__slice"])
        .withColumn(rank, F.col("__off_n") + F.row_number().over(inside))
    )
    if total:
        out = out.withColumn(total, F.col("__all_n"))
    return out.drop("__slice", "__off_n", "__all_n")


def value_slice(value: Column) -> Column:
    """A whole number that never falls as the value rises: sign, exponent and the leading
    bits of the mantissa. A plain expression, so cutting a table needs no extra pass."""
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    # should log2 round across a power of two, both readings give the same code
    code = (exponent + 1100) * SLICES_PER_OCTAVE + F.floor(
        size / F.pow(F.lit(2.0), exponent) * SLICES_PER_OCTAVE - SLICES_PER_OCTAVE
    )
    code = F.when(size == float("inf"), F.lit(5000 * SLICES_PER_OCTAVE)).otherwise(code)
    return F.when(v == 0, F.lit(0)).when(v > 0, code).otherwise(-code).cast("long")


def value_slices(freq: DataFrame, by: list[str], value: str, refine: bool = False) -> DataFrame:
    """Add `__slice`, rising with the value inside each group.

    `refine` cuts every slice again into equal widths between its own minimum and
    maximum, for huge groups whose values share their leading digits. The cuts depend on
    values only, so a task that is run again makes the same ones.
    """
    out = freq.withColumn("__slice", value_slice(F.col(value)))
    if not refine:
        return out
    keys = [*by, "__slice"]
    edges = out.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(FINE_SLICES))
    step = F.floor((F.col(value) - F.col("__lo")) / F.nullif(width, F.lit(0.0)))
    fine = F.least(F.coalesce(step, F.lit(0)), F.lit(FINE_SLICES - 1))
    return (
        out.join(edges, keys)
        .withColumn("__slice", F.col("__slice") * FINE_SLICES + fine)
        .drop("__lo", "__hi")
    )


def running_counts(freq: DataFrame, by: list[str], value: str, counts: list[str], refine: bool = False) -> DataFrame:
    """For a table with one row per (group, value): how many lie strictly below.

    Adds `<count>_below` (values strictly smaller) and `<count>_total` (whole group) for
    each count column.
    """
    cut = value_slices(freq, by, value, refine)
    offsets = _slice_offsets(cut, by, "__slice", {c: F.sum(c) for c in counts})
    inside = Window.partitionBy(*by, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets, [*by, "__slice"])
    for c in counts:
        out = out.withColumn(
            f"{c}_below", F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
        ).withColumnRenamed(f"__all_{c}", f"{c}_total")
    return out.drop("__slice", *[f"__off_{c}" for c in counts])


def value_frequencies(df: DataFrame, by: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per (group, value); `counts` maps a name to a boolean or to lit(True)."""
    return df.groupBy(*by, value).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def average_ranks(df: DataFrame, by: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per (group, value) with `n` (ties), `avg_rank` (ties share the mean rank),
    and the count columns of `counts` with their totals."""
    freq = value_frequencies(df, by, value, {"n": F.lit(True), **counts})
    ranked = running_counts(freq, by, value, ["n", *counts])
    return ranked.withColumn("avg_rank", F.col("n_below") + (F.col("n") + 1) / 2.0)


def order_statistics(df: DataFrame, by: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group.

    `picks` maps an output name to the zero-based position as an expression over `n`,
    the group size. One row per group with `n` and the picked values.
    """
    freq = value_frequencies(df, by, value, {"c": F.lit(True)})
    ranked = running_counts(freq, by, value, ["c"]).withColumn("n", F.col("c_total"))
    chosen = [
        F.max(F.when((F.col("c_below") <= p) & (p < F.col("c_below") + F.col("c")), F.col(value))).alias(name)
        for name, p in picks.items()
    ]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *chosen)


def median_by(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group, (group, n, median), whatever the group's size."""
    n = F.col("n")
    picked = order_statistics(
        df, by, value, {"__m1": F.floor((n - 1) / 2), "__m2": F.floor(n / 2)}
    )
    return picked.select(*by, "n", ((F.col("__m1") + F.col("__m2")) / 2.0).alias(out))
