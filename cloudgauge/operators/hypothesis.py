"""Rank tests, goodness of fit, bootstrap intervals and false-discovery control.

Each test folds its rows to one row per distinct value before anything is ordered, and
the order is taken slice by slice (see `ranks`), so one huge group is not one huge task.
Every function takes grouping columns and returns one row per group: many contrasts are
one job. P-values are asymptotic; n is always shown.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.functions import pvalues
from cloudgauge.operators.ranks import (
    average_ranks,
    before_slices,
    median_by,
    running_counts,
    value_frequencies,
    value_slices,
)
from cloudgauge.session import ensure_checkpoint_dir


def _cube_ties(n: str = "n") -> Column:
    t = F.col(n).cast("double")
    return F.sum(t * t * t - t)


def wilcoxon_paired(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Signed-rank test on pairs: zero differences dropped, tie-corrected normal tail."""
    d = df.select(*by, (F.col(x) - F.col(y)).alias("__d")).filter("__d <> 0")
    d = d.select(*by, F.abs("__d").alias("__a"), (F.col("__d") > 0).alias("__pos"))
    ranked = average_ranks(d, by, "__a", {"pos": F.col("__pos")})
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("pos") * F.col("avg_rank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("pos")) * F.col("avg_rank")).alias("w_minus"),
        _cube_ties().alias("__ties"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - F.col("__ties") / 48.0
    z = (F.col("w_plus") - n * (n + 1.0) / 4.0) / F.sqrt(F.nullif(var, F.lit(0.0)))
    return (
        sums.withColumn("statistic", F.least("w_plus", "w_minus"))
        .withColumn("z", z)
        .withColumn("p_value", pvalues.normal_two_sided(F.col("z")))
        .drop("__ties")
    )


def mann_whitney(df: DataFrame, by: list[str], first: Column, value: str) -> DataFrame:
    """Two-sample rank-sum test, tie and continuity corrected. `first` marks sample one."""
    ranked = average_ranks(df.withColumn("__first", first), by, value, {"a": F.col("__first")})
    sums = ranked.groupBy(*by).agg(
        F.sum("a").alias("n1"),
        F.sum(F.col("n") - F.col("a")).alias("n2"),
        F.sum(F.col("a") * F.col("avg_rank")).alias("__r1"),
        _cube_ties().alias("__ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("__r1") - n1 * (n1 + 1.0) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1.0) - F.col("__ties") / (n * (n - 1.0))))
    z = (F.greatest(F.col("u1"), n1 * n2 - F.col("u1")) - n1 * n2 / 2.0 - 0.5) / F.nullif(sd, F.lit(0.0))
    return (
        sums.withColumn("u1", u1)
        .withColumn("z", z)
        .withColumn("p_value", F.when(F.col("z") <= 0, 1.0).otherwise(pvalues.normal_two_sided(F.col("z"))))
        .withColumn("cliffs_delta", 2.0 * F.col("u1") / (n1 * n2) - 1.0)
        .drop("__r1", "__ties")
    )


def cliffs_delta(df: DataFrame, by: list[str], first: Column, value: str) -> DataFrame:
    """(#{x > y} - #{x < y}) / (n m) with x from the marked sample."""
    freq = value_frequencies(
        df.withColumn("__first", first), by, value, {"x": F.col("__first"), "y": ~F.col("__first")}
    )
    r = running_counts(freq, by, value, ["x", "y"])
    above = F.col("y_total") - F.col("y_below") - F.col("y")
    wins = F.sum((F.col("x") * (F.col("y_below") - above)).cast("double"))
    nx, ny = F.max("x_total"), F.max("y_total")
    return r.groupBy(*by).agg(
        nx.alias("n1"), ny.alias("n2"), (wins / F.nullif(nx.cast("double") * ny, F.lit(0.0))).alias("delta")
    )


def kruskal_wallis(df: DataFrame, by: list[str], group: str, value: str, min_n: int = 10, min_groups: int = 3) -> DataFrame:
    """k-sample rank test over groups with at least `min_n` rows; needs `min_groups`."""
    fine = df.groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("c"))
    big = fine.groupBy(*by, group).agg(F.sum("c").alias("__g")).filter(F.col("__g") >= min_n)
    fine = fine.join(big.drop("__g"), [*by, group], "left_semi")
    coarse = fine.groupBy(*by, value).agg(F.sum("c").alias("n"))
    ranked = running_counts(coarse, by, value, ["n"])
    ranked = ranked.select(*by, value, "n", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
    sums = (
        fine.join(ranked.drop("n"), [*by, value])
        .groupBy(*by, group)
        .agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("r"))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
            F.sum(F.col("r") * F.col("r") / F.col("n")).alias("__s"),
        )
        .filter(F.col("k") >= min_groups)
    )
    ties = ranked.groupBy(*by).agg(_cube_ties().alias("__ties"))
    joined = sums.join(ties, by) if by else sums.join(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1.0)) * F.col("__s") - 3.0 * (n + 1.0)) / F.nullif(
        1.0 - F.col("__ties") / (n * n * n - n), F.lit(0.0)
    )
    return joined.select(*by, "k", "n", h.alias("h")).withColumn(
        "p_value", pvalues.chi2_sf(F.col("h"), F.col("k").cast("int") - 1)
    )


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 20) -> DataFrame:
    """Rank correlation with the t-based p-value, for groups of at least `min_n` pairs."""
    pairs = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))

    def ranks(col: str, name: str) -> DataFrame:
        freq = pairs.groupBy(*by, col).agg(F.sum("c").alias("n"))
        r = running_counts(freq, by, col, ["n"])
        return r.select(*by, col, (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(name))

    both = pairs.join(ranks(x, "__rx"), [*by, x]).join(ranks(y, "__ry"), [*by, y])
    # ranks are centred on (n+1)/2 before squaring to keep digits for large n
    total = pairs.groupBy(*by).agg(F.sum("c").alias("n"))
    both = both.join(total, by) if by else both.join(F.broadcast(total))
    rx, ry = F.col("__rx") - (F.col("n") + 1) / 2.0, F.col("__ry") - (F.col("n") + 1) / 2.0
    sums = both.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum(F.col("c") * rx * ry).alias("__xy"),
        F.sum(F.col("c") * rx * rx).alias("__xx"),
        F.sum(F.col("c") * ry * ry).alias("__yy"),
    )
    rho = F.col("__xy") / F.nullif(F.sqrt(F.col("__xx") * F.col("__yy")), F.lit(0.0))
    out = sums.filter(F.col("n") >= min_n).select(*by, "n", rho.alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1.0 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return out.withColumn("t", t).withColumn(
        "p_value",
        F.when(F.abs("rho") >= 1.0, 0.0).otherwise(pvalues.student_t_two_sided(F.col("t"), F.col("n") - 2)),
    )


def chi_square_gof(
    counts: DataFrame, by: list[str], observed: str, share: str, min_n: int = 20, min_expected: float = 1.0
) -> DataFrame:
    """Observed counts per category against given shares (one row per category and group,
    categories without observations included). Null where counts are too small."""
    total = counts.groupBy(*by).agg(F.sum(observed).alias("n"))
    joined = counts.join(total, by).withColumn("__e", F.col(share) * F.col("n"))
    gap = F.col(observed) - F.col("__e")
    agg = joined.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.min("__e").alias("min_expected"),
        F.sum(gap * gap / F.nullif(F.col("__e"), F.lit(0.0))).alias("__x"),
    )
    usable = (F.col("n") >= min_n) & (F.col("min_expected") >= min_expected)
    return agg.select(*by, "n", "k", "min_expected", F.when(usable, F.col("__x")).alias("chi2")).withColumn(
        "p_value", pvalues.chi2_sf(F.col("chi2"), F.col("k").cast("int") - 1)
    )


def chi_square_counts(
    observed: DataFrame, shares: DataFrame, by: list[str], category: str, count: str, share: str, min_n: int = 20, min_expected: float = 1.0
) -> DataFrame:
    """The same test from the counts that are not zero (one row per group and category)
    and the shares (one row per category, all of them, adding up to 1): categories are
    joined, and those a group has not seen enter through the sum of what is expected."""
    seen = observed.join(shares.select(category, share), category)
    total = seen.groupBy(*by).agg(F.sum(count).alias("n"))
    joined = seen.join(total, by).withColumn("__e", F.col(share) * F.col("n"))
    gap = F.col(count) - F.col("__e")
    agg = joined.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(gap * gap / F.nullif(F.col("__e"), F.lit(0.0))).alias("__x"), F.sum("__e").alias("__seen")
    )
    # the shares as a whole are one row
    whole = shares.agg(F.count(F.lit(1)).alias("k"), F.min(share).alias("__least"))
    agg = agg.join(F.broadcast(whole)).withColumn("min_expected", F.col("__least") * F.col("n"))
    usable = (F.col("n") >= min_n) & (F.col("min_expected") >= min_expected)
    unseen = F.greatest(F.col("n") - F.col("__seen"), F.lit(0.0))
    return agg.select(*by, "n", "k", "min_expected", F.when(usable, F.col("__x") + unseen).alias("chi2")).withColumn(
        "p_value", pvalues.chi2_sf(F.col("chi2"), F.col("k").cast("int") - 1)
    )


# --- bootstrap -------------------------------------------------------------------------


def bootstrap_ci_median(
    df: DataFrame, by: list[str], value: str, b: int = 10_000, seed: int = 42, min_n: int = 3
) -> DataFrame:
    """Median with a 95 % bootstrap interval from the order statistics at 2.5 and 97.5 %.

    A resample's median needs no resample: the places of its middle values among the n
    sorted ones have a known distribution, which is inverted at numbers drawn from the
    hash of (seed, group, resample). One way for groups of every size, two numbers per
    resample.
    """
    freq = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    placed = running_counts(freq, by, value, ["c"]).select(
        *by, F.col(value).alias("__v"), "c", F.col("c_below").alias("__at"), F.col("c_total").alias("n")
    )
    medians = _resampled_medians(placed.filter(F.col("n") >= min_n), by, b, seed)
    by_resample = Window.partitionBy(*by).orderBy("__m")
    ends = (
        medians.withColumn("__i", F.row_number().over(by_resample) - 1)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("__i") == int(0.025 * b), F.col("__m"))).alias("ci_low"),
            F.max(F.when(F.col("__i") == int(0.975 * b), F.col("__m"))).alias("ci_high"),
        )
    )
    return median_by(df, by, value).join(ends, by)


def middle_places(n: int, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 1) of the two middle values of resamples of n sorted values.

    The k-th smallest of n picks is at most j when k or more picks are: a binomial tail
    in j/n, inverted at u by halving. For even n the next one lies beyond j2 when exactly
    k picks are at most j2, the largest of them at j: (1 - j2/n)^(n-k) up to a factor, so
    it is inverted at w directly.
    """
    k = (n + 1) // 2
    tail = lambda j: pvalues.incomplete_beta(k, n - k + 1, j / n)
    low, high = np.zeros(len(u), np.int64), np.full(len(u), n, np.int64)
    while (high - low > 1).any():
        middle = (low + high) // 2
        reached = tail(middle) >= u
        high, low = np.where(reached, middle, high), np.where(reached, low, middle)
    first = high
    if n % 2 or k == n:
        return first, first
    mass = tail(first) - tail(first - 1)
    pairs = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    weight = pairs + k * np.log(first / n) + np.log1p(-np.power((first - 1) / first, k))
    second = np.ceil(n * -np.expm1((np.log(w) + np.log(mass) - weight) / (n - k)))
    return first, np.clip(second, first, n).astype(np.int64)


def _resampled_medians(placed: DataFrame, by: list[str], b: int, seed: int) -> DataFrame:
    names = list(by)
    labels = [F.col(c).cast("string") for c in by]
    sizes = placed.groupBy(*by).agg(F.max("n").alias("n")).withColumn("__label", F.concat_ws(":", *labels))

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                keys, n, label = row[:-2], int(row[-2]), row[-1]
                digests = [hashlib.md5(f"{seed}:{label}:{i}".encode()).hexdigest()[:16] for i in range(b)]
                u, w = (np.array([(int(d[a : a + 8], 16) + 0.5) / 2**32 for d in digests]) for a in (0, 8))
                first, second = middle_places(n, u, w)
                out = pd.DataFrame({"__b": np.arange(b)})
                for name, key in zip(names, keys):
                    out[name] = key
                out["__i1"], out["__i2"] = first - 1, second - 1
                yield out[[*names, "__b", "__i1", "__i2"]]

    key_ddl = "".join(f"`{c}` {placed.schema[c].dataType.simpleString()}, " for c in by)
    drawn = sizes.mapInPandas(draw, f"{key_ddl}__b int, __i1 long, __i2 long")
    wanted = drawn.select(*by, "__b", F.explode(F.array("__i1", "__i2")).alias("__at"))
    reach = wanted.groupBy(*by).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
    # only the values around the median can be hit: about 8 sqrt(n) of n places
    near = placed.join(reach, by).filter((F.col("__at") <= F.col("__hi")) & (F.col("__at") + F.col("c") > F.col("__lo")))
    steps = near.select(*by, "__at", F.col("__v"), F.lit(None).cast("int").alias("__b")).unionByName(
        wanted.select(*by, "__at", F.lit(None).cast("double").alias("__v"), "__b")
    )
    upto = Window.partitionBy(*by).orderBy("__at", F.col("__b").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    hit = steps.withColumn("__x", F.last("__v", ignorenulls=True).over(upto)).filter(F.col("__b").isNotNull())
    return hit.groupBy(*by, "__b").agg(F.avg("__x").alias("__m")).drop("__b")


# --- many tests at once -------------------------------------------------------------------


def bh_fdr(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Add `q_value` and `survives`: p * m / rank, made monotone from the top, at most 1.

    Null and NaN p-values are not tests: they count nowhere and get no q. Equal p-values
    share the q of the largest rank among them, so the pass runs over
    distinct p-values and its running minimum is taken slice by slice.
    """
    by = list(by)
    freq = tests.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*by, p).agg(F.count(F.lit(1)).alias("c"))
    ranked = running_counts(freq, by, p, ["c"])
    raw = ranked.select(*by, p, (F.col(p) * F.col("c_total") / (F.col("c_below") + F.col("c"))).alias("__raw"))
    cut = value_slices(raw, by, p)
    least = cut.groupBy(*by, "__slice").agg(F.min("__raw").alias("__m"))
    floors = before_slices(least, by, "__slice", {"__floor": ("min", "__m")}, falling=True).drop("__m")
    inside = Window.partitionBy(*by, "__slice").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.min("__raw").over(inside), F.coalesce("__floor", F.lit(1.0)), F.lit(1.0))
    per_p = cut.join(floors, [*by, "__slice"]).select(*by, p, q.alias("q_value"))
    return tests.join(per_p, [*by, p], "left").withColumn("survives", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def consolidate_tests(tables: dict[str, DataFrame], p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Union the (test, unit, p) rows of several stages and correct them together."""
    union = None
    for source, t in tables.items():
        part = t.select(F.lit(source).alias("source"), "test", "unit", p)
        union = part if union is None else union.unionByName(part)
    # every part is the end of a long plan, and the correction reads it several times
    ensure_checkpoint_dir(union.sparkSession)
    return bh_fdr(union.checkpoint(), p, alpha)
