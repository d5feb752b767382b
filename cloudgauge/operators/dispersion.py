"""How far and how widely clouds lie: energy distance, spreads, mean-curve views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions.params import GAINS
from cloudgauge.operators import clouds
from cloudgauge.operators.blocks import cloud_sizes
from cloudgauge.operators.ranks import median_by
from cloudgauge.operators.render import frequency_grid
from cloudgauge.session import attach, settle

# Upper frequency bounds of the signed-error regions.
REGIONS_HZ = [("low", 20.0, 150.0), ("lowmid", 150.0, 600.0), ("mid", 600.0, 2000.0), ("highmid", 2000.0, 6000.0), ("high", 6000.0, 20000.1)]
LOW_BAND_HZ = (20.0, 200.0)
HIGH_BAND_HZ = (5000.0, 20000.1)
MIN_CONSENSUS_DB = 0.5


def energy_distance(
    pred: DataFrame, gold: DataFrame, group: list[str], label: str, pred_id: str, gold_id: str, min_n: int = 5, **sizes
) -> DataFrame:
    """Energy distance and spreads of every prediction group against its label's cloud.

    2 E|X-Y| - E|X-X'| - E|Y-Y'| with the inner means over distinct pairs. `pred_id` must
    be unique within a label. Groups under `min_n` samples are left out.
    """
    keys = [*group, label]
    enough = cloud_sizes(pred, keys, "n_samples").filter(F.col("n_samples") >= min_n)
    scored = pred.join(enough, keys, "left_semi").join(gold.select(label).distinct(), label, "left_semi")
    cross = (
        clouds.distances_to_cloud(scored, gold, [label], pred_id, gold_id, carry=group, **sizes)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_samples"), (F.sum("sum_dist") / F.sum("n_pairs")).alias("__ab"))
    )
    inner_pred = clouds.pairs_unordered(scored, keys, pred_id).select(*keys, F.col("mean_dist").alias("__aa"))
    wanted = gold.join(scored.select(label).distinct(), label, "left_semi")
    inner_gold = clouds.pairs_unordered(wanted, [label], gold_id).select(label, F.col("mean_dist").alias("__bb"))
    joined = cross.join(inner_pred, keys).join(inner_gold, label)
    return joined.select(
        *keys,
        "n_samples",
        (2.0 * F.col("__ab") - F.col("__aa") - F.col("__bb")).alias("energy_dist"),
        F.col("__aa").alias("cloud_dispersion"),
        F.col("__bb").alias("human_dispersion"),
        dispersion_ratio(F.col("__aa"), F.col("__bb")).alias("dispersion_ratio"),
    )


def dispersion_ratio(cloud: Column, human: Column) -> Column:
    """Null where the human cloud has no spread."""
    return F.when(human > 0, cloud / human)


def split_half_reference(halves: DataFrame, label: str, id_col: str, half: str = "half") -> DataFrame:
    """Energy distance between the two halves of every label's cloud."""
    a = halves.filter(F.col(half) == "a").drop(half)
    b = halves.filter(F.col(half) == "b").drop(half)
    return energy_distance(a, b, [], label, id_col, id_col, min_n=1)


def dispersion_to_centroid(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Mean distance of the rows to their group's mean curve."""
    centre, small = settle(clouds.mean_curve(df, by, vec).select(*by, "mean_vec"))
    d = clouds.lsd_distance(F.col(vec), F.col("mean_vec"))
    return (
        attach(df.select(*by, vec), centre, small, by)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("dispersion"))
    )


def centroid_shift(
    df: DataFrame, by: list[str], group: str, first: str, second: str, vec: str = "vec", min_n: int = 15
) -> DataFrame:
    """Distance between the mean curves of two groups, where both have enough rows."""
    means = clouds.mean_curve(df.filter(F.col(group).isin(first, second)), [*by, group], vec)
    means = means.filter(F.col("n") >= min_n)

    def side(name: str, tag: str) -> DataFrame:
        return means.filter(F.col(group) == name).select(
            *[F.col(c).alias(c) for c in by], F.col("n").alias(f"n_{tag}"), F.col("mean_vec").alias(f"__{tag}")
        )

    return (
        side(first, "first")
        .join(side(second, "second"), by)
        .select(*by, "n_first", "n_second", clouds.lsd_distance(F.col("__first"), F.col("__second")).alias("shift"))
    )


def mean_curve_envelope(long: DataFrame, by: list[str], pos: str = "bin", value: str = "db") -> DataFrame:
    """Mean and population SD per bin."""
    return long.groupBy(*by, pos).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )


# --- gains against the consensus -----------------------------------------------------


def consensus_gains(train: DataFrame, label: str, gains: Sequence[str] = GAINS) -> DataFrame:
    """Mean gain per label and band, one column per band."""
    return train.groupBy(label).agg(*[F.avg(g).alias(g) for g in gains])


def _with_consensus(units: DataFrame, consensus: DataFrame, label: str, gains: Sequence[str]) -> DataFrame:
    ref = consensus.select(label, *[F.col(g).alias(f"__c_{g}") for g in gains])
    return units.join(ref, label, "left")


def sign_and_magnitude_error(
    units: DataFrame, consensus: DataFrame, label: str, keep: Sequence[str], gains: Sequence[str] = GAINS
) -> DataFrame:
    """Per unit, over bands whose consensus is at least 0.5 dB either way: share of equal
    signs (positive or not) and mean absolute error; null without such a band."""
    n, same, err = F.lit(0), F.lit(0), F.lit(0.0)
    for g in gains:
        c = F.col(f"__c_{g}")
        counts = F.coalesce(F.abs(c) >= MIN_CONSENSUS_DB, F.lit(False))
        n = n + counts.cast("int")
        same = same + (counts & ((F.col(g) > 0) == (c > 0))).cast("int")
        err = err + F.when(counts, F.abs(F.col(g) - c)).otherwise(0.0)
    safe = F.nullif(n, F.lit(0))
    return _with_consensus(units, consensus, label, gains).select(
        *keep, (same / safe).alias("sign_agree_frac"), (err / safe).alias("mag_err")
    )


def band_anatomy(
    units: DataFrame, consensus: DataFrame, label: str, by: Sequence[str], gains: Sequence[str] = GAINS
) -> DataFrame:
    """The same two measures per band and group of units; empty bands are left out."""
    aggs = []
    for g in gains:
        c = F.col(f"__c_{g}")
        counts = F.coalesce(F.abs(c) >= MIN_CONSENSUS_DB, F.lit(False))
        agree = F.when(counts, ((F.col(g) > 0) == (c > 0)).cast("double"))
        aggs.append(
            F.struct(
                F.lit(g).alias("band"),
                F.count_if(counts).alias("n"),
                F.avg(F.when(counts, F.abs(F.col(g) - c))).alias("mean_abs_err"),
                (100.0 * F.avg(agree)).alias("sign_agree_pct"),
            ).alias(f"__b_{g}")
        )
    wide = _with_consensus(units, consensus, label, gains).groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[f"__b_{g}" for g in gains]))).filter("n > 0")


# --- curve regions ---------------------------------------------------------------------


def bin_regions(spark: SparkSession, regions=REGIONS_HZ, points: int = 256) -> DataFrame:
    """(bin, region) from frequency bounds, lower bound included."""
    grid = frequency_grid(spark, points)
    name = None
    for r, low, high in regions:
        hit = (F.col("freq_hz") >= low - 1e-9) & (F.col("freq_hz") < high)
        name = F.when(hit, r) if name is None else name.when(hit, r)
    return grid.select("bin", name.alias("region")).filter(F.col("region").isNotNull())


def region_unit_error(
    answers: DataFrame, centre: DataFrame, regions: DataFrame, label: str, unit: list[str], pos: str = "bin", value: str = "db"
) -> DataFrame:
    """Mean signed difference `e` to the label's mean curve per unit and region.

    Long-form inputs; `centre` has (label, bin, mean). The region table has one row per
    grid point.
    """
    return (
        answers.join(F.broadcast(regions), pos)
        .join(centre.select(label, pos, "mean"), [label, pos])
        .groupBy(label, *unit, "region")
        .agg(F.avg(F.col(value) - F.col("mean")).alias("e"))
    )


def region_signed_error(
    answers: DataFrame, centre: DataFrame, regions: DataFrame, label: str, unit: list[str], pos: str = "bin", value: str = "db"
) -> DataFrame:
    """`region_unit_error`, averaged over units (models and prompts)."""
    diff = region_unit_error(answers, centre, regions, label, unit, pos, value)
    return diff.groupBy(label, "region").agg(F.count(F.lit(1)).alias("n_units"), F.avg("e").alias("signed_error"))


def packed_region_signed_error(
    answers: DataFrame,
    centre: DataFrame,
    label: str,
    unit: list[str],
    levels: str = "levels",
    regions: Sequence[tuple[str, float, float]] = REGIONS_HZ,
    pos: str = "bin",
) -> DataFrame:
    """`region_signed_error` of answers that carry their mean level in each region
    (`render.region_vector`); `centre` has (label, bin, mean). The mean difference to the
    centre over a region is the difference of the means, so a unit is one row."""
    spark = answers.sparkSession
    of = centre.join(F.broadcast(bin_regions(spark, regions)), pos)
    names = [name for name, _, _ in regions]
    middle = F.array(*[F.avg(F.when(F.col("region") == name, F.col("mean"))) for name in names])
    centres, small = settle(of.groupBy(label).agg(middle.alias("__centre")))
    level = F.array(*[F.avg(F.get(levels, F.lit(i))) for i in range(len(names))])
    units = attach(answers.groupBy(label, *unit).agg(level.alias("__level")), centres, small, [label])
    sums = units.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_units"),
        *[F.avg(F.get("__level", F.lit(i)) - F.get("__centre", F.lit(i))).alias(f"__e{i}") for i in range(len(names))],
    )
    each = F.array(*[F.struct(F.lit(name).alias("region"), F.col(f"__e{i}").alias("signed_error")) for i, name in enumerate(names)])
    return sums.select(label, "n_units", F.inline(each)).select(label, "region", "n_units", "signed_error")


def region_level(
    long: DataFrame, by: list[str], grid: DataFrame, pos: str = "bin", value: str = "db", weight: str | None = None
) -> DataFrame:
    """Mean level of the low and the high band per group; `weight` names the number of
    values that a row stands for."""

    def level(bounds: tuple[float, float]) -> Column:
        low, high = bounds
        inside = (F.col("freq_hz") >= low - 1e-9) & (F.col("freq_hz") < high)
        if weight is None:
            return F.avg(F.when(inside, F.col(value)))
        times = F.when(inside & F.col(value).isNotNull(), F.col(weight))
        return F.sum(F.col(value) * times) / F.nullif(F.sum(times), F.lit(0).cast("long"))

    return (
        long.join(F.broadcast(grid.select(pos, "freq_hz")), pos)
        .groupBy(*by)
        .agg(level(LOW_BAND_HZ).alias("low_level"), level(HIGH_BAND_HZ).alias("high_level"))
    )


def context_pull(
    answers: DataFrame, base: DataFrame, target: DataFrame, on: list[str], label: str, keep: Sequence[str], vec: str = "vec"
) -> DataFrame:
    """Projection of (answer - base) on (target - base), 1 meaning full deference.

    `base` is keyed by `on` (model, prompt and label, say) and has `base_vec`; `target` has
    `target_vec`, one or more rows per label, and whatever tells them apart: its columns
    may be named in `keep`. Answers without a base, or whose base equals the target, are
    left out. Both sides are per label and measured before they are joined, so the answers
    of a large label stay where they are.
    """
    bases, few = settle(base.select(*on, "base_vec"))
    targets, small = settle(target)
    joined = attach(attach(answers, bases, few, on), targets, small, [label])
    step = F.zip_with("target_vec", "base_vec", lambda t, b: t - b)
    move = F.zip_with(vec, "base_vec", lambda a, b: a - b)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with("__move", "__step", lambda m, s: m * s))
    norm = total(F.transform("__step", lambda s: s * s))
    return (
        joined.select(*keep, step.alias("__step"), move.alias("__move"))
        .select(*keep, dot.alias("__dot"), norm.alias("__norm"))
        .filter("__norm >= 1e-9")
        .select(*keep, (F.col("__dot") / F.col("__norm")).alias("pull"))
    )


def context_pull_by_model(pulls: DataFrame, by: list[str]) -> DataFrame:
    return median_by(pulls, by, "pull", "median_pull")


def arm_dispersion_mean(energy: DataFrame, by: list[str]) -> DataFrame:
    """Mean within-cloud spread per arm (and label), next to the human one, over rows
    with a ratio."""
    return (
        energy.filter(F.col("dispersion_ratio").isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.avg("cloud_dispersion").alias("mean_dispersion"),
            F.avg("human_dispersion").alias("human_reference"),
        )
    )
