"""Joining study tables and comparing arms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.operators.ranks import median_by, order_statistics
from cloudgauge.operators.retrieval import first_of


def rejoin_metadata(df: DataFrame, meta: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Left-join text metadata by id; missing becomes the empty string."""
    return df.join(meta.select(on, *cols), on, "left").fillna("", subset=list(cols))


def join_features(
    df: DataFrame, ids: DataFrame, feats: DataFrame, row_id: str, entry_id: str, label: str, min_n: int = 50
) -> tuple[DataFrame, DataFrame]:
    """row id -> entry id -> features. Returns (joined rows of labels with at least
    `min_n` of them, coverage per label)."""
    linked = df.join(ids.select(row_id, entry_id), row_id, "left").join(
        feats.withColumn("__hit", F.lit(True)), entry_id, "left"
    )
    coverage = linked.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("__hit").alias("n_joined"),
        F.avg(F.coalesce(F.col("__hit"), F.lit(False)).cast("double")).alias("coverage"),
    )
    enough = coverage.filter(F.col("n_joined") >= min_n).select(label)
    joined = linked.filter("__hit").drop("__hit").join(enough, label, "left_semi")
    return joined, coverage.withColumn("used", F.col("n_joined") >= min_n)


def join_paired_arms(a: DataFrame, b: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Values of two arms on their common keys: (keys, x, y); the last row of a repeated
    key counts."""
    x = first_of(a, keys, [F.desc(order)]).select(*keys, F.col(value).alias("x"))
    y = first_of(b, keys, [F.desc(order)]).select(*keys, F.col(value).alias("y"))
    return x.join(y, keys)


def greedy_baseline_join(
    answers: DataFrame, base: DataFrame, keys: list[str], value: str, order: str, sample: str = "sample_idx"
) -> DataFrame:
    """Every answer next to the base arm's sample 0 of the same keys; of base rows with
    the same keys the last in `order` counts."""
    greedy = first_of(base.filter(F.col(sample) == 0), keys, [F.desc(order)])
    return answers.join(greedy.select(*keys, F.col(value).alias("base_value")), keys)


def union_units(arms: dict[str, DataFrame], columns: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """All arms in one table; columns an arm lacks take the default."""
    parts = [df.withColumn("arm", F.lit(name)) for name, df in arms.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.fillna(defaults).select("arm", *columns)


def common_keys_all_arms(values: DataFrame, arm: str, key: str) -> DataFrame:
    """Keys that every arm of the table has."""
    arms = values.agg(F.count_distinct(arm).alias("__arms"))
    per = values.select(key, arm).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_arms"))
    return per.join(F.broadcast(arms), F.col("n_arms") == F.col("__arms")).select(key)


def arm_summary(units: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median and the nearest-rank quartiles v[n//4], v[3n//4]."""
    n = F.col("n")
    picked = order_statistics(
        units.filter(F.col(value).isNotNull()),
        by,
        value,
        {
            "__m1": F.floor((n - 1) / 2),
            "__m2": F.floor(n / 2),
            "q1": F.floor(n / 4),
            "q3": F.floor(n * 3 / 4),
        },
    )
    return picked.select(*by, "n", ((F.col("__m1") + F.col("__m2")) / 2.0).alias("median"), "q1", "q3")


def tail_value_per_label(
    units: DataFrame, arm: str, label: str, value: str, baselines: Sequence[str], prompts: Sequence[str], sample: str = "sample_idx", prompt: str = "prompt"
) -> DataFrame:
    """One value per arm and label: a baseline's value, or the median over models of
    sample 0 under the minimal prompt."""
    is_base = F.col(arm).isin(*baselines)
    minimal = (F.col(sample) == 0) & F.col(prompt).isin(*prompts)
    used = units.filter(F.col(value).isNotNull() & (is_base | minimal))
    return median_by(used, [arm, label], value, "tail_value")


def win_matrix(values: DataFrame, arm: str, key: str, value: str, arms: Sequence[str]) -> DataFrame:
    """Percent of common keys where the row arm is strictly below the column arm.

    Arms are few and become columns of one row per key, so no arm-by-arm self-join is
    needed. Should an arm have a key twice, its smallest value counts.
    """
    wide = values.groupBy(key).pivot(arm, list(arms)).agg(F.min(value))
    complete = wide.dropna(subset=list(arms))
    aggs = []
    for a in arms:
        cells = [
            F.lit(None).cast("double").alias(f"vs_{b}") if a == b else (100.0 * F.avg((F.col(a) < F.col(b)).cast("double"))).alias(f"vs_{b}")
            for b in arms
        ]
        aggs.append(F.struct(F.lit(a).alias("arm"), F.count(F.lit(1)).alias("n_keys"), *cells).alias(f"__{a}"))
    return complete.agg(*aggs).select(F.inline(F.array(*[f"__{a}" for a in arms])))
