"""Baselines built from the training rows: centroids, blends and keyword profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudgauge.functions.params import FLAT_SETTINGS, GAINS, PARAM_NAMES, kind
from cloudgauge.functions.text import clamp
from cloudgauge.operators import blocks
from cloudgauge.session import attach, settle


def centroid(df: DataFrame, by: list[str], params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(p) for p in params])


def reject_outliers_nsd(
    df: DataFrame, by: list[str], cols: Sequence[str] = GAINS, z: float = 2.0, min_n: int = 3
) -> DataFrame:
    """Drop rows with any |z| above the limit, per group and sample SD.

    Groups under `min_n` rows, and groups where nothing would be left, keep all rows. The
    statistics are one row per group, measured and joined back, so no group is sorted and
    rows of a large group stay where they are.
    """
    stats, small = settle(df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(c).alias(f"__m_{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols],
    ))
    within = F.lit(True)
    for c in cols:
        dev = F.abs(F.col(c) - F.col(f"__m_{c}"))
        within = within & ((F.col(f"__s_{c}") == 0) | (dev / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) <= z))
    marked = attach(df, stats, small, by).withColumn("__in", (F.col("__n") < min_n) | F.coalesce(within, F.lit(False)))
    left, few = settle(marked.groupBy(*by).agg(F.bool_or("__in").alias("__any")))
    extra = [c for c in marked.columns if c.startswith("__")]
    return attach(marked, left, few, by).filter(F.col("__in") | ~F.col("__any")).drop(*extra, "__any")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    na = F.sqrt(total(F.transform(a, lambda x: x * x)))
    nb = F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.coalesce(dot / F.nullif(na * nb, F.lit(0.0)), F.lit(0.0))


def cosine_anchor_join(
    labels: DataFrame,
    anchors: DataFrame,
    label: str,
    anchor: str,
    vec: str = "vec",
    params: Sequence[str] = PARAM_NAMES,
    label_rows: int = blocks.LEFT_ROWS,
    anchor_rows: int = blocks.RIGHT_ROWS,
) -> DataFrame:
    """Every label against every anchor by clamped cosine, folded per label.

    One row per label: `n_positive`, `weight_sum`, `top_weight`, `nearest` (ties
    alphabetical) and, for each parameter the anchors carry, the weighted sum
    `ws_<param>`. Labels meet anchors block by block; the pair weights themselves are
    never written.
    """
    has = [p for p in params if p in anchors.columns]
    l = labels.select(F.col(label).alias("lid"), F.col(vec).alias("vec"))
    r = anchors.select(F.col(anchor).alias("rid"), F.col(vec).alias("vec"), *has)
    schema = "lid {}, rid {}, n long, s double, top double, {}".format(
        labels.schema[label].dataType.simpleString(),
        anchors.schema[anchor].dataType.simpleString(),
        ", ".join(f"`{p}` double" for p in has) or "__none double",
    )
    wide = has or ["__none"]

    def weigh(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            ids = {
                "lid": a["lid"].slice(0, 0) if "lid" in a.column_names else pa.array([], pa.string()),
                "rid": b["rid"].slice(0, 0) if "rid" in b.column_names else pa.array([], pa.string()),
            }
            nums = {"n": pa.array([], pa.int64()), **{k: pa.array([], pa.float64()) for k in ["s", "top", *wide]}}
            return pa.table({**ids, **nums})
        x, y = blocks.matrix(a, "vec"), blocks.matrix(b, "vec")
        scale = np.outer(np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1)))
        dot = x @ y.T
        w = np.maximum(np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0), 0.0)
        order = np.argsort(np.array(b["rid"].to_pylist(), dtype=object), kind="stable")
        best = order[np.argmax(w[:, order], axis=1)]
        table = {
            "lid": a["lid"],
            "rid": b["rid"].take(pa.array(best)),
            "n": pa.array((w > 0).sum(axis=1)),
            "s": pa.array(w.sum(axis=1)),
            "top": pa.array(w[np.arange(len(w)), best]),
        }
        for p in has:
            table[p] = pa.array(w @ b[p].to_numpy().astype(float))
        if not has:
            table["__none"] = pa.array(np.zeros(len(w)))
        return pa.table(table)

    parts = blocks.block_product(l, r, [], "lid", "rid", weigh, schema, label_rows, anchor_rows)
    best = F.min(F.struct((-F.col("top")).alias("t"), F.col("rid").alias("r")))
    return (
        parts.groupBy(F.col("lid").alias(label))
        .agg(
            F.sum("n").alias("n_positive"),
            F.sum("s").alias("weight_sum"),
            F.max("top").alias("top_weight"),
            best.alias("__best"),
            *[F.sum(p).alias(f"ws_{p}") for p in has],
        )
        .withColumn("nearest", F.when(F.col("n_positive") > 0, F.col("__best")["r"]))
        .drop("__best")
    )


def cosine_blend(weighted: DataFrame, label: str, params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    """Finish `cosine_anchor_join`: weighted means, or the flat row without any weight."""
    ok = F.col("weight_sum") > 0
    return weighted.select(
        label,
        F.when(ok, "cosine_blend").otherwise("no_positive_similarity_flat").alias("method"),
        *[
            F.when(ok, F.col(f"ws_{p}") / F.col("weight_sum")).otherwise(F.lit(FLAT_SETTINGS[p])).alias(p)
            for p in params
        ],
    )


def keyword_profile_join(
    labels: DataFrame, vocab: DataFrame, profiles: DataFrame, label: str, bonus: float = 3.0
) -> DataFrame:
    """(label, profile, weight): 1 if the whole label is in the profile's vocabulary, plus
    `bonus` if it names the profile. `vocab` has (profile, word); profiles without data,
    i.e. not in `profiles`, are left out. Two equi-joins; rows without a hit do not exist.
    """
    have = profiles.select("profile").distinct()
    by_word = vocab.select("profile", F.col("word").alias(label)).distinct().withColumn("w", F.lit(1.0))
    by_name = have.select("profile", F.col("profile").alias(label), F.lit(bonus).alias("w"))
    hits = by_word.join(have, "profile", "left_semi").select("profile", label, "w").unionByName(by_name)
    scored = hits.groupBy("profile", label).agg(F.sum("w").alias("weight"))
    return labels.select(label).distinct().join(scored, label)


def weighted_blend(
    labels: DataFrame,
    weights: DataFrame,
    centroids: DataFrame,
    label: str,
    anchor: str,
    params: Sequence[str] = PARAM_NAMES,
    method: str = "keyword_blend",
    fallback_method: str = "flat_fallback",
) -> DataFrame:
    """Sum of weight * centroid over the sum of weights; the flat row if nothing weighs."""
    joined = weights.join(centroids.select(anchor, *params), anchor)
    sums = joined.groupBy(label).agg(
        F.sum("weight").alias("__w"), *[F.sum(F.col("weight") * F.col(p)).alias(f"__{p}") for p in params]
    )
    ok = F.coalesce(F.col("__w") > 0, F.lit(False))
    return (
        labels.select(label)
        .distinct()
        .join(sums, label, "left")
        .select(
            label,
            F.when(ok, method).otherwise(fallback_method).alias("method"),
            *[F.when(ok, F.col(f"__{p}") / F.col("__w")).otherwise(F.lit(FLAT_SETTINGS[p])).alias(p) for p in params],
        )
    )


def nearest_anchor(labels: DataFrame, weights: DataFrame, label: str, anchor: str, default: str | None = None) -> DataFrame:
    """Anchor of the largest weight, ties alphabetical; the default without weights."""
    best = weights.groupBy(label).agg(
        F.min(F.struct((-F.col("weight")).alias("w"), F.col(anchor).alias("a")))["a"].alias("__best")
    )
    return labels.select(label).distinct().join(best, label, "left").select(
        label, F.coalesce("__best", F.lit(default)).alias("nearest")
    )


def to_log_space(df: DataFrame, params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    """Frequencies and Q as log10, gains unchanged."""
    return df.withColumns({p: F.log10(p) for p in params if kind(p) != "gain"})


def from_log_space(df: DataFrame, bounds: dict[str, tuple[float, float]], params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    back = df.withColumns({p: F.pow(F.lit(10.0), F.col(p)) for p in params if kind(p) != "gain"})
    return clip_to_bounds(back, bounds, params)


def clip_to_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    """Clamp every parameter to the bounds of its kind (gain, freq, q)."""
    return df.withColumns({p: clamp(F.col(p), *bounds[kind(p)]) for p in params})


def flat_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(FLAT_SETTINGS[p] for p in PARAM_NAMES)], list(PARAM_NAMES))


def first_of(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order (last wins with a descending order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
