"""Distances, percentiles and spreads on labelled vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudgauge.operators import clouds, dispersion, sampling
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query

_DIST = "list_distance(a.vec, b.vec) / sqrt(len(a.vec))"
_UNIT_GOLD = f"ug AS (SELECT a.vec_id, a.label, a.arm, a.model, a.prompt, {_DIST} AS d FROM units a JOIN gold b ON a.label = b.label)"
_LOO = f"loo AS (SELECT a.vec_id, a.label, {_DIST} AS d FROM gold a JOIN gold b ON a.label = b.label AND a.vec_id <> b.vec_id)"


@query(
    "pairs_to_cloud",
    t.with_views(t.UNITS_SQL, _UNIT_GOLD)
    + "SELECT vec_id, label, count(*) AS n_pairs, round(avg(d), 6) AS mean_dist, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM ug GROUP BY vec_id, label",
)
def pairs_to_cloud(spark, sf_dir):
    got = clouds.pairs_to_cloud(t.answer_units(spark, sf_dir), t.gold_cloud(spark, sf_dir), ["label"], "vec_id", "vec_id")
    return _rounded_pairs(got)


def _rounded_pairs(df):
    return df.select(
        "vec_id",
        "label",
        "n_pairs",
        F.round(F.col("sum_dist") / F.col("n_pairs"), 6).alias("mean_dist"),
        F.round("min_dist", 6).alias("min_dist"),
        F.round("max_dist", 6).alias("max_dist"),
    )


@query(
    "pairs_leave_one_out",
    t.with_views(t.UNITS_SQL, _LOO)
    + "SELECT vec_id, label, count(*) AS n_pairs, round(avg(d), 6) AS mean_dist, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM loo GROUP BY vec_id, label",
)
def pairs_leave_one_out(spark, sf_dir):
    return _rounded_pairs(clouds.pairs_leave_one_out(t.gold_cloud(spark, sf_dir), ["label"], "vec_id"))


@query(
    "pairs_unordered",
    t.with_views(t.CURVES_SQL)
    + f"""SELECT a.label, (SELECT count(*) FROM curves c WHERE c.label = a.label) AS n_rows, count(*) AS n_pairs, round(avg({_DIST}), 6) AS mean_dist
FROM curves a JOIN curves b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""",
)
def pairs_unordered(spark, sf_dir):
    got = clouds.pairs_unordered(t.curves(spark, sf_dir), ["label"], "vec_id")
    return got.select("label", "n_rows", "n_pairs", F.round("mean_dist", 6).alias("mean_dist"))


_MEANS = "means AS (SELECT label, list(m ORDER BY i) AS vec FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM curves) GROUP BY label, i) GROUP BY label)"


@query(
    "lsd_distance",
    t.with_views(t.CURVES_SQL, _MEANS)
    + f"SELECT a.vec_id, round({_DIST}, 6) AS lsd FROM curves a JOIN means b ON a.label = b.label",
)
def lsd_distance(spark, sf_dir):
    """Every vector against its label's mean vector."""
    df = t.curves(spark, sf_dir)
    centre = clouds.mean_curve(df, ["label"]).select("label", "mean_vec")
    return df.join(centre, "label").select("vec_id", F.round(clouds.lsd_distance(F.col("vec"), F.col("mean_vec")), 6).alias("lsd"))


@query(
    "cloud_centrality",
    t.with_views(t.UNITS_SQL, _UNIT_GOLD)
    + "SELECT vec_id, label, count(*) AS n_pairs, round(median(d), 6) AS centrality FROM ug GROUP BY vec_id, label",
)
def cloud_centrality(spark, sf_dir):
    got = clouds.cloud_centrality(t.answer_units(spark, sf_dir), t.gold_cloud(spark, sf_dir), ["label"], "vec_id", "vec_id")
    return got.withColumn("centrality", F.round("centrality", 6))


_KNOTS_SQL = (
    "knots AS (SELECT vec_id, label, list_transform(vec, lambda x, i: x / 10 + CASE WHEN i % 5 = vec_id % 5 + 1 OR (i % 5 = 0 AND vec_id % 5 = 4) THEN 1E0 ELSE 0E0 END) AS vec FROM curves)",
    "kk AS (SELECT a.vec_id, a.label, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a.vec)) AS d FROM knots a JOIN knots b ON a.label = b.label AND a.vec_id <> b.vec_id)",
)


@query(
    "centrality_in_blocks",
    t.with_views(t.CURVES_SQL, *_KNOTS_SQL)
    + "SELECT vec_id, label, count(*) AS n_pairs, round(median(d), 6) AS centrality FROM kk GROUP BY vec_id, label",
)
def centrality_in_blocks(spark, sf_dir):
    """Each curve against the others of its label, which lie around five knots, in blocks
    that are small for clouds of any size."""
    knot = lambda x, i: x / 10 + F.when(i % 5 == F.col("vec_id") % 5, 1.0).otherwise(0.0)
    df = t.curves(spark, sf_dir).withColumn("vec", F.transform("vec", knot))
    got = clouds.leave_one_out_centrality(df, ["label"], "vec_id", left_rows=64, right_rows=32)
    return got.withColumn("centrality", F.round("centrality", 6))


_TAIL_LABELS = "tails AS (SELECT label FROM curves GROUP BY label HAVING count(*) < (SELECT count(*) / count(DISTINCT label) FROM curves))"


@query(
    "tail_distance",
    t.with_views(t.UNITS_SQL, _TAIL_LABELS, _UNIT_GOLD)
    + "SELECT vec_id, label, round(median(d), 6) AS tail_lsd FROM ug WHERE label IN (SELECT label FROM tails) GROUP BY vec_id, label",
)
def tail_distance(spark, sf_dir):
    """The same median for labels under the floor, here the mean label size."""
    df = t.curves(spark, sf_dir)
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    floor = counts.agg(F.avg("n").alias("floor"))
    tails = counts.join(F.broadcast(floor), F.col("n") < F.col("floor")).select("label")
    units = t.answer_units(spark, sf_dir).join(tails, "label", "left_semi")
    got = clouds.cloud_centrality(units, t.gold_cloud(spark, sf_dir), ["label"], "vec_id", "vec_id", "tail_lsd")
    return got.select("vec_id", "label", F.round("tail_lsd", 6).alias("tail_lsd"))


_HRP_SQL = (
    "refs AS (SELECT vec_id, label, median(d) AS c FROM loo GROUP BY vec_id, label)",
    "preds AS (SELECT vec_id, label, median(d) AS c FROM ug GROUP BY vec_id, label)",
    "hrps AS (SELECT p.vec_id, p.label, 100.0 * count(*) FILTER (WHERE r.c < p.c) / count(*) AS hrp FROM preds p JOIN refs r ON r.label = p.label GROUP BY p.vec_id, p.label)",
)


@query(
    "human_relative_percentile",
    t.with_views(t.UNITS_SQL, _UNIT_GOLD, _LOO, *_HRP_SQL) + "SELECT vec_id, label, round(hrp, 6) AS hrp FROM hrps",
)
def human_relative_percentile(spark, sf_dir):
    gold = t.gold_cloud(spark, sf_dir)
    pred = clouds.cloud_centrality(t.answer_units(spark, sf_dir), gold, ["label"], "vec_id", "vec_id")
    ref = clouds.leave_one_out_centrality(gold, ["label"], "vec_id")
    got = clouds.human_relative_percentile(pred, ref, ["label"])
    return got.select("vec_id", "label", F.round("hrp", 6).alias("hrp"))


def _energy_sql(groups: str, prefix: str) -> str:
    """SQL for energy rows of `{prefix}units` against `gold`."""
    on = " AND ".join(f"a.{g} = b.{g}" for g in groups.split(", "))
    return f"""xy AS (SELECT {', '.join('a.' + g for g in groups.split(', '))}, avg({_DIST}) AS ab, count(DISTINCT a.vec_id) AS n FROM units a JOIN gold b ON a.label = b.label GROUP BY ALL),
xx AS (SELECT {', '.join('a.' + g for g in groups.split(', '))}, avg({_DIST}) AS aa FROM units a JOIN units b ON {on} AND a.vec_id < b.vec_id GROUP BY ALL),
yy AS (SELECT a.label, avg({_DIST}) AS bb FROM gold a JOIN gold b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label),
energy AS (SELECT {', '.join('xy.' + g for g in groups.split(', '))}, n AS n_samples, 2 * ab - coalesce(aa, 0) - coalesce(bb, 0) AS energy_dist,
  coalesce(aa, 0) AS cloud_dispersion, coalesce(bb, 0) AS human_dispersion, CASE WHEN bb > 0 THEN coalesce(aa, 0) / bb END AS dispersion_ratio
  FROM xy LEFT JOIN xx USING ({groups}) LEFT JOIN yy USING (label) WHERE n >= 5)"""


ENERGY_SQL = t.UNITS_SQL + ",\n" + _energy_sql("arm, label", "")


def energy_rows(spark, sf_dir):
    return dispersion.energy_distance(
        t.answer_units(spark, sf_dir), t.gold_cloud(spark, sf_dir), ["arm"], "label", "vec_id", "vec_id"
    )


@query(
    "energy_distance",
    t.with_views(ENERGY_SQL)
    + "SELECT arm, label, n_samples, round(energy_dist, 6) + 0.0 AS energy_dist, round(cloud_dispersion, 6) AS cloud_dispersion, round(human_dispersion, 6) AS human_dispersion FROM energy",
)
def energy_distance(spark, sf_dir):
    return energy_rows(spark, sf_dir).select(
        "arm",
        "label",
        "n_samples",
        (F.round("energy_dist", 6) + 0.0).alias("energy_dist"),
        F.round("cloud_dispersion", 6).alias("cloud_dispersion"),
        F.round("human_dispersion", 6).alias("human_dispersion"),
    )


@query("dispersion_ratio", t.with_views(ENERGY_SQL) + "SELECT arm, label, round(dispersion_ratio, 6) AS dispersion_ratio FROM energy")
def dispersion_ratio(spark, sf_dir):
    return energy_rows(spark, sf_dir).select("arm", "label", F.round("dispersion_ratio", 6).alias("dispersion_ratio"))


@query(
    "arm_dispersion_mean",
    t.with_views(ENERGY_SQL)
    + "SELECT arm, count(*) AS n_groups, round(avg(cloud_dispersion), 6) AS mean_dispersion, round(avg(human_dispersion), 6) AS human_reference FROM energy WHERE dispersion_ratio IS NOT NULL GROUP BY arm",
)
def arm_dispersion_mean(spark, sf_dir):
    got = dispersion.arm_dispersion_mean(energy_rows(spark, sf_dir), ["arm"])
    return got.select(
        "arm", "n_groups", F.round("mean_dispersion", 6).alias("mean_dispersion"), F.round("human_reference", 6).alias("human_reference")
    )


_HALVES = """ranked AS (SELECT vec_id, label, vec, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS STRING)), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM curves),
units AS (SELECT vec_id, label, vec FROM ranked WHERE rn <= n // 2),
gold AS (SELECT vec_id, label, vec FROM ranked WHERE rn > n // 2)"""


@query(
    "split_half_reference",
    t.with_views(t.CURVES_SQL, _HALVES, _energy_sql("label", "").replace("WHERE n >= 5", ""))
    + "SELECT label, n_samples, round(energy_dist, 6) + 0.0 AS energy_dist FROM energy",
)
def split_half_reference(spark, sf_dir):
    halves = sampling.split_half(t.curves(spark, sf_dir), ["label"], "vec_id")
    got = dispersion.split_half_reference(halves, "label", "vec_id")
    return got.select("label", "n_samples", (F.round("energy_dist", 6) + 0.0).alias("energy_dist"))


@query(
    "dispersion_to_centroid",
    t.with_views(t.CURVES_SQL, _MEANS)
    + f"SELECT a.label, count(*) AS n, round(avg({_DIST}), 6) AS dispersion FROM curves a JOIN means b ON a.label = b.label GROUP BY a.label",
)
def dispersion_to_centroid(spark, sf_dir):
    got = dispersion.dispersion_to_centroid(t.curves(spark, sf_dir), ["label"])
    return got.select("label", "n", F.round("dispersion", 6).alias("dispersion"))


@query(
    "centroid_shift",
    t.with_views(
        t.CURVES_SQL,
        "long AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 'novice' WHEN vec_id % 3 = 1 THEN 'experienced' ELSE 'gap' END AS grp, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM curves)",
        "m AS (SELECT label, grp, i, avg(x) AS m, count(*) AS n FROM long GROUP BY label, grp, i HAVING count(*) >= 15)",
    )
    + """SELECT a.label, max(a.n) AS n_first, max(b.n) AS n_second, round(sqrt(avg((a.m - b.m) * (a.m - b.m))), 6) AS shift
FROM m a JOIN m b ON a.label = b.label AND a.i = b.i WHERE a.grp = 'novice' AND b.grp = 'experienced' GROUP BY a.label""",
)
def centroid_shift(spark, sf_dir):
    third = F.col("vec_id") % 3
    grouped = t.curves(spark, sf_dir).withColumn(
        "grp", F.when(third == 0, "novice").when(third == 1, "experienced").otherwise("gap")
    )
    got = dispersion.centroid_shift(grouped, ["label"], "grp", "novice", "experienced")
    return got.withColumn("shift", F.round("shift", 6))


_PULL_SQL = (
    "base AS (SELECT model, prompt, label, vec AS base_vec FROM units WHERE arm = 'B' QUALIFY row_number() OVER (PARTITION BY model, prompt, label ORDER BY vec_id DESC) = 1)",
    "shown AS (SELECT * FROM gold QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5)",
    """items AS (SELECT 'centroid' AS target, label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM gold
  UNION ALL SELECT 'exemplars', label, unnest(range(len(vec))), unnest(vec) FROM shown)""",
    "target AS (SELECT label, target, list(m ORDER BY i) AS target_vec FROM (SELECT label, target, i, avg(x) AS m FROM items GROUP BY ALL) GROUP BY label, target)",
    """pulls AS (SELECT vec_id, model, prompt, target, list_sum(list_transform(range(1, len(u.vec) + 1), lambda i: (u.vec[i] - base_vec[i]) * (target_vec[i] - base_vec[i])))
    / list_sum(list_transform(range(1, len(u.vec) + 1), lambda i: (target_vec[i] - base_vec[i]) * (target_vec[i] - base_vec[i]))) AS pull
  FROM units u JOIN base USING (model, prompt, label) JOIN target USING (label) WHERE u.arm = 'C')""",
)


@query(
    "context_pull",
    t.with_views(t.UNITS_SQL, *_PULL_SQL)
    + "SELECT model, prompt, target, count(*) AS n, round(median(pull), 6) AS median_pull FROM pulls GROUP BY model, prompt, target",
)
def context_pull(spark, sf_dir):
    """Both targets of an answer: the centroid of its label, and the mean of the five
    curves that it was shown."""
    units, gold = t.answer_units(spark, sf_dir), t.gold_cloud(spark, sf_dir)
    keys = ["model", "prompt", "label"]
    base = units.filter("arm = 'B'").groupBy(*keys).agg(F.max_by("vec", "vec_id").alias("base_vec"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    shown = gold.withColumn("nth", nth).filter("nth <= 5").drop("nth")
    target = None
    for name, curves in (("centroid", gold), ("exemplars", shown)):
        one = clouds.mean_curve(curves, ["label"]).select("label", F.lit(name).alias("target"), F.col("mean_vec").alias("target_vec"))
        target = one if target is None else target.unionByName(one)
    pulls = dispersion.context_pull(units.filter("arm = 'C'"), base, target, keys, "label", ["vec_id", "model", "prompt", "target"])
    got = dispersion.context_pull_by_model(pulls, ["model", "prompt", "target"])
    return got.withColumn("median_pull", F.round("median_pull", 6))
