"""Rendered settings: coefficients, curves, checks and views of mean curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudgauge.functions.params import BANDS
from cloudgauge.operators import clouds, dispersion, render
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query
from cloudgauge.session import remove_path, scratch_path

RECORDS_A_FILE = 32_768
MOST_FILES = 16  # rendered at once, about 1 GB of curves

_CHAIN = " UNION ALL ".join(
    f"SELECT id, descriptor, {i} AS filter, '{b.shape}' AS shape, {b.gain} AS g, {b.freq} AS f, {b.q or '0.71E0'} AS q FROM settings"
    for i, b in enumerate(BANDS)
)
COEF_SQL = f"""{t.SETTINGS_SQL},
chain AS ({_CHAIN}),
prep AS (SELECT *, pow(10E0, g / 40) AS a, cos(2 * pi() * f / 48000) AS cw, sin(2 * pi() * f / 48000) / (2 * q) AS al FROM chain),
coef AS (SELECT id, descriptor, filter, shape,
  CASE shape WHEN 'peaking' THEN 1 + al * a WHEN 'low_shelf' THEN a * ((a + 1) - (a - 1) * cw + 2 * sqrt(a) * al) ELSE a * ((a + 1) + (a - 1) * cw + 2 * sqrt(a) * al) END AS b0,
  CASE shape WHEN 'peaking' THEN -2 * cw WHEN 'low_shelf' THEN 2 * a * ((a - 1) - (a + 1) * cw) ELSE -2 * a * ((a - 1) + (a + 1) * cw) END AS b1,
  CASE shape WHEN 'peaking' THEN 1 - al * a WHEN 'low_shelf' THEN a * ((a + 1) - (a - 1) * cw - 2 * sqrt(a) * al) ELSE a * ((a + 1) + (a - 1) * cw - 2 * sqrt(a) * al) END AS b2,
  CASE shape WHEN 'peaking' THEN 1 + al / a WHEN 'low_shelf' THEN (a + 1) + (a - 1) * cw + 2 * sqrt(a) * al ELSE (a + 1) - (a - 1) * cw + 2 * sqrt(a) * al END AS a0,
  CASE shape WHEN 'peaking' THEN -2 * cw WHEN 'low_shelf' THEN -2 * ((a - 1) + (a + 1) * cw) ELSE 2 * ((a - 1) - (a + 1) * cw) END AS a1,
  CASE shape WHEN 'peaking' THEN 1 - al / a WHEN 'low_shelf' THEN (a + 1) + (a - 1) * cw - 2 * sqrt(a) * al ELSE (a + 1) - (a - 1) * cw - 2 * sqrt(a) * al END AS a2
  FROM prep)"""
GRID_SQL = "grid AS (SELECT CAST(i AS INTEGER) AS bin, 20 * pow(1000E0, i / 255E0) AS freq_hz, pow(sin(pi() * 20 * pow(1000E0, i / 255E0) / 48000), 2) AS phi FROM range(256) r(i))"


def _square(x: str) -> str:
    return (
        f"(pow({x}0 + {x}1 + {x}2, 2) - 4 * ({x}0 * {x}1 + 4 * {x}0 * {x}2 + {x}1 * {x}2) * phi + 16 * {x}0 * {x}2 * phi * phi)"
    )


RENDER_SQL = f"""{COEF_SQL},
{GRID_SQL},
rendered AS (SELECT id, descriptor, bin, sum(10 * log10({_square('b')} / {_square('a')})) AS db FROM coef, grid GROUP BY id, descriptor, bin)"""


def folded(settings):
    """Curves of a label as sums per grid point: there are too many to be rows."""
    return render.folded_curves(settings, ["descriptor"])


_COEFS = ["b0", "b1", "b2", "a0", "a1", "a2"]


@query(
    "biquad_coefficients",
    t.with_views(COEF_SQL)
    + f"SELECT descriptor, filter, shape, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _COEFS)} FROM coef GROUP BY ALL",
)
def biquad_coefficients(spark, sf_dir):
    co = render.biquad_coefficients(t.settings(spark, sf_dir), ["descriptor"])
    return co.groupBy("descriptor", "filter", "shape").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in _COEFS]
    )


@query(
    "render_curves",
    t.with_views(RENDER_SQL)
    + "SELECT descriptor, bin, count(*) AS n, round(avg(db), 6) AS mean_db, round(min(db), 6) AS min_db, round(max(db), 6) AS max_db FROM rendered GROUP BY ALL",
)
def render_curves(spark, sf_dir):
    rounded = [F.round(c, 6).alias(name) for c, name in (("mean", "mean_db"), ("min_db", "min_db"), ("max_db", "max_db"))]
    return folded(t.settings(spark, sf_dir)).select("descriptor", "bin", "n", *rounded)


@query(
    "render_table_job",
    t.with_views(RENDER_SQL)
    + "SELECT descriptor, count(DISTINCT id) AS n_curves, round(avg(db), 6) AS mean_db, round(max(db), 6) AS max_db FROM rendered GROUP BY descriptor",
)
def render_table_job(spark, sf_dir):
    """Settings table in, table with the packed curve out, read back and folded; a few files
    at a time, as the curves take 2 KB a record. Every record goes through."""
    path = scratch_path(spark, "render")
    settings = t.settings(spark, sf_dir)
    settings.write.option("maxRecordsPerFile", RECORDS_A_FILE).parquet(f"{path}/in")
    files = spark.read.schema(settings.schema).parquet(f"{path}/in").inputFiles()
    at_once = max(1, min(MOST_FILES, spark.sparkContext.defaultParallelism))
    folds = "descriptor string, n_curves long, n long, total double, max_db double"
    for low in range(0, len(files), at_once):
        out = render.render_table_job(spark, files[low : low + at_once], f"{path}/out-{low}")
        long = out.select("descriptor", F.posexplode("response_db").alias("bin", "db"))
        fold = long.groupBy("descriptor").agg(
            F.count_if(F.col("bin") == 0).alias("n_curves"), F.count("db").alias("n"), F.sum("db").alias("total"), F.max("db").alias("max_db")
        )
        fold.coalesce(1).write.mode("append").parquet(f"{path}/folds")
        remove_path(spark, f"{path}/out-{low}")
    remove_path(spark, f"{path}/in")
    if not files:
        spark.createDataFrame([], folds).write.parquet(f"{path}/folds")
    return spark.read.schema(folds).parquet(f"{path}/folds").groupBy("descriptor").agg(
        F.sum("n_curves").alias("n_curves"),
        F.round(F.sum("total") / F.sum("n"), 6).alias("mean_db"),
        F.round(F.max("max_db"), 6).alias("max_db"),
    )


@query(
    "render_checks",
    t.with_views(t.SETTINGS_SQL)
    + """SELECT name, descriptor, count(*) AS n_curves, 0 AS n_violations
FROM settings, (VALUES ('flat'), ('peak'), ('low_shelf'), ('high_shelf'), ('cancellation'), ('grid')) v(name) GROUP BY name, descriptor""",
)
def render_checks(spark, sf_dir):
    """The six analytic checks of the renderer on every row's settings: without gains the
    curve is flat; one filter alone, with the row's gain (within 6 dB) at the frequency of
    the check, has that gain where it should and none far from there; negated gains cancel;
    the grid has its ends and its length."""
    rows = t.settings(spark, sf_dir).select("descriptor", render.settings_checks().alias("__fine"))
    ends = render.frequency_grid(spark).agg(
        ((F.abs(F.min("freq_hz") / render.GRID_LOW_HZ - 1) < 1e-9) & (F.abs(F.max("freq_hz") / render.GRID_HIGH_HZ - 1) < 1e-9) & (F.count_distinct("freq_hz") == render.GRID_POINTS)).alias("grid")
    )
    rows = rows.select("descriptor", "__fine.*").join(F.broadcast(ends))
    names = [*render.CHECKS, "grid"]
    bad = {c: F.count_if(~F.coalesce(c, F.lit(False))).alias(f"__{c}") for c in names}
    wide = rows.groupBy("descriptor").agg(F.count(F.lit(1)).alias("n_curves"), *bad.values())
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"__{c}").alias("n_violations")) for c in names])
    return wide.select("descriptor", "n_curves", F.inline(each)).select("name", "descriptor", "n_curves", "n_violations")


@query(
    "pack_curve",
    t.with_views(t.CURVES_SQL)
    + "SELECT vec_id, len(vec) AS n_bins, round(list_sum(list_transform(vec, lambda x, i: x * i)), 6) AS weighted FROM curves",
)
def pack_curve(spark, sf_dir):
    long = clouds.unpack_curve(t.curves(spark, sf_dir), ["vec_id"])
    packed = clouds.pack_curve(long, ["vec_id"])
    weighted = F.aggregate(
        F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return packed.select("vec_id", F.size("vec").cast("long").alias("n_bins"), F.round(weighted, 6).alias("weighted"))


@query(
    "unpack_curve",
    t.with_views(t.CURVES_SQL)
    + "SELECT vec_id, CAST(i AS INTEGER) AS bin, vec[i + 1] AS db FROM curves, LATERAL (SELECT unnest(range(len(vec))) AS i)",
)
def unpack_curve(spark, sf_dir):
    return clouds.unpack_curve(t.curves(spark, sf_dir), ["vec_id"])


@query(
    "mean_curve_envelope",
    t.with_views(RENDER_SQL)
    + "SELECT descriptor, bin, count(*) AS n, round(avg(db), 6) AS mean, round(stddev_pop(db), 6) AS sd FROM rendered GROUP BY descriptor, bin",
)
def mean_curve_envelope(spark, sf_dir):
    env = folded(t.settings(spark, sf_dir))
    return env.select("descriptor", "bin", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_REGION_SQL = "CASE " + " ".join(
    f"WHEN freq_hz >= {low - 1e-9!r} AND freq_hz < {high!r} THEN '{name}'" for name, low, high in dispersion.REGIONS_HZ
) + " END"


@query(
    "region_signed_error",
    t.with_views(
        RENDER_SQL,
        "split AS (SELECT r.*, s.source FROM rendered r JOIN settings s USING (id))",
        "centre AS (SELECT descriptor, bin, avg(db) AS mean FROM split WHERE source <> 'R' GROUP BY descriptor, bin)",
        f"regions AS (SELECT bin, {_REGION_SQL} AS region FROM grid)",
        "per_unit AS (SELECT a.descriptor, id, region, avg(db - mean) AS e FROM split a JOIN centre USING (descriptor, bin) JOIN regions USING (bin) WHERE source = 'R' GROUP BY ALL)",
    )
    + "SELECT descriptor, region, count(*) AS n_units, round(avg(e), 6) + 0.0 AS signed_error FROM per_unit GROUP BY ALL",
)
def region_signed_error(spark, sf_dir):
    """Returned items answer, the other items are the cloud."""
    rows = t.settings(spark, sf_dir)
    centre = folded(rows.filter("source <> 'R'"))
    answers = rows.filter("source = 'R'").select("descriptor", "id", render.region_vector(dispersion.REGIONS_HZ).alias("levels"))
    got = dispersion.packed_region_signed_error(answers, centre, "descriptor", ["id"])
    return got.withColumn("signed_error", F.round("signed_error", 6) + 0.0)


@query(
    "region_level",
    t.with_views(RENDER_SQL)
    + """SELECT descriptor, round(avg(CASE WHEN freq_hz >= 19.999999999 AND freq_hz < 200 THEN db END), 6) AS low_level,
  round(avg(CASE WHEN freq_hz >= 4999.999999999 AND freq_hz < 20000.1 THEN db END), 6) AS high_level
FROM rendered JOIN grid USING (bin) GROUP BY descriptor""",
)
def region_level(spark, sf_dir):
    curves = folded(t.settings(spark, sf_dir))
    got = dispersion.region_level(curves, ["descriptor"], render.frequency_grid(spark), value="mean", weight="n_db")
    return got.select("descriptor", F.round("low_level", 6).alias("low_level"), F.round("high_level", 6).alias("high_level"))
