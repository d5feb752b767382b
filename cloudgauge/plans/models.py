"""Components, mixtures, conditional variance, and the standing log queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudgauge.functions.params import PARAM_NAMES
from cloudgauge.operators import dispersion, hypothesis, mixtures, structure
from cloudgauge.plans import tables as t
from cloudgauge.plans.aggregates import COST_SQL, FIRST_OK_SQL, usage_columns
from cloudgauge.plans.registry import query
from cloudgauge.session import scratch_path
from cloudgauge.streaming import receipts as stream


@query("pca_curves")
def pca_curves(spark, sf_dir):
    got = structure.pca_curves(t.curves(spark, sf_dir), ["label"], k=10)
    return got.select("label", "n", F.posexplode("ratio").alias("component", "variance_share"))


@query("pca_curves_95")
def pca_curves_95(spark, sf_dir):
    """As many components as 95 % of the variance takes."""
    got = structure.pca_curves(t.curves(spark, sf_dir), ["label"], variance=0.95)
    return got.select("label", "n", F.size("ratio").alias("n_components"))


@query(
    "pca_two_columns",
    t.with_views(
        t.CURVES_SQL,
        "c2 AS (SELECT label, vec[1] AS x, vec[2] AS y FROM curves)",
        "cov AS (SELECT label, count(*) AS n, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM c2 GROUP BY label)",
        "val AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM cov)",
        "pairs AS (SELECT label, n, 0 AS component, l1 AS l, l1 + l2 AS total, b, l1 - a AS d FROM val UNION ALL SELECT label, n, 1, l2, l1 + l2, b, l2 - a FROM val)",
        "unit AS (SELECT *, b / sqrt(b * b + d * d) AS u, d / sqrt(b * b + d * d) AS v FROM pairs)",
    )
    + "SELECT label, n, component, round(l, 6) AS explained, round(l / total, 6) AS variance_share,"
    " round(CASE WHEN abs(u) >= abs(v) THEN abs(u) ELSE u * sign(v) END, 5) AS loading_x, round(CASE WHEN abs(u) >= abs(v) THEN v * sign(u) ELSE abs(v) END, 5) AS loading_y FROM unit",
)
def pca_two_columns(spark, sf_dir):
    """Components of two columns, whose values and directions have a closed form."""
    rows = t.curves(spark, sf_dir).withColumn("vec", F.slice("vec", 1, 2))
    got = structure.pca_curves(rows, ["label"], k=2)
    each = got.select("label", "n", F.posexplode("ratio").alias("component", "share"), "explained", "components")
    load = lambda i: F.get("components", 2 * F.col("component") + i)
    return each.select(
        "label",
        "n",
        "component",
        F.round(F.get("explained", F.col("component")), 6).alias("explained"),
        F.round("share", 6).alias("variance_share"),
        F.round(load(0), 5).alias("loading_x"),
        F.round(load(1), 5).alias("loading_y"),
    )


def _scores(spark, sf_dir, k=10):
    df = t.curves(spark, sf_dir)
    model = structure.pca_curves(df, ["label"], k=k)
    return mixtures.project(df, model, ["label"])


def _mixture(spark, sf_dir):
    return mixtures.gmm_select_by_bic(_scores(spark, sf_dir), ["label"], "vec_id")


@query("gmm_select_by_bic")
def gmm_select_by_bic(spark, sf_dir):
    return _mixture(spark, sf_dir)[0]


@query("assign_modes")
def assign_modes(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    comps = mixtures.gmm_select_by_bic(scores, ["label"], "vec_id")[1]
    modes = mixtures.assign_modes(scores, comps, ["label"])
    return structure.mode_table(modes.withColumn("arm", F.col("vec_id") % 3), ["label"], ["arm"])


# Two columns of every curve, for which densities are short enough to be written as SQL.
TWO_SQL = "two AS (SELECT vec_id, label, vec[1] AS x0, vec[2] AS x1 FROM curves)"
EM_STEPS, EM_TOL = 5, 1e-3
_LOG_JOINT = (
    "ln(w) - ln(2 * pi()) - ln(c00 * c11 - c01 * c01) / 2 - (c11 * (x0 - m0) * (x0 - m0) - 2 * c01 * (x0 - m0) * (x1 - m1)"
    " + c00 * (x1 - m1) * (x1 - m1)) / (c00 * c11 - c01 * c01) / 2"
)


def _em_sql() -> str:
    """The fit of one and two components, from two starts, step by step."""
    steps = [
        "g AS (SELECT label, count(*) AS n, avg(x0) AS a0, avg(x1) AS a1, avg(x0 * x0) - avg(x0) * avg(x0) + 1e-6 AS v00, avg(x0 * x1) - avg(x0) * avg(x1) AS v01, avg(x1 * x1) - avg(x1) * avg(x1) + 1e-6 AS v11 FROM two GROUP BY label)",
        "drawn AS (SELECT *, row_number() OVER (PARTITION BY label, s ORDER BY md5(concat_ws(':', '42', CAST(s AS STRING), CAST(vec_id AS STRING))), vec_id) AS j FROM two, (VALUES (0), (1)) AS st(s) QUALIFY j <= 2)",
        "p0 AS (SELECT label, n, 1 AS k, 0 AS s, 1 AS j, 1E0 AS w, a0 AS m0, a1 AS m1, v00 AS c00, v01 AS c01, v11 AS c11, CAST('-inf' AS DOUBLE) AS ll, 0 AS n_steps, false AS done, false AS converged FROM g"
        " UNION ALL SELECT label, n, 2, s, j, 0.5E0, x0, x1, v00, v01, v11, CAST('-inf' AS DOUBLE), 0, false, false FROM drawn JOIN g USING (label))",
    ]
    for i in range(EM_STEPS):
        last = "true" if i == EM_STEPS - 1 else "false"
        keep = lambda old, new: f"CASE WHEN stops THEN {old} ELSE {new} END AS {old}"
        new = ", ".join(
            keep(old, value)
            for old, value in (
                ("w", "nj / n"), ("m0", "s0 / nj"), ("m1", "s1 / nj"), ("c00", "s00 / nj - s0 * s0 / nj / nj + 1e-6"),
                ("c01", "s01 / nj - s0 * s1 / nj / nj"), ("c11", "s11 / nj - s1 * s1 / nj / nj + 1e-6"),
            )
        )
        steps += [
            f"e{i} AS (SELECT k, s, j, label, vec_id, x0, x1, {_LOG_JOINT} AS lj FROM two JOIN p{i} USING (label) WHERE NOT done)",
            f"t{i} AS (SELECT *, max(lj) OVER u + ln(sum(exp(lj - mx)) OVER u) AS total FROM (SELECT *, max(lj) OVER (PARTITION BY label, k, s, vec_id) AS mx FROM e{i}) WINDOW u AS (PARTITION BY label, k, s, vec_id))",
            f"q{i} AS (SELECT label, k, s, j, avg(total) AS ll_new, sum(r) AS nj, sum(r * x0) AS s0, sum(r * x1) AS s1, sum(r * x0 * x0) AS s00, sum(r * x0 * x1) AS s01, sum(r * x1 * x1) AS s11 FROM (SELECT *, exp(lj - total) AS r FROM t{i}) GROUP BY label, k, s, j)",
            f"r{i} AS (SELECT *, abs(ll_new - ll) < {EM_TOL} AS near, abs(ll_new - ll) < {EM_TOL} OR {last} AS stops FROM p{i} JOIN q{i} USING (label, k, s, j))",
            f"p{i + 1} AS (SELECT label, n, k, s, j, {new}, ll_new AS ll, n_steps + 1 AS n_steps, stops AS done, near AS converged FROM r{i} UNION ALL SELECT * FROM p{i} WHERE done)",
        ]
    steps += [
        f"rated AS (SELECT DISTINCT label, k, s, n, ll * n AS log_likelihood, -2 * ll * n + (6 * k - 1) * ln(n) AS bic, n_steps, converged FROM p{EM_STEPS})",
        "firsts AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY label, k ORDER BY bic, s) = 1)",
    ]
    return (
        t.with_views(t.CURVES_SQL, TWO_SQL, *steps)
        + "SELECT label, k, n, round(log_likelihood, 4) AS log_likelihood, round(bic, 4) AS bic, n_steps, converged,"
        " row_number() OVER (PARTITION BY label ORDER BY bic, k) = 1 AS best FROM firsts"
    )


def _two_columns(spark, sf_dir):
    return t.curves(spark, sf_dir).select("vec_id", "label", F.slice("vec", 1, 2).alias("scores"))


@query("gmm_two_columns", _em_sql())
def gmm_two_columns(spark, sf_dir):
    """One or two components on two columns, with what SQL makes of the same steps."""
    bic, _ = mixtures.gmm_select_by_bic(_two_columns(spark, sf_dir), ["label"], "vec_id", ks=(1, 2), starts=2, max_iter=EM_STEPS, tol=EM_TOL)
    return bic.withColumns({c: F.round(c, 4) for c in ("log_likelihood", "bic")})


_FIXED_SQL = (
    "fixed AS (SELECT label, CAST(vec_id % 2 AS INT) AS mode, CASE WHEN vec_id % 2 = 0 THEN 0.6E0 ELSE 0.4E0 END AS w, avg(x0) AS m0, avg(x1) AS m1,"
    " CASE WHEN vec_id % 2 = 0 THEN 0.01E0 ELSE 0.02E0 END AS c00, 0.002E0 AS c01, 0.015E0 AS c11 FROM two GROUP BY label, vec_id % 2)"
)


@query(
    "assign_fixed_modes",
    t.with_views(t.CURVES_SQL, TWO_SQL, _FIXED_SQL)
    + f"SELECT label, vec_id, arg_max(mode, lj) AS mode, round(ln(sum(exp(lj))), 6) AS log_density FROM (SELECT label, vec_id, mode, {_LOG_JOINT} AS lj FROM two JOIN fixed USING (label)) GROUP BY label, vec_id",
)
def assign_fixed_modes(spark, sf_dir):
    """Modes under a given mixture: two components per label around the means of its halves."""
    rows = _two_columns(spark, sf_dir)
    even = F.col("vec_id") % 2 == 0
    comps = rows.groupBy("label", (F.col("vec_id") % 2).cast("int").alias("mode")).agg(
        F.max(F.when(even, 0.6).otherwise(0.4)).alias("share"),
        F.array(F.avg(F.col("scores")[0]), F.avg(F.col("scores")[1])).alias("mean"),
        F.array(F.max(F.when(even, 0.01).otherwise(0.02)), F.lit(0.002), F.lit(0.002), F.lit(0.015)).alias("cov"),
    )
    modes = mixtures.assign_modes(rows, comps, ["label"])
    return modes.select("label", "vec_id", "mode", F.round("log_density", 6).alias("log_density"))


@query(
    "mode_shares",
    "SELECT o_orderpriority AS label, o_orderstatus AS mode, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY o_orderpriority, o_orderstatus",
)
def mode_shares(spark, sf_dir):
    assigned = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("mode")
    )
    return structure.mode_shares(assigned, ["label"]).withColumn("share", F.round("share", 6))


@query(
    "mode_levels",
    t.with_views(t.CURVES_SQL, "long AS (SELECT label, vec_id % 3 AS mode, unnest(range(len(vec))) AS bin, unnest(vec) AS x FROM curves)")
    + "SELECT label, mode, round(avg(x), 6) AS level, round(avg(x) FILTER (WHERE bin < 16), 6) AS low_level FROM long GROUP BY label, mode",
)
def mode_levels(spark, sf_dir):
    """Mean level of each mode, over all bins and over the lowest sixteen."""
    assigned = t.curves(spark, sf_dir).withColumn("mode", F.col("vec_id") % 3)
    every = structure.mode_levels(assigned, ["label"], "mode", "vec")
    low = structure.mode_levels(assigned, ["label"], "mode", "vec", F.col("bin") < 16).withColumnRenamed("level", "low_level")
    return every.join(low, ["label", "mode"]).select(
        "label", "mode", F.round("level", 6).alias("level"), F.round("low_level", 6).alias("low_level")
    )


def _features(spark, sf_dir):
    """First 56 dimensions as features, the last 8 as targets."""
    return t.curves(spark, sf_dir).select(
        "vec_id", "label", F.slice("vec", 1, 56).alias("x"), F.slice("vec", 57, 8).alias("y")
    )


@query("ridge_cv_r2")
def ridge_cv_r2(spark, sf_dir):
    got = structure.ridge_cv_r2(_features(spark, sf_dir), ["label"], "vec_id", "x", "y")
    return got.select("label", "n", "r2", F.size("r2_per_target").alias("n_targets"))


@query("permutation_null")
def permutation_null(spark, sf_dir):
    return structure.permutation_null(_features(spark, sf_dir), ["label"], "vec_id", "x", "y").select("label", "n", "r2")


# A ridge from one column to another: every step of the operator is short enough for SQL.
_RIDGE_SQL = (
    "folded AS (SELECT label, CAST('0x' || substr(md5(concat_ws(':', '42:fold', CAST(vec_id AS STRING))), 1, 8) AS BIGINT) % 5 AS f, vec[1] AS x, vec[2] AS y FROM curves)",
    "folds AS (SELECT DISTINCT label, f FROM folded)",
    "trained AS (SELECT o.label, o.f, count(*) AS nt, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS vx, avg(x * y) - avg(x) * avg(y) AS vxy FROM folds o JOIN folded r ON r.label = o.label AND r.f <> o.f GROUP BY o.label, o.f)",
    "fitted AS (SELECT label, f, mx, my, nt * vxy / (vx * (nt + 10)) AS b FROM trained)",
    "errors AS (SELECT label, count(*) AS n, sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS sse FROM folded JOIN fitted USING (label, f) GROUP BY label)",
    "spreads AS (SELECT label, var_pop(y) * count(*) AS sst FROM folded GROUP BY label)",
    "explained AS (SELECT label, n, greatest(-1, 1 - sse / sst) AS r2 FROM errors JOIN spreads USING (label))",
)


def _one_column_r2(spark, sf_dir):
    rows = t.curves(spark, sf_dir).select("vec_id", "label", F.slice("vec", 1, 1).alias("x"), F.slice("vec", 2, 1).alias("y"))
    return structure.ridge_cv_r2(rows, ["label"], "vec_id", "x", "y").select("label", "n", "r2")


@query("ridge_one_column", t.with_views(t.CURVES_SQL, *_RIDGE_SQL) + "SELECT label, n, round(r2, 6) AS r2 FROM explained")
def ridge_one_column(spark, sf_dir):
    """The second column of every curve from the first, out of fold."""
    return _one_column_r2(spark, sf_dir).withColumn("r2", F.round("r2", 6))


@query(
    "residual_dispersion",
    t.with_views(
        t.CURVES_SQL,
        *_RIDGE_SQL,
        "long AS (SELECT vec_id, label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM curves)",
        "m AS (SELECT label, i, avg(x) AS m FROM long GROUP BY label, i)",
        "d AS (SELECT vec_id, label, sqrt(avg((x - m) * (x - m))) AS d FROM long JOIN m USING (label, i) GROUP BY vec_id, label)",
        "g AS (SELECT label, avg(d) AS raw FROM d GROUP BY label)",
    )
    + "SELECT label, round(raw, 6) AS raw, round(r2, 6) AS r2, round(raw * sqrt(least(greatest(1 - r2, 0), 1)), 6) AS residual FROM g JOIN explained USING (label)",
)
def residual_dispersion(spark, sf_dir):
    """What is left of each label's dispersion by the share that a fitted ridge explains."""
    raw = dispersion.dispersion_to_centroid(t.curves(spark, sf_dir), ["label"])
    joined = raw.join(_one_column_r2(spark, sf_dir).select("label", "r2"), "label")
    return joined.select(
        "label",
        F.round("dispersion", 6).alias("raw"),
        F.round("r2", 6).alias("r2"),
        F.round(structure.residual_dispersion(F.col("dispersion"), F.col("r2")), 6).alias("residual"),
    )


@query(
    "sd_ratio",
    t.with_views(
        t.CURVES_SQL,
        "long AS (SELECT vec_id, label, unnest(range(len(vec))) AS i, unnest(vec) AS u FROM curves)",
        "f AS (SELECT label, i, stddev_pop(u) AS su, stddev_pop(u * (1 + (vec_id % 3) / 2E0)) AS sp FROM long GROUP BY label, i)",
    )
    + "SELECT label, count(*) AS n_features, round(median(sp / su), 6) AS sd_ratio FROM f WHERE su > 1e-9 GROUP BY label",
)
def sd_ratio(spark, sf_dir):
    louder = F.transform("vec", lambda x: x * (1 + (F.col("vec_id") % 3) / 2.0))
    both = t.curves(spark, sf_dir).withColumn("after", louder)
    return structure.sd_ratio(both, ["label"], "vec", "after").withColumn("sd_ratio", F.round("sd_ratio", 6))


@query("embedding_regressor")
def embedding_regressor(spark, sf_dir):
    df = _features(spark, sf_dir)
    got = structure.embedding_regressor(
        df.filter("vec_id % 7 >= 3"), df.filter("vec_id % 7 < 3").select("vec_id", "label", "x"), "vec_id", "x", "y"
    )
    return got.select("vec_id", "label", "prediction", F.size("prediction").alias("n_targets"), "seed_spread")


_POISSON = [sum(math.exp(-1.0) / math.factorial(j) for j in range(i + 1)) for i in range(12)]


@query(
    "embedding_regressor_one_column",
    t.with_views(
        t.CURVES_SQL,
        "rows2 AS (SELECT vec_id, label, vec[1] AS x, vec[2] AS y FROM curves)",
        "drawn AS (SELECT s, x, y, CAST('0x' || substr(md5(concat_ws(':', 'boot', CAST(s AS STRING), CAST(vec_id AS STRING))), 1, 8) AS BIGINT) / 4294967296E0 AS u FROM rows2, (VALUES (0), (1), (2)) v(s) WHERE vec_id % 7 >= 3)",
        f"weighted AS (SELECT s, x, y, {' + '.join(f'CASE WHEN u > {c!r} THEN 1 ELSE 0 END' for c in _POISSON)} AS w FROM drawn)",
        "means AS (SELECT s, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM weighted GROUP BY s)",
        "fits AS (SELECT s, mx, my, sum(w * (x - mx) * (y - my)) / (sum(w * (x - mx) * (x - mx)) + 1) AS b FROM weighted JOIN means USING (s) GROUP BY s, mx, my)",
    )
    + "SELECT vec_id, round(avg(my + b * (x - mx)), 6) AS prediction, round(stddev_pop(my + b * (x - mx)), 6) AS seed_spread FROM rows2, fits WHERE vec_id % 7 < 3 GROUP BY vec_id",
)
def embedding_regressor_one_column(spark, sf_dir):
    """From one column to another, so that SQL can make the same replicates and fits."""
    rows = t.curves(spark, sf_dir).select("vec_id", F.slice("vec", 1, 1).alias("x"), F.slice("vec", 2, 1).alias("y"))
    got = structure.embedding_regressor(rows.filter("vec_id % 7 >= 3"), rows.filter("vec_id % 7 < 3").select("vec_id", "x"), "vec_id", "x", "y")
    return got.select("vec_id", F.round(F.col("prediction")[0], 6).alias("prediction"), F.round("seed_spread", 6).alias("seed_spread"))


@query("mode_gof")
def mode_gof(spark, sf_dir):
    """Goodness of fit of every arm's mode counts against the shares of the whole cloud."""
    scores = _scores(spark, sf_dir)
    comps = mixtures.gmm_select_by_bic(scores, ["label"], "vec_id")[1]
    modes = mixtures.assign_modes(scores, comps, ["label"]).withColumn("arm", F.col("vec_id") % 3)
    shares = structure.mode_shares(modes, ["label"]).select("label", "mode", "share")
    cells = structure.mode_table(modes, ["label"], ["arm"]).join(shares, ["label", "mode"])
    return hypothesis.chi_square_gof(cells, ["label", "arm"], "observed", "share")


# --- streams ---------------------------------------------------------------------------------------

# rows of the first ten days that arrive after everything else
HELD_BACK = "seq % 50 = 0 AND ts < TIMESTAMP '2024-01-11 00:00:00'"
LAST_DAYS = "ts >= TIMESTAMP '2024-01-21 00:00:00'"


def _delivered(spark, sf_dir, deliveries, start):
    """The log arrives in parts; after each of them the stream starts again from its
    checkpoint and takes what has come as one batch."""
    path = scratch_path(spark, "stream")
    log = t.receipts(spark, sf_dir)
    for part in deliveries:
        log.filter(part).write.mode("append").parquet(f"{path}/in")
        arriving = stream.read_log_stream(spark, f"{path}/in", log.schema, max_files=1_000_000)
        start(arriving, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{path}/in"), f"{path}/out"


@query(
    "stream_compile_receipts",
    t.with_views(FIRST_OK_SQL) + f"SELECT cell_id, seq, model, {', '.join(PARAM_NAMES)} FROM first_ok",
)
def stream_compile_receipts(spark, sf_dir):
    """The last days arrive first, and a part of the first ones last."""

    def start(log, out, checkpoint):
        return stream.stream_compile_receipts(log, out, checkpoint, "cell_id", "seq", keep=["model"])

    parts = [LAST_DAYS, f"NOT ({LAST_DAYS}) AND NOT ({HELD_BACK})", HELD_BACK]
    _, out = _delivered(spark, sf_dir, parts, start)
    return stream.read_compiled(spark, out, "cell_id", "seq")


def _late_costs(spark, sf_dir):
    tokens_in, tokens_out = usage_columns()

    def start(log, out, checkpoint):
        return stream.stream_cost(log, out, checkpoint, "ts", "model", tokens_in, tokens_out, lateness="2 days")

    parts = [f"NOT ({LAST_DAYS}) AND NOT ({HELD_BACK})", LAST_DAYS, HELD_BACK]
    arrived, out = _delivered(spark, sf_dir, parts, start)
    return arrived, stream.read_stream_cost(spark, out, "model")


@query(
    "stream_cost",
    t.with_views(COST_SQL.replace("FROM receipts)", f"FROM receipts WHERE NOT ({HELD_BACK}))"))
    + "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, model, count(*) AS calls, sum(coalesce(ti, 0))::BIGINT AS tokens_in, sum(coalesce(tk, 0))::BIGINT AS tokens_out FROM usage GROUP BY ALL",
)
def stream_cost(spark, sf_dir):
    """What is held back comes when its windows are closed, and does not count."""
    return _late_costs(spark, sf_dir)[1]


@query(
    "stream_late_rows",
    t.with_views(t.RECEIPTS_SQL)
    + f"SELECT model, count(*) AS arrived, count(*) FILTER (WHERE NOT ({HELD_BACK})) AS counted, count(*) FILTER (WHERE {HELD_BACK}) AS late FROM receipts GROUP BY model",
)
def stream_late_rows(spark, sf_dir):
    arrived, costs = _late_costs(spark, sf_dir)
    return stream.late_rows(arrived, costs, "model")
