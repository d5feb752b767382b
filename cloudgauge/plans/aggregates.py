"""Label profiles, the call log's summaries and arm comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudgauge.functions.params import GAINS, PARAM_NAMES
from cloudgauge.operators import answers, cleaning, dispersion, selection, structure
from cloudgauge.operators.ranks import ordered_row_number, value_slice
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query
from cloudgauge.plans.rows import ANSWERS_SQL, KEY_SQL, USABLE_SQL, usable_entries


@query("label_counts", "SELECT p_name AS descriptor, count(*) AS n FROM part GROUP BY p_name")
def label_counts(spark, sf_dir):
    return cleaning.label_counts(t.table(spark, sf_dir, "part").select(F.col("p_name").alias("descriptor")), "descriptor")


@query(
    "bucket_counts",
    t.with_views(
        t.RECEIPTS_SQL,
        "c AS (SELECT cell_id, count(*) AS n FROM receipts GROUP BY cell_id)",
        "dims(bucket) AS (VALUES ('>=20'), ('10-19'), ('5-9'), ('2-4'), ('singleton'))",
        "b AS (SELECT CASE WHEN n >= 20 THEN '>=20' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9' WHEN n >= 2 THEN '2-4' ELSE 'singleton' END AS bucket FROM c)",
    )
    + "SELECT bucket, count(b.bucket) AS n_labels FROM dims LEFT JOIN b USING (bucket) GROUP BY bucket",
)
def bucket_counts(spark, sf_dir):
    counts = cleaning.label_counts(t.receipts(spark, sf_dir), "cell_id")
    return cleaning.bucket_counts(spark, counts)


@query(
    "floor_partition",
    "SELECT CASE WHEN n >= 30 THEN 'above' ELSE 'below' END AS side, count(*) AS n_labels, sum(n)::BIGINT AS n_rows FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) GROUP BY 1",
)
def floor_partition(spark, sf_dir):
    return cleaning.floor_partition(t.table(spark, sf_dir, "part"), "p_name", 30)


@query(
    "per_param_summary",
    t.with_views(t.SETTINGS_SQL)
    + " UNION ALL ".join(
        f"SELECT descriptor, '{p}' AS param, count(*) AS n, round(avg({p}), 6) + 0.0 AS mean, round(stddev_samp({p}), 6) AS sd, min({p}) AS min, max({p}) AS max FROM settings GROUP BY descriptor"
        for p in PARAM_NAMES
    ),
)
def per_param_summary(spark, sf_dir):
    got = cleaning.per_param_summary(t.settings(spark, sf_dir), "descriptor")
    return got.withColumn("mean", F.round("mean", 6) + 0.0).withColumn("sd", F.round("sd", 6))


@query(
    "duplicate_report",
    t.with_views(USABLE_SQL, f"g AS (SELECT count(*) AS c FROM usable GROUP BY {KEY_SQL})")
    + "SELECT count(*) FILTER (WHERE c > 1) AS n_groups, sum(c - 1)::BIGINT AS n_redundant, round(100.0 * sum(c - 1) / sum(c), 6) AS pct_redundant FROM g",
)
def duplicate_report(spark, sf_dir):
    got = cleaning.duplicate_report(usable_entries(spark, sf_dir), cleaning.settings_key("descriptor", "ip"))
    return got.withColumn("pct_redundant", F.round("pct_redundant", 6))


_META = ["genre", "instrument", "experience"]


@query(
    "metadata_profile",
    t.with_views(
        t.ENTRIES_SQL,
        "long AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce(nullif(trim({c}), ''), '<blank>') AS value FROM entries" for c in _META)
        + ")",
        "c AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY ALL)",
    )
    + """SELECT * FROM (SELECT column_name, value, n, count(*) OVER (PARTITION BY column_name) AS n_distinct,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 8""",
)
def metadata_profile(spark, sf_dir):
    return cleaning.metadata_profile(t.entries(spark, sf_dir), _META)


_MANY = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]


@query(
    "top_values",
    "WITH c AS (SELECT column_name, value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce(nullif(trim(CAST({c} AS VARCHAR)), ''), '<blank>') AS value FROM lineitem" for c in _MANY)
    + """) GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 8""",
)
def top_values(spark, sf_dir):
    """Columns of few, many and nearly as many values as rows."""
    return cleaning.top_values(t.table(spark, sf_dir, "lineitem"), _MANY)


@query(
    "top_k",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 30",
)
def top_k(spark, sf_dir):
    counts = cleaning.label_counts(t.table(spark, sf_dir, "orders"), "o_custkey")
    return cleaning.top_k(counts, "n", "o_custkey", 30)


# --- gains --------------------------------------------------------------------------------------

_TRAIN = "orderkey % 4 <> 0"
_CONSENSUS_SQL = f"cons AS (SELECT descriptor, {', '.join(f'avg({g}) AS c_{g}' for g in GAINS)} FROM settings WHERE {_TRAIN} GROUP BY descriptor)"


@query(
    "consensus_gains",
    t.with_views(t.SETTINGS_SQL, _CONSENSUS_SQL) + f"SELECT descriptor, {', '.join(f'round(c_{g}, 6) + 0.0 AS {g}' for g in GAINS)} FROM cons",
)
def consensus_gains(spark, sf_dir):
    got = dispersion.consensus_gains(t.settings(spark, sf_dir).filter(_TRAIN), "descriptor")
    return got.select("descriptor", *[(F.round(g, 6) + 0.0).alias(g) for g in GAINS])


_N_BANDS = " + ".join(f"CASE WHEN abs(c_{g}) >= 0.5 THEN 1 ELSE 0 END" for g in GAINS)
_N_SAME = " + ".join(f"CASE WHEN abs(c_{g}) >= 0.5 AND ({g} > 0) = (c_{g} > 0) THEN 1 ELSE 0 END" for g in GAINS)
_ERR = " + ".join(f"CASE WHEN abs(c_{g}) >= 0.5 THEN abs({g} - c_{g}) ELSE 0 END" for g in GAINS)


@query(
    "sign_and_magnitude_error",
    t.with_views(t.SETTINGS_SQL, _CONSENSUS_SQL)
    + f"SELECT id, round(({_N_SAME}) / nullif(({_N_BANDS}) + 0E0, 0), 6) AS sign_agree_frac, round(({_ERR}) / nullif(({_N_BANDS}) + 0E0, 0), 6) AS mag_err FROM settings LEFT JOIN cons USING (descriptor) WHERE NOT ({_TRAIN})",
)
def sign_and_magnitude_error(spark, sf_dir):
    rows = t.settings(spark, sf_dir)
    cons = dispersion.consensus_gains(rows.filter(_TRAIN), "descriptor")
    got = dispersion.sign_and_magnitude_error(rows.filter(f"NOT ({_TRAIN})"), cons, "descriptor", ["id"])
    return got.select("id", F.round("sign_agree_frac", 6).alias("sign_agree_frac"), F.round("mag_err", 6).alias("mag_err"))


@query(
    "band_anatomy",
    t.with_views(t.SETTINGS_SQL, _CONSENSUS_SQL)
    + " UNION ALL ".join(
        f"""SELECT source, '{g}' AS band, count(*) AS n, round(avg(abs({g} - c_{g})), 6) AS mean_abs_err, round(100 * avg(CASE WHEN ({g} > 0) = (c_{g} > 0) THEN 1E0 ELSE 0 END), 6) AS sign_agree_pct
FROM settings JOIN cons USING (descriptor) WHERE NOT ({_TRAIN}) AND abs(c_{g}) >= 0.5 GROUP BY source"""
        for g in GAINS
    ),
)
def band_anatomy(spark, sf_dir):
    rows = t.settings(spark, sf_dir)
    cons = dispersion.consensus_gains(rows.filter(_TRAIN), "descriptor")
    got = dispersion.band_anatomy(rows.filter(f"NOT ({_TRAIN})"), cons, "descriptor", ["source"])
    return got.withColumn("mean_abs_err", F.round("mean_abs_err", 6)).withColumn("sign_agree_pct", F.round("sign_agree_pct", 6))


# --- the call log ---------------------------------------------------------------------------------

FIRST_OK_SQL = (
    ANSWERS_SQL
    + ",\nfirst_ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY seq) AS rn FROM checked WHERE status = 'ok' AND reason IS NULL) WHERE rn = 1)"
)


@query(
    "compile_first_ok",
    t.with_views(FIRST_OK_SQL) + f"SELECT cell_id, seq, model, {', '.join(PARAM_NAMES)} FROM first_ok",
)
def compile_first_ok(spark, sf_dir):
    return answers.compile_first_ok(t.receipts(spark, sf_dir), "cell_id", "seq", "response_content", ["seq", "model"])


@query(
    "attempt_summary",
    t.with_views(
        t.RECEIPTS_SQL,
        "c AS (SELECT model, cell_id, count(*) AS tries, bool_or(status = 'ok') AS ok FROM receipts GROUP BY ALL)",
    )
    + "SELECT model, count(*) AS n_cells, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok AND tries >= 3) AS n_failed FROM c GROUP BY model",
)
def attempt_summary(spark, sf_dir):
    return answers.attempt_summary(t.receipts(spark, sf_dir), "cell_id", "model")


def usage_columns():
    """Token counts of the log: null usage for one event in eleven."""
    k = F.get_json_object("props", "$.k").cast("long")
    some = F.col("seq") % 11 != 0
    return F.when(some, k * 10), F.when(some, k + 5)


COST_SQL = f"""{t.RECEIPTS_SQL},
{t.PRICES_SQL},
usage AS (SELECT model, ts, CASE WHEN seq % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 END AS ti, CASE WHEN seq % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) + 5 END AS tk FROM receipts),
per_model AS (SELECT model, count(*) AS calls, sum(coalesce(ti, 0))::BIGINT AS tokens_in, sum(coalesce(tk, 0))::BIGINT AS tokens_out FROM usage GROUP BY model),
priced AS (SELECT p.*, tokens_in / 1e6 * coalesce(price_in, 0) + tokens_out / 1e6 * coalesce(price_out, 0) AS cost FROM per_model p LEFT JOIN prices USING (model))"""


@query(
    "cost_rollup",
    t.with_views(COST_SQL)
    + "SELECT model, sum(calls)::BIGINT AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost FROM priced GROUP BY ROLLUP (model)",
)
def cost_rollup(spark, sf_dir):
    tokens_in, tokens_out = usage_columns()
    got = answers.cost_rollup(t.receipts(spark, sf_dir), t.prices(spark), "model", tokens_in, tokens_out)
    return got.withColumn("cost", F.round("cost", 6))


# --- arms -------------------------------------------------------------------------------------------


@query(
    "arm_summary",
    t.with_views(
        t.SCORED_SQL,
        "r AS (SELECT arm, metric, row_number() OVER (PARTITION BY arm ORDER BY metric) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM scored)",
    )
    + "SELECT arm, max(n) AS n, round(median(metric), 6) AS median, max(metric) FILTER (WHERE i = n // 4) AS q1, max(metric) FILTER (WHERE i = 3 * n // 4) AS q3 FROM r GROUP BY arm",
)
def arm_summary(spark, sf_dir):
    got = selection.arm_summary(t.scored(spark, sf_dir), ["arm"], "metric")
    return got.withColumn("median", F.round("median", 6))


TAIL_SQL = f"""{t.SCORED_SQL},
tails AS (SELECT arm, descriptor, median(metric) AS v, count(*) AS n FROM scored WHERE arm IN ('A', 'FLAT') OR (sample_idx = 0 AND prompt = 'p1') GROUP BY arm, descriptor)"""
_BASELINES, _MINIMAL = ["A", "FLAT"], ["p1"]


def tail_values(spark, sf_dir):
    return selection.tail_value_per_label(t.scored(spark, sf_dir), "arm", "descriptor", "metric", _BASELINES, _MINIMAL)


@query("tail_value_per_label", t.with_views(TAIL_SQL) + "SELECT arm, descriptor, n, round(v, 6) AS tail_value FROM tails")
def tail_value_per_label(spark, sf_dir):
    return tail_values(spark, sf_dir).withColumn("tail_value", F.round("tail_value", 6))


_WIN_ARMS = ["FLAT", "A", "B", "C", "C_AGG"]


def _win_cell(a: str, b: str) -> str:
    if a == b:
        return f"CAST(NULL AS DOUBLE) AS vs_{b}"
    return f"round(100 * avg(CASE WHEN {a}_v < {b}_v THEN 1E0 ELSE 0 END), 6) AS vs_{b}"


@query(
    "win_matrix",
    t.with_views(
        TAIL_SQL,
        "wide AS (SELECT descriptor, "
        + ", ".join(f"max(v) FILTER (WHERE arm = '{a}') AS {a}_v" for a in _WIN_ARMS)
        + " FROM tails GROUP BY descriptor HAVING "
        + " AND ".join(f"max(v) FILTER (WHERE arm = '{a}') IS NOT NULL" for a in _WIN_ARMS)
        + ")",
    )
    + " UNION ALL ".join(
        f"SELECT '{a}' AS arm, count(*) AS n_keys, {', '.join(_win_cell(a, b) for b in _WIN_ARMS)} FROM wide" for a in _WIN_ARMS
    ),
)
def win_matrix(spark, sf_dir):
    got = selection.win_matrix(tail_values(spark, sf_dir), "arm", "descriptor", "tail_value", _WIN_ARMS)
    return got.select("arm", "n_keys", *[F.round(f"vs_{a}", 6).alias(f"vs_{a}") for a in _WIN_ARMS])


@query(
    "seed_spread",
    t.with_views(t.SCORED_SQL)
    + "SELECT descriptor, round(avg(m), 6) AS mean_prediction, round(avg(s), 6) AS seed_spread FROM (SELECT descriptor, arm, avg(metric) AS m, stddev_pop(metric) AS s FROM scored GROUP BY ALL) GROUP BY descriptor",
)
def seed_spread(spark, sf_dir):
    """Samples play the seeds, arms the targets."""
    got = structure.seed_spread(t.scored(spark, sf_dir), ["descriptor"], "sample_idx", "arm", "metric")
    return got.select("descriptor", F.round("mean_prediction", 6).alias("mean_prediction"), F.round("seed_spread", 6).alias("seed_spread"))


# --- set operations and order ------------------------------------------------------------------------


@query(
    "union_units",
    """SELECT 'A' AS arm, 'n/a' AS model, CAST(o_orderkey AS STRING) AS descriptor, CAST(0 AS INTEGER) AS sample_idx, o_totalprice AS metric FROM orders
UNION ALL SELECT 'B', concat('model-', CAST(user_id % 6 AS STRING)), CAST(event_id AS STRING), CAST(event_id % 5 AS INTEGER), value FROM events""",
)
def union_units(spark, sf_dir):
    a = t.table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS descriptor", "o_totalprice AS metric")
    b = t.table(spark, sf_dir, "events").selectExpr(
        "concat('model-', CAST(user_id % 6 AS STRING)) AS model",
        "CAST(event_id AS STRING) AS descriptor",
        "CAST(event_id % 5 AS INT) AS sample_idx",
        "value AS metric",
    )
    absent = b.limit(0)
    return selection.union_units(
        {"A": a, "B": b, "C": absent}, ["model", "descriptor", "sample_idx", "metric"], {"model": "n/a", "sample_idx": 0}
    )


@query(
    "total_sort",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
)
def total_sort(spark, sf_dir):
    """A numbered total order: slices by value, sorted on their own."""
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    falling = -value_slice(F.col("o_totalprice"))
    got = ordered_row_number(orders, [], falling, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place")
    return got.select("o_orderkey", "place")


@query("intersect_keys", "SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem")
def intersect_keys(spark, sf_dir):
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return parts.intersect(t.table(spark, sf_dir, "lineitem").select("l_partkey"))


@query("except_keys", "SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events")
def except_keys(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return orders.subtract(t.table(spark, sf_dir, "events").select("user_id"))


@query("union_distinct_labels", "SELECT lang AS label FROM documents UNION SELECT role FROM conversations UNION SELECT p_name FROM part")
def union_distinct_labels(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").selectExpr("lang AS label")
    roles = t.table(spark, sf_dir, "conversations").selectExpr("role AS label")
    return docs.union(roles).union(t.table(spark, sf_dir, "part").selectExpr("p_name AS label")).distinct()
