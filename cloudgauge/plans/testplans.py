"""Hypothesis tests, bootstrap and false-discovery control.

The SQL side gets its p-values by numerical integration of the density, the Spark side by
series and continued fractions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudgauge.operators import hypothesis, selection
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query

_SIMPSON = "CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def normal_p_sql(z: str) -> str:
    return f"(SELECT 2 * sum({_SIMPSON} * exp(-pow(abs({z}) + i * 0.0015E0, 2) / 2)) * 0.0005E0 / sqrt(2 * pi()) FROM range(8001) r(i))"


def chi2_p_sql(x: str, df: str) -> str:
    return (
        f"(SELECT sum({_SIMPSON} * pow(sqrt({x}) + i * 0.0015E0, {df} - 1) * exp(-pow(sqrt({x}) + i * 0.0015E0, 2) / 2)) * 0.0005E0"
        f" * 2 / (pow(2, {df} / 2E0) * gamma({df} / 2E0)) FROM range(8001) r(i))"
    )


def t_p_sql(tv: str, df: str) -> str:
    start = f"atan(abs({tv}) / sqrt({df}))"
    step = f"((pi() / 2 - {start}) / 8000)"
    return (
        f"(SELECT 2 * exp(lgamma(({df} + 1) / 2E0) - lgamma({df} / 2E0)) / sqrt(pi()) * {step} / 3 *"
        f" sum({_SIMPSON} * pow(abs(cos({start} + i * {step})), {df} - 1)) FROM range(8001) r(i))"
    )


def _p_cols(df):
    return df.withColumn("log10_p", F.round(F.log10("p_value"), 4)).withColumn("p_value", F.round("p_value", 6))


_P_OUT = "round(p, 6) AS p_value, round(log10(p), 4) AS log10_p"
_KEYS = ["model", "prompt", "descriptor", "sample_idx"]
PAIRED_SQL = f"""{t.SCORED_SQL},
xs AS (SELECT {', '.join(_KEYS)}, arg_max(metric, seq) AS x FROM scored WHERE arm = 'B' GROUP BY ALL),
ys AS (SELECT {', '.join(_KEYS)}, arg_max(metric, seq) AS y FROM scored WHERE arm = 'C' GROUP BY ALL),
paired AS (SELECT * FROM xs JOIN ys USING ({', '.join(_KEYS)}))"""


def paired(spark, sf_dir):
    df = t.scored(spark, sf_dir)
    return selection.join_paired_arms(df.filter("arm = 'B'"), df.filter("arm = 'C'"), _KEYS, "metric", "seq")


@query("join_paired_arms", t.with_views(PAIRED_SQL) + "SELECT * FROM paired")
def join_paired_arms(spark, sf_dir):
    return paired(spark, sf_dir)


WILCOXON_SQL = f"""{PAIRED_SQL},
ds AS (SELECT prompt, abs(x - y) AS a, x > y AS pos FROM paired WHERE x <> y),
rk AS (SELECT *, rank() OVER (PARTITION BY prompt ORDER BY a) + (count(*) OVER (PARTITION BY prompt, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY prompt, a) AS c FROM ds),
wsum AS (SELECT prompt, count(*) AS n, coalesce(sum(r) FILTER (WHERE pos), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE NOT pos), 0) AS w_minus, sum(c * c - 1) AS ties FROM rk GROUP BY prompt),
wz AS (SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0E0) * (2 * n + 1) / 24 - ties / 48E0) AS z FROM wsum),
wilcoxon AS (SELECT *, {normal_p_sql('z')} AS p FROM wz)"""


@query(
    "wilcoxon_paired",
    t.with_views(WILCOXON_SQL)
    + f"SELECT prompt, n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, CAST(least(w_plus, w_minus) AS DOUBLE) AS statistic, round(z, 6) AS z, {_P_OUT} FROM wilcoxon",
)
def wilcoxon_paired(spark, sf_dir):
    got = hypothesis.wilcoxon_paired(paired(spark, sf_dir), ["prompt"], "x", "y")
    return _p_cols(got).withColumn("z", F.round("z", 6))


MW_SQL = f"""{t.SCORED_SQL},
mr AS (SELECT model, arm, metric, rank() OVER w + (count(*) OVER (PARTITION BY model, metric) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, metric) AS c
  FROM scored WHERE arm IN ('B', 'C') WINDOW w AS (PARTITION BY model ORDER BY metric)),
ms AS (SELECT model, count(*) FILTER (WHERE arm = 'B') AS n1, count(*) FILTER (WHERE arm = 'C') AS n2, sum(r) FILTER (WHERE arm = 'B') AS r1, sum(c * c - 1) AS ties FROM mr GROUP BY model),
mu AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 + n2 AS n FROM ms),
mz AS (SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12E0 * ((n + 1) - ties / (n * (n - 1E0)))) AS z FROM mu),
mw AS (SELECT *, CASE WHEN z <= 0 THEN 1 ELSE {normal_p_sql('z')} END AS p FROM mz)"""


@query(
    "mann_whitney",
    t.with_views(MW_SQL)
    + f"SELECT model, n1, n2, CAST(u1 AS DOUBLE) AS u1, round(z, 6) AS z, {_P_OUT}, round(2 * u1 / (n1 * n2) - 1, 6) AS cliffs_delta FROM mw",
)
def mann_whitney(spark, sf_dir):
    both = t.scored(spark, sf_dir).filter("arm IN ('B', 'C')")
    got = hypothesis.mann_whitney(both, ["model"], F.col("arm") == "B", "metric")
    return _p_cols(got).withColumn("z", F.round("z", 6)).withColumn("cliffs_delta", F.round("cliffs_delta", 6))


@query(
    "cliffs_delta",
    t.with_views(t.SCORED_SQL)
    + """SELECT a.prompt, (SELECT count(*) FROM scored WHERE arm = 'C' AND prompt = a.prompt) AS n1, (SELECT count(*) FROM scored WHERE arm = 'B' AND prompt = a.prompt) AS n2,
  round(avg(CASE WHEN a.metric > b.metric THEN 1 WHEN a.metric < b.metric THEN -1 ELSE 0 END), 6) AS delta
FROM scored a JOIN scored b ON a.prompt = b.prompt AND a.arm = 'C' AND b.arm = 'B' GROUP BY a.prompt""",
)
def cliffs_delta(spark, sf_dir):
    both = t.scored(spark, sf_dir).filter("arm IN ('B', 'C')")
    got = hypothesis.cliffs_delta(both, ["prompt"], F.col("arm") == "C", "metric")
    return got.withColumn("delta", F.round("delta", 6))


KW_SQL = f"""{t.SCORED_SQL},
kr AS (SELECT arm, model, metric, rank() OVER (PARTITION BY arm ORDER BY metric) + (count(*) OVER (PARTITION BY arm, metric) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY arm, metric) AS c FROM scored),
kg AS (SELECT arm, model, count(*) AS n, sum(r) AS r FROM kr GROUP BY arm, model),
kt AS (SELECT arm, sum(c * c - 1) AS ties FROM kr GROUP BY arm),
kh AS (SELECT arm, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(CAST(r AS DOUBLE) * r / n) AS s FROM kg GROUP BY arm),
kz AS (SELECT arm, k, n, (12 / (n * (n + 1E0)) * s - 3 * (n + 1)) / (1 - ties / (n * (n * n - 1E0))) AS h FROM kh JOIN kt USING (arm)),
kw AS (SELECT *, {chi2_p_sql('h', '(k - 1)')} AS p FROM kz)"""


@query("kruskal_wallis", t.with_views(KW_SQL) + f"SELECT arm, k, n, round(h, 6) AS h, {_P_OUT} FROM kw")
def kruskal_wallis(spark, sf_dir):
    got = hypothesis.kruskal_wallis(t.scored(spark, sf_dir), ["arm"], "model", "metric")
    return _p_cols(got).withColumn("h", F.round("h", 6))


SPEARMAN_SQL = f"""sr AS (SELECT o_orderpriority AS grp,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2E0 AS rx,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2E0 AS ry FROM orders),
ss AS (SELECT grp, count(*) AS n, corr(rx, ry) AS rho FROM sr GROUP BY grp HAVING count(*) >= 20),
st AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM ss),
spearman AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM st)"""


@query("spearman", t.with_views(SPEARMAN_SQL) + f"SELECT grp, n, round(rho, 6) AS rho, round(t, 6) AS t, {_P_OUT} FROM spearman")
def spearman(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("grp"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")
    )
    got = hypothesis.spearman(orders, ["grp"], "o_totalprice", "o_custkey")
    return _p_cols(got).withColumn("rho", F.round("rho", 6)).withColumn("t", F.round("t", 6))


GOF_SQL = f"""shares AS (SELECT o_orderpriority, count(*) / (SELECT count(*) + 0E0 FROM orders) AS share FROM orders GROUP BY o_orderpriority),
obs AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL),
cells AS (SELECT s.o_orderstatus, h.o_orderpriority, share, coalesce(c, 0) AS c FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN shares h LEFT JOIN obs o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = h.o_orderpriority),
exps AS (SELECT *, share * sum(c) OVER (PARTITION BY o_orderstatus) AS e FROM cells),
chi AS (SELECT o_orderstatus, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, min(e) AS min_expected, sum((c - e) * (c - e) / e) AS chi2 FROM exps GROUP BY o_orderstatus),
gof AS (SELECT *, {chi2_p_sql('chi2', '(k - 1)')} AS p FROM chi)"""


def gof(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("observed"))
    total = orders.agg(F.count(F.lit(1)).alias("__n"))
    priorities = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(total))
    shares = priorities.select("o_orderpriority", (F.col("c") / F.col("__n")).alias("share"))
    return hypothesis.chi_square_counts(counts, shares, ["o_orderstatus"], "o_orderpriority", "observed", "share")


@query(
    "chi_square_gof",
    t.with_views(GOF_SQL)
    + f"SELECT o_orderstatus, n, k, round(min_expected, 6) AS min_expected, round(chi2, 6) AS chi2, {_P_OUT} FROM gof",
)
def chi_square_gof(spark, sf_dir):
    got = gof(spark, sf_dir)
    return _p_cols(got).withColumn("min_expected", F.round("min_expected", 6)).withColumn("chi2", F.round("chi2", 6))


def chi2_p_log_sql(x: str, df: str, terms: int) -> str:
    """Upper tail by the lower series, every term from its logarithm."""
    return (
        f"(SELECT 1 - sum(exp(({df} / 2E0 + r.i) * ln({x} / 2E0) - {x} / 2E0 - lgamma({df} / 2E0 + r.i + 1))) FROM range({terms}) r(i))"
    )


@query(
    "chi_square_gof_many",
    f"""WITH lines AS (SELECT l_returnflag, l_partkey * 2 + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END AS cell FROM lineitem),
shares AS (SELECT cell, count(*) / (SELECT count(*) + 0E0 FROM lines) AS share FROM lines GROUP BY cell),
obs AS (SELECT l_returnflag, cell, count(*) AS c FROM lines GROUP BY ALL),
cells AS (SELECT s.l_returnflag, h.cell, share, coalesce(c, 0) AS c FROM (SELECT DISTINCT l_returnflag FROM lines) s CROSS JOIN shares h LEFT JOIN obs o ON o.l_returnflag = s.l_returnflag AND o.cell = h.cell),
exps AS (SELECT *, share * sum(c) OVER (PARTITION BY l_returnflag) AS e FROM cells),
chi AS (SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, sum((c - e) * (c - e) / e) AS chi2 FROM exps GROUP BY l_returnflag)
SELECT l_returnflag, n, k, round(chi2, 6) AS chi2, round({chi2_p_log_sql('chi2', '(k - 1)', 6000)}, 6) AS p_value FROM chi""",
)
def chi_square_gof_many(spark, sf_dir):
    """Thousands of categories: parts, each split by early and late line numbers."""
    lines = t.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.expr("l_partkey * 2 + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END").alias("cell")
    )
    counts = lines.groupBy("l_returnflag", "cell").agg(F.count(F.lit(1)).alias("observed"))
    total = lines.agg(F.count(F.lit(1)).alias("all"))
    per_cell = counts.groupBy("cell").agg(F.sum("observed").alias("c")).join(F.broadcast(total))
    shares = per_cell.select("cell", (F.col("c") / F.col("all")).alias("share"))
    got = hypothesis.chi_square_counts(counts, shares, ["l_returnflag"], "cell", "observed", "share", min_expected=0.0)
    return _p_cols(got).select("l_returnflag", "n", "k", F.round("chi2", 6).alias("chi2"), "p_value")


_B = 10_000


@query(
    "bootstrap_ci_median",
    f"""WITH vals AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL),
placed AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM vals),
sizes AS (SELECT DISTINCT event_type, n, (n + 1) // 2 AS k FROM placed WHERE n >= 3),
terms AS (SELECT event_type, n, k, j, x, lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(j / (n + 0E0)) + CASE WHEN x = n THEN 0 ELSE (n - x) * ln(1 - j / (n + 0E0)) END AS l
  FROM sizes, LATERAL (SELECT unnest(range(1, n)) AS j), LATERAL (SELECT unnest(range(k, n + 1)) AS x)),
tails AS (SELECT event_type, j, sum(exp(l)) AS tail FROM terms GROUP BY event_type, j UNION ALL SELECT event_type, n, 1E0 FROM sizes),
steps AS (SELECT event_type, j, tail, coalesce(lag(tail) OVER (PARTITION BY event_type ORDER BY j), 0E0) AS below FROM tails),
draws AS (SELECT event_type, n, k, b, (CAST('0x' || substr(md5('42:' || event_type || ':' || CAST(b AS STRING)), 1, 8) AS BIGINT) + 0.5E0) / 4294967296E0 AS u,
  (CAST('0x' || substr(md5('42:' || event_type || ':' || CAST(b AS STRING)), 9, 8) AS BIGINT) + 0.5E0) / 4294967296E0 AS w FROM sizes, range({_B}) r(b)),
firsts AS (SELECT d.*, j, tail - below AS mass FROM draws d JOIN steps s ON s.event_type = d.event_type AND s.below < u AND u <= s.tail),
seconds AS (SELECT *, CASE WHEN n % 2 = 1 OR k = n THEN j ELSE
  least(n, greatest(j, CAST(ceil(n * (1 - exp((ln(w) + ln(mass) - (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(j / (n + 0E0)) + ln(1 - pow((j - 1) / (j + 0E0), k)))) / (n - k)))) AS BIGINT))) END AS j2 FROM firsts),
meds AS (SELECT s.event_type, b, (p.v + q.v) / 2 AS m FROM seconds s JOIN placed p ON p.event_type = s.event_type AND p.i = s.j JOIN placed q ON q.event_type = s.event_type AND q.i = s.j2),
sorted AS (SELECT event_type, m, row_number() OVER (PARTITION BY event_type ORDER BY m) - 1 AS i FROM meds)
SELECT s.event_type, (SELECT count(*) FROM vals WHERE event_type = s.event_type) AS n, (SELECT round(median(v), 6) FROM vals WHERE event_type = s.event_type) AS median,
  round(max(m) FILTER (WHERE i = {int(0.025 * _B)}), 6) AS ci_low, round(max(m) FILTER (WHERE i = {int(0.975 * _B)}), 6) AS ci_high FROM sorted s GROUP BY s.event_type""",
)
def bootstrap_ci_median(spark, sf_dir):
    means = t.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    got = hypothesis.bootstrap_ci_median(means, ["event_type"], "v", b=_B)
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "ci_low", "ci_high")])


@query("bootstrap_ci_median_large")
def bootstrap_ci_median_large(spark, sf_dir):
    """Every event value: groups of thousands; held against plain resampling in the tests."""
    events = t.table(spark, sf_dir, "events").select("event_type", "value")
    return hypothesis.bootstrap_ci_median(events, ["event_type"], "value", b=_B)


@query(
    "bh_fdr",
    """WITH p AS (SELECT event_id, ((event_id * 7919) % 10007 + 1) / 10008E0 * ((event_id * 31) % 17 + 1) / 17E0 AS p_value FROM events),
r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, event_id) AS raw, row_number() OVER (ORDER BY p_value, event_id) AS rk FROM p),
q AS (SELECT *, least(1, min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM r)
SELECT event_id, round(p_value, 9) AS p_value, round(q_value, 9) AS q_value, q_value <= 0.05 AS survives FROM q""",
)
def bh_fdr(spark, sf_dir):
    p = F.expr("((event_id * 7919) % 10007 + 1) / 10008E0 * ((event_id * 31) % 17 + 1) / 17E0").alias("p_value")
    tests = t.table(spark, sf_dir, "events").select("event_id", p)
    got = hypothesis.bh_fdr(tests)
    return got.select("event_id", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"), "survives")


@query(
    "bh_fdr_small",
    """WITH p AS (SELECT event_id, (1 + event_id % 7 / 8E0) / 2E0 * pow(2E0, -(event_id * 31 % 997)) AS p_value FROM events),
r AS (SELECT *, p_value * count(*) OVER () / count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw, row_number() OVER (ORDER BY p_value, event_id) AS rk FROM p),
q AS (SELECT *, least(1, min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM r)
SELECT event_id, round(-log10(p_value), 6) AS minus_log_p, round(-log10(q_value), 6) AS minus_log_q, q_value <= 0.05 AS survives FROM q""",
)
def bh_fdr_small(spark, sf_dir):
    """P-values from 1 down to 1e-300: a thousand octaves of slices, all in one family."""
    p = F.expr("(1 + event_id % 7 / 8.0D) / 2.0D * pow(2.0D, -(event_id * 31 % 997))").alias("p_value")
    got = hypothesis.bh_fdr(t.table(spark, sf_dir, "events").select("event_id", p))
    return got.select(
        "event_id", F.round(-F.log10("p_value"), 6).alias("minus_log_p"), F.round(-F.log10("q_value"), 6).alias("minus_log_q"), "survives"
    )


@query(
    "consolidate_tests",
    t.with_views(
        WILCOXON_SQL,
        GOF_SQL,
        KW_SQL.replace(t.SCORED_SQL + ",\n", ""),
        """alltests AS (SELECT 'paired' AS source, concat('B vs C ', prompt) AS test, 'cell' AS unit, p FROM wilcoxon
UNION ALL SELECT 'gof', concat('priority ', o_orderstatus), 'order', p FROM gof
UNION ALL SELECT 'family', concat('models ', arm), 'unit', p FROM kw)""",
        "ranked AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM alltests)",
        "qs AS (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked)",
    )
    + "SELECT source, test, unit, round(p, 6) AS p_value, round(q, 6) AS q_value, q <= 0.05 AS survives FROM qs",
)
def consolidate_tests(spark, sf_dir):
    wil = hypothesis.wilcoxon_paired(paired(spark, sf_dir), ["prompt"], "x", "y")
    kw = hypothesis.kruskal_wallis(t.scored(spark, sf_dir), ["arm"], "model", "metric")
    parts = {
        "paired": wil.select(F.concat(F.lit("B vs C "), "prompt").alias("test"), F.lit("cell").alias("unit"), "p_value"),
        "gof": gof(spark, sf_dir).select(
            F.concat(F.lit("priority "), "o_orderstatus").alias("test"), F.lit("order").alias("unit"), "p_value"
        ),
        "family": kw.select(F.concat(F.lit("models "), "arm").alias("test"), F.lit("unit").alias("unit"), "p_value"),
    }
    got = hypothesis.consolidate_tests(parts)
    return got.withColumn("p_value", F.round("p_value", 6)).withColumn("q_value", F.round("q_value", 6))
