"""Readers, fingerprints and sinks on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions.params import PARAM_NAMES
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query
from cloudgauge.session import scratch_path
from cloudgauge.sources import files, locks

_FIELDS = (
    ["CAST(entry_id AS STRING)", "descriptor", "ip", "'u'", "'u'"]
    + PARAM_NAMES
    + ["genre", "instrument", "'loc'", "experience", "'30'", "'xx'", "'end'"]
)


@query(
    "scan_positional_csv",
    t.with_views(t.ENTRIES_SQL)
    + """SELECT CAST(entry_id AS STRING) AS entry_id,
  CASE WHEN entry_id % 89 > 1 THEN descriptor END AS descriptor,
  CASE WHEN entry_id % 89 > 1 THEN band3_q END AS band3_q,
  CASE WHEN entry_id % 89 > 1 THEN experience END AS experience,
  entry_id % 89 <= 1 AS bad_width
FROM entries""",
)
def scan_positional_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are two fields short, one field long, or followed by a blank line."""
    path = scratch_path(spark, "entries-csv")
    full = f"concat_ws(',', {', '.join(_FIELDS)})"
    short = f"concat_ws(',', {', '.join(_FIELDS[:-2])})"
    line = (
        f"CASE WHEN entry_id % 89 = 0 THEN {short} WHEN entry_id % 89 = 1 THEN concat({full}, ',extra') "
        f"WHEN entry_id % 89 = 2 THEN concat({full}, '\\n') ELSE {full} END AS line"
    )
    t.entries(spark, sf_dir).selectExpr(line).write.text(path)
    got = files.scan_positional_csv(spark, path)
    good = ~F.col("bad_width")
    return got.select(
        "entry_id",
        *[F.when(good, F.col(c)).alias(c) for c in ("descriptor", "band3_q", "experience")],
        "bad_width",
    )


@query(
    "scan_numbered_csv",
    t.with_views(
        t.ENTRIES_SQL,
        "numbered AS (SELECT *, row_number() OVER (ORDER BY entry_id) - 1 + coalesce(sum(CASE WHEN entry_id % 89 = 2 THEN 1 ELSE 0 END) OVER (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM entries)",
    )
    + """SELECT concat('safe-', CAST(CAST(i AS BIGINT) AS STRING)) AS id, CAST(entry_id AS STRING) AS entry_id,
  CASE WHEN entry_id % 89 > 1 THEN band3_q END AS band3_q,
  CASE WHEN entry_id % 89 = 3 THEN concat(instrument, ', ', chr(10), '"second" line') WHEN entry_id % 89 > 1 THEN instrument END AS instrument,
  entry_id % 89 <= 1 AS bad_width
FROM numbered""",
)
def scan_numbered_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `scan_positional_csv`, with row numbers; some rows have a field of two lines."""
    path = scratch_path(spark, "entries-csv")
    quoted = ["concat('\"', instrument, ', \\n\"\"second\"\" line\"')" if f == "instrument" else f for f in _FIELDS]
    line = (
        f"CASE WHEN entry_id % 89 = 0 THEN concat_ws(',', {', '.join(_FIELDS[:-2])}) WHEN entry_id % 89 = 1 THEN concat_ws(',', {', '.join(_FIELDS)}, 'extra') "
        f"WHEN entry_id % 89 = 2 THEN concat(concat_ws(',', {', '.join(_FIELDS)}), '\\n') "
        f"WHEN entry_id % 89 = 3 THEN concat_ws(',', {', '.join(quoted)}) ELSE concat_ws(',', {', '.join(_FIELDS)}) END AS line"
    )
    t.entries(spark, sf_dir).orderBy("entry_id").selectExpr(line).write.text(path)
    good = ~F.col("bad_width")
    return files.scan_numbered_csv(spark, path).select(
        "id", "entry_id", *[F.when(good, F.col(c)).alias(c) for c in ("band3_q", "instrument")], "bad_width"
    )


@query(
    "scan_feature_csv",
    """SELECT entry_id, role, vec_id AS kept_row FROM (
  SELECT concat('e', CAST(vec_id % 180 AS STRING)) AS entry_id,
    CASE WHEN vec_id % 2 = 0 THEN 'processed' ELSE 'unprocessed' END AS role, vec_id,
    row_number() OVER (PARTITION BY vec_id % 180, vec_id % 2 ORDER BY vec_id DESC) AS rn
  FROM embeddings WHERE vec_id % 50 <> 3) WHERE rn = 1""",
)
def scan_feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated (id, role) rows, of which the last counts, and rows that do not parse."""
    path = scratch_path(spark, "features-csv")
    role = F.when(F.col("vec_id") % 2 == 0, "processed").otherwise("unprocessed")
    nums = F.concat_ws(",", F.transform("vec", lambda x: x.cast("string")))
    first = F.when(F.col("vec_id") % 50 == 3, "n/a").otherwise(F.col("vec_id").cast("string"))
    t.curves(spark, sf_dir).orderBy("vec_id").select(
        F.concat_ws(",", F.concat(F.lit("e"), (F.col("vec_id") % 180).cast("string")), role, first, nums).alias("line")
    ).write.text(path)
    got = files.scan_feature_csv(spark, path, width=65)
    return got.select("entry_id", "role", F.get("vec", F.lit(0)).cast("long").alias("kept_row"))



@query(
    "scan_json_lines",
    t.with_views(t.RECEIPTS_SQL)
    + "SELECT seq, cell_id, model, status, md5(response_content) AS content_md5 FROM receipts",
)
def scan_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "receipts-json")
    log = t.receipts(spark, sf_dir)
    log.select("seq", "cell_id", "model", "status", "response_content").write.json(path)
    schema = log.select("seq", "cell_id", "model", "status", "response_content").schema
    got = files.scan_json_lines(spark, path, schema)
    nothing = files.scan_json_lines(spark, path + "-absent", schema, missing_ok=True)
    both = got.unionByName(nothing)
    return both.select("seq", "cell_id", "model", "status", F.md5("response_content").alias("content_md5"))


@query(
    "scan_mixed_rows",
    t.with_views(t.SCORED_SQL)
    + """SELECT 'energy' AS kind, arm, count(*) AS n, round(sum(metric), 6) AS total FROM scored WHERE seq % 10 = 0 GROUP BY arm
UNION ALL
SELECT 'metric', arm, count(*), round(sum(metric), 6) FROM scored WHERE seq % 10 <> 0 GROUP BY arm""",
)
def scan_mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metrics-json")
    rows = t.scored(spark, sf_dir).select(
        "arm",
        F.when(F.col("seq") % 10 != 0, F.col("metric")).alias("hrp"),
        F.when(F.col("seq") % 10 == 0, F.col("metric")).alias("energy_dist"),
        F.when(F.col("seq") % 10 == 0, "energy").alias("row_type"),
    )
    rows.write.json(path)
    metric, energy = files.scan_mixed_rows(spark, path, rows.schema)

    def totals(df: DataFrame, kind: str, value: str) -> DataFrame:
        return df.groupBy(F.lit(kind).alias("kind"), "arm").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")
        )

    return totals(energy, "energy", "energy_dist").unionByName(totals(metric, "metric", "hrp"))


@query(
    "scan_tolerant_log",
    t.with_views(t.RECEIPTS_SQL)
    + """SELECT model, count(*) FILTER (WHERE seq % 31 <> 0) AS n_rows, 0 AS n_corrupt FROM receipts GROUP BY model
UNION ALL SELECT NULL, 0, count(*) FILTER (WHERE seq % 31 = 0) FROM receipts""",
)
def scan_tolerant_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log-text")
    log = t.receipts(spark, sf_dir).select("seq", "cell_id", "model", "status", "response_content")
    text = F.to_json(F.struct(*log.columns))
    cut = F.when(F.col("seq") % 31 == 0, F.expr("substring(line, 1, 25)")).otherwise(F.col("line"))
    log.select("seq", text.alias("line")).select(cut.alias("value")).write.text(path)
    good, bad = files.scan_tolerant_log(spark, path, log.schema)
    per_model = good.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_corrupt", F.lit(0).cast("long"))
    corrupt = bad.agg(F.count(F.lit(1)).alias("n_corrupt")).select(
        F.lit(None).cast("string").alias("model"), F.lit(0).cast("long").alias("n_rows"), "n_corrupt"
    )
    return per_model.unionByName(corrupt)


# every column of orders, as text that both engines write the same way; in order of name
_LOCKED = {
    "o_custkey": "o_custkey",
    "o_orderdate": "CAST(o_orderdate AS DATE)",
    "o_orderkey": "o_orderkey",
    "o_orderpriority": "o_orderpriority",
    "o_orderstatus": "o_orderstatus",
    "o_totalcents": "CAST(round(o_totalprice * 100) AS BIGINT)",
}
_DIGEST = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS STRING), '\\N')" for c in _LOCKED.values()) + "))"
_FINGERPRINT = f"""count(*) AS n_rows,
  CAST(sum(CAST(('0x' || substr({_DIGEST}, 1, 8)) AS BIGINT)) AS STRING) AS digest_a,
  CAST(sum(CAST(('0x' || substr({_DIGEST}, 9, 8)) AS BIGINT)) AS STRING) AS digest_b"""


def _locked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _LOCKED.items()])


@query(
    "verify_fingerprint",
    f"""WITH here AS (SELECT {_FINGERPRINT} FROM orders)
SELECT name, verdict, n_rows, digest_a, digest_b FROM here, (VALUES ('orders', 'ok'), ('orders-changed', 'mismatch'), ('orders-gone', 'missing')) v(name, verdict)""",
)
def verify_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of three copies of orders: one is only in another order, one has a
    single order's price off by a cent, one is not there."""
    orders = _locked_orders(spark, sf_dir)
    cols = list(_LOCKED)
    first = orders.agg(F.min("o_orderkey").alias("first"))
    off = F.when(F.col("o_orderkey") == F.col("first"), 1).otherwise(0)
    changed = orders.join(F.broadcast(first)).withColumn("o_totalcents", F.col("o_totalcents") + off)
    copies = {"orders": orders.repartition(5, "o_custkey"), "orders-changed": changed}
    actual = [locks.table_fingerprint(df, cols).select(F.lit(name).alias("name"), "*") for name, df in copies.items()]
    names = F.explode(F.array(*[F.lit(n) for n in (*copies, "orders-gone")])).alias("name")
    manifest = locks.table_fingerprint(orders, cols).select(names, "*")
    verdict = locks.verify_fingerprint(actual[0].unionByName(actual[1]), manifest, "name", "digest_a")
    return verdict.join(manifest, "name")


@query(
    "file_gate",
    """SELECT CASE batch % 3 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'missing' ELSE 'ok' END AS verdict, count(*) AS n_files
FROM (SELECT DISTINCT c_custkey // 300 AS batch FROM customer) GROUP BY ALL""",
)
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of files against a manifest: customers are written in files of 300 keys,
    then once more without every third file and with a blank more in every other third."""
    customers = t.table(spark, sf_dir, "customer")
    path = scratch_path(spark, "gated-files")
    lines = customers.select(
        F.expr("c_custkey div 300").alias("batch"), F.to_json(F.struct(*sorted(customers.columns))).alias("value")
    )
    blank = F.when(F.col("batch") % 3 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("value"))
    later = lines.filter(F.col("batch") % 3 != 1).withColumn("value", blank)
    for when, rows in (("then", lines), ("now", later)):
        # a batch is in one task, so it becomes one file in the folder of its number
        rows.repartition("batch").sortWithinPartitions("batch", "value").write.partitionBy("batch").text(f"{path}/{when}")
    then, now = (locks.file_fingerprints(spark, f"{path}/{when}/*/part-*", folders=True) for when in ("then", "now"))
    verdicts = locks.verify_fingerprint(now, then, "name", "sha256")
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_files"))


@query("sink_locked_table", f"SELECT 'orders-lock' AS name, {_FINGERPRINT} FROM orders")
def sink_locked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "locked")
    return locks.sink_locked_table(_locked_orders(spark, sf_dir), f"{path}/data", f"{path}/manifest", "orders-lock")


@query(
    "sink_append_log",
    t.with_views(t.RECEIPTS_SQL) + "SELECT status, count(*) AS n, max(seq) AS last_seq FROM receipts GROUP BY status",
)
def sink_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one log, one of them twice, and rows of an append that was
    given up before it counted."""
    path = scratch_path(spark, "append-log")
    log = t.receipts(spark, sf_dir).select("seq", "cell_id", "status")
    locks.sink_append_log(log.filter("status = 'ok'"), path, "ok")
    locks.sink_append_log(log.filter("status <> 'ok'"), path, "rest")
    locks.sink_append_log(log.filter("status = 'ok'"), path, "ok")
    log.write.json(f"{path}/data/attempt=given-up")
    back = locks.scan_append_log(spark, path, log.schema)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
