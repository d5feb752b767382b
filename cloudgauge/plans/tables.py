"""Study-shaped views of the standard tables.

The column formulas are text that both engines read the same way, so a view means the
same on both sides; what is done with it is written separately for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions.params import PARAM_NAMES
from cloudgauge.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows cost much work each; see `spread`."""
    return spread(table(spark, sf_dir, name), key)


def _select(cols: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} AS {n}" for n, e in cols.items())


# --- settings: one 13-value block per line item, labelled by part name ------------------

_SETTINGS = {
    "id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))",
    "orderkey": "l_orderkey",
    "source": "l_returnflag",
    "descriptor": "p_name",
    "low_shelf_gain": "(l_quantity - 25E0) / 2E0",
    "low_shelf_freq": "40E0 + l_partkey % 360",
    "band1_gain": "((l_quantity * 7E0) % 49 - 24E0) / 2E0",
    "band1_freq": "150E0 + l_orderkey % 500",
    "band1_q": "0.5E0 + 10E0 * l_discount",
    "band2_gain": "((l_quantity * 11E0 + l_linenumber) % 47 - 23E0) / 2E0",
    "band2_freq": "700E0 + (l_partkey * 3) % 1300",
    "band2_q": "0.7E0 + 10E0 * l_tax",
    "band3_gain": "((l_partkey * 13 + l_linenumber) % 45 - 22E0) / 2E0",
    "band3_freq": "2500E0 + l_orderkey % 3000",
    "band3_q": "0.5E0 + l_linenumber / 4E0",
    "high_shelf_gain": "((l_suppkey * 17 + l_linenumber * 3) % 49 - 24E0) / 2E0",
    "high_shelf_freq": "8000E0 + (l_suppkey * 7) % 6000",
}
SETTINGS_SQL = f"settings AS (SELECT\n  {_select(_SETTINGS)}\nFROM lineitem JOIN part ON l_partkey = p_partkey)"


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the join's own shuffle spreads the rows; hashed, they need not be sorted for it
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("shuffle_hash")
    joined = table(spark, sf_dir, "lineitem").join(parts, F.expr("l_partkey = p_partkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in _SETTINGS.items()])


# --- curves: embeddings as labelled vectors -----------------------------------------------

CURVES_SQL = """curves AS (SELECT vec_id, CAST(label AS STRING) AS label,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec")
    )


# Human cloud and answers of three arms: an answer is a held-out vector.
_UNIT = {
    "arm": "CASE vec_id % 7 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE 'D' END",
    "model": "concat('m', CAST(vec_id % 3 AS STRING))",
    "prompt": "CASE WHEN vec_id % 5 = 0 THEN 'p2' ELSE 'p1' END",
    "label": "label",
    "vec_id": "vec_id",
    "vec": "vec",
}
GOLD_WHERE = "vec_id % 7 > 2"
UNITS_SQL = (
    f"{CURVES_SQL},\ngold AS (SELECT vec_id, label, vec FROM curves WHERE {GOLD_WHERE}),\n"
    f"units AS (SELECT {_select(_UNIT)} FROM curves WHERE NOT ({GOLD_WHERE}))"
)


def gold_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(spark, sf_dir).filter(GOLD_WHERE)


def answer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(spark, sf_dir).filter(f"NOT ({GOLD_WHERE})").selectExpr(*[f"{e} AS {n}" for n, e in _UNIT.items()])


# --- entries: raw text rows with deliberate faults ------------------------------------------

_ENTRIES = {
    "entry_id": "o_orderkey",
    "descriptor": "CASE WHEN o_orderkey % 97 = 0 THEN '   ' WHEN o_orderkey % 41 = 0 THEN ' TEST ' "
    "ELSE concat('  ', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN '  X ' ELSE ' x' END) END",
    "ip": "concat(' 10.0.', CAST(o_custkey % 20 AS STRING), ' ')",
    "bad_width": "o_orderkey % 89 = 0",
    **{
        p: (
            f"CASE WHEN o_orderkey % {83 + 2 * i} = 1 THEN 'abc' WHEN o_orderkey % {101 + i} = 2 THEN '"
            + ("99.5" if p.endswith("_gain") else "-3" if p.endswith("_freq") else "nan")
            + f"' ELSE CAST((o_custkey % {7 + i}) + 1 AS STRING) END"
        )
        for i, p in enumerate(PARAM_NAMES)
    },
    "genre": "o_orderpriority",
    "instrument": "CASE o_custkey % 5 WHEN 0 THEN 'Electric Guitar' WHEN 1 THEN 'jazz4' WHEN 2 THEN 'metal12' WHEN 3 THEN '' ELSE 'Drums' END",
    "experience": "CASE o_custkey % 6 WHEN 0 THEN '10+ years' WHEN 1 THEN 'about 2.5' WHEN 2 THEN '' WHEN 3 THEN '1 yr' WHEN 4 THEN 'none' ELSE '4' END",
}
ENTRIES_SQL = f"entries AS (SELECT\n  {_select(_ENTRIES)}\nFROM orders)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy(spark, sf_dir, "orders", "o_orderkey").selectExpr(*[f"{e} AS {n}" for n, e in _ENTRIES.items()])


# --- receipts: the call log -------------------------------------------------------------------

_PAIRS = [
    ("low_shelf_gain", "event_id % 13 - 6"),
    ("low_shelf_freq", "60 + event_id % 200"),
    ("band1_gain", "event_id % 11 - 5"),
    ("band1_freq", "200 + event_id % 400"),
    ("band1_q", "1 + event_id % 3"),
    ("band2_gain", "event_id % 9 - 4"),
    ("band2_freq", "900 + event_id % 900"),
    ("band2_q", "1 + event_id % 4"),
    ("band3_gain", "event_id % 7 - 3"),
    ("band3_freq", "3000 + event_id % 2000"),
    ("band3_q", "2"),
    ("high_shelf_gain", "event_id % 5 - 2"),
    ("high_shelf_freq", "9000 + event_id % 3000"),
]


def _json_text(pairs: list[tuple[str, str]]) -> str:
    bits = []
    for i, (name, value) in enumerate(pairs):
        lead = "{" if i == 0 else ", "
        bits.append(f"'{lead}\"{name}\": ', CAST({value} AS STRING)")
    return f"concat({', '.join(bits)}, '}}')"


_GOOD = _json_text(_PAIRS)
_BAD = {
    "missing": _json_text(_PAIRS[1:]),
    "boolean": _json_text([*_PAIRS[:-1], (_PAIRS[-1][0], "'true'")]),
    "bounds": _json_text([(_PAIRS[0][0], "event_id % 9 + 13"), *_PAIRS[1:]]),
    "zero_freq": _json_text([_PAIRS[0], (_PAIRS[1][0], "0"), *_PAIRS[2:]]),
}
_CONTENT = (
    "CASE event_id % 10 "
    f"WHEN 0 THEN {_GOOD} "
    f"WHEN 1 THEN concat('Sure. ```json ', {_GOOD}, ' ``` Enjoy {{it}}.') "
    f"WHEN 2 THEN concat('Here you go: ', {_GOOD}, ' and mind {{the}} rest.') "
    f"WHEN 3 THEN {_BAD['missing']} "
    f"WHEN 4 THEN {_BAD['boolean']} "
    f"WHEN 5 THEN {_BAD['bounds']} "
    f"WHEN 6 THEN {_BAD['zero_freq']} "
    "WHEN 7 THEN concat('no settings for ', event_type, ' today') "
    "WHEN 8 THEN '' "
    f"ELSE concat('```python x = 1``` then ```', {_GOOD}, '```') END"
)
_RECEIPTS = {
    "seq": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "cell_id": "concat(CAST(user_id AS STRING), ':', CAST(event_id % 7 AS STRING))",
    "model": "concat('model-', CAST(user_id % 6 AS STRING))",
    "sample_idx": "event_id % 7",
    "response_content": _CONTENT,
    "status": "CASE WHEN event_id % 10 IN (0, 1, 2, 9) AND event_type IN ('purchase', 'signup') THEN 'ok' "
    "WHEN event_id % 10 = 5 AND event_type = 'signup' THEN 'ok' ELSE 'invalid' END",
    "props": "props",
    "value": "value",
    "event_type": "event_type",
    "user_id": "user_id",
}
RECEIPTS_SQL = f"receipts AS (SELECT\n  {_select(_RECEIPTS)}\nFROM events)"


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy(spark, sf_dir, "events", "event_id").selectExpr(*[f"{e} AS {n}" for n, e in _RECEIPTS.items()])


# --- scored units: one metric per answer, from the event values ---------------------------------

_SCORED = {
    "arm": "CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'C_AGG' WHEN 'signup' THEN 'A' ELSE 'FLAT' END",
    "model": "concat('model-', CAST(event_id % 4 AS STRING))",
    "prompt": "CASE WHEN event_id % 3 = 0 THEN 'p1' ELSE 'p2' END",
    "descriptor": "concat('d', CAST(user_id AS STRING))",
    "sample_idx": "event_id % 5",
    "seq": "event_id",
    "metric": "value",
}
SCORED_SQL = f"scored AS (SELECT\n  {_select(_SCORED)}\nFROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in _SCORED.items()])


# --- small dimensions, stated in both languages ---------------------------------------------------

PRICES = [("model-0", 0.5, 1.5), ("model-1", 1.0, 4.0), ("model-2", 0.25, 0.75), ("model-3", 2.0, 8.0)]
PRICES_SQL = "prices(model, price_in, price_out) AS (VALUES " + ", ".join(
    f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, a, b in PRICES
) + ")"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
