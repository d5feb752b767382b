"""Row rules, label text, answers and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions import text
from cloudgauge.functions.params import ANSWER_BOUNDS, GAINS, FREQS, PARAM_NAMES, REGRESSOR_BOUNDS, kind
from cloudgauge.operators import answers, cleaning, retrieval, sampling, structure
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query
from cloudgauge.session import settled

SPACE_SQL = r"[\s\x0b\pZ\x1c-\x1f\x85]+"


def norm_sql(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{SPACE_SQL}', ' ', 'g')))"


def number_sql(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({c} AS DOUBLE) END"


BLOCKED = ["test", "asdf"]
_PARSED_COLS = ", ".join(f"{number_sql(p)} AS {p}" for p in PARAM_NAMES)
PARSED_SQL = (
    f"{t.ENTRIES_SQL},\nparsed AS (SELECT entry_id, {norm_sql('descriptor')} AS descriptor, trim(ip) AS ip, bad_width, {_PARSED_COLS} FROM entries)"
)
_ALL = " AND ".join(f"{p} IS NOT NULL" for p in PARAM_NAMES)
_BAD_GAIN = " OR ".join(f"coalesce(abs({g}) > 15, false)" for g in GAINS)
_BAD_FREQ = " OR ".join(f"coalesce({f} <= 0, false)" for f in FREQS)
REASON_SQL = f"""CASE WHEN bad_width THEN 'width' WHEN descriptor = '' THEN 'empty' WHEN NOT ({_ALL}) THEN 'parse'
  WHEN {_BAD_GAIN} THEN 'gain' WHEN {_BAD_FREQ} THEN 'freq' WHEN descriptor IN ('test', 'asdf') THEN 'blocklist' ELSE 'usable' END"""
USABLE_SQL = f"{PARSED_SQL},\nusable AS (SELECT * FROM (SELECT *, {REASON_SQL} AS rule FROM parsed) WHERE rule = 'usable')"
KEY_SQL = ", ".join(["descriptor", "ip", *[f"round({p}, 4)" for p in PARAM_NAMES]])


def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.entries(spark, sf_dir).withColumn("descriptor", text.normalize_label("descriptor"))
    return cleaning.parse_numeric_block(raw, PARAM_NAMES)


def funnel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = cleaning.entry_rules("descriptor", F.col("descriptor").isin(BLOCKED))
    return cleaning.cleaning_funnel(
        parsed_entries(spark, sf_dir), rules, cleaning.settings_key("descriptor", "ip"), [F.col("entry_id")]
    )


def usable_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = cleaning.entry_rules("descriptor", F.col("descriptor").isin(BLOCKED))
    return parsed_entries(spark, sf_dir).filter(cleaning.failure_reason(rules).isNull())


@query("normalize_label", f"SELECT doc_id, md5({norm_sql('text')}) AS label_md5 FROM documents")
def normalize_label(spark, sf_dir):
    return t.heavy(spark, sf_dir, "documents", "doc_id").select("doc_id", F.md5(text.normalize_label("text")).alias("label_md5"))


@query(
    "parse_numeric_block",
    t.with_views(PARSED_SQL)
    + f"SELECT entry_id, {_ALL} AS parse_ok, {', '.join(f'{p}' for p in PARAM_NAMES)} FROM parsed",
)
def parse_numeric_block(spark, sf_dir):
    return parsed_entries(spark, sf_dir).select("entry_id", "parse_ok", *PARAM_NAMES)


@query("filter_range", t.with_views(PARSED_SQL) + f"SELECT entry_id FROM parsed WHERE {_ALL} AND NOT ({_BAD_GAIN} OR {_BAD_FREQ})")
def filter_range(spark, sf_dir):
    return cleaning.filter_range(parsed_entries(spark, sf_dir).filter("parse_ok")).select("entry_id")


@query(
    "filter_blocklist",
    t.with_views(PARSED_SQL) + "SELECT descriptor, count(*) AS n FROM parsed WHERE descriptor NOT IN ('test', 'asdf') GROUP BY descriptor",
)
def filter_blocklist(spark, sf_dir):
    blocked = spark.createDataFrame([(b,) for b in BLOCKED], "descriptor string")
    kept = cleaning.filter_blocklist(parsed_entries(spark, sf_dir), "descriptor", blocked)
    return cleaning.label_counts(kept, "descriptor")


@query(
    "cleaning_funnel",
    t.with_views(
        USABLE_SQL,
        "reasons AS (SELECT rule, count(*) AS n FROM (SELECT "
        + REASON_SQL
        + " AS rule FROM parsed) GROUP BY rule UNION ALL SELECT 'kept', count(*) FROM (SELECT 1 FROM usable GROUP BY "
        + KEY_SQL
        + "))",
        "steps(step, rule) AS (VALUES (0, 'width'), (1, 'empty'), (2, 'parse'), (3, 'gain'), (4, 'freq'), (5, 'blocklist'), (6, 'usable'), (7, 'kept'))",
    )
    + "SELECT step, rule, CAST(coalesce(n, 0) AS BIGINT) AS n_rows FROM steps LEFT JOIN reasons USING (rule)",
)
def cleaning_funnel(spark, sf_dir):
    return funnel(spark, sf_dir)[1]


@query(
    "drop_exact_duplicates",
    t.with_views(USABLE_SQL) + f"SELECT min(entry_id) AS entry_id, descriptor, ip FROM usable GROUP BY {KEY_SQL}",
)
def drop_exact_duplicates(spark, sf_dir):
    kept = cleaning.drop_exact_duplicates(
        usable_entries(spark, sf_dir), cleaning.settings_key("descriptor", "ip"), [F.col("entry_id")]
    )
    return kept.select("entry_id", "descriptor", F.trim("ip").alias("ip"))


@query(
    "surface_suspicious",
    r"""SELECT DISTINCT label FROM (
  SELECT lang AS label FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT p_name FROM part
  UNION ALL SELECT CAST(p_size AS STRING) FROM part UNION ALL SELECT CAST(n_chars AS STRING) FROM documents)
WHERE NOT regexp_matches(label, '\pL') OR length(label) <= 2""",
)
def surface_suspicious(spark, sf_dir):
    docs, part = t.heavy(spark, sf_dir, "documents", "doc_id"), t.table(spark, sf_dir, "part")
    labels = (
        docs.selectExpr("lang AS label")
        .unionByName(docs.selectExpr("source AS label"))
        .unionByName(part.selectExpr("p_name AS label"))
        .unionByName(part.selectExpr("CAST(p_size AS STRING) AS label"))
        .unionByName(docs.selectExpr("CAST(n_chars AS STRING) AS label"))
    )
    return cleaning.surface_suspicious(labels, "label")


@query(
    "extract_first_number",
    r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '\d+\.?\d*', 0), '') AS DOUBLE) AS first_number FROM documents""",
)
def extract_first_number(spark, sf_dir):
    return t.heavy(spark, sf_dir, "documents", "doc_id").select("doc_id", text.extract_first_number("text").alias("first_number"))


_CONTEXT_SQL = "CASE WHEN contains(lower(instrument), 'guitar') THEN 'guitar' WHEN regexp_full_match(lower(instrument), '[a-z]+[0-9]') THEN 'mix_stimulus' END"


@query("classify_context", t.with_views(t.ENTRIES_SQL) + f"SELECT entry_id, {_CONTEXT_SQL} AS context FROM entries")
def classify_context(spark, sf_dir):
    return t.entries(spark, sf_dir).select("entry_id", text.classify_context("instrument").alias("context"))


_YEARS_SQL = r"TRY_CAST(nullif(regexp_extract(experience, '\d+\.?\d*', 0), '') AS DOUBLE)"


@query(
    "bucket_experience",
    t.with_views(t.ENTRIES_SQL)
    + f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN y IS NULL THEN 'unparsed' WHEN y <= 2 THEN 'novice'
  WHEN y >= 5 THEN 'experienced' ELSE 'gap' END AS bucket FROM (SELECT {_YEARS_SQL} AS y FROM entries)) GROUP BY bucket""",
)
def bucket_experience(spark, sf_dir):
    bucket = text.bucket_experience(text.extract_first_number("experience")).alias("bucket")
    return t.entries(spark, sf_dir).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def _bounds_sql(bounds: dict) -> str:
    return ", ".join(f"least(greatest({p} * 3, {bounds[kind(p)][0]}E0), {bounds[kind(p)][1]}E0) AS {p}" for p in PARAM_NAMES)


@query("clip_to_bounds", t.with_views(t.SETTINGS_SQL) + f"SELECT id, {_bounds_sql(REGRESSOR_BOUNDS)} FROM settings")
def clip_to_bounds(spark, sf_dir):
    loud = t.settings(spark, sf_dir).withColumns({p: F.col(p) * 3 for p in PARAM_NAMES})
    return retrieval.clip_to_bounds(loud, REGRESSOR_BOUNDS).select("id", *PARAM_NAMES)


@query(
    "to_log_space",
    t.with_views(t.SETTINGS_SQL)
    + "SELECT id, "
    + ", ".join(p if kind(p) == "gain" else f"round(log10({p}), 6) AS {p}" for p in PARAM_NAMES)
    + " FROM settings",
)
def to_log_space(spark, sf_dir):
    out = retrieval.to_log_space(t.settings(spark, sf_dir))
    return out.select("id", *[F.col(p) if kind(p) == "gain" else F.round(p, 6).alias(p) for p in PARAM_NAMES])


@query(
    "from_log_space",
    t.with_views(t.SETTINGS_SQL)
    + "SELECT id, "
    + ", ".join(
        (
            f"least(greatest({p}, -12), 12) AS {p}"
            if kind(p) == "gain"
            else f"round(least(greatest(pow(10, log10({p}) * 1.1E0), {REGRESSOR_BOUNDS[kind(p)][0]}E0), {REGRESSOR_BOUNDS[kind(p)][1]}E0), 6) AS {p}"
        )
        for p in PARAM_NAMES
    )
    + " FROM settings",
)
def from_log_space(spark, sf_dir):
    logs = retrieval.to_log_space(t.settings(spark, sf_dir))
    logs = logs.withColumns({p: F.col(p) * 1.1 for p in PARAM_NAMES if kind(p) != "gain"})
    out = retrieval.from_log_space(logs, REGRESSOR_BOUNDS)
    return out.select("id", *[F.col(p) if kind(p) == "gain" else F.round(p, 6).alias(p) for p in PARAM_NAMES])


# --- answers ----------------------------------------------------------------------------------

_SORTED_KEYS = "[" + ", ".join(f"'{p}'" for p in sorted(PARAM_NAMES)) + "]"


def _json_double(p: str) -> str:
    return f"CASE WHEN json_type(body, '$.{p}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(body, '$.{p}') AS DOUBLE) END"


def _inside_sql(p: str) -> str:
    low, high = ANSWER_BOUNDS[kind(p)]
    more = f" AND {p} > 0" if kind(p) == "freq" else ""
    return f"{p} BETWEEN {low} AND {high}{more}"


ANSWERS_SQL = (
    t.RECEIPTS_SQL
    + r""",
bodies AS (SELECT *, regexp_extract(CASE WHEN contains(response_content, '```')
    THEN coalesce(list_filter(string_split(response_content, '```'), lambda s: contains(s, '{'))[1], response_content)
    ELSE response_content END, '\{[^{}]*\}', 0) AS body0 FROM receipts),
values_of AS (SELECT *, nullif(body0, '') AS body FROM bodies),
typed AS (SELECT *, list_sort(json_keys(body)) AS answer_keys, """
    + ", ".join(f"{_json_double(p)} AS {p}" for p in PARAM_NAMES)
    + f""" FROM values_of),
checked AS (SELECT *, CASE WHEN trim(response_content) = '' THEN 'empty' WHEN NOT contains(response_content, '{{') THEN 'no_object'
  WHEN body IS NULL THEN 'bad_json' WHEN answer_keys <> {_SORTED_KEYS} THEN 'wrong_keys'
  WHEN NOT ({_ALL}) THEN 'not_numbers' WHEN NOT ({' AND '.join(_inside_sql(p) for p in PARAM_NAMES)}) THEN 'out_of_bounds' END AS reason
  FROM typed)"""
)


@query(
    "extract_answer_json",
    t.with_views(ANSWERS_SQL)
    + f"SELECT seq, array_to_string(answer_keys, ',') AS answer_keys, {', '.join(PARAM_NAMES)} FROM checked",
)
def extract_answer_json(spark, sf_dir):
    got = answers.extract_answer_json(t.receipts(spark, sf_dir), "response_content")
    return got.select(
        "seq", F.array_join("answer_keys", ",").alias("answer_keys"), *[F.col("answer")[p].alias(p) for p in PARAM_NAMES]
    )


@query(
    "validate_answer",
    t.with_views(ANSWERS_SQL)
    + "SELECT seq, CASE WHEN reason IS NULL THEN 'ok' ELSE 'invalid' END AS answer_status, reason, "
    + ", ".join(f"CASE WHEN reason IS NULL THEN {p} END AS {p}" for p in PARAM_NAMES)
    + " FROM checked",
)
def validate_answer(spark, sf_dir):
    got = answers.validate_answer(t.receipts(spark, sf_dir), "response_content")
    return got.select("seq", "answer_status", "reason", *[F.col("answer")[p].alias(p) for p in PARAM_NAMES])


@query(
    "build_cell_id",
    t.with_views(t.RECEIPTS_SQL)
    + "SELECT seq, concat_ws('|', model, event_type, status, cell_id, CAST(sample_idx AS STRING)) AS cell FROM receipts",
)
def build_cell_id(spark, sf_dir):
    cell = text.build_cell_id("model", "event_type", "status", "cell_id", "sample_idx")
    return t.receipts(spark, sf_dir).select("seq", cell.alias("cell"))


@query("prompt_digest", "SELECT doc_id, substr(sha256(text), 1, 8) AS prompt_sha8 FROM documents")
def prompt_digest(spark, sf_dir):
    return t.heavy(spark, sf_dir, "documents", "doc_id").select("doc_id", text.digest8("text").alias("prompt_sha8"))


TEMPLATES = [
    ("short", 'Settings for "{descriptor}", please.', "Known settings ({n}) for {descriptor}:\n{context}\n"),
    ("long", 'Make it sound "{descriptor}". Answer with one object for {descriptor}.', "Ground truth, {n} rows:\n{context}\n\n"),
]
_JSON_SQL = "to_json(struct_pack(" + ", ".join(f"{p} := round_even({p}, 2)" for p in PARAM_NAMES) + "))"


@query(
    "fill_template",
    t.with_views(
        t.SETTINGS_SQL,
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY descriptor ORDER BY md5('42:' || id), id) - 1 AS pos, count(*) OVER (PARTITION BY descriptor) AS n, {_JSON_SQL} AS payload FROM settings)",
        "starts AS (SELECT DISTINCT descriptor, n, CAST('0x' || substr(md5('42:' || descriptor), 1, 8) AS BIGINT) % n AS start FROM ranked)",
        "picks AS (SELECT s.descriptor, i.pick, r.payload FROM starts s, (SELECT unnest(range(5)) AS pick) i JOIN ranked r ON r.descriptor = s.descriptor AND r.pos = (s.start + i.pick) % s.n WHERE i.pick < s.n)",
        "contexts AS (SELECT descriptor, count(*) AS n_context, string_agg(payload, chr(10) ORDER BY pick) AS context FROM picks GROUP BY descriptor)",
        "templates(variant, template, block) AS (VALUES "
        + ", ".join("(" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in row) + ")" for row in TEMPLATES)
        + ")",
    )
    + """SELECT descriptor, variant, md5(replace(replace(replace(block, '{n}', CAST(n_context AS STRING)), '{descriptor}', descriptor), '{context}', context)
  || replace(template, '{descriptor}', descriptor)) AS prompt_md5 FROM contexts, templates""",
)
def fill_template(spark, sf_dir):
    rows = t.settings(spark, sf_dir).withColumn("payload", answers.settings_json())
    targets = rows.select("descriptor").distinct().withColumn("pool_label", F.col("descriptor"))
    pool = rows.select(F.col("descriptor").alias("pool_label"), "id", "payload")
    picks = sampling.sample_exemplars(targets, pool, "descriptor", "pool_label", "id")
    contexts = answers.exemplar_block(picks, ["descriptor"], "payload", "pick")
    templates = spark.createDataFrame(TEMPLATES, "variant string, template string, block string")
    cells = targets.select("descriptor").withColumn("variant", F.explode(F.array(*[F.lit(v[0]) for v in TEMPLATES])))
    filled = answers.fill_template(cells, templates, contexts, "variant", "descriptor", ["descriptor"])
    return filled.select("descriptor", "variant", F.md5("prompt_text").alias("prompt_md5"))


# --- probes -------------------------------------------------------------------------------------


@query(
    "probe_verbatim",
    """SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) <> '' AND contains(d.text, substr(b.text, 1, 60))) THEN 'verbatim_recall'
  WHEN contains(upper(text), 'CANNOT RECALL') THEN 'declined' ELSE 'no_match' END AS verbatim FROM documents d""",
)
def probe_verbatim(spark, sf_dir):
    docs = t.heavy(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    got = answers.probe_verbatim(docs, "doc_id", "text", t.table(spark, sf_dir, "benchmark"), "text")
    return got.select("doc_id", "verbatim")


_PROBED_SQL = (
    t.SETTINGS_SQL,
    t.RECEIPTS_SQL,
    "truth AS (SELECT avg(low_shelf_gain) AS t1, avg(high_shelf_gain) AS t2 FROM settings)",
    r"probed AS (SELECT model, seq, response_content, list_transform(list_slice(regexp_extract_all(response_content, '-?\d+\.?\d*'), 1, 4), lambda x: CAST(x AS DOUBLE)) AS nums, t1, t2 FROM receipts, truth)",
    """verdicts AS (SELECT model, seq, CASE WHEN len(list_filter(nums, lambda x: abs(x - t1) <= 1)) > 0 AND len(list_filter(nums, lambda x: abs(x - t2) <= 1)) > 0
  THEN 'statistical_recall' WHEN contains(upper(response_content), 'CANNOT RECALL') THEN 'declined' ELSE 'no_match' END AS statistical,
  CASE WHEN contains(response_content, '"low_shelf_freq": 77,') THEN 'verbatim_recall' WHEN contains(upper(response_content), 'CANNOT RECALL') THEN 'declined' ELSE 'no_match' END AS verbatim FROM probed)""",
)


def _probed(spark, sf_dir):
    truth = t.settings(spark, sf_dir).agg(F.avg("low_shelf_gain").alias("t1"), F.avg("high_shelf_gain").alias("t2"))
    # the two truths are one row, asked for by both uses of the log
    log = t.receipts(spark, sf_dir).select("model", "seq", "response_content").join(F.broadcast(settled(truth)))
    out = answers.probe_statistic(log, "response_content", [F.col("t1"), F.col("t2")])
    passages = spark.createDataFrame([('"low_shelf_freq": 77,',)], "passage string")
    return answers.probe_verbatim(out, "seq", "response_content", passages, "passage")


@query("probe_statistic", t.with_views(*_PROBED_SQL) + "SELECT seq, statistical FROM verdicts")
def probe_statistic(spark, sf_dir):
    return _probed(spark, sf_dir).select("seq", "statistical")


@query("probe_keyword", "SELECT doc_id, contains(text, '25') OR contains(lower(text), 'columns') AS aware FROM documents")
def probe_keyword(spark, sf_dir):
    return t.heavy(spark, sf_dir, "documents", "doc_id").select("doc_id", answers.probe_keyword("text").alias("aware"))


@query(
    "recall_verdicts",
    t.with_views(*_PROBED_SQL)
    + """SELECT count(*) AS n_models, count(*) FILTER (WHERE v) AS n_verbatim, count(*) FILTER (WHERE s) AS n_statistical
FROM (SELECT model, bool_or(verbatim = 'verbatim_recall') AS v, bool_or(statistical = 'statistical_recall') AS s FROM verdicts GROUP BY model)""",
)
def recall_verdicts(spark, sf_dir):
    return answers.recall_verdicts(_probed(spark, sf_dir), "model")


@query(
    "zero_variance_drop",
    t.with_views(t.CURVES_SQL)
    + """SELECT label, feature, round(stddev_pop(x), 6) AS sd, stddev_pop(x) > 1e-9 AS keep FROM (
  SELECT label, unnest(range(len(vec) + 1)) AS feature, unnest(list_append(vec, 1.0)) AS x FROM curves) GROUP BY label, feature""",
)
def zero_variance_drop(spark, sf_dir):
    padded = t.curves(spark, sf_dir).withColumn("vec", F.concat("vec", F.array(F.lit(1.0))))
    return structure.zero_variance_drop(padded, ["label"], "vec").select(
        "label", "feature", F.round("sd", 6).alias("sd"), "keep"
    )
