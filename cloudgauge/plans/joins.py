"""Study joins, retrieval baselines and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudgauge.functions.params import FLAT_SETTINGS, GAINS, PARAM_NAMES
from cloudgauge.functions.text import build_cell_id
from cloudgauge.operators import answers, retrieval, sampling, selection
from cloudgauge.plans import tables as t
from cloudgauge.plans.registry import query


@query(
    "rejoin_metadata",
    """SELECT doc_id, source, coalesce(CAST(quality AS STRING), '') AS quality, coalesce(CAST(toxic AS STRING), '') AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def rejoin_metadata(spark, sf_dir):
    meta = t.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")
    )
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.rejoin_metadata(docs, meta, "doc_id", ["quality", "toxic"])


@query(
    "join_features",
    """WITH linked AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
cov AS (SELECT lang, count(*) AS n_rows, count(quality) AS n_joined, round(count(quality) / (count(*) + 0E0), 6) AS coverage, count(quality) >= 50 AS used FROM linked GROUP BY lang)
SELECT c.*, CASE WHEN used THEN (SELECT sum(quality) FROM linked l WHERE l.lang = c.lang) END::BIGINT AS quality_sum FROM cov c""",
)
def join_features(spark, sf_dir):
    """Row id -> entry id -> features, with the coverage gate."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang")
    ids = docs.select("doc_id", F.col("doc_id").alias("entry_id"))
    feats = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), "quality")
    joined, coverage = selection.join_features(docs, ids, feats, "doc_id", "entry_id", "lang", 50)
    total = joined.groupBy("lang").agg(F.sum("quality").alias("quality_sum"))
    return coverage.withColumn("coverage", F.round("coverage", 6)).join(total, "lang", "left")


_MODELS, _ARMS, _PROMPTS = ["m1", "m2", "m3"], ["B", "C"], ["p1", "p2"]


def _values(xs) -> str:
    return ", ".join(f"('{x}')" for x in xs)


_ANCHORS = ["m1", "m-anchor"]


@query(
    "grid_cross_join",
    f"""WITH labels AS (SELECT p_name AS descriptor, count(*) >= 30 AS evaluated FROM part GROUP BY p_name),
sets AS (SELECT descriptor, model, arm, prompt, s FROM labels, (VALUES {_values(_MODELS)}) m(model), (VALUES {_values(_ARMS)}) a(arm), (VALUES {_values(_PROMPTS)}) p(prompt), range(11) r(s) WHERE evaluated
UNION SELECT descriptor, model, arm, 'p1', 0 FROM labels, (VALUES {_values(_MODELS)}) m(model), (VALUES {_values(_ARMS)}) a(arm) WHERE NOT evaluated
UNION SELECT descriptor, model, 'C_AGG', 'p1', s FROM labels, (VALUES {_values(_MODELS)}) m(model), range(11) r(s) WHERE evaluated
UNION SELECT descriptor, model, 'B', prompt, s FROM labels, (VALUES {_values(_ANCHORS)}) m(model), (VALUES {_values(_PROMPTS)}) p(prompt), range(11) r(s) WHERE evaluated)
SELECT concat_ws('|', model, arm, prompt, descriptor, CAST(s AS STRING)) AS cell_id, CASE WHEN s = 0 THEN 0.0E0 ELSE 0.7E0 END AS temperature FROM sets""",
)
def grid_cross_join(spark, sf_dir):
    """Evaluated labels under every variant, tail labels once under the minimal prompt,
    the centroid as context, and the anchor models, which partly are the others."""
    labels = t.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("descriptor")).agg(F.count(F.lit(1)).alias("n"))
    evaluated, tail = (labels.filter(c).select("descriptor") for c in ("n >= 30", "n < 30"))
    cells = answers.grid_union(
        [
            (evaluated, {"model": _MODELS, "arm": _ARMS, "prompt": _PROMPTS}, 10),
            (tail, {"model": _MODELS, "arm": _ARMS, "prompt": _PROMPTS[:1]}, 0),
            (evaluated, {"model": _MODELS, "arm": ["C_AGG"], "prompt": _PROMPTS[:1]}, 10),
            (evaluated, {"model": _ANCHORS, "arm": ["B"], "prompt": _PROMPTS}, 10),
        ],
        0.0,
        0.7,
    )
    return cells.select(build_cell_id("model", "arm", "prompt", "descriptor", "sample_idx").alias("cell_id"), "temperature")


@query(
    "resume_anti_join",
    t.with_views(t.RECEIPTS_SQL)
    + "SELECT DISTINCT cell_id FROM receipts WHERE cell_id NOT IN (SELECT cell_id FROM receipts WHERE status = 'ok')",
)
def resume_anti_join(spark, sf_dir):
    log = t.receipts(spark, sf_dir)
    return answers.resume_anti_join(log.select("cell_id").distinct(), log, "cell_id")


_DEV_SQL = f"""{t.CURVES_SQL},
dev AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:dev:' || CAST(vec_id AS STRING)), vec_id) <= round_even(0.1E0 * count(*) OVER (PARTITION BY label), 0) AS is_dev FROM curves)"""


@query("dev_slice", t.with_views(_DEV_SQL) + "SELECT vec_id, label, is_dev FROM dev")
def dev_slice(spark, sf_dir):
    return sampling.dev_slice(t.curves(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")


@query(
    "dev_semi_anti",
    t.with_views(_DEV_SQL)
    + "SELECT CASE WHEN is_dev THEN 'dev' ELSE 'train' END AS side, label, count(*) AS n, sum(vec_id)::BIGINT AS id_sum FROM dev GROUP BY ALL",
)
def dev_semi_anti(spark, sf_dir):
    rows = t.curves(spark, sf_dir).select("vec_id", "label")
    dev = sampling.dev_slice(rows, "label", "vec_id").filter("is_dev").select("vec_id")

    def fold(df, side):
        return df.groupBy(F.lit(side).alias("side"), "label").agg(
            F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("id_sum")
        )

    return fold(rows.join(dev, "vec_id", "left_semi"), "dev").unionByName(
        fold(rows.join(dev, "vec_id", "left_anti"), "train")
    )


_COS = "greatest(0E0, list_sum(list_transform(range(1, 65), lambda i: l.vec[i] * a.vec[i])) / (sqrt(list_sum(list_transform(l.vec, lambda x: x * x))) * sqrt(list_sum(list_transform(a.vec, lambda x: x * x)))))"
_ANCHOR_SQL = f"""{t.CURVES_SQL},
rare AS (SELECT CAST(vec_id AS STRING) AS name, vec FROM curves WHERE vec_id % 7 < 3),
anchors AS (SELECT CAST(vec_id AS STRING) AS anchor, vec, CAST(vec_id % 25 AS DOUBLE) - 12 AS low_shelf_gain, 20E0 + vec_id AS low_shelf_freq FROM curves WHERE vec_id % 7 >= 3),
weights AS (SELECT l.name, a.anchor, {_COS} AS weight, low_shelf_gain, low_shelf_freq FROM rare l, anchors a)"""


def _rare_and_anchors(spark, sf_dir):
    df = t.curves(spark, sf_dir)
    rare = df.filter("vec_id % 7 < 3").select(F.col("vec_id").cast("string").alias("name"), "vec")
    anchors = df.filter("vec_id % 7 >= 3").select(
        F.col("vec_id").cast("string").alias("anchor"),
        "vec",
        (F.expr("CAST(vec_id % 25 AS DOUBLE)") - 12).alias("low_shelf_gain"),
        (F.lit(20.0) + F.col("vec_id")).alias("low_shelf_freq"),
    )
    return rare, anchors


@query(
    "cosine_anchor_join",
    t.with_views(_ANCHOR_SQL)
    + """SELECT name, count(*) FILTER (WHERE weight > 0) AS n_positive, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS top_weight,
  arg_max(anchor, weight) AS nearest FROM weights GROUP BY name""",
)
def cosine_anchor_join(spark, sf_dir):
    rare, anchors = _rare_and_anchors(spark, sf_dir)
    got = retrieval.cosine_anchor_join(rare, anchors, "name", "anchor")
    return got.select(
        "name", "n_positive", F.round("weight_sum", 6).alias("weight_sum"), F.round("top_weight", 6).alias("top_weight"), "nearest"
    )


_BLEND_PARAMS = ["low_shelf_gain", "low_shelf_freq"]


@query(
    "cosine_blend",
    t.with_views(_ANCHOR_SQL)
    + """SELECT name, CASE WHEN sum(weight) > 0 THEN 'cosine_blend' ELSE 'no_positive_similarity_flat' END AS method,
  round(CASE WHEN sum(weight) > 0 THEN sum(weight * low_shelf_gain) / sum(weight) ELSE 0 END, 6) AS low_shelf_gain,
  round(CASE WHEN sum(weight) > 0 THEN sum(weight * low_shelf_freq) / sum(weight) ELSE 120 END, 6) AS low_shelf_freq FROM weights GROUP BY name""",
)
def cosine_blend(spark, sf_dir):
    rare, anchors = _rare_and_anchors(spark, sf_dir)
    weighted = retrieval.cosine_anchor_join(rare, anchors, "name", "anchor", params=_BLEND_PARAMS)
    got = retrieval.cosine_blend(weighted, "name", _BLEND_PARAMS)
    return got.select("name", "method", *[F.round(p, 6).alias(p) for p in _BLEND_PARAMS])


# profiles are colours, their words the part names that hold the colour, plus the colour
_VOCAB_SQL = f"""{t.SETTINGS_SQL},
labels_in AS (SELECT DISTINCT p_name AS descriptor FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT 'nothing known'),
vocab AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS profile, p_name AS word FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) FROM part UNION SELECT 'unused', 'nothing known'),
profiles AS (SELECT DISTINCT split_part(descriptor, ' ', 1) AS profile FROM settings),
kw AS (SELECT descriptor, profile, (CASE WHEN EXISTS (SELECT 1 FROM vocab v WHERE v.profile = p.profile AND v.word = l.descriptor) THEN 1E0 ELSE 0E0 END)
  + (CASE WHEN p.profile = l.descriptor THEN 3E0 ELSE 0E0 END) AS weight FROM labels_in l, profiles p),
kws AS (SELECT * FROM kw WHERE weight > 0)"""


def _keyword_inputs(spark, sf_dir):
    part = t.table(spark, sf_dir, "part").select("p_name").distinct()
    colour = F.split("p_name", " ")[0]
    labels = (
        part.select(F.col("p_name").alias("descriptor"))
        .unionByName(part.select(colour.alias("descriptor")))
        .unionByName(spark.createDataFrame([("nothing known",)], "descriptor string"))
        .distinct()
    )
    vocab = part.select(colour.alias("profile"), F.col("p_name").alias("word")).unionByName(
        part.select(colour.alias("profile"), colour.alias("word"))
    )
    # a profile of the vocabulary without rows, which must not get weight
    vocab = vocab.unionByName(spark.createDataFrame([("unused", "nothing known")], "profile string, word string"))
    rows = t.settings(spark, sf_dir).withColumn("profile", F.split("descriptor", " ")[0])
    return labels, vocab, rows


@query("keyword_profile_join", t.with_views(_VOCAB_SQL) + "SELECT * FROM kws")
def keyword_profile_join(spark, sf_dir):
    labels, vocab, rows = _keyword_inputs(spark, sf_dir)
    return retrieval.keyword_profile_join(labels, vocab, rows, "descriptor")


_PROFILE_CENTROIDS = (
    "cents AS (SELECT split_part(descriptor, ' ', 1) AS profile, "
    + ", ".join(f"avg({p}) AS {p}" for p in PARAM_NAMES)
    + " FROM settings GROUP BY 1)"
)


@query(
    "weighted_blend",
    t.with_views(_VOCAB_SQL, _PROFILE_CENTROIDS)
    + "SELECT l.descriptor, CASE WHEN sum(weight) > 0 THEN 'keyword_blend' ELSE 'flat_fallback' END AS method, "
    + ", ".join(f"round(coalesce(sum(weight * {p}) / sum(weight), {FLAT_SETTINGS[p]}E0), 6) + 0.0 AS {p}" for p in PARAM_NAMES)
    + " FROM labels_in l LEFT JOIN kws USING (descriptor) LEFT JOIN cents c ON c.profile = kws.profile GROUP BY l.descriptor",
)
def weighted_blend(spark, sf_dir):
    labels, vocab, rows = _keyword_inputs(spark, sf_dir)
    weights = retrieval.keyword_profile_join(labels, vocab, rows, "descriptor")
    cents = retrieval.centroid(rows, ["profile"])
    got = retrieval.weighted_blend(labels, weights, cents, "descriptor", "profile")
    return got.select("descriptor", "method", *[(F.round(p, 6) + 0.0).alias(p) for p in PARAM_NAMES])


@query(
    "nearest_anchor",
    t.with_views(t.SCORED_SQL)
    + """SELECT descriptor, coalesce(nearest, 'm-default') AS nearest FROM (SELECT DISTINCT descriptor FROM scored) LEFT JOIN
(SELECT descriptor, model AS nearest FROM (SELECT descriptor, model, row_number() OVER (PARTITION BY descriptor ORDER BY w DESC, model) AS rn
  FROM (SELECT descriptor, model, max(round(metric / 20)) AS w FROM scored WHERE arm = 'B' GROUP BY ALL)) WHERE rn = 1) USING (descriptor)""",
)
def nearest_anchor(spark, sf_dir):
    df = t.scored(spark, sf_dir)
    weights = df.filter("arm = 'B'").groupBy("descriptor", "model").agg(F.max(F.round(F.col("metric") / 20)).alias("weight"))
    return retrieval.nearest_anchor(df, weights, "descriptor", "model", "m-default")


@query(
    "greedy_baseline_join",
    t.with_views(t.SCORED_SQL)
    + """SELECT c.seq, c.metric, b.metric AS base_value FROM scored c JOIN
  (SELECT * FROM scored WHERE arm = 'B' AND sample_idx = 0 QUALIFY row_number() OVER (PARTITION BY model, prompt, descriptor ORDER BY seq DESC) = 1) b
  ON c.model = b.model AND c.prompt = b.prompt AND c.descriptor = b.descriptor
WHERE c.arm = 'C'""",
)
def greedy_baseline_join(spark, sf_dir):
    df = t.scored(spark, sf_dir)
    got = selection.greedy_baseline_join(
        df.filter("arm = 'C'"), df.filter("arm = 'B'"), ["model", "prompt", "descriptor"], "metric", "seq"
    )
    return got.select("seq", "metric", "base_value")


@query(
    "common_keys_all_arms",
    t.with_views(t.SCORED_SQL)
    + "SELECT cell FROM (SELECT concat(descriptor, model) AS cell, arm FROM scored) GROUP BY cell HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM scored)",
)
def common_keys_all_arms(spark, sf_dir):
    df = t.scored(spark, sf_dir).select(F.concat("descriptor", "model").alias("cell"), "arm")
    return selection.common_keys_all_arms(df, "arm", "cell")


@query(
    "price_lookup",
    t.with_views(t.RECEIPTS_SQL, t.PRICES_SQL)
    + "SELECT seq, model, coalesce(price_in, 0) AS price_in, coalesce(price_out, 0) AS price_out FROM receipts LEFT JOIN prices USING (model)",
)
def price_lookup(spark, sf_dir):
    log = t.receipts(spark, sf_dir).select("seq", "model")
    return answers.price_lookup(log, t.prices(spark), "model").select("seq", "model", "price_in", "price_out")


# --- samples ------------------------------------------------------------------------------------


@query(
    "stratified_split",
    t.with_views(t.SETTINGS_SQL)
    + """SELECT id, descriptor, CASE WHEN count(*) OVER (PARTITION BY descriptor) < 900 THEN 'tail_eval'
  WHEN row_number() OVER (PARTITION BY descriptor ORDER BY md5('42:' || id), id) <= round_even(0.2E0 * count(*) OVER (PARTITION BY descriptor), 0) THEN 'eval' ELSE 'train' END AS split
FROM settings""",
)
def stratified_split(spark, sf_dir):
    rows = t.settings(spark, sf_dir).select("id", "descriptor")
    return sampling.stratified_split(rows, "descriptor", "id", floor=900)


@query(
    "sample_labels",
    "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('42:' || CAST(user_id AS STRING)), user_id LIMIT 60",
)
def sample_labels(spark, sf_dir):
    return sampling.sample_labels(t.table(spark, sf_dir, "events"), "user_id", 60)


_EXEMPLAR_SQL = (
    t.SETTINGS_SQL,
    "targets AS (SELECT DISTINCT p_name AS descriptor, p_name AS pool_label FROM part UNION SELECT DISTINCT p_name || ' tail', p_name FROM part)",
    "ranked AS (SELECT descriptor AS pool_label, id, row_number() OVER (PARTITION BY descriptor ORDER BY md5('42:' || id), id) - 1 AS pos, count(*) OVER (PARTITION BY descriptor) AS n FROM settings)",
    "sizes AS (SELECT DISTINCT pool_label, n FROM ranked)",
    "starts AS (SELECT t.*, n, CAST('0x' || substr(md5('42:' || t.descriptor), 1, 8) AS BIGINT) % n AS start FROM targets t JOIN sizes USING (pool_label))",
)


@query(
    "sample_exemplars",
    t.with_views(*_EXEMPLAR_SQL)
    + """SELECT s.descriptor, CAST(i.pick AS INTEGER) AS pick, r.id FROM starts s, (SELECT unnest(range(5)) AS pick) i JOIN ranked r
ON r.pool_label = s.pool_label AND r.pos = (s.start + i.pick) % s.n WHERE i.pick < s.n""",
)
def sample_exemplars(spark, sf_dir):
    names = t.table(spark, sf_dir, "part").select(F.col("p_name").alias("descriptor"), F.col("p_name").alias("pool_label")).distinct()
    targets = names.unionByName(names.select(F.concat("descriptor", F.lit(" tail")).alias("descriptor"), "pool_label"))
    pool = t.settings(spark, sf_dir).select(F.col("descriptor").alias("pool_label"), "id")
    got = sampling.sample_exemplars(targets, pool, "descriptor", "pool_label", "id")
    return got.select("descriptor", "pick", "id")


_RAFT_SQL = (
    _DEV_SQL,
    "pool AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:raft:' || CAST(vec_id AS STRING)), vec_id) - 1 AS pos FROM dev WHERE NOT is_dev)",
    "sizes AS (SELECT label, count(*) AS n FROM pool GROUP BY label)",
    "starts AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0, sum(n) OVER () AS total FROM sizes)",
    "numbered AS (SELECT off0 + pos AS g, vec_id AS pick FROM pool JOIN starts USING (label))",
    """me AS (SELECT d.label, d.vec_id, pos, n, off0, total, n - CASE WHEN pos IS NULL THEN 0 ELSE 1 END AS own FROM dev d LEFT JOIN pool p USING (label, vec_id) JOIN starts s USING (label))""",
    """draws AS (SELECT *, total - n AS rest,
  CAST('0x' || substr(md5('42:raft:same:' || CAST(vec_id AS STRING)), 1, 8) AS BIGINT) AS hs,
  CAST('0x' || substr(md5('42:raft:same-stride:' || CAST(vec_id AS STRING)), 1, 8) AS BIGINT) AS hss,
  CAST('0x' || substr(md5('42:raft:other:' || CAST(vec_id AS STRING)), 1, 8) AS BIGINT) AS ho,
  CAST('0x' || substr(md5('42:raft:other-stride:' || CAST(vec_id AS STRING)), 1, 8) AS BIGINT) AS hos FROM me)""",
    """steps AS (SELECT *, (hs + i * (1 + hss % greatest((own - 1) // 2, 1))) % own AS step FROM draws, range(3) r(i) WHERE i < own),
outs AS (SELECT *, (ho + i * (1 + hos % greatest((rest - 1) // 1, 1))) % rest AS v FROM draws, range(2) r(i) WHERE i < rest)""",
    """wanted AS (SELECT label, vec_id, off0 + CASE WHEN pos IS NULL THEN step ELSE (pos + 1 + step) % n END AS g FROM steps
  UNION ALL SELECT label, vec_id, CASE WHEN v < off0 THEN v ELSE v + n END FROM outs)""",
)


@query(
    "raft_examples",
    t.with_views(*_RAFT_SQL)
    + "SELECT label, vec_id, string_agg(CAST(pick AS STRING), ',' ORDER BY md5('42:raft:order:' || CAST(vec_id AS STRING) || ':' || CAST(pick AS STRING))) AS examples FROM wanted JOIN numbered USING (g) GROUP BY label, vec_id",
)
def raft_examples(spark, sf_dir):
    rows = sampling.dev_slice(t.curves(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")
    pool = rows.filter("NOT is_dev").select("label", "vec_id", F.col("vec_id").cast("string").alias("payload"))
    got = sampling.raft_examples(rows, pool, "label", "vec_id", "payload")
    return got.select("label", "vec_id", F.array_join("examples", ",").alias("examples"))


@query(
    "hash_permutation",
    """WITH a AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:a:' || CAST(event_id AS STRING)), event_id) AS rn FROM events),
b AS (SELECT event_type, event_id AS partner_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:b:' || CAST(event_id AS STRING)), event_id) AS rn FROM events)
SELECT event_type, event_id, partner_id FROM a JOIN b USING (event_type, rn)""",
)
def hash_permutation(spark, sf_dir):
    return sampling.hash_permutation(t.table(spark, sf_dir, "events"), ["event_type"], "event_id")


# --- training-row aggregates ----------------------------------------------------------------------


@query(
    "centroid",
    t.with_views(t.SETTINGS_SQL)
    + f"SELECT descriptor, count(*) AS n, {', '.join(f'round(avg({p}), 6) + 0.0 AS {p}' for p in PARAM_NAMES)} FROM settings GROUP BY descriptor",
)
def centroid(spark, sf_dir):
    got = retrieval.centroid(t.settings(spark, sf_dir), ["descriptor"])
    return got.select("descriptor", "n", *[(F.round(p, 6) + 0.0).alias(p) for p in PARAM_NAMES])


_Z = " AND ".join(
    f"(stddev_samp({g}) OVER w = 0 OR abs({g} - avg({g}) OVER w) / nullif(stddev_samp({g}) OVER w, 0) <= 1.5)" for g in GAINS
)


@query(
    "reject_outliers_nsd",
    t.with_views(
        t.SETTINGS_SQL,
        f"marked AS (SELECT id, descriptor, count(*) OVER w < 3 OR coalesce({_Z}, false) AS inside FROM settings WINDOW w AS (PARTITION BY descriptor))",
        "grp AS (SELECT *, bool_or(inside) OVER (PARTITION BY descriptor) AS any_in FROM marked)",
    )
    + "SELECT id, descriptor FROM grp WHERE inside OR NOT any_in",
)
def reject_outliers_nsd(spark, sf_dir):
    return retrieval.reject_outliers_nsd(t.settings(spark, sf_dir), ["descriptor"], z=1.5).select("id", "descriptor")
