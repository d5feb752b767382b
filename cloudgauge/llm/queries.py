"""The corpus operators as registered queries on the standard tables.

Each query names the documents' columns as the call log does, applies its operator with
production parameters, and derives the asked columns from what it returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.llm import archives, bpe, credentials, dialogues, divergence, negatives, neighbours, packing, privacy, quality, repeats, simhash, toxicity
from cloudgauge.llm.common import key_type
from cloudgauge.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def receipts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The documents under the call log's names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("cell_id"), F.col("text").alias("response_content"), *more)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the rank queue, and the bytes they decode to."""
    path = public_tokenizers.path(BYTE_RANKS)
    encoded = bpe.encode_responses(receipts(spark, sf_dir), path, public_tokenizers.PATTERN)
    decoded = bpe.decode_responses(encoded, path)
    return decoded.select(
        F.col("cell_id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op10_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in windows of 2048."""
    packed = packing.pack_responses(receipts(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))
    return packed.select(
        F.col("cell_id").alias("doc_id"),
        F.col("piece_start").alias("start"),
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("answer_tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the divergence rules."""
    judged = divergence.divergence_rules(receipts(spark, sf_dir, F.col("lang").alias("profile")))
    return judged.withColumnRenamed("cell_id", "doc_id")


@query
def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: strict spans and what the boosted trees add."""
    found = privacy.pii_spans(receipts(spark, sf_dir))
    base = F.filter("pii_spans", lambda s: s["kind_no"] < len(privacy.BASE))
    return found.select(
        F.col("cell_id").alias("doc_id"),
        *[of_kind(F.col("pii_spans"), kind).alias(f"n_{kind}") for kind in privacy.BASE],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("pii_spans")).alias("spans"),
    )


@query
def op7_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source owns its documents, and each of its languages
    is a repository."""
    owned = receipts(
        spark, sf_dir, F.col("source").alias("model"), F.concat_ws("/", "source", F.coalesce("lang", F.lit(""))).alias("arm")
    )
    found = credentials.secret_spans(owned)
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        F.col("cell_id").alias("doc_id"),
        *[of_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in credentials.KINDS[:3]],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_duplicate_groups(receipts(spark, sf_dir), shingle_words=4, max_bits=4)
    return groups.select(
        F.col("cell_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op6_induced_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that occur elsewhere."""
    cleared = repeats.remove_repeats(receipts(spark, sf_dir), min_bytes=400)
    return cleared.select(
        F.col("cell_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op8_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding, among all."""
    curves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    found = neighbours.nearest_curves(curves, F.col("id") % 20 == 0, k=20)
    return found.select(
        F.col("query_id").cast("long"), "rank", F.col("id").cast("long").alias("vec_id"), "score"
    )


def remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string")) % divisor


def training_labels(spark: SparkSession, sf_dir: str, known: Column) -> DataFrame:
    """The labels that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(known)
    return labels.withColumnRenamed("doc_id", "cell_id")


@query
def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fifth."""
    docs = receipts(spark, sf_dir)
    model = quality.fit_attention_model(docs, training_labels(spark, sf_dir, remainder(F.col("doc_id"), 5) != 0), threshold=0.3)
    return quality.quality_scores(docs, model).select(
        F.col("cell_id").alias("doc_id"),
        (remainder(F.col("cell_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op5_ratio_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out third."""
    docs = receipts(spark, sf_dir)
    model = toxicity.fit_ratio_model(docs, training_labels(spark, sf_dir, remainder(F.col("doc_id"), 3) != 1), threshold=0.7)
    return toxicity.toxicity_scores(docs, model).select(
        F.col("cell_id").alias("doc_id"),
        (remainder(F.col("cell_id"), 3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; every seventh has a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    curves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), label.alias("descriptor"), F.col("embedding").alias("vec")
    )
    return negatives.hard_negatives(curves, F.col("id") % 50 == 0)


ORACLES["op11_multi_index"] = """
with r as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
    select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint as score
    from r a join r b on a.vec_id <> b.vec_id
    where a.vec_id % 50 = 0
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score
    from s where own = label
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id,
       (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and s.own <> s.label
where 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""


@query
def op12_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, and what is read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch_path(spark, "archives")
    archives.write_archives(pages, folder, cell_id="page_id", response_content="html", target="url")
    back = archives.resolve_revisits(archives.read_archives(spark, folder))
    kind = key_type(pages, "page_id")
    return back.select(
        F.col("cell_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


ORACLES["op12_segment_reassembly"] = """
with p as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest from pages
), b as (
    select page_id, strlen(html)::bigint as payload_bytes, html,
           list_aggregate(list_transform(range(32), lambda i:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      1 + (((('0x' || substr(digest, (1 + 5 * (i // 4))::int, 5))::bigint) >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
           max(page_id) over (partition by html) as stored
    from p
)
select page_id, payload_bytes, payload_digest,
       case when page_id = stored then 'response' else 'revisit' end as record_type,
       case when page_id <> stored then stored end as refers_to
from b
"""


@query
def op13_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    names = {"cell_id": "conv_id", "response_content": "text"}
    audits, repaired = dialogues.repair_turns(dialogues.damage_turns(turns, **names), **names)
    found = audits.join(dialogues.dialogue_digests(repaired).withColumnRenamed("cell_id", "digest_id"), F.col("cell_id").eqNullSafe(F.col("digest_id")), "left")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("cell_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
