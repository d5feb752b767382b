"""The stages one by one on odd documents, and what each must do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cloudgauge.llm import queries
from tests.llm import brute, edge

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept", "node"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, a, b, None) for i, t, a, b, _ in edge.rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("kept", F.lit(1)).withColumn("node", F.lit("x"))


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}


def one_of_each_group(rows):
    """The ids that stay: the least of each group of rows that links of 0.8 connect."""
    root, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    groups = {}
    for at, (own, _) in enumerate(rows):
        groups.setdefault(root[at], []).append(own)
    return [min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values()]


def test_unlike_documents_of_one_id_stay(spark, sf_dir):
    texts = ["one text of its own that is like no other here", "quite another text under the same id as the first one", "third", "third"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[0] + " or so"), (None, "alone"), (None, "lonely"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, texts[0]), (1, texts[1]), (2, "third"), (None, "alone"), (None, "lonely"), (None, texts[0] + " or so")], key=str)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd, name):
    stage = dict(pipeline.STAGES)[name]
    got = stage(spark, odd, sf_dir)
    rows = got.collect()
    if name != "packed_sequences":
        assert got.columns == COLUMNS and got.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    if name in ("repeated_passages", "personal_data"):
        assert len(rows) == len(edge.rows())
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    if name == "near_duplicates":
        assert sorted((r.doc_id for r in rows), key=str) == sorted(one_of_each_group([(i, t) for i, t, *_ in edge.rows()]), key=str)
    assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_copies_leave_one_and_distinct_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = docs.filter("n_chars > 800").limit(20).withColumn("doc_id", F.col("doc_id") + 100_000)
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs.union(copies), sf_dir).select("doc_id").collect()}
    assert all(i < 100_000 for i in kept)
    texts = {r.doc_id: r.text for r in docs.collect()}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [(t or "").lower().split()]}
    for i in set(texts) - kept:  # whoever went has something alike that it shares passages with
        assert max(len(shingles[i] & shingles[j]) for j in texts if j != i) > 0 or not texts[i].strip()


def test_repeated_passages_are_those_of_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    want = brute.without_passages(texts, pipeline.MIN_REPEAT_BYTES, pipeline.MIN_REPEAT_WORDS)
    assert got == {i: texts[i] if kept is None else kept.decode("utf-8", "ignore") for i, kept in want.items()}


def test_personal_data_goes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = sum(len(brute.private(r.text)) for r in docs.collect())
    after = [brute.private(r.text) for r in pipeline.personal_data(spark, docs, sf_dir).collect()]
    assert before > 0 and not any(after)


def test_run_chains_the_stages(spark, sf_dir):
    got = pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    per = {}
    for r in rows:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 for s, n in per.items() if s != max(per))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = {r.doc_id for r in pipeline.quality_filter(spark, docs, sf_dir).select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= quality


def test_queries_return_the_asked_columns(spark, sf_dir):
    asked = {
        "op1": ["doc_id", "fingerprint", "component_id"],
        "op2": ["doc_id", "held_out", "score", "predicted"],
        "op3": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op4": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op5": ["doc_id", "held_out", "score", "predicted"],
        "op6": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op8": ["query_id", "rank", "vec_id", "score"],
        "op9": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op10": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op11": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
        "op12": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op13": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    }
    by_number = {name.split("_")[0]: fn for name, fn in queries.QUERIES.items()}
    assert set(by_number) == set(asked)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for number, columns in asked.items():
        got = by_number[number](spark, sf_dir)
        assert set(columns) <= set(got.columns), number
        if number not in ("op8", "op10", "op11", "op12", "op13"):
            assert got.count() == docs


def test_digests_of_a_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_boosted_pii"](spark, sf_dir).collect():
        assert r.base_sha256 == brute.sha(brute.joined(brute.private(texts[r.doc_id])))
    for r in queries.QUERIES["op7_owned_secrets"](spark, sf_dir).collect():
        assert r.base_sha256 == brute.sha(brute.joined(brute.secrets(texts[r.doc_id])))
    assert np.isfinite([r.score for r in queries.QUERIES["op8_dimension_scan"](spark, sf_dir).collect()]).all()
