"""Classifiers by held-out accuracy, and the nearest-neighbour scan by recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge.llm import labelled, neighbours, quality, toxicity
from tests.llm import edge

SF = "/root/testdata/sf0.1"
NAMES = {"cell_id": "doc_id", "response_content": "text"}


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels.select("doc_id"), "doc_id"), labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def held_out(scored, labels, held, score, label):
    rows = scored.join(labels, "doc_id").filter(held).select(score, label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_on_held_out_labels(tables):
    docs, labels, held = tables
    model = quality.fit_attention_model(docs, labels.filter(~held), **NAMES)
    score, label = held_out(quality.quality_scores(docs, model, "s", "text"), labels, held, "s", "quality")
    assert ((score >= 0.3) == label).mean() > 0.98
    assert (score[label == 1] >= 0.3).mean() > 0.98


def test_toxicity_on_held_out_labels(tables):
    docs, labels, held = tables
    model = toxicity.fit_ratio_model(docs, labels.filter(~held), **NAMES)
    score, label = held_out(toxicity.toxicity_scores(docs, model, "s", "text"), labels, held, "s", "toxic")
    assert ((score >= 0.7) == label).mean() > 0.93
    assert (score[label == 0] < 0.7).mean() > 0.97


def test_attention_gradients():
    rng = np.random.default_rng(1)
    first = [rng.standard_normal(s) * 0.5 for s in ((quality.FEATURES, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,))]
    model = quality.AttentionModel(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), *first)
    x, starts, y = rng.standard_normal((9, quality.FEATURES)) * 0.2, np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    x[:, -1] = rng.random(9)

    def loss():
        p = labelled.sigmoid(model.forward(x, starts)["logit"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    f = model.forward(x, starts)
    for p, g in zip(model.parameters(), model.gradients(f, starts, labelled.sigmoid(f["logit"]) - y, 0.0), strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
            p[at] += 1e-5
            up = loss()
            p[at] -= 2e-5
            down = loss()
            p[at] += 1e-5
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_passages_cover_whole_texts():
    text = " ".join(["word"] * 200) + " ### " + "tail " * 60
    got = quality.passages(text)
    assert got.shape == (-(-261 // quality.PASSAGE_WORDS), quality.FEATURES) and np.isfinite(got).all()
    assert not np.allclose(got[3], got[0])
    for odd in ("", " \n", "x", "é", "\x00", "a b", " a\n"):
        assert quality.passages(odd).shape == (1, quality.FEATURES) and np.isfinite(quality.passages(odd)).all()


def test_grams_run_across_blanks_and_fold_case():
    assert set(toxicity.gram_buckets("Ab  CD")) == set(toxicity.gram_buckets("ab\ncd!"))
    assert len(toxicity.gram_buckets("")) == 0 and len(toxicity.gram_buckets("ab")) == 1


def test_best_cut_lies_in_the_widest_gap():
    assert labelled.best_logit(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0
    assert labelled.best_logit(np.array([1.0, 2.0]), np.array([1, 1])) == 0.0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifier_edges(spark, kind):
    fit, score = (quality.fit_attention_model, quality.quality_scores) if kind == "quality" else (toxicity.fit_ratio_model, toxicity.toxicity_scores)
    receipts = edge.receipts(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 1), (None, 1), (77, 0), (5, None)], f"cell_id long, {kind} int")
    rows = score(receipts, fit(receipts, labels, kind), "text").collect()
    assert len(rows) == len(edge.rows()) and all(0 <= r["text"] <= 1 for r in rows)
    by_text = {}
    for r in rows:  # the same text, the same score; null is empty
        by_text.setdefault(r["response_content"] or "", set()).add(r["text"])
    assert all(len(s) == 1 for s in by_text.values())
    unlabelled = score(receipts, fit(receipts, labels.limit(0), kind), "s").select("s").distinct().collect()
    assert [r["s"] for r in unlabelled] == [0.5]
    assert score(edge.receipts(spark, empty=True), fit(edge.receipts(spark, empty=True), labels, kind)).count() == 0


def brute_nearest(ids, vectors, own, k):
    score = (vectors * vectors[ids.index(own)]).sum(axis=1)
    order = np.lexsort((ids, -score))
    return [ids[i] for i in order if ids[i] != own][:k], score


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    curves = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = {}
    for r in neighbours.nearest_curves(curves, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    hits = 0
    for own, got in found.items():
        want, score = brute_nearest(ids, vectors, own, 20)
        assert [r.rank for r in got] == list(range(1, 21)) and own not in [r.id for r in got]
        assert [r.score for r in got] == pytest.approx([score[ids.index(r.id)] for r in got], abs=1e-12)
        assert [(-r.score, r.id) for r in got] == sorted((-r.score, r.id) for r in got)
        hits += len({r.id for r in got} & set(want))
    assert len(found) == sum(i % 20 == 0 for i in ids) and hits >= 0.9 * 20 * len(found)


def test_recall_of_vectors_in_clusters(spark):
    """A cluster of cosine 0.75 fills the best k; tighter ones in later lists must still get in."""
    rng = np.random.default_rng(4)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def around(centre, n, cosine):
        across = rng.standard_normal((n, 64))
        across = unit(across - (across @ centre)[:, None] * centre)
        return cosine * centre + (1 - cosine**2) ** 0.5 * across

    centres = unit(rng.standard_normal((20, 64)))
    parts = [np.concatenate([around(c, 40, 0.75), around(c, 15, 0.9), around(c, 10, 0.98), c[None]]) for c in centres]
    vectors = np.concatenate(parts)
    ids = list(range(len(vectors)))
    asks = [i for i in ids if i % 66 in (65, 60, 45)]
    curves = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "id long, vec array<double>")
    found = {}
    for r in neighbours.nearest_curves(curves, F.col("id").isin(asks), probe_share=1.0).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(found[own] & set(brute_nearest(ids, vectors, own, 20)[0])) for own in asks)
    assert hits >= 0.995 * 20 * len(asks)


def test_each_vector_of_an_id_asks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8))
    ids = [7, 7, 7, *range(100, 157)]
    rows = [(i, v.tolist(), i == 7) for i, v in zip(ids, vectors, strict=True)]
    rows.append((7, rows[0][1], False))  # marked in one of two equal rows
    curves = spark.createDataFrame(rows, "id long, vec array<double>, asks boolean")
    got = {}
    for r in neighbours.nearest_curves(curves, F.col("asks"), k=5, probe_share=1.0).collect():
        got.setdefault(r.query_key, {})[r.rank] = r.id
    want = sorted([ids[3 + i] for i in np.argsort(-(vectors[3:] @ v))[:5]] for v in vectors[:3])
    assert sorted([mine[rank] for rank in range(1, 6)] for mine in got.values()) == want


@pytest.mark.parametrize(("cell_rows", "block"), [(8192, 16), (7, 16), (5, 3)])
def test_small_and_odd_curves(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    nan, inf = float("nan"), float("inf")
    good = {i: [float(i % 5), 1.0, -float(i % 3)] for i in range(30)}  # many ties
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0])]
    curves = spark.createDataFrame([*good.items(), *list(good.items())[:3], *odd], "id long, vec array<double>").withColumn("list", F.lit("x"))
    got = neighbours.nearest_curves(curves, F.col("id") % 2 == 0, k=40, probe_share=1.0, cell_rows=cell_rows).collect()
    ids, vectors = list(good), np.array(list(good.values()))
    for own in (i for i in good if i % 2 == 0):
        mine = sorted((r.rank, r.id) for r in got if r.query_id == own)
        assert [i for _, i in mine] == brute_nearest(ids, vectors, own, 40)[0]
    assert {r.query_id for r in got} == {i for i in good if i % 2 == 0}
    few = neighbours.nearest_curves(curves, F.col("id") == 4, k=12, probe_share=0.01, cell_rows=cell_rows).count()
    assert few == 12
    assert neighbours.nearest_curves(curves.limit(0), F.col("id") == 4).count() == 0
