import cmath
import math
import os
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudgauge.functions.params import BANDS, PARAM_NAMES
from cloudgauge.operators import answers, blocks, cleaning, clouds, dispersion, hypothesis, mixtures, ranks, render, retrieval, sampling, selection, structure
from cloudgauge.plans import rendering, tables


@pytest.fixture(scope="module")
def cloud(spark):
    """Two labels, one of them large, with copies."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(230):
        label = "hot" if i < 170 else "cold"
        v = rng.normal(size=6) if i % 10 else np.ones(6)
        rows.append((i, label, [float(x) for x in v]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, vec array<double>")


def brute(rows, leave_one_out=True):
    out = {}
    for i, label, v in rows:
        d = [
            math.sqrt(np.mean((np.array(v) - np.array(w)) ** 2))
            for j, other, w in rows
            if other == label and (not leave_one_out or j != i)
        ]
        out[i] = d
    return out


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_block_medians_are_exact(spark, cloud, block):
    df = frame(spark, cloud)
    want = brute(cloud)
    got = clouds.leave_one_out_centrality(df, ["label"], "id", left_rows=block, right_rows=block).collect()
    assert len(got) == len(cloud)
    for r in got:
        assert r["n_pairs"] == len(want[r["id"]])
        assert r["centrality"] == pytest.approx(np.median(want[r["id"]]), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("block", [16, 4096])
def test_pair_sums(spark, cloud, block):
    df = frame(spark, cloud)
    want = brute(cloud)
    got = clouds.pairs_leave_one_out(df, ["label"], "id", left_rows=block, right_rows=block).collect()
    assert len(got) == len(cloud)
    for r in got:
        assert r["sum_dist"] == pytest.approx(sum(want[r["id"]]), rel=1e-12)
        assert r["min_dist"] == pytest.approx(min(want[r["id"]]), abs=1e-12)
    for r in clouds.pairs_unordered(df, ["label"], "id", block_rows=block).collect():
        total = sum(sum(want[i]) for i, label, _ in cloud if label == r["label"]) / 2
        assert r["sum_dist"] == pytest.approx(total, rel=1e-10)
        assert r["n_pairs"] == r["n_rows"] * (r["n_rows"] - 1) // 2


def test_equal_curves_tie_in_every_block(spark):
    v = [0.1, 0.7, -0.3]
    rows = [(i, "a", v if i % 2 else [float(i), 0.0, 1.0]) for i in range(40)]
    c = clouds.leave_one_out_centrality(frame(spark, rows), ["label"], "id", left_rows=7, right_rows=7)
    values = {r["centrality"] for r in c.collect() if r["id"] % 2}
    assert len(values) == 1


def test_percentile_counts_strictly_below(spark):
    ref = spark.createDataFrame([("a", x) for x in [1.0, 2.0, 2.0, 4.0]], "label string, centrality double")
    pred = spark.createDataFrame([("a", x, i) for i, x in enumerate([0.5, 1.0, 2.0, 3.0, 9.0, 2.0])] + [("b", 1.0, 9)], "label string, centrality double, id int")
    got = {r["id"]: r["hrp"] for r in clouds.human_relative_percentile(pred, ref, ["label"]).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 25.0, 3: 75.0, 4: 100.0, 5: 25.0}


def test_energy_of_a_cloud_with_itself(spark, cloud):
    df = frame(spark, cloud)
    e = dispersion.energy_distance(df.withColumn("arm", F.lit("x")), df, ["arm"], "label", "id", "id").collect()
    for r in e:
        # the cross mean holds the n zero self distances, the inner means do not
        assert r["energy_dist"] == pytest.approx(-2 * r["cloud_dispersion"] / r["n_samples"], rel=1e-9)
        assert r["dispersion_ratio"] == pytest.approx(1.0)


def test_renderer_checks(spark):
    rows = render.render_checks(spark).collect()
    assert len(rows) == 10
    assert all(r["passed"] for r in rows), rows


def test_renderer_matches_the_complex_response(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        s = {}
        for p in PARAM_NAMES:
            s[p] = float(rng.uniform(-12, 12) if p.endswith("gain") else rng.uniform(30, 16000) if p.endswith("freq") else rng.uniform(0.1, 10))
        rows.append((i, *[s[p] for p in PARAM_NAMES]))
    df = spark.createDataFrame(rows, ["id", *PARAM_NAMES])
    co = render.biquad_coefficients(df, ["id"]).collect()
    long = {(r["id"], r["bin"]): r["db"] for r in render.render_curves(df, ["id"]).collect()}
    packed = {r["id"]: r["vec"] for r in render.render_packed(df).collect()}
    hz = render.grid_hz()
    for i in range(40):
        for b in range(0, 256, 15):
            z = cmath.exp(-2j * math.pi * hz[b] / render.SAMPLE_RATE)
            want = sum(
                20 * math.log10(abs((c["b0"] + c["b1"] * z + c["b2"] * z * z) / (c["a0"] + c["a1"] * z + c["a2"] * z * z)))
                for c in co
                if c["id"] == i
            )
            assert long[i, b] == pytest.approx(want, abs=1e-6)
            assert packed[i][b] == pytest.approx(long[i, b], abs=1e-9)


@pytest.mark.parametrize("refine", [False, True])
def test_running_counts_match_pandas(spark, refine):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-6, 6, 300), [0.0, -0.0, 1e6, 1e6 + 1e-3, -5, -5], np.arange(20)])
    pdf = pd.DataFrame({"g": ["a", "b"] * (len(values) // 2), "v": values})
    df = spark.createDataFrame(pdf)
    freq = ranks.value_frequencies(df, ["g"], "v", {"n": F.lit(True)})
    got = ranks.running_counts(freq, ["g"], "v", ["n"], refine).collect()
    pdf["r"] = pdf.groupby("g")["v"].rank()
    want = {(g, v): r for g, v, r in pdf.itertuples(index=False)}
    assert len(got) == len(want)
    for r in got:
        assert r["n_below"] + (r["n"] + 1) / 2 == want[r["g"], r["v"]]


def test_order_statistics_and_median(spark):
    values = [5.0, 1.0, 1.0, 9.0, 7.0, -2.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "g string, v double")
    got = {r["g"]: r["median"] for r in ranks.median_by(df, ["g"], "v").collect()}
    assert got == {"a": 3.0, "b": 3.0}


def test_fdr_against_the_definition(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(size=200) ** 3, 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id int, p_value double")
    got = {r["id"]: r["q_value"] for r in hypothesis.bh_fdr(df).collect()}
    order = np.argsort(p, kind="stable")
    q, prev = {}, 1.0
    for rank in range(len(p), 0, -1):
        i = int(order[rank - 1])
        prev = min(prev, p[i] * len(p) / rank)
        q[i] = prev
    for i in got:
        assert got[i] == pytest.approx(q[i], rel=1e-12)
        assert got[i] >= p[i]


def test_rank_tests_on_hand_cases(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (2.0, 5.0), (4.0, 4.0), (9.0, 5.0)], "x double, y double")
    r = hypothesis.wilcoxon_paired(df.withColumn("g", F.lit(0)), ["g"], "x", "y").first()
    # differences 1, 2, -3, 0, 4 -> ranks 1, 2, -3, 4
    assert (r["n"], r["w_plus"], r["w_minus"]) == (4, 7.0, 3.0)
    sides = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)]
    df = spark.createDataFrame([(0, *s) for s in sides], "g int, s string, v double")
    d = hypothesis.cliffs_delta(df, ["g"], F.col("s") == "a", "v").first()["delta"]
    assert d == pytest.approx(-4 / 6)
    m = hypothesis.mann_whitney(df, ["g"], F.col("s") == "a", "v").first()
    assert m["cliffs_delta"] == pytest.approx(d)


@pytest.mark.parametrize("n", [3, 4, 24, 301, 400])
def test_bootstrap_has_the_distribution_of_resampling(spark, n):
    rng = np.random.default_rng(7)
    values = np.sort(rng.exponential(size=n))
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = hypothesis.bootstrap_ci_median(df, ["g"], "v", b=20_000).first()
    meds = np.sort(np.median(values[rng.integers(0, n, (20_000, n))], axis=1))
    for end, at in ((got["ci_low"], 500), (got["ci_high"], 19_500)):
        low, high = np.searchsorted(meds, [end - 1e-12]), np.searchsorted(meds, [end + 1e-12], "right")
        assert low[0] - 500 <= at <= high[0] + 500, (n, end, meds[at])


def test_middle_places_follow_their_distribution():
    u, w = (np.random.default_rng(i).random(200_000) for i in (1, 2))
    n, picks = 10, np.sort(np.random.default_rng(3).integers(1, 11, (200_000, 10)), axis=1)
    first, second = hypothesis.middle_places(n, u, w)
    for mine, theirs in ((first, picks[:, 4]), (second, picks[:, 5]), (second - first, picks[:, 5] - picks[:, 4])):
        assert np.abs(np.bincount(mine, minlength=11) - np.bincount(theirs, minlength=11)).max() < 1_500


def test_baseline_takes_the_last_of_repeated_keys(spark):
    answers = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    base = spark.createDataFrame([("a", 5.0, 0, 1), ("a", 6.0, 0, 2), ("a", 9.0, 1, 3), ("b", 7.0, 1, 4)], "k string, v double, sample_idx int, seq int")
    got = selection.greedy_baseline_join(answers, base, ["k"], "v", "seq").collect()
    assert sorted((r["k"], r["v"], r["base_value"]) for r in got) == [("a", 1.0, 6.0), ("a", 2.0, 6.0)]


def test_examples_of_small_pools(spark):
    """Labels of one, two, three and many pool rows: no row twice, never itself."""
    pool = [(label, i, str(i)) for label, ids in (("one", [1]), ("two", [2, 3]), ("three", [4, 5, 6]), ("many", range(10, 40))) for i in ids]
    df = spark.createDataFrame(pool, "label string, id int, payload string")
    label_of = {str(i): label for label, i, _ in pool}
    for r in sampling.raft_examples(df, df, "label", "id", "payload").collect():
        own = [e for e in r["examples"] if label_of[e] == r["label"]]
        assert len(set(r["examples"])) == len(r["examples"]) and str(r["id"]) not in own
        assert len(own) == {"one": 0, "two": 1, "three": 2, "many": 3}[r["label"]] and len(r["examples"]) == len(own) + 2
    alone = df.filter("label = 'one'")
    assert [r["examples"] for r in sampling.raft_examples(alone, alone, "label", "id", "payload").collect()] == [[]]


def test_nan_p_values_are_no_tests(spark):
    df = spark.createDataFrame([(1, 0.01), (2, float("nan")), (3, None), (4, 0.04)], "id int, p_value double")
    got = {r["id"]: r["q_value"] for r in hypothesis.bh_fdr(df).collect()}
    assert got == {1: pytest.approx(0.02), 2: None, 3: None, 4: pytest.approx(0.04)}


def test_draws_do_not_depend_on_partitions(spark, sf_dir):
    rows = tables.settings(spark, sf_dir).select("id", "descriptor")

    def split(n):
        got = sampling.stratified_split(rows.repartition(n), "descriptor", "id", floor=95)
        return {(r["id"], r["split"]) for r in got.collect()}

    one = split(1)
    assert one == split(9)
    assert {s for _, s in one} == {"train", "eval", "tail_eval"}
    swap = sampling.hash_permutation(rows, ["descriptor"], "id").collect()
    assert sorted(r["id"] for r in swap) == sorted(r["partner_id"] for r in swap)


def test_split_takes_the_rounded_share(spark):
    df = spark.createDataFrame([(f"l{n}", f"{n}-{i}") for n in (1, 2, 3, 12, 13, 40) for i in range(n)], "label string, id string")
    got = sampling.hash_cut(df, ["label"], "id", sampling.share_of(0.2), 42, "f").groupBy("label").agg(F.count_if("f").alias("k"))
    assert {r["label"]: r["k"] for r in got.collect()} == {f"l{n}": round(0.2 * n) for n in (1, 2, 3, 12, 13, 40)}


def test_raft_examples_never_show_the_row_itself(spark):
    rows = [(f"{'ab'[i % 2]}", i, str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "label string, id long, payload string")
    got = sampling.raft_examples(df, df, "label", "id", "payload").collect()
    assert len(got) == 60
    for r in got:
        ids = [int(x) for x in r["examples"]]
        assert len(set(ids)) == 5 and r["id"] not in ids
        assert sum("ab"[i % 2] == r["label"] for i in ids) == 3


def test_outlier_rejection_guards(spark):
    rows = [("few", 0.0), ("few", 100.0)] + [("flat", 1.0)] * 5 + [("out", float(x)) for x in [0, 0, 0, 0, 0, 0, 0, 0, 50]]
    df = spark.createDataFrame(rows, "label string, g double")
    kept = retrieval.reject_outliers_nsd(df, ["label"], ["g"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {"few": 2, "flat": 5, "out": 8}


def test_medians_of_clustered_clouds_leave_pairs_uncomputed(spark):
    rng = np.random.default_rng(21)
    rows = [(i, "many", (rng.normal(size=6) * 0.05 + 4 * (i % 5)).tolist()) for i in range(500)]
    rows += [(1000 + i, "few", rng.normal(size=6).tolist()) for i in range(9)] + [(2000, "lone", [0.0] * 6)]
    df = frame(spark, rows)
    got = clouds.median_to_cloud(df, df, ["label"], "id", "id", exclude_self=True, left_rows=64, right_rows=100, computed="computed").collect()
    by = {r["id"]: r for r in got}
    assert len(by) == len(got) == 509
    for label in ("many", "few"):
        ids = [i for i, name, _ in rows if name == label]
        x = np.array([v for _, name, v in rows if name == label])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).mean(axis=2))
        for k, i in enumerate(ids):
            assert by[i]["centrality"] == pytest.approx(np.median(np.delete(d[k], k)), rel=1e-12) and by[i]["n_pairs"] == len(ids) - 1
    share = sum(r["computed"] for r in got if r["label"] == "many") / (500 * 499)
    assert share < 0.7 and all(r["computed"] == 0 for r in got if r["label"] == "few")


def test_funnel_counts_add_up(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "x"), (5, "b")], "id int, label string")
    rules = [("empty", F.col("label") == ""), ("blocked", F.col("label") == "x"), ("never", F.lit(False))]
    clean, counts = cleaning.cleaning_funnel(df, rules, [F.col("label")], [F.col("id")])
    assert {r["rule"]: r["n_rows"] for r in counts.collect()} == {"empty": 1, "blocked": 1, "never": 0, "usable": 3, "kept": 2}
    assert sorted(r["id"] for r in clean.collect()) == [1, 5]


def test_components_match_numpy(spark, cloud):
    model = structure.pca_curves(frame(spark, cloud), ["label"], k=3)
    for r in model.collect():
        x = np.array([v for _, label, v in cloud if label == r["label"]])
        values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
        assert np.allclose(r["explained"], values[:3])
        assert np.allclose(r["mean"], x.mean(axis=0))
    scores = mixtures.project(frame(spark, cloud), model, ["label"]).filter("label = 'hot'").collect()
    s = np.array([r["scores"] for r in scores])
    assert np.allclose(s.mean(axis=0), 0, atol=1e-9)


MIXTURE_BIC = {}


@pytest.mark.parametrize("block_rows", [4096, 10])
def test_mixture_finds_two_groups(spark, block_rows):
    rng = np.random.default_rng(9)
    rows = [(i, "a", [float(x) for x in rng.normal(size=2) + (8 if i % 4 == 0 else 0)]) for i in range(200)]
    rows += [(1000 + i, "b", [float(x) for x in rng.normal(size=2)]) for i in range(150)]
    df = frame(spark, rows)
    bic, comps = mixtures.gmm_select_by_bic(df, ["label"], "id", "vec", ks=(1, 2), starts=2, max_iter=40, block_rows=block_rows)
    best = {r["label"]: r["k"] for r in bic.collect() if r["best"]}
    assert best == {"a": 2, "b": 1}
    # blocks of any size take the same steps from the same starts
    assert {r["label"]: round(r["bic"], 3) for r in bic.collect() if r["k"] == 2} == pytest.approx(MIXTURE_BIC.setdefault("k2", {r["label"]: round(r["bic"], 3) for r in bic.collect() if r["k"] == 2}), rel=1e-5)
    modes = mixtures.assign_modes(df, comps, ["label"], "vec")
    shares = {(r["label"], r["mode"]): r["share"] for r in structure.mode_shares(modes, ["label"]).collect()}
    assert shares["a", 0] == pytest.approx(0.75, abs=0.02)


def test_mixture_has_the_likelihood_it_reports(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a", (rng.normal(size=3) * [1, 2, 0.5] + 3 * (i % 3)).tolist()) for i in range(240)] + [(900, "lone", [1.0, 2.0, 3.0])]
    df = frame(spark, rows)
    bic, comps = mixtures.gmm_select_by_bic(df, ["label"], "id", "vec", starts=2, max_iter=7, tol=1e-4, block_rows=50)
    best = {r["label"]: r for r in bic.collect() if r["best"]}
    x = np.array([v for _, label, v in rows if label == "a"])
    parts = sorted((r for r in comps.collect() if r["label"] == "a"), key=lambda r: r["mode"])
    assert [r["share"] for r in parts] == sorted((r["share"] for r in parts), reverse=True)
    density = sum(
        r["share"] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - r["mean"], np.linalg.inv(c), x - r["mean"])) / np.sqrt(np.linalg.det(2 * np.pi * c))
        for r in parts
        for c in [np.array(r["cov"]).reshape(3, 3)]
    )
    assert np.log(density).sum() == pytest.approx(best["a"]["log_likelihood"], rel=1e-9)
    assert {(r["converged"], r["n_steps"] == 7) for r in bic.collect() if r["label"] == "a" and r["k"] > 1} <= {(True, False), (True, True), (False, True)}
    assert [r["k"] for r in bic.collect() if r["label"] == "lone"] == [1]  # a k above the number of rows is left out
    modes = mixtures.assign_modes(df, comps, ["label"], "vec", "own").filter("label = 'a'").collect()
    assert sum(r["log_density"] for r in modes) == pytest.approx(best["a"]["log_likelihood"], rel=1e-9)
    assert mixtures.assign_modes(df, comps.filter("false"), ["label"], "vec").count() == 0


def test_ridge_matches_a_direct_fit(spark):
    rng = np.random.default_rng(11)
    n = 120
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 0]
    y = np.stack([x[:, 0] * 2 + rng.normal(size=n), rng.normal(size=n)], axis=1)
    rows = [("a", i, x[i].tolist(), y[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "label string, id long, x array<double>, y array<double>")
    got = structure.ridge_cv_r2(df, ["label"], "id", "x", "y").first()
    from cloudgauge.functions.hashing import hash_index, hash_key

    fold_of = {r["id"]: r["f"] for r in df.select("id", hash_index(hash_key("42:fold", "id"), F.lit(5)).alias("f")).collect()}
    folds = np.array([fold_of[i] for i in range(n)])
    pred = np.zeros_like(y)
    for f in range(5):
        tr, te = folds != f, folds == f
        m, s = x[tr].mean(0), x[tr].std(0)
        keep = s > 1e-9
        a, b = ((x[tr] - m) / np.where(keep, s, 1))[:, keep], y[tr] - y[tr].mean(0)
        w = np.linalg.solve(a.T @ a + 10 * np.eye(keep.sum()), a.T @ b)
        pred[te] = ((x[te] - m) / np.where(keep, s, 1))[:, keep] @ w + y[tr].mean(0)
    sst = ((y - y.mean(0)) ** 2).sum(0)
    r2 = np.maximum(-1, 1 - ((y - pred) ** 2).sum(0) / sst)
    assert np.allclose(got["r2_per_target"], r2)
    assert got["r2"] == pytest.approx((r2 * sst).sum() / sst.sum())
    null = structure.permutation_null(df, ["label"], "id", "x", "y").first()
    assert null["r2"] < 0.1 < got["r2"]


def test_block_shape_is_bounded(spark, cloud):
    """No task sees more rows of a cloud than the block sizes allow, give or take hashing."""
    import pyarrow as pa

    df = frame(spark, cloud).select("label", F.col("id").alias("lid"), "vec")
    right = df.withColumnRenamed("lid", "rid")

    def sizes(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table({"l": [a.num_rows], "r": [b.num_rows]})

    got = blocks.block_product(df, right, ["label"], "lid", "rid", sizes, "l long, r long", 20, 20).collect()
    assert max(max(r["l"], r["r"]) for r in got) <= 40
    assert sum(r["l"] * r["r"] for r in got) == 170**2 + 60**2


def test_regressor_recovers_a_linear_map(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([[1.0, 0.0], [2.0, -1.0], [0.0, 0.5]]) + [3.0, -2.0]
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    got = structure.embedding_regressor(df, df.select("id", "x"), "id", "x", "y", alpha=1e-6).collect()
    assert len(got) == 400
    for r in got:
        assert np.allclose(r["prediction"], y[r["id"]], atol=1e-4)
        assert r["seed_spread"] < 1e-4


def test_verbatim_probe_with_one_filter_and_several(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgh é𝔘"))
    make = lambda n: "".join(rng.choice(letters, n))
    passages = [make(int(n)) for n in rng.integers(5, 90, 400)] + ["   ", ""]
    texts = [(i, make(300) + (passages[i % 400][:60] if i % 3 == 0 else "") + make(20)) for i in range(120)] + [(500, None), (501, "I cannot recall"), (502, passages[7])]
    responses = spark.createDataFrame(texts, "id long, text string")
    side = spark.createDataFrame([(p,) for p in passages], "p string")
    heads = [p[:60] for p in passages if p.strip()]
    want = {i: any(h in (t or "") for h in heads) for i, t in texts}
    for most in (answers.FILTER_BYTES, 512):
        got = answers.probe_verbatim(responses, "id", "text", side, "p", filter_bytes=most).collect()
        assert {r["id"]: r["verbatim"] == "verbatim_recall" for r in got} == want and len(got) == len(texts)
    assert answers.filter_shape(402, 512)[1] > 1 and answers.filter_shape(10_000_000) == (28, 1)


def test_few_other_windows_pass_the_filter():
    rng = np.random.default_rng(5)
    log_bits, _ = answers.filter_shape(1_000_000)
    inside, other = rng.integers(0, 1 << 63, (2, 1_000_000), dtype=np.uint64) * np.uint64(2)
    bits = answers.filter_of(iter([inside]), log_bits)
    assert answers.passes_filter(inside, bits, log_bits).all()
    assert answers.passes_filter(other, bits, log_bits).mean() < 0.01


def test_hash_of_a_window_does_not_depend_on_its_place():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdé𝔘 "), 5000))
    for size in (1, 5, 6, 7, 60):
        hashes = answers.window_hashes(text, [size])
        assert all(hashes[at] == answers.window_hashes(text[at : at + size], [size])[0] for at in (0, 1, 77, 4000, 5000 - size))
        assert len(set(hashes.tolist())) == len({text[i : i + size] for i in range(5000 - size + 1)})


def test_regressor_on_an_empty_predict_table(spark):
    df = spark.createDataFrame([(i, [float(i)], [2.0 * i]) for i in range(9)], "id long, x array<double>, y array<double>")
    got = structure.embedding_regressor(df, df.select("id", "x").filter("false"), "id", "x", "y")
    assert got.columns == ["id", "prediction", "seed_spread"] and got.count() == 0


def _random_settings(spark, n=300, seed=8):
    rng = np.random.default_rng(seed)
    value = {"gain": lambda: rng.uniform(-12, 12, n), "freq": lambda: rng.uniform(30, 16000, n), "q": lambda: rng.uniform(0.1, 10, n)}
    pdf = pd.DataFrame({p: value[p.rsplit("_", 1)[1]]() for p in PARAM_NAMES})
    pdf.insert(0, "label", np.where(rng.random(n) < 0.5, "a", "b"))
    pdf.insert(0, "id", np.arange(n))
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("groups", [1, 2048])
def test_folded_curves_are_the_folded_long_form(spark, groups):
    df = _random_settings(spark)
    df = df.withColumn("band1_gain", F.when(F.col("id") % 7 > 0, F.col("band1_gain")))  # no setting, no value
    long = render.render_curves(df, ["label"]).groupBy("label", "bin")
    want = long.agg(F.count("*").alias("n"), F.count("db").alias("n_db"), F.avg("db").alias("mean"), F.stddev_pop("db").alias("sd"), F.min("db").alias("min_db"), F.max("db").alias("max_db"))
    got = render.folded_curves(df, ["label"], groups=groups).toPandas().sort_values(["label", "bin"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want.toPandas().sort_values(["label", "bin"], ignore_index=True), check_dtype=False, rtol=1e-9)


def test_packed_region_error_is_the_long_one(spark):
    df = _random_settings(spark)
    long = render.render_curves(df, ["id", "label"])
    centre = dispersion.mean_curve_envelope(long.filter("id % 3 > 0"), ["label"])
    want = dispersion.region_signed_error(long.filter("id % 3 = 0"), centre, dispersion.bin_regions(spark), "label", ["id"])
    answers = df.filter("id % 3 = 0").select("id", "label", render.region_vector(dispersion.REGIONS_HZ).alias("levels"))
    got = dispersion.packed_region_signed_error(answers, centre, "label", ["id"])
    key = lambda d: d.toPandas()[["label", "region", "n_units", "signed_error"]].sort_values(["label", "region"], ignore_index=True)
    pd.testing.assert_frame_equal(key(got), key(want), rtol=1e-9)


def test_region_level_of_folded_curves(spark):
    df = _random_settings(spark)
    grid = render.frequency_grid(spark)
    want = {r[0]: r[1:] for r in dispersion.region_level(render.render_curves(df, ["label"]), ["label"], grid).collect()}
    got = dispersion.region_level(render.folded_curves(df, ["label"]), ["label"], grid, value="mean", weight="n_db").collect()
    assert {r[0] for r in got} == set(want)
    for r in got:
        assert r[1:] == pytest.approx(want[r[0]], rel=1e-9)


def test_settings_checks_find_what_is_broken(spark, monkeypatch):
    df = _random_settings(spark, 50)
    fine = df.withColumn("band1_freq", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("band1_freq")))
    rows = fine.select("id", render.settings_checks().alias("c")).collect()
    assert all(all(r["c"]) == (r["id"] != 3) for r in rows)
    assert not any(next(r["c"] for r in rows if r["id"] == 3))
    # a shelf in the place of the peak fails that check alone, and only where it has a gain
    bands = [replace(b, shape="low_shelf") if b.gain == "band2_gain" else b for b in BANDS]
    got = df.select("band2_gain", render.settings_checks(bands).alias("c")).collect()
    assert all(r["c"]["peak"] == (abs(r["band2_gain"]) < 0.1) for r in got)
    assert all(r["c"][name] for r in got for name in render.CHECKS if name != "peak")


def test_narrowed_brackets_keep_the_median(spark, cloud, monkeypatch):
    monkeypatch.setattr(clouds, "_INSIDE_ROWS", 0.05)  # several rounds, below the distance of copies too
    want = brute(cloud)
    got = clouds.leave_one_out_centrality(frame(spark, cloud), ["label"], "id", left_rows=16, right_rows=50).collect()
    assert len(got) == len(cloud)
    for r in got:
        assert r["n_pairs"] == len(want[r["id"]])
        assert r["centrality"] == pytest.approx(np.median(want[r["id"]]), rel=1e-12, abs=1e-12)


def test_narrowing_leaves_few_distances_in_a_bracket(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(x)], "lid long, label string, vec array<double>")
    wide = df.withColumn("a", F.lit(0.5)).withColumn("b", F.lit(3.0))
    schema = "label string, lid long"
    narrow = clouds._narrowed(wide, df.withColumnRenamed("lid", "rid"), ["label"], schema, True, 64, 32).toPandas().set_index("lid")
    d = blocks.rms_distances(x, x)
    for i in range(0, 1500, 50):
        others = np.delete(d[i], i)
        a, b = narrow.loc[i, ["a", "b"]]
        assert a <= np.median(others) <= b
        assert ((others >= a) & (others <= b)).sum() < 150


def test_large_clouds_are_not_cut_into_small_blocks(spark):
    df = spark.range(3000).select(F.lit("x").alias("label"), F.array(F.col("id").cast("double")).alias("vec"), "id")
    left, right = df.withColumnRenamed("id", "lid"), df.withColumnRenamed("id", "rid")

    def here(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table({"label": a["label"].slice(0, 1), "n": pa.array([a.num_rows * b.num_rows])})

    met = blocks.block_product(left, right, ["label"], "lid", "rid", here, "label string, n long", 64, 32)
    tasks, pairs = met.agg(F.count("*"), F.sum("n")).first()
    assert pairs == 3000 * 3000 and 1 < tasks <= 64


def test_windows_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(21)
    texts = ["".join(rng.choice(list("ab\u00e9\U0001f600"), size)) for size in (0, 1, 7, 300, 3, 0, 4000, 12, 2)]
    lengths, (log_bits, _) = [1, 3, 8], answers.filter_shape(40)
    heads = [h for t in texts[3:5] for h in answers.window_hashes(t, [3])[::9]]
    bits = answers.filter_of(iter([np.array(heads, np.uint64)]), log_bits)
    want = []
    for t in texts:
        value = answers.window_hashes(t, lengths)
        want.append(np.unique(value[answers.passes_filter(value, bits, log_bits)]).view(np.int64).tolist())
    assert any(want)
    for run in (1, 10, 1 << 15):
        monkeypatch.setattr(answers, "_RUN_LETTERS", run)
        got = answers.passing_windows(texts, lengths, bits, log_bits)
        assert [g.tolist() for g in got] == [sorted(w, key=lambda x: x % 2**64) for w in want]


def test_render_table_job_holds_a_few_files_of_curves(spark, sf_dir, monkeypatch):
    """Every record is rendered, written and read back, and what is folded is let go."""
    kept = []
    scratch_path = rendering.scratch_path
    monkeypatch.setattr(rendering, "scratch_path", lambda *a: kept.append(scratch_path(*a)) or kept[-1])
    written, job = [], render.render_table_job

    def counted(session, src, dst, **options):
        out = job(session, src, dst, **options)
        written.append(out.count())
        assert len([d for d in os.listdir(kept[-1]) if d.startswith("out")]) == 1
        return out

    monkeypatch.setattr(render, "render_table_job", counted)
    whole = sorted(rendering.render_table_job(spark, sf_dir).collect())
    settings = tables.settings(spark, sf_dir).count()
    assert sum(written) == settings
    written.clear()
    monkeypatch.setattr(rendering, "RECORDS_A_FILE", 200)
    monkeypatch.setattr(rendering, "MOST_FILES", 4)
    assert sorted(rendering.render_table_job(spark, sf_dir).collect()) == whole
    assert sum(written) == settings and len(written) > 3 and max(written) <= 800
    assert all(sorted(os.listdir(p)) == ["folds"] for p in kept)
