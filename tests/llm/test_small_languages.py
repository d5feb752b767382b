"""Documents of languages with a small share of all words are judged like others."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from cloudgauge.llm import divergence


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_language_has_a_verdict(spark, monkeypatch, broadcast):
    if not broadcast:
        real = divergence.settle
        monkeypatch.setattr(divergence, "settle", lambda side: (real(side)[0], False))
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}rd" for i in range(80)]
    plain = " ".join(w.replace("w", "o") for w in vocabulary)
    odd = " ".join(f"{i}{i + 7}{i * 3}" for i in range(80))
    rows = [(i, plain, "hot") for i in range(9000)]
    for lang in range(3):
        rows += [(10_000 + 100 * lang + i, odd if i == 0 else plain, f"small{lang}") for i in range(30)]
    rows += [(20_000, plain, None), (20_001, None, "empty")]
    docs = spark.createDataFrame(rows, "cell_id long, response_content string, profile string")
    got = {r.cell_id: r for r in divergence.divergence_rules(docs).collect()}
    assert len(got) == len(rows) and all(r.class_distance is not None for r in got.values())
    dropped = {i for i, r in got.items() if not r.kept}
    assert dropped == {10_000, 10_100, 10_200, 20_001}


def shares(counts):
    total = sum(counts) + len(counts)
    return [(c + 1) / total for c in counts]


def distance(p, q):
    return math.sqrt(max(0.0, sum(a * math.log2(2 * a / (a + b)) + b * math.log2(2 * b / (a + b)) for a, b in zip(p, q, strict=True)) / 2))


def classes_of(text):
    out = []
    for pattern in divergence.CLASSES.values():
        left = regex.sub(pattern, "", text)
        out.append(len(text) - len(left))
        text = left
    return [*out, len(text)]


def test_distances_equal_the_plain_version(spark, sf_dir):
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(-1, "### *** 12 34 " * 30, "alone"), (-2, "", "nothing")]
    docs = spark.createDataFrame(rows, "cell_id long, response_content string, profile string")
    got = {r.cell_id: r for r in divergence.divergence_rules(docs).collect()}
    words = {i: [w for w in regex.split(r"[\x20\x09-\x0D]+", t) if w] for i, t, _ in rows}
    classes = {i: classes_of(t) for i, t, _ in rows}
    every = [sum(c) for c in zip(*classes.values(), strict=True)]
    for lang in {r[2] for r in rows}:
        own = [i for i, _, name in rows if name == lang]
        count = Counter(w for i in own for w in words[i] if len(w) <= 5)
        common = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:16]]
        sums, mass = [sum(classes[i][k] for i in own) for k in range(len(every))], sum(len(words[i]) for i in own)
        for i in own:
            others = [a - b for a, b in zip(every, classes[i], strict=True)]
            ref = [a - b + 10_000 * o / sum(others) for a, b, o in zip(sums, classes[i], others, strict=True)]
            apart = distance(shares(classes[i]), shares(ref))
            assert math.isclose(got[i].class_distance, apart, abs_tol=1e-9)
            mine = [words[i].count(w) for w in common]
            rest = [count[w] - n for w, n in zip(common, mine, strict=True)]
            expected = sum(rest) * len(words[i]) / (mass - len(words[i])) if mass > len(words[i]) else 0
            words_apart = distance(shares(mine), shares(rest)) if expected >= 20 else None
            assert (words_apart is None) == (got[i].word_distance is None)
            assert words_apart is None or math.isclose(got[i].word_distance, words_apart, abs_tol=1e-9)
            assert got[i].kept == (not got[i].base_failed and apart <= 0.25 and (words_apart or 0) <= 0.5)
    assert not got[-1].kept and got[-1].class_distance > 0.25  # alone, and unlike all others


def test_the_only_text_has_no_distance(spark):
    docs = spark.createDataFrame([(1, "some words here", "x")], "cell_id long, response_content string, profile string")
    assert divergence.divergence_rules(docs).first()["class_distance"] is None
