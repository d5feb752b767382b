"""Near duplicates of the pipeline against exact similarities."""

import random

import pytest

import corpus_pipeline as pipeline
from cloudgauge.llm import similar


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def kept(spark, sf_dir, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()}


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_short_texts_are_compared(spark, sf_dir):
    rng, texts = random.Random(1), []
    for n in (9, 10, 13, 15, 16, 19, 30, 75, 79, 93, 96):
        base = words(rng, n)
        texts += [" ".join(base), " ".join([*base, "more"])]
    pairs = range(0, len(texts), 2)
    assert kept(spark, sf_dir, texts) == {*pairs, *(i + 1 for i in pairs if likeness(texts[i], texts[i + 1]) < 0.8)}


def test_exactly_texts_that_share_four_fifths_go(spark, sf_dir):
    rng, texts = random.Random(2), []
    for i in range(400):
        base = words(rng, 200)
        # a tail of other words: 0.6 to 0.95
        tail = 5 + i % 46
        texts += [" ".join(base), " ".join([*base[:-tail], *words(rng, tail)])]
    near = [i for i in range(0, len(texts), 2) if likeness(texts[i], texts[i + 1]) >= 0.8]
    assert 100 < len(near) < 300
    gone = set(range(len(texts))) - kept(spark, sf_dir, texts)
    assert gone <= {i + 1 for i in near}  # none under four fifths
    assert len(gone) >= 0.995 * len(near)


@pytest.mark.parametrize(("block", "texts_block"), [(8192, 512), (6, 6)])
def test_groups_in_blocks(spark, block, texts_block):
    rng = random.Random(3)
    base, texts = words(rng, 60), []
    for _ in range(40):  # one group, most pairs of which are alike, and all of which meet
        texts.append(" ".join([*base, *words(rng, rng.randrange(8))]))
    texts += [" ".join([*base[:20], *words(rng, 40)]) for _ in range(20)] + ["", None, texts[0], "a  A\tb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "cell_id long, response_content string")
    got = {r.cell_id: r.component_id for r in similar.similar_groups(docs, 5, None, block, texts_block).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if likeness(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got == dict(enumerate(root))


def test_fingerprints_alone_bring_near_copies_together(spark, monkeypatch):
    rng = random.Random(12)
    texts = [words(rng, 3000) for _ in range(8)]
    changed = [[*w[:1500], "other", *w[1501:]] for w in texts]
    rows = [(i, " ".join(w)) for i, w in enumerate([*texts, *changed])]
    whole, calls = similar.linked_in_cells, []

    def without_keys(keyed, *rest):
        calls.append(0)
        links = whole(keyed, *rest)
        return links.limit(0) if len(calls) == 1 else links  # the first are the keys' candidates

    monkeypatch.setattr(similar, "linked_in_cells", without_keys)
    got = similar.similar_groups(spark.createDataFrame(rows, "cell_id long, response_content string")).collect()
    assert {r["cell_id"]: r["component_id"] for r in got} == {i: i % 8 for i in range(16)}
