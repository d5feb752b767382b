"""Repeated passages of over fifty words in few bytes."""

import random

import corpus_pipeline as pipeline


def test_fifty_one_short_words_are_a_passage(spark, sf_dir):
    rng = random.Random(1)

    def words(n, low, high):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(low, high))) for _ in range(n))

    passages = {51: words(51, 2, 5), 50: words(50, 2, 5), 53: " ".join("abcdefghij"[i % 7] for i in range(53))}
    assert all(len(p) < pipeline.MIN_REPEAT_BYTES for p in passages.values())
    texts, want = [], []
    for n, passage in passages.items():
        for _ in range(2):
            a, b = words(30, 7, 9), words(30, 7, 9)
            texts.append(f"{a}\n{passage}\n{b}")
            want.append(texts[-1] if n == 50 else f"{a}\n\n{b}")
    texts += [passages[51], words(20, 3, 5)]
    want += ["", texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    assert got == dict(enumerate(want))
