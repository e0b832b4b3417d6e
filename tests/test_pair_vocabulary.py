"""Bigrams that cannot reach the vocabulary are not counted; the vocabulary is the same."""

import random

import pytest

from themeloom.operators import terms as V


@pytest.mark.parametrize("size", [1, 5, 12, 5000])
@pytest.mark.parametrize("most", [10_000, 2])
def test_pair_vocabulary_is_exact(spark, monkeypatch, size, most):
    monkeypatch.setattr(V, "PAIR_WORDS", most)
    rng = random.Random(size)
    words = ["ab", "cd", "ef", "gh"] + [f"w{i}" for i in range(30)]
    rows = [(i, rng.choices(words, weights=[9, 9, 9, 9, *[1] * 30], k=rng.randrange(0, 12))) for i in range(60)]
    rows += [(100, ["ab", "cd"] * 20), (101, None), (102, [])]
    texts = spark.createDataFrame(rows, "doc_id int, terms array<string>")
    plain = V.fit_corpus(V.with_pairs(texts), size)
    assert V.fit_corpus(texts, size, pairs=True) == plain
    if most > 2:
        counted = V._vocabulary_with_pairs(texts, size)
        assert [r["term"] for r in counted.orderBy("slot").collect()] == plain.terms


def test_rare_pairs_are_not_counted(spark, monkeypatch):
    seen = []
    whole = V.term_statistics
    monkeypatch.setattr(V, "term_statistics", lambda texts, *a: seen.append(whole(texts, *a)) or seen[-1])
    rows = [(i, ["ab", "cd", f"w{i}", f"x{i}"]) for i in range(50)]
    V.fit_corpus(spark.createDataFrame(rows, "doc_id int, terms array<string>"), 2, pairs=True)
    assert [s.count() for s in seen] == [102, 1]
