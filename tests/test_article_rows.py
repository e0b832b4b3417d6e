"""Stage 1 inside the article's row: one shuffle, and the same as by (article, term)."""

import random

import pytest

from themeloom.operators import skew
from themeloom.operators.responder import segment_topics
from themeloom.operators.terms import tfidf_vectors, with_terms

WORDS = "river stone bridge garden engine market winter signal copper lantern".split()


@pytest.fixture(scope="module")
def segments(spark):
    rng = random.Random(3)
    rows = [
        (a, i, " ".join(rng.choices(WORDS, k=rng.randint(0, 7))) + ". x")
        for a in (1, 2, 3, 4, None)
        for i in range(15 if a == 1 else 4)
    ]
    # a repeated number, no number, no text, no article
    rows += [(2, 1, "river river bridge. a"), (2, 1, "river stone engine. b"), (3, None, "stone stone signal river")]
    rows += [(4, 2, None), (6, 0, "a b"), (6, 1, None), (None, None, "river stone")]
    return spark.createDataFrame(rows, "k int, no int, t string").cache()


def shuffles(df) -> int:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning")


def vectors(segments):
    return tfidf_vectors(with_terms(segments, "t"), ["k", "no"], 6, ["k"])


def topics(segments):
    return segment_topics(segments, "k", "no", "t", 5)


def test_one_shuffle_for_an_article(segments):
    assert shuffles(topics(segments)) == 1
    assert shuffles(vectors(segments)) == 1


def test_large_articles_give_the_same(segments, monkeypatch):
    def read():
        found = sorted(map(repr, topics(segments).collect()))
        weights = [
            (r["k"], r["no"], [(e["slot"], e["term"], round(e["w"], 9)) for e in r["vector"]])
            for r in vectors(segments).collect()
        ]
        return found, sorted(map(repr, weights))

    in_rows = read()
    assert len(in_rows[0]) == 18 and len(in_rows[1]) == 35
    monkeypatch.setattr(skew, "GROUP_ROWS", 4)
    assert read() == in_rows
    monkeypatch.setattr(skew, "GROUP_ROWS", 0)
    assert read() == in_rows
