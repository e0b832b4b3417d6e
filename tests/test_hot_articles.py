"""Whole stage 1 through the paths that only large or crowded groups take."""

import random

import pytest

from themeloom.operators import skew
from themeloom.operators.terms import long_vectors
from themeloom.plans.stage1 import records_of, topic_vectors
from themeloom.settings import Settings

TOPIC = (
    "id int, topic_no int, name string, description string, key_phrases array<string>, "
    "importance double, supporting_quotes array<string>"
)


@pytest.fixture(scope="module")
def topics(spark):
    """One article holds most topics, a third of them copies of one text."""
    rng = random.Random(11)
    words = "river stone bridge garden engine market winter signal".split()
    rows = []
    for article, n in ((1, 40), (2, 4), (3, 1)):
        for i in range(n):
            text = "river stone" if i % 3 == 0 else " ".join(rng.choices(words, k=3))
            rows.append((article, i, f"t{i}", text, [text[:5]], float(i % 9), [f"q{i % 5}"]))
    return spark.createDataFrame(rows, TOPIC).cache()


def weights(vectors):
    rows = long_vectors(vectors, ["id", "topic_no"]).collect()
    return {(r["id"], r["topic_no"], r["term"]): round(r["w"], 9) for r in rows}


def test_salted_vectors_equal_plain_ones(spark, topics, monkeypatch):
    plain = weights(topic_vectors(topics, "id", Settings()))
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    assert weights(topic_vectors(topics, "id", Settings())) == plain


def test_parts_of_records_add_up_to_the_whole(spark, topics):
    articles = spark.createDataFrame(
        [(1, None), (2, None), (3, None), (4, None)], "id int, error string"
    )

    def read(block_rows):
        rows = records_of(articles, topics, "id", Settings(similarity_threshold=0.3, block_rows=block_rows)).collect()
        out = {}
        for r in sorted(rows, key=lambda r: (r["id"], r["part_no"])):
            counts = (r["topics_count"], r["clustered_count"], r["reduction_ratio"])
            seen = out.setdefault(r["id"], (counts, [], {}))
            assert seen[0] == counts
            seen[1].extend(t["name"] for t in r["original_topics"])
            for t in r["clustered_topics"]:
                seen[2].setdefault((t["name"], t["importance"]), []).extend(
                    t["merged_from"] or [t["name"]]
                )
        return out

    whole = read(1000)
    assert whole[1][0][0] == 40 and whole[1][0][1] < 40 and whole[4][0] == (0, 0, 0.0)
    assert read(7) == whole
