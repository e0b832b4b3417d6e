import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators.grouping import has_later_blocks, similar_pairs, topic_leaders
from themeloom.operators.merging import article_records, merge_topics
from themeloom.operators.rollups import stage1_summary
from themeloom.operators import skew
from themeloom.operators.skew import salted_join

VECTOR = "array<struct<slot: int, term: string, w: double>>"


def vectors(spark, rows):
    packed = [
        (a, n, [(s + 1, str(s), float(x)) for s, x in enumerate(v) if x]) for a, n, v in rows
    ]
    return spark.createDataFrame(packed, f"article string, topic_no int, vector {VECTOR}")


def random_topics(seed, sizes):
    """Non-negative unit vectors, many of them copies, a few empty."""
    rng = random.Random(seed)
    rows = []
    for article, n in sizes.items():
        pool = [np.array([rng.random() ** 3 for _ in range(6)]) for _ in range(max(2, n // 3))]
        for i in range(n):
            v = pool[rng.randrange(len(pool))]
            v = np.zeros(6) if rng.random() < 0.05 else v / np.linalg.norm(v)
            rows.append((article, i, v))
    return rows


def greedy(rows, threshold):
    by = {}
    for a, n, v in rows:
        by.setdefault(a, []).append((n, v))
    out = {}
    for a, topics in by.items():
        topics.sort(key=lambda t: t[0])
        taken = set()
        for i, (n, v) in enumerate(topics):
            if n in taken:
                continue
            taken.add(n)
            out[a, n] = n
            if len(topics) <= 2:
                continue
            for m, u in topics[i + 1 :]:
                if m not in taken and round(float(v @ u), 9) > threshold:
                    taken.add(m)
                    out[a, m] = n
    return out


def found(df):
    return {(r["article"], r["topic_no"]): r["leader_no"] for r in df.collect()}


def unit(sims):
    """Vectors with the given Gram matrix."""
    return np.linalg.cholesky(np.array(sims) + 1e-12 * np.eye(len(sims)))


@pytest.mark.parametrize(
    "gram,expected",
    [
        ([[1, 0.8, 0.1], [0.8, 1, 0.6], [0.1, 0.6, 1]], [0, 0, 2]),
        ([[1, 0.4, 0.9], [0.4, 1, 0.75], [0.9, 0.75, 1]], [0, 1, 0]),
        ([[1, 0.7, 0], [0.7, 1, 0], [0, 0, 1]], [0, 1, 2]),
        ([[1, 0.99], [0.99, 1]], [0, 1]),
    ],
)
def test_leader_rule(spark, gram, expected):
    rows = [("a", i, v) for i, v in enumerate(unit(gram))]
    df = topic_leaders(vectors(spark, rows), ["article"], "topic_no", 0.7, False)
    assert [found(df)["a", i] for i in range(len(gram))] == expected


def test_topics_without_terms_stay_alone(spark):
    rows = [("a", i, np.zeros(3)) for i in range(4)]
    df = topic_leaders(vectors(spark, rows), ["article"], "topic_no", 0.7, False)
    assert found(df) == {("a", i): i for i in range(4)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_the_one_pass_rule(spark, seed):
    rows = random_topics(seed, {"hot": 90, "two": 2, "one": 1, "small": 9, "edge": 5})
    df = vectors(spark, rows)
    expected = greedy(rows, 0.9)
    assert has_later_blocks(df, "topic_no", 5)
    rounds = topic_leaders(df, ["article"], "topic_no", 0.9, True, block_rows=5)
    assert found(rounds) == expected
    assert found(topic_leaders(df, ["article"], "topic_no", 0.9, False)) == expected


@pytest.mark.parametrize("later,block_rows", [(False, 1000), (True, 7)])
def test_pairs_equal_brute_force(spark, later, block_rows):
    rows = random_topics(3, {"hot": 60, "small": 8})
    points = {}
    for a, n, v in rows:
        if v.any():
            points.setdefault((a, tuple(v)), []).append(n)
    expected = set()
    for (a, v), ns in points.items():
        for (b, u), ms in points.items():
            sim = round(float(np.dot(v, u)), 9)
            if a == b and min(ns) < min(ms) and sim > 0.9:
                expected.add((a, min(ns), min(ms), round(sim, 6), len(ns), len(ms)))
    df = similar_pairs(vectors(spark, rows), ["article"], "topic_no", 0.9, later, block_rows)
    got = {
        (r["article"], r["i"], r["j"], round(r["sim"], 6), r["copies_i"], r["copies_j"])
        for r in df.collect()
    }
    assert got == expected and expected


TOPIC = (
    "article string, topic_no int, name string, description string, key_phrases array<string>, "
    "importance double, supporting_quotes array<string>"
)


def test_merging(spark):
    topics = spark.createDataFrame(
        [
            ("a", 0, "A", "da", ["p", "q"], 7.0, ["z", "y"]),
            ("a", 1, "B", "db", ["q"], 8.0, ["x"]),
            ("a", 2, "C", "dc", None, None, ["w", "x"]),
            ("a", 3, "D", "dd", ["r", "r"], None, ["k"] * 4),
        ],
        TOPIC,
    )
    leaders = spark.createDataFrame(
        [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 3, 3)],
        "article string, topic_no int, leader_no int",
    )
    got = {
        r["leader_no"]: r
        for r in merge_topics(topics, leaders, ["article"], "topic_no", False).collect()
    }
    merged, alone = got[0], got[3]
    assert merged["name"] == "A / B" and merged["description"] == "da | db | dc"
    assert merged["key_phrases"] == ["p", "q"] and merged["importance"] == 7.0
    assert merged["supporting_quotes"] == ["w", "x", "y"]
    assert merged["merged_from"] == ["A", "B", "C"] and merged["cluster_size"] == 3
    assert alone["importance"] is None and alone["merged_from"] is None
    assert alone["key_phrases"] == ["r", "r"] and alone["supporting_quotes"] == ["k"] * 4


@pytest.mark.parametrize("pair,mean", [((7.0, 8.0), 8.0), ((8.0, 9.0), 8.0), ((6.0, None), 6.0)])
def test_importance_is_rounded_half_even(spark, pair, mean):
    topics = spark.createDataFrame(
        [("a", i, "n", "d", [], x, []) for i, x in enumerate(pair)], TOPIC
    )
    leaders = spark.createDataFrame(
        [("a", 0, 0), ("a", 1, 0)], "article string, topic_no int, leader_no int"
    )
    got = merge_topics(topics, leaders, ["article"], "topic_no", False).first()
    assert got["importance"] == mean


def test_parts_hold_the_whole_group(spark):
    n = 23
    topics = spark.createDataFrame(
        [
            ("hot", i, f"n{i:02}", f"d{i:02}", [f"p{i % 4}", f"p{i}"], float(i % 5), [f"q{i:02}"])
            for i in range(n)
        ]
        + [("cold", 0, "x", "y", ["z"], 1.0, [])],
        TOPIC,
    )
    group = lambda i: 1 if i in (1, 20, 22) else 0
    leaders = spark.createDataFrame(
        [("hot", i, group(i)) for i in range(n)] + [("cold", 0, 0)],
        "article string, topic_no int, leader_no int",
    )
    whole = merge_topics(topics, leaders, ["article"], "topic_no", False)
    parts = merge_topics(topics, leaders, ["article"], "topic_no", True, block_rows=5)
    by_group = {(r["article"], r["leader_no"]): r for r in whole.collect()}
    split = {}
    for r in parts.orderBy("part_no").collect():
        split.setdefault((r["article"], r["leader_no"]), []).append(r)
    assert split.keys() == by_group.keys()
    for key, one in by_group.items():
        rows = split[key]
        assert {r["parts"] for r in rows} == {len(rows)}
        for field in ("name", "importance", "supporting_quotes", "cluster_size"):
            assert all(r[field] == one[field] for r in rows), field
        assert " | ".join(r["description"] for r in rows) == one["description"]
        assert sorted(p for r in rows for p in r["key_phrases"]) == one["key_phrases"]
        names = [m for r in rows for m in r["merged_from"] or []]
        assert (names or None) == one["merged_from"]
    articles = spark.createDataFrame(
        [("hot", 1, None), ("cold", 1, None), ("none", 0, None), ("bad", 0, "broken")],
        "article string, word_count long, error string",
    )
    for later, merged in ((False, whole), (True, parts)):
        records = article_records(articles, topics, merged, "article", "topic_no", later, 5)
        counts = {
            r["article"]: (r["topics_count"], r["clustered_count"])
            for r in records.collect()
        }
        assert counts == {"hot": (23, 2), "cold": (1, 1), "none": (0, 0), "bad": (None, None)}
        total = stage1_summary(records).first()
        assert (total["total_articles"], total["failed_articles"]) == (4, 1)
        assert (total["total_original_topics"], total["total_clustered_topics"]) == (24, 3)
        topics_kept = records.select(F.explode("original_topics")).count()
        assert topics_kept == 24


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_salted_join_equals_plain_join(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(900)] + [(1000, None)],
        "i int, k string",
    )
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        plain = rows.join(table, "k", how).select("i", "k", "n")
        salted = salted_join(rows, table, ["k"], "n", ["i"], how).select("i", "k", "n")
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))
