"""The prefix-filtered similarity join against brute force, large articles included."""

import random

import numpy as np
import pytest

from themeloom.operators import grouping as G

VECTOR = "array<struct<slot: int, term: string, w: double>>"


def sparse_topics(seed, sizes, width=400, terms=8):
    """Unit vectors over a wide vocabulary, with near copies and exact copies."""
    rng = random.Random(seed)
    rows = []
    for article, n in sizes.items():
        base = []
        for i in range(n):
            if base and rng.random() < 0.3:
                slots, w = dict(rng.choice(base)), None
                if rng.random() < 0.5:  # a near copy: one weight moved
                    k = rng.choice(list(slots))
                    slots[k] *= 1.3
            else:
                slots = {rng.randrange(width): rng.random() + 0.1 for _ in range(terms)}
                base.append(slots)
            norm = sum(x * x for x in slots.values()) ** 0.5
            rows.append((article, i, [(s, str(s), x / norm) for s, x in sorted(slots.items())]))
    return rows


def brute(rows, threshold):
    points = {}
    for a, n, v in rows:
        if v:
            points.setdefault((a, tuple((s, w) for s, _, w in v)), []).append(n)
    by = {}
    for (a, v), ns in points.items():
        by.setdefault(a, []).append((min(ns), len(ns), dict(v)))
    out = set()
    for a, members in by.items():
        for i, ci, x in members:
            for j, cj, y in members:
                if i < j:
                    sim = round(sum(w * y.get(s, 0.0) for s, w in x.items()), 9)
                    if sim > threshold:
                        out.add((a, i, j, round(sim, 6), ci, cj))
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.3])
def test_prefix_pairs_equal_brute_force(spark, threshold):
    rows = sparse_topics(4, {"big": 700, "small": 9, None: 12}) + [("small", 99, [])]
    df = spark.createDataFrame(rows, f"article string, topic_no int, vector {VECTOR}")
    got = {(r["article"], r["i"], r["j"], round(r["sim"], 6), r["copies_i"], r["copies_j"])
           for r in G.prefix_pairs(df, ["article"], "topic_no", threshold).collect()}
    assert got == brute(rows, threshold) and got


def test_article_of_5000_topics(spark):
    rows = sparse_topics(9, {"huge": 5000}, width=3000)
    df = spark.createDataFrame(rows, f"article string, topic_no int, vector {VECTOR}")
    got = {(r["article"], r["i"], r["j"], round(r["sim"], 6), r["copies_i"], r["copies_j"])
           for r in G.prefix_pairs(df, ["article"], "topic_no", 0.7).collect()}
    # brute force by a dense product, the same rounding
    points = {}
    for a, n, v in rows:
        points.setdefault(tuple((s, w) for s, _, w in v), []).append(n)
    keys = list(points)
    dense = np.zeros((len(keys), 3000))
    for r, v in enumerate(keys):
        for s, w in v:
            dense[r, s] = w
    sims = np.round(dense @ dense.T, 9)
    want = set()
    for a, b in zip(*np.nonzero(sims > 0.7)):
        i, j = min(points[keys[a]]), min(points[keys[b]])
        if i < j:
            want.add(("huge", i, j, round(float(sims[a, b]), 6), len(points[keys[a]]), len(points[keys[b]])))
    assert {(a, i, j, c1, c2) for a, i, j, _, c1, c2 in got} == {(a, i, j, c1, c2) for a, i, j, _, c1, c2 in want}
    assert len(want) > 100


def test_copies_list_every_topic(spark):
    v = [(1, "1", 1.0)]
    rows = [("a", 3, v), ("a", 1, v), ("a", 2, v), ("a", 4, []), ("a", 5, []), ("b", 1, v), (None, 7, v)]
    df = spark.createDataFrame(rows, f"article string, topic_no int, vector {VECTOR}")
    got = sorted((tuple(r) for r in G.copies(df, ["article"], "topic_no").collect()), key=str)
    assert got == sorted([("a", 3, 1, 3), ("a", 1, 1, 3), ("a", 2, 1, 3), ("a", 4, 4, 2), ("a", 5, 4, 2),
                          ("b", 1, 1, 1), (None, 7, 7, 1)], key=str)
