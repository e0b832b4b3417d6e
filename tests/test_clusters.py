import json
import random
import zlib

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from themeloom.stop_words import ENGLISH
from themeloom.operators import clusters as C
from themeloom.operators import retrieval as R
from themeloom.operators.silhouette import silhouette, silhouette_points
from themeloom.operators.terms import tfidf_vectors, with_terms
from themeloom.plans.stage2 import cluster_analysis, themes_of
from themeloom.settings import Settings


def points(spark, rows):
    return spark.createDataFrame(rows, "id int, label int, v array<double>")


def brute(rows):
    out = {}
    for i, c, v in rows:
        mean = {}
        for j, d, u in rows:
            if i != j:
                mean.setdefault(d, []).append(np.linalg.norm(np.subtract(v, u)))
        others = [np.mean(x) for d, x in mean.items() if d != c]
        if not others:
            out[i] = None
        elif c not in mean:
            out[i] = 0.0
        else:
            a, b = np.mean(mean[c]), min(others)
            out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_silhouette_equals_brute_force(spark, block_rows):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.random(), rng.random()]) for i in range(40)]
    rows += [(100 + i, 1, [0.5, 0.25]) for i in range(20)]  # a hot point
    rows += [(200, 9, [3.0, 3.0])]  # a cluster of one
    expected = brute(rows)
    df = points(spark, rows)
    got = silhouette_points(df, "id", "label", "v", block_rows).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(expected[r["id"]], abs=1e-6)
    whole = silhouette(df, "id", "label", "v", block_rows).first()
    assert whole["silhouette_score"] == pytest.approx(np.mean(list(expected.values())), abs=6e-4)


def test_one_cluster(spark):
    df = points(spark, [(1, 0, [1.0, 0.0]), (2, 0, [3.0, 2.0]), (3, 0, [2.0, 4.0])])
    found = C.fit_kmeans(df, "id", "v", 1, (42, 43))
    assert sorted(map(tuple, found.assigned.collect())) == [(1, 0), (2, 0), (3, 0)]
    assert found.centres == [[2.0, 2.0]] and found.cost == pytest.approx(10.0)


def test_silhouette_edges(spark):
    one = points(spark, [(1, 0, [1.0]), (2, 0, [2.0])])
    assert silhouette(one, "id", "label", "v").first()["silhouette_score"] == 0.0
    each = points(spark, [(1, 0, [1.0]), (2, 1, [2.0])])
    assert silhouette(each, "id", "label", "v").first()["silhouette_score"] is None


def test_kmeans_is_best_of_its_starts_and_consistent(spark):
    rng = random.Random(7)
    rows = [(i, 0, [rng.gauss(4 * (i % 4), 1.0), rng.gauss(0, 1.0)]) for i in range(80)]
    df = points(spark, rows).select("id", "v")
    best = C.fit_kmeans(df, "id", "v", 4, (42, 43, 44))
    for seed in (42, 43, 44):
        assert best.cost <= C.fit_kmeans(df, "id", "v", 4, (seed,)).cost + 1e-9
    again = C.fit_kmeans(df.repartition(5), "id", "v", 4, (42, 43, 44))
    label = lambda m: {r["id"]: r["cluster_number"] for r in m.assigned.collect()}
    assert label(again) == label(best)
    lowest = {}
    for i, c in sorted(label(best).items()):
        lowest.setdefault(c, i)
    assert list(lowest) == sorted(lowest)
    near = C.nearest_centre(df, "v", dict(enumerate(best.centres))).collect()
    assert {r["id"]: r["nearest"]["cluster_number"] for r in near} == label(best)
    assert sum(r["nearest"]["squared_distance"] for r in near) == pytest.approx(best.cost)


def test_cluster_prompts_show_every_theme(spark):
    rows = spark.createDataFrame(
        [(a, 0, [(f"t{a}_{i}", "d", [], None, None) for i in range(n)], 1, None) for a, n in ((1, 20), (2, 3))],
        "doc int, part_no int, themes array<struct<name:string,description:string,"
        "related_topics:array<string>,strength:double,coverage:string>>, n int, error string",
    )
    themes = themes_of(rows, "doc").withColumn("cluster_number", F.lit(0))
    sizes = spark.createDataFrame([(0, 2)], "cluster_number int, size long")

    def respond(prompt):
        # a batch counts its theme lines, a combination adds up its parts
        if "\nParts:\n" in prompt:
            parts = prompt.split("\nParts:\n", 1)[1].split("\n\nAnswer", 1)[0].split("\n")
            return '{"cluster_name": "%d lines"}' % sum(int(json.loads(p)["cluster_name"].split()[0]) for p in parts)
        lines = [x for x in prompt.split("\n") if x.startswith("- ")]
        return '{"cluster_name": "%d lines"}' % len(lines)

    got = cluster_analysis(themes, sizes, "doc", Settings(), respond).first()
    assert got["cluster_name"] == "23 lines" and got["themes_analyzed"] == 23
    assert got["display_theme"] == "Unknown theme"


def test_vectors_have_norm_one_or_no_entries(spark):
    df = spark.createDataFrame(
        [(1, "alpha beta beta"), (2, "beta gamma"), (3, "the and of"), (4, "")], "id int, t string"
    )
    got = {
        r["id"]: r["vector"]
        for r in tfidf_vectors(with_terms(df, "t", pairs=True), ["id"], 4).collect()
    }
    assert got.keys() == {1, 2, 3, 4} and got[3] == got[4] == []
    for i in (1, 2):
        assert sum(e["w"] ** 2 for e in got[i]) == pytest.approx(1.0)
    none = df.where("id > 2")
    empty = tfidf_vectors(with_terms(none, "t"), ["id"], 4).collect()
    assert [r["vector"] for r in empty] == [[], []]


def test_stop_words_are_those_of_the_library(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_chunk_vector_counts_hashed_terms(spark):
    df = spark.createDataFrame([(1, 0, "red red blue the"), (2, 0, "of the")], "doc int, chunk_no int, text string")
    got = {r["doc"]: r["embedding"] for r in R.chunk_vectors(df, "doc", 16).collect()}
    expected = [0.0] * 16
    for term in ("red", "red", "blue"):
        expected[zlib.crc32(term.encode()) % 16] += 1
    assert got == {1: expected, 2: [0.0] * 16}


def test_topk_over_several_passes_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 4))
    data[50:90] = data[50]  # equal scores go by key
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id int, v array<double>")
    queries = [(f"q{i}", rng.normal(size=4).tolist()) for i in range(7)]
    monkeypatch.setattr(R, "QUERIES_PER_PASS", 3)
    got = R.vector_topk(df.repartition(6), ["id"], "v", queries, 45)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for name, q in queries:
        scores = np.round(unit @ (np.array(q) / np.linalg.norm(q)), 9)
        assert found[name] == sorted(range(200), key=lambda i: (-scores[i], i))[:45]


def test_first_match_takes_the_first_record(spark):
    left = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    records = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "k string, n int, v string")
    got = sorted((r["k"], r["v"]) for r in C.first_match(left, records, "k", "n").collect() if r["v"])
    assert got == [("a", "x"), ("a", "x")]
