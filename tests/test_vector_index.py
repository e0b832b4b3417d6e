"""The bucketed vector index against an exact scan: exact mode, probes, a hot bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import vector_index as X


def clustered(n, d=16, clusters=12, seed=3, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    labels = rng.integers(0, clusters, size=n)
    labels[: int(hot * n)] = 0  # one cluster with this share of the rows
    points = centres[labels] + 0.25 * rng.normal(size=(n, d))
    return points


def exact(points, asked, k):
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in asked:
        scores = np.round(unit[q] @ unit.T, 9)
        order = sorted(range(len(points)), key=lambda i: (-scores[i], i))[:k]
        out[str(q)] = [(i, scores[i]) for i in order]
    return out


def frame(spark, points, extra=()):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def found(spark, points, k, probes=None, rows_per_list=100, extra=()):
    vectors = frame(spark, points, extra)
    index = X.build_index(vectors, ["vec_id"], "embedding", rows_per_list=rows_per_list)
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").cast("string").alias("question_id"), F.col("embedding").alias("vector")
    )
    got = {}
    for r in X.search(index, asked, k, probes).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["vec_id"], r["score"]))
    return index, got


def test_exact_mode_equals_scan(spark):
    points = clustered(1500)
    index, got = found(spark, points, 10, extra=[(5000, None)])
    want = exact(points, range(0, 1500, 50), 10)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert len(index.lists) > 1


def test_hot_bucket_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 64)
    points = clustered(1200, hot=0.34, seed=5)
    index, got = found(spark, points, 5)
    assert index.lists["blocks"].max() > 1
    want = exact(points, range(0, 1200, 50), 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_probes_recall_on_clustered_vectors(spark):
    points = clustered(3000, d=24, clusters=20, seed=8)
    _, got = found(spark, points, 10, probes=3, rows_per_list=150)
    want = exact(points, range(0, 3000, 50), 10)
    recall = np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in v}) / 10 for q, v in want.items()])
    assert recall >= 0.9


def test_scan_is_pruned_by_bucket(spark):
    points = clustered(600)
    index = X.build_index(frame(spark, points), ["vec_id"], "embedding", rows_per_list=100)
    plan = index.rows(spark, [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    assert {r["bucket"] for r in index.rows(spark, [0, 1]).select("bucket").distinct().collect()} <= {0, 1}


def test_empty_questions(spark):
    points = clustered(100)
    index = X.build_index(frame(spark, points), ["vec_id"], "embedding")
    none = spark.createDataFrame([], "question_id string, vector array<double>")
    assert X.search(index, none, 5).count() == 0
