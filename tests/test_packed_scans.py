"""k-means scans read packed blocks, corpus terms are counted by number: the same results."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from themeloom.operators import kmeans_starts as KS
from themeloom.operators import terms as V


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_blocks_give_back_their_rows(monkeypatch, share, rows):
    monkeypatch.setattr(KS, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(1)
    points = np.where(rng.random((20, 30)) < share, rng.normal(size=(20, 30)), 0.0)
    packed = list(KS._pack(iter([pd.DataFrame({"key": range(20), "x": list(points)})])))
    assert len(packed) == math.ceil(20 / rows)
    assert np.array_equal(np.vstack(list(KS._points(iter(packed)))), points)
    assert [k for p in packed for names in p["keys"] for k in names] == [str(i) for i in range(20)]
    held = sum(len(p["numbers"].iloc[0]) + len(p["columns"].iloc[0]) for p in packed)
    assert held <= points.nbytes and (share == 1.0 or held <= 0.3 * points.nbytes)


def test_iterations_scan_blocks_not_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=6) + 9 * np.eye(6)[i % 3]]) for i in range(90)]
    df = spark.createDataFrame(rows, "key long, features array<double>")
    scanned, added = [], KS._added
    monkeypatch.setattr(KS, "_added", lambda centres, points, *a: scanned.append(points) or added(centres, points, *a))
    fit = KS.fit_kmeans_starts(df, "key", "features", 3, (1, 2))
    assert {r["key"]: r["cluster_number"] for r in fit.assigned.collect()} == {i: i % 3 for i in range(90)}
    x = np.array([r[1] for r in rows])
    assert np.allclose(fit.centres, [x[i::3].mean(0) for i in range(3)], atol=1e-9)
    assert all("array" not in kind for points in scanned for _, kind in points.dtypes)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_slices_take_every_row_once(monkeypatch, most):
    monkeypatch.setattr(V, "SLICE_TERMS", most)
    lists = pa.array([["a"] * n for n in (3, 0, 0, 9, 1, 6, 0)] + [None])
    for width in (0, 5):
        cut = list(V._slices(lists, width))
        assert [i for at, n in cut for i in range(at, at + n)] == list(range(8))
        assert all(n == 1 or n * width <= most and len(lists.slice(at, n).flatten()) <= most for at, n in cut)
    batch = pa.RecordBatch.from_arrays([lists], names=["terms"])
    parts = [r for b in V._statistics_of(iter([batch])) for r in b.to_pylist()]
    assert {r["term"] for r in parts} == {"a"} and sum(r["cf"] for r in parts) == 19 and sum(r["df"] for r in parts) == 4


def test_terms_counted_by_number(spark):
    rng = np.random.default_rng(3)
    texts = [list(rng.choice(["ab", "cd", "ef", "ab cd", "x"], rng.integers(0, 9))) for _ in range(40)]
    texts = [[str(t) for t in terms] for terms in texts] + [[], ["none"]]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, terms array<string>")
    stats = {r["term"]: (r["cf"], r["df"]) for r in V.term_statistics(df).collect()}
    words = Counter(t for terms in texts for t in terms)
    assert stats == {t: (n, sum(t in terms for terms in texts)) for t, n in words.items()}

    fit = V.Fit(["ab", "cd ab", "ab cd", "ab cd ef"], [1.5, 2.0, 1.25, 3.0])
    found = V.corpus_features(df, ["doc_id"], fit, pairs=True).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        terms = texts[r["doc_id"]] if r["doc_id"] < len(texts) else []
        tf = Counter([*terms, *[f"{a} {b}" for a, b in zip(terms, terms[1:])]])
        raw = [tf[t] * w for t, w in zip(fit.terms, fit.idf)]
        norm = math.sqrt(sum(v * v for v in raw)) or 1.0
        assert r["features"] == [v / norm for v in raw]


def test_corpus_counts_explode_no_terms(spark):
    df = spark.createDataFrame([(1, ["ab", "cd"])], "doc_id int, terms array<string>")
    plan = V.term_statistics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
