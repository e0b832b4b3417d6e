"""All k-means starts in shared scans: as good as separate fits, the same on a rerun."""

import numpy as np
import pytest

from themeloom.operators import clusters as C
from themeloom.operators import kmeans_starts as KS


def blobs(n=600, d=5, k=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=5, size=(k, d))
    return centres[rng.integers(0, k, n)] + rng.normal(size=(n, d))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(blobs())]
    rows += [(1000 + i, [0.5] * 5) for i in range(40)]  # a group of equal points
    return spark.createDataFrame(rows, "key long, features array<double>")


def test_as_good_as_separate_fits(spark, vectors):
    seeds = (1, 2, 3)
    one_pass = KS.fit_kmeans_starts(vectors, "key", "features", 4, seeds)
    separate = C.fit_kmeans(vectors, "key", "features", 4, seeds)
    assert one_pass.cost <= separate.cost * 1.0001
    labels = {r["key"]: r["cluster_number"] for r in one_pass.assigned.collect()}
    assert len(labels) == 640 and set(labels.values()) == {0, 1, 2, 3}
    # clusters are numbered by their lowest key
    firsts = sorted({c: min(k for k, v in labels.items() if v == c) for c in range(4)}.items(), key=lambda x: x[1])
    assert [c for c, _ in firsts] == [0, 1, 2, 3]
    again = KS.fit_kmeans_starts(vectors, "key", "features", 4, seeds)
    # sums may be added in another order: equal up to rounding, the same clusters
    assert again.cost == pytest.approx(one_pass.cost, rel=1e-12)
    assert {r["key"]: r["cluster_number"] for r in again.assigned.collect()} == labels


def test_more_clusters_than_distinct_points(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "key long, features array<double>")
    fit = KS.fit_kmeans_starts(df, "key", "features", 3, (5, 6))
    assert fit.assigned.count() == 10 and fit.cost == pytest.approx(0.0)
