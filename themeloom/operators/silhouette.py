"""Exact mean silhouette with Euclidean distance.

Equal points of one cluster are folded into one weighted point. The rest is band
against all: every task holds one band of target points, all points stream past it
in batches, and only sums per (point, cluster) leave it. No pair of points is ever a
row, and no task holds more than one band, its sums and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.storage import written

BANDS = 32  # as many bands while they are small, so that all cores have work
BAND_BLOCKS = 32  # blocks in a band at most; the data moves once per band
TILE = 1 << 21  # distances held at once


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("f")
    if values.null_count:
        raise ValueError("a point has no vector")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class _Band:
    """Targets of one band and the distances summed so far, per cluster seen."""

    def __init__(self) -> None:
        self.targets: list[pa.RecordBatch] = []
        self.x: np.ndarray | None = None
        self.totals: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        """Distances of all targets to one batch of passing points."""
        if self.x is None:
            self.x = np.concatenate([_vectors(t) for t in self.targets])
            self.targets = [t.select(["key", "cluster", "copies"]) for t in self.targets]
            self.squares = (self.x * self.x).sum(1)
        y = _vectors(batch)
        y_squares = (y * y).sum(1)
        labels, column = np.unique(batch.column("cluster").to_numpy(zero_copy_only=False), return_inverse=True)
        member = np.zeros((len(y), len(labels)))
        member[np.arange(len(y)), column] = batch.column("copies").to_numpy(zero_copy_only=False)
        found = np.empty((len(self.x), len(labels)))
        step = max(1, TILE // len(y))
        for at in range(0, len(self.x), step):
            part = slice(at, at + step)
            square = self.x[part] @ y.T
            square *= -2.0
            square += self.squares[part, None]
            square += y_squares[None, :]
            found[part] = np.sqrt(np.maximum(square, 0.0, out=square), out=square) @ member
        for c, label in enumerate(labels.tolist()):
            self.totals.setdefault(int(label), np.zeros(len(self.x)))
            self.totals[int(label)] += found[:, c]
            self.counts[int(label)] = self.counts.get(int(label), 0) + int(member[:, c].sum())

    def sums(self) -> Iterator[pa.RecordBatch]:
        for label, total in self.totals.items():
            at = 0
            for t in self.targets:
                n = t.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        *t.columns,
                        pa.array(np.full(n, label, dtype=np.int32)),
                        pa.array(total[at : at + n]),
                        pa.array(np.full(n, self.counts[label], dtype=np.int64)),
                    ],
                    names=["key", "cluster", "copies", "other", "total", "n"],
                )
                at += n


def _band_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come band by band, each band's targets before the points that pass it."""
    band, number = _Band(), None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bands = batch.column("band").to_numpy()
        places = bands.astype(np.int64) * 2 + batch.column("passing").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            if bands[start] != number:
                yield from band.sums()
                band, number = _Band(), bands[start]
            if places[start] % 2:
                band.add(part)
            else:
                band.targets.append(part)
    yield from band.sums()


def _bands(blocks: int) -> int:
    """Bands for so many blocks of points; each band takes a copy of all points."""
    return max(min(blocks, BANDS), -(-blocks // BAND_BLOCKS))


def silhouette_points(
    points: DataFrame, key: str, cluster: str, features: str, block_rows: int = 1000
) -> DataFrame:
    """``key, cluster, copies, score``: one row per distinct point of a cluster.

    ``key`` is the lowest key among equal points and ``copies`` their number.
    ``score`` is 0 for a cluster of one and NULL when there is one cluster only.
    A band holds from one to ``BAND_BLOCKS`` times ``block_rows`` points.
    """
    distinct = written(
        points.select(
            F.col(key).alias("key"),
            F.col(cluster).cast("int").alias("cluster"),
            F.col(features).cast("array<double>").alias("f"),
        )
        .groupBy("cluster", "f")
        .agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    )
    blocks_needed = max(1, -(-distinct.count() // block_rows))
    bands = _bands(blocks_needed)
    # a point is a target in its own band and passes every band
    mine = F.struct(F.pmod(F.xxhash64("key", "f"), F.lit(bands)).cast("int").alias("band"), F.lit(0).alias("passing"))
    all_bands = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.lit(1).alias("passing"))
    )
    placed = distinct.select(F.explode(F.concat(F.array(mine), all_bands)).alias("p"), "key", "cluster", "copies", "f")
    ordered = (
        placed.select("p.band", "p.passing", "key", "cluster", "copies", "f")
        .repartitionById(bands, F.col("band"))
        .sortWithinPartitions("band", "passing")
    )
    kept = ", ".join(f"`{c}` {distinct.schema[c].dataType.simpleString()}" for c in ("key", "cluster", "copies"))
    per_cluster = (
        ordered.mapInArrow(_band_sums, f"{kept}, other int, total double, n bigint")
        .groupBy("key", "cluster", "copies", "other")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    own = F.col("other") == F.col("cluster")
    scored = per_cluster.groupBy("key", "cluster", "copies").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    gap = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    score = (
        F.when(F.col("b").isNull(), F.lit(None).cast("double"))
        .when(F.col("size") == 1, F.lit(0.0))
        .otherwise(F.coalesce(gap, F.lit(0.0)))
    )
    return scored.select(
        F.col("key").alias(key), F.col("cluster").alias(cluster), "copies", score.alias("score")
    )


def silhouette(
    points: DataFrame, key: str, cluster: str, features: str, block_rows: int = 1000
) -> DataFrame:
    """One row ``points, clusters, silhouette_score``, three decimals.

    0 when one cluster is left, NULL when every point is its own cluster.
    """
    scores = silhouette_points(points, key, cluster, features, block_rows)
    per_cluster = scores.groupBy(cluster).agg(
        F.sum("copies").alias("points"),
        F.sum(F.col("score") * F.col("copies")).alias("total"),
    )
    whole = per_cluster.agg(
        F.sum("points").alias("points"),
        F.count("*").alias("clusters"),
        F.sum("total").alias("total"),
    )
    mean = (
        F.when(F.col("clusters") == 1, F.lit(0.0))
        .when(F.col("clusters") < F.col("points"), F.round(F.col("total") / F.col("points"), 3))
    )
    return whole.select("points", "clusters", mean.alias("silhouette_score"))
