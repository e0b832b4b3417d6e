"""k-means with all starts in one pass: every scan serves every start at once.

Each start has its own seed. Seeding is k-means|| (Bahmani et al., 2012) for all starts
together: one point by a seeded hash, then ``ROUNDS`` rounds that each add points with
probability ``oversampling * k * d^2 / cost``, every start by its own hashed coin; the
candidates, weighted by the points they are nearest to, are reduced to k centres by
k-means++ on the driver (they number about ROUNDS * oversampling * k + 1 a start). Lloyd
iterations then scan the rows once for all starts still moving: each task returns, per
start, the sums, counts and cost of its rows, which Spark adds up. The start of least
cost wins (ties by seed). Only centres and partial sums (starts x k x d numbers, for
at most COLLECTED_PARTS tasks; beyond, Spark adds them first) reach the driver.

All these scans read the points from blocks of rows packed once as bytes, the zeros
left out where that is shorter. A block is made dense in the task that reads it, at
most BLOCK_NUMBERS numbers at a time, and meets the centres of all starts in one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.clusters import Clustering, _one_cluster
from themeloom.operators.storage import written

ROUNDS = 2
OVERSAMPLING = 2.0
PARTIAL = "start int, sums array<double>, counts array<long>, cost double"
COLLECTED_PARTS = 64  # up to so many tasks, partial sums are added on the driver
BLOCK_ROWS = 1024
BLOCK_NUMBERS = 1 << 20  # of one block, made dense
POINTS = ["n", "d", "filled", "columns", "numbers"]
BLOCKS = "keys array<string>, n int, d int, filled binary, columns binary, numbers binary"


def _uniform(keys: np.ndarray, seed: int, round_no: int) -> np.ndarray:
    """A coin in [0, 1) per row, fixed by key, seed and round."""
    h = pd.util.hash_array(keys.astype(str), hash_key=f"{seed:08d}{round_no:08d}"[:16])
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0.0)


def _rows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return batch["key"].to_numpy(), np.stack(batch["x"].to_numpy()).astype(float)


def _column_type(d: int) -> type:
    return np.uint16 if d <= 1 << 16 else np.int64


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows: numbers per row, their columns and values, or all numbers if shorter."""
    for batch in batches:
        if batch.empty:
            continue
        keys, points = _rows(batch)
        keys, d = keys.astype(str), points.shape[1]
        step = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, d)))
        for at in range(0, len(points), step):
            part = points[at : at + step]
            row, column = np.nonzero(part)
            filled, columns = np.bincount(row, minlength=len(part)).astype(np.int32), column.astype(_column_type(d))
            numbers = part[row, column]
            if filled.nbytes + columns.nbytes + numbers.nbytes >= part.nbytes:
                filled, columns, numbers = filled[:0], columns[:0], part
            yield pd.DataFrame({
                "keys": [keys[at : at + step].tolist()], "n": len(part), "d": d,
                "filled": filled.tobytes(), "columns": columns.tobytes(), "numbers": numbers.tobytes(),
            })


def _unpack(n: int, d: int, filled: bytes, columns: bytes, numbers: bytes) -> np.ndarray:
    values = np.frombuffer(numbers)
    if not filled:
        return values.reshape(n, d)
    points = np.zeros((n, d))
    starts = np.repeat(np.arange(n, dtype=np.int64) * d, np.frombuffer(filled, np.int32))
    points.ravel()[starts + np.frombuffer(columns, _column_type(d))] = values
    return points


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in zip(*[batch[c] for c in POINTS], strict=True):
            yield _unpack(*block)


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over the few candidates, then Lloyd on them."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    for _ in range(1, k):
        d = _distances(points, points[chosen]).min(1) * weights
        chosen.append(int(rng.choice(len(points), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(points))))
    centres = points[chosen].copy()
    for _ in range(30):
        nearest = _distances(points, centres).argmin(1)
        for j in range(k):
            mine = nearest == j
            if weights[mine].sum() > 0:
                centres[j] = (points[mine] * weights[mine, None]).sum(0) / weights[mine].sum()
    return centres


def seed_all(x: DataFrame, blocks: DataFrame, k: int, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """k starting centres per seed, by k-means|| with shared scans; ``blocks`` are ``x`` packed."""
    first = x.select(
        *[F.min_by("x", F.xxhash64(F.col("key").cast("string"), F.lit(s))).alias(f"s{i}") for i, s in enumerate(seeds)]
    ).first()
    candidates = [np.array([first[f"s{i}"]], dtype=float) for i in range(len(seeds))]
    points_of = blocks.select(*POINTS)
    for round_no in range(ROUNDS):
        held = [c.copy() for c in candidates]

        def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = np.zeros(len(seeds))
            for points in _points(batches):
                for i, c in enumerate(held):
                    totals[i] += _distances(points, c).min(1).sum()
            yield pd.DataFrame({"start": range(len(seeds)), "cost": totals})

        costs = points_of.mapInPandas(cost, "start long, cost double").groupBy("start").agg(F.sum("cost").alias("cost")).collect()
        phi = {int(r["start"]): float(r["cost"]) for r in costs}

        def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for names, points in zip(batch["keys"], _points(iter([batch])), strict=True):
                    keys = np.array(names, dtype=str)
                    for i, c in enumerate(held):
                        if phi[i] <= 0:
                            continue
                        d = _distances(points, c).min(1)
                        p = np.minimum(1.0, OVERSAMPLING * k * d / phi[i])
                        taken = _uniform(keys, seeds[i], round_no) < p
                        if taken.any():
                            yield pd.DataFrame({"start": i, "x": list(points[taken])})

        # about oversampling * k rows a start a round: the driver holds them
        for r in blocks.mapInPandas(sample, "start int, x array<double>").collect():
            candidates[r["start"]] = np.vstack([candidates[r["start"]], np.asarray(r["x"])])
    held = [c.copy() for c in candidates]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros(len(c), dtype=np.int64) for c in held]
        for points in _points(batches):
            for i, c in enumerate(held):
                counts[i] += np.bincount(_distances(points, c).argmin(1), minlength=len(c))
        yield pd.DataFrame({"start": range(len(seeds)), "counts": [list(c) for c in counts]})

    weights = [np.zeros(len(c)) for c in held]
    for r in points_of.mapInPandas(weigh, "start int, counts array<long>").collect():
        weights[r["start"]] += np.asarray(r["counts"], dtype=float)
    out = []
    for i, seed in enumerate(seeds):
        unique, at = np.unique(held[i], axis=0, return_inverse=True)
        w = np.bincount(at.ravel(), weights=weights[i], minlength=len(unique))
        rng = np.random.default_rng(seed)
        picked = _plus_plus(unique, np.maximum(w, 1e-12), min(k, len(unique)), rng)
        if len(picked) < k:  # fewer distinct points than k: repeat the last
            picked = np.vstack([picked, np.repeat(picked[-1:], k - len(picked), axis=0)])
        out.append(picked)
    return out


def _partials(centres: list[np.ndarray], active: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = centres[0].shape
        every = np.vstack([centres[i] for i in active])
        norms = (every * every).sum(1)
        own = np.arange(len(active)) * k
        sums, counts = np.zeros((len(every), d)), np.zeros(len(every), dtype=np.int64)
        costs = np.zeros(len(active))
        for points in _points(batches):
            dist = points @ every.T
            dist *= -2
            dist += (points * points).sum(1)[:, None]
            dist += norms
            np.maximum(dist, 0.0, out=dist)
            nearest = dist.reshape(len(points), len(active), k).argmin(2) + own
            costs += np.take_along_axis(dist, nearest, 1).sum(0)
            member = dist  # its numbers are no longer needed
            member.fill(0.0)
            np.put_along_axis(member, nearest, 1.0, 1)
            sums += member.T @ points
            counts += np.bincount(nearest.ravel(), minlength=len(every))
        yield pd.DataFrame({
            "start": active, "sums": [sums[i : i + k].ravel() for i in own],
            "counts": [counts[i : i + k] for i in own], "cost": costs,
        })

    return run


def _added(
    centres: list[np.ndarray], points: DataFrame, parts: int, active: list[int]
) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    k, d = centres[0].shape

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "start": [int(group["start"].iloc[0])],
            "sums": [np.sum(np.stack(group["sums"].to_numpy()), axis=0)],
            "counts": [np.sum(np.stack(group["counts"].to_numpy()), axis=0)],
            "cost": [float(group["cost"].sum())],
        })

    partials = points.mapInPandas(_partials(centres, active), PARTIAL)
    if parts > COLLECTED_PARTS:
        partials = partials.groupBy("start").applyInPandas(add, PARTIAL)
    # else the few partial sums (parts x starts x k x d) are added on the driver
    out = {}
    for r in partials.collect():
        sums, counts = np.asarray(r["sums"]).reshape(k, d), np.asarray(r["counts"])
        if r["start"] in out:
            a, b, c = out[r["start"]]
            out[r["start"]] = (a + sums, b + counts, c + r["cost"])
        else:
            out[r["start"]] = (sums, counts, r["cost"])
    return out


def fit_kmeans_starts(
    vectors: DataFrame,
    key: str,
    features: str,
    k: int,
    seeds: tuple[int, ...],
    max_iter: int = 300,
    tol: float = 1e-4,
) -> Clustering:
    """Best of one start per seed, all fitted by the same scans; clusters are numbered
    by their lowest key. A start stops when no centre moves more than ``tol``; an empty
    cluster keeps its centre. ``vectors`` is read more than once: a written table."""
    if k == 1:
        return _one_cluster(vectors, key, features, seeds[0])
    x = vectors.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"))
    # scanned once an iteration: kept by the executors, spilled to their disks if need be
    blocks = written(x.mapInPandas(_pack, BLOCKS)).persist(StorageLevel.MEMORY_AND_DISK)
    points, parts = blocks.select(*POINTS), blocks.rdd.getNumPartitions()
    centres = seed_all(x, blocks, k, seeds)
    active = list(range(len(seeds)))
    for _ in range(max_iter):
        if not active:
            break
        added = _added(centres, points, parts, active)
        still = []
        for i in active:
            sums, counts, _ = added[i]
            moved = centres[i].copy()
            full = counts > 0
            moved[full] = sums[full] / counts[full, None]
            shift = np.sqrt(((moved - centres[i]) ** 2).sum(1)).max()
            centres[i] = moved
            if shift > tol:
                still.append(i)
        active = still
    final = _added(centres, points, parts, list(range(len(seeds))))
    cost, best = min((final[i][2], seeds[i], i) for i in range(len(seeds)))[0::2]
    chosen = centres[best]
    seed = seeds[best]

    @F.pandas_udf("int")
    def nearest(values: pd.Series) -> pd.Series:
        points = np.stack(values.to_numpy()).astype(float)
        return pd.Series(_distances(points, chosen).argmin(1).astype(np.int32))

    labelled = written(x.select("key", nearest("x").alias("prediction")))
    lowest = labelled.groupBy("prediction").agg(F.min("key").alias("lowest")).collect()
    order = [r["prediction"] for r in sorted(lowest, key=lambda r: r["lowest"])]
    number = F.coalesce(*[F.when(F.col("prediction") == p, F.lit(i)) for i, p in enumerate(order)])
    assigned = labelled.select(F.col("key").alias(key), number.cast("int").alias("cluster_number"))
    blocks.unpersist()
    return Clustering(assigned, [chosen[p].tolist() for p in order], float(cost), seed)
