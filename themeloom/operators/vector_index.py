"""An inverted-file index of vectors: stored by bucket, searched by probing buckets.

Building: coarse centres are fitted by spherical k-means on a bounded sample
(``sample_rows``, seeded); every row is then given the bucket of its nearest centre by a
Spark job and written partitioned by bucket, so that a search reads the folders of the
buckets it probes and no others (``PartitionFilters`` in the plan). Per bucket the
index keeps its size and radius, the least cosine of a member to its centre.

Searching: each question probes the buckets of its nearest centres, and every row of
a probed bucket is scored exactly. The work is grouped by (bucket, block): a bucket of
more than ``BLOCK_ROWS`` rows is cut into blocks, and the questions probing it are
copied to each block, so a bucket with a third of all rows is many tasks, not one. With
``probes=None`` the search is exact: after a first round, a bucket is probed too if the
angle bound cos(max(0, angle(question, centre) - radius)) can still reach the question's
k-th score, so no row that belongs in the top k is left out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.operators.storage import shared_folder, written

SAMPLE_NUMBERS = 2_000_000  # sample rows times dimension fitted on the driver, at most
ROWS_PER_LIST = 2_000
MAX_LISTS = 1_024
BLOCK_ROWS = 4_096
FIRST_PROBES = 2
ROUNDING = 9  # scores are ranked at 9 decimals, as the exact scan ranks them


@dataclass
class VectorIndex:
    path: str
    keys: list[str]
    centres: np.ndarray  # n_lists x d, unit rows
    lists: pd.DataFrame  # bucket, rows, radius (least cosine to the centre), blocks

    def rows(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """Rows of the given buckets only: the scan is pruned to their folders."""
        return spark.read.parquet(self.path).where(F.col("bucket").isin([int(b) for b in buckets]))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def spherical_kmeans(sample: np.ndarray, lists: int, seed: int, rounds: int = 25) -> np.ndarray:
    rng = np.random.default_rng(seed)
    units = _unit(sample)
    centres = units[rng.choice(len(units), lists, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(units @ centres.T, axis=1)
        for j in range(lists):
            members = units[nearest == j]
            total = members.sum(axis=0) if len(members) else units[rng.integers(len(units))]
            norm = np.linalg.norm(total)
            centres[j] = total / norm if norm > 0 else centres[j]
    return centres


def build_index(
    vectors: DataFrame,
    keys: list[str],
    embedding: str,
    path: str | None = None,
    rows_per_list: int = ROWS_PER_LIST,
    seed: int = 7,
) -> VectorIndex:
    """Index every row of ``vectors`` with a non-NULL ``embedding``; rows with a NULL one
    are not indexed. A zero vector scores 0 with every question. The folder is new in
    the shared folder of the cluster unless ``path`` is given."""
    spark = vectors.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rows = vectors.where(F.col(embedding).isNotNull()).select(*keys, F.col(embedding).cast("array<double>").alias("_v"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("d")).first()
    n, d = int(shape["n"]), int(shape["d"] or 1)
    lists = max(1, min(MAX_LISTS, math.ceil(n / rows_per_list)))
    sample_rows = max(lists, SAMPLE_NUMBERS // max(d, 1))
    # the centres are fitted on a bounded sample; every row is indexed below
    fraction = min(1.0, 1.2 * sample_rows / max(n, 1))
    sample = [r["_v"] for r in rows.sample(fraction=fraction, seed=seed).limit(sample_rows).collect()]
    if len(sample) < lists:
        sample = [r["_v"] for r in rows.limit(lists).collect()]
    lists = max(1, min(lists, len(sample)))
    centres = spherical_kmeans(np.array(sample, dtype=float), lists, seed) if sample else np.zeros((1, d))

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_u", T.ArrayType(T.DoubleType())),
                           T.StructField("bucket", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            units = _unit(np.stack(batch["_v"].to_numpy()).astype(float))
            scores = units @ centres.T
            bucket = np.argmax(scores, axis=1)
            out = batch[keys].copy()
            out["_u"] = list(units)
            out["bucket"] = bucket.astype(np.int32)
            out["near"] = scores[np.arange(len(bucket)), bucket]
            yield out

    rows.mapInPandas(assign, schema).write.partitionBy("bucket").parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("near").alias("radius")).toPandas()
    sizes["blocks"] = np.ceil(sizes["rows"] / BLOCK_ROWS).astype(int).clip(lower=1)
    return VectorIndex(path, keys, centres, sizes.sort_values("bucket").reset_index(drop=True))


def _bounds(index: VectorIndex, questions: np.ndarray) -> np.ndarray:
    """Upper bound of the cosine between each question and any row of each bucket."""
    angle = np.arccos(np.clip(questions @ index.centres.T, -1.0, 1.0))
    radius = np.full(len(index.centres), np.pi)
    radius[index.lists["bucket"].to_numpy()] = np.arccos(np.clip(index.lists["radius"].to_numpy(), -1.0, 1.0))
    present = np.zeros(len(index.centres), dtype=bool)
    present[index.lists["bucket"].to_numpy()] = True
    # a little slack for rounding in arccos near 0 keeps the bound an upper one
    bound = np.cos(np.maximum(0.0, angle - radius[None, :] - 1e-6))
    return np.where(present[None, :], bound, -np.inf)


def _score(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """Top ``k`` per question among the rows of its probed buckets, exact cosines.

    ``probes``: question_id, _q (unit vector), bucket. Grouped by (bucket, block)."""
    spark = probes.sparkSession
    buckets = [int(b) for b in probes.select("bucket").distinct().toPandas()["bucket"]]
    if not buckets:
        return None
    blocks = spark.createDataFrame(index.lists[["bucket", "blocks"]].astype(int)).select(
        F.col("bucket").cast("int"), F.col("blocks").cast("int")
    )
    rows = index.rows(spark, buckets).join(F.broadcast(blocks), "bucket")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*index.keys), F.col("blocks")).cast("int"))
    asked = probes.join(F.broadcast(blocks), "bucket").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key_fields = [rows.schema[c] for c in index.keys]
    schema = T.StructType([T.StructField("question_id", T.StringType()), *key_fields, T.StructField("score", T.DoubleType())])
    keys = index.keys

    def best(own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if own.empty or questions.empty:
            return pd.DataFrame({c.name: [] for c in schema.fields})
        own = own.sort_values(keys, kind="stable")
        scores = np.round(np.stack(questions["_q"].to_numpy()) @ np.stack(own["_u"].to_numpy()).T, ROUNDING)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = own[keys].iloc[top.ravel()].reset_index(drop=True)
        found.insert(0, "question_id", np.repeat(questions["question_id"].to_numpy(), top.shape[1]))
        found["score"] = np.take_along_axis(scores, top, axis=1).ravel()
        return found

    return (
        rows.select(*keys, "_u", "bucket", "_block").groupBy("bucket", "_block")
        .cogroup(asked.select("question_id", "_q", "bucket", "_block").groupBy("bucket", "_block"))
        .applyInPandas(best, schema)
    )


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), *[F.asc(c) for c in keys]]
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: VectorIndex, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """question_id, keys, score, rank: the ``k`` rows of highest cosine per question.

    ``questions``: question_id (string) and vector (array of numbers). ``probes=None``
    gives the exact top ``k`` (ties by key); a number probes that many nearest buckets
    only. Per question at most k rows a block reach the final ranking, so no question
    gathers its candidates in one task.
    """
    spark = questions.sparkSession
    centres = index.centres
    first = probes or FIRST_PROBES

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            q = _unit(np.stack(batch["vector"].to_numpy()).astype(float))
            bound = _bounds(index, q)
            order = np.argsort(-bound, axis=1, kind="stable")
            out = pd.DataFrame({"question_id": batch["question_id"].to_numpy(), "_q": list(q)})
            out["near"] = [list(o[:first]) for o in order]
            out["bound"] = list(bound)
            yield out

    planned = written(
        questions.where(F.col("vector").isNotNull())
        .select("question_id", F.col("vector").cast("array<double>").alias("vector"))
        .mapInPandas(plan, "question_id string, _q array<double>, near array<int>, bound array<double>")
    )
    one = planned.select("question_id", "_q", F.explode("near").alias("bucket"))
    found = _score(index, one, k)
    if found is None:
        return spark.createDataFrame([], "question_id string, score double, rank int")
    found = written(_top(found, index.keys, k))
    if probes is not None:
        return found
    # second round: buckets whose bound reaches the k-th score found so far
    kth = found.groupBy("question_id").agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
    reach = F.when(F.col("_n") < k, F.lit(-2.0)).otherwise(F.col("_kth") - 10.0 ** -ROUNDING)
    more = (
        planned.join(kth, "question_id", "left")
        .select("question_id", "_q", "near", F.coalesce(reach, F.lit(-2.0)).alias("_reach"),
                F.posexplode("bound").alias("bucket", "_bound"))
        .where((F.col("_bound") >= F.col("_reach")) & ~F.array_contains("near", F.col("bucket")))
        .select("question_id", "_q", F.col("bucket").cast("int").alias("bucket"))
    )
    extra = _score(index, written(more), k)
    if extra is None:
        return found
    return _top(found.drop("rank").unionByName(extra), index.keys, k)
