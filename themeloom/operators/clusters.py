"""k-means on article vectors, its single steps, and cluster reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.prompts import theme_line
from themeloom.operators.storage import written

ROWS_PER_PARTITION = 20_000
PARALLEL_STARTS = 10


@dataclass(frozen=True)
class Clustering:
    assigned: DataFrame  # key, cluster_number
    centres: list[list[float]]
    cost: float
    seed: int


def fit_kmeans(
    vectors: DataFrame,
    key: str,
    features: str,
    k: int,
    seeds: tuple[int, ...],
    max_iter: int = 300,
    tol: float = 1e-4,
) -> Clustering:
    """Best of one start per seed; clusters are numbered by their lowest key.

    The start depends on the partition layout, so rows are laid out by key hash
    and sorted, in a number of partitions that follows from their count alone.
    """
    if k == 1:
        return _one_cluster(vectors, key, features, seeds[0])
    rows = vectors.count()
    laid_out = (
        vectors.select(key, array_to_vector(F.col(features)).alias("features"))
        .repartition(max(1, -(-rows // ROWS_PER_PARTITION)), key)
        .sortWithinPartitions(key)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    def start(seed: int):
        # the block solver fails when equal points leave fewer than k centres
        means = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, solver="row")
        model = means.fit(laid_out)
        return model.summary.trainingCost, seed, model

    laid_out.count()
    # the starts are independent and their jobs short, so they share the executors
    with ThreadPoolExecutor(PARALLEL_STARTS) as pool:
        started = pool.map(inheritable_thread_target(vectors.sparkSession)(start), seeds)
        cost, seed, model = min(started, key=lambda s: (s[0], s[1]))
    labelled = model.transform(laid_out).select(key, "prediction")
    # one row per cluster
    lowest = labelled.groupBy("prediction").agg(F.min(key).alias("lowest")).collect()
    order = [r["prediction"] for r in sorted(lowest, key=lambda r: r["lowest"])]
    number = F.coalesce(*[F.when(F.col("prediction") == p, F.lit(i)) for i, p in enumerate(order)])
    centres = model.clusterCenters()
    assigned = written(labelled.select(key, number.cast("int").alias("cluster_number")))
    laid_out.unpersist()
    return Clustering(
        assigned,
        [centres[p].tolist() for p in order],
        cost,
        seed,
    )


def _one_cluster(vectors: DataFrame, key: str, features: str, seed: int) -> Clustering:
    """Every row in cluster 0 around the mean of all; k-means itself starts at two."""
    assigned = written(vectors.select(key, F.lit(0).alias("cluster_number")))
    whole = vectors.select(F.lit(0).alias("cluster_number"), features)
    mean = list(centroids(whole, "cluster_number", features).first()["centre"])
    cost = inertia(nearest_centre(vectors, features, {0: mean})).first()["inertia"]
    return Clustering(assigned, [mean], cost, seed)


def centroids(points: DataFrame, cluster: str, features: str) -> DataFrame:
    """``cluster, centre``: mean vector per label, summed before the shuffle."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    return (
        points.select(cluster, vector.alias("v"))
        .groupBy(cluster)
        .agg(Summarizer.mean(F.col("v")).alias("v"))
        .select(cluster, vector_to_array("v").alias("centre"))
    )


def nearest_centre(points: DataFrame, features: str, centres: dict[int, list[float]]) -> DataFrame:
    """Add ``nearest STRUCT<cluster_number, squared_distance>``.

    ``centres`` is a fitted model: k rows. Equal distances go to the lower number.
    """
    numbers = np.array(sorted(centres))
    matrix = np.array([centres[n] for n in numbers])

    @F.pandas_udf("cluster_number int, squared_distance double")
    def run(batch: pd.Series) -> pd.DataFrame:
        x = np.stack(batch.to_numpy()).astype(float)
        square = ((x * x).sum(1)[:, None] + (matrix * matrix).sum(1)[None, :]) - 2 * x @ matrix.T
        chosen = np.round(square, 9).argmin(axis=1)
        rest = x - matrix[chosen]
        return pd.DataFrame(
            {"cluster_number": numbers[chosen], "squared_distance": (rest * rest).sum(1)}
        )

    return points.withColumn("nearest", run(F.col(features).cast("array<double>")))


def inertia(assigned: DataFrame) -> DataFrame:
    """One row ``points, inertia`` for the output of ``nearest_centre``."""
    return assigned.agg(
        F.count("*").alias("points"), F.sum("nearest.squared_distance").alias("inertia")
    )


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster_number") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count("*").alias("size"))


def cluster_members(assigned: DataFrame, key: str, cluster: str = "cluster_number") -> DataFrame:
    """Members in long form with the cluster's name and size.

    Sizes are one row per cluster; Spark broadcasts them by their known size.
    """
    return assigned.join(cluster_sizes(assigned, cluster), cluster).select(
        F.format_string(fixed.CLUSTER_ID_FORMAT, F.col(cluster).cast("string")).alias("cluster_id"),
        F.col(cluster).alias("cluster_number"),
        key,
        "size",
    )


def first_match(left: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """Equi-join to the first record of each key; later records never match."""
    fields = [c for c in records.columns if c != key]
    first = records.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_first"))
    return left.join(first, key, "left").select(*left.columns, "_first.*")


def cluster_theme_counts(themes: DataFrame, cluster: str = "cluster_number") -> DataFrame:
    """All themes of each cluster, whatever number is shown."""
    strength = F.coalesce("strength", F.lit(fixed.DEFAULT_STRENGTH))
    return themes.groupBy(cluster).agg(
        F.count("*").alias("themes_analyzed"), F.avg(strength).alias("mean_strength")
    )


def shown_themes(
    themes: DataFrame, article: str, limit: int, cluster: str = "cluster_number"
) -> DataFrame:
    """The first themes of each cluster, in article then theme order.

    The rank filter is applied per task ahead of the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(article, "theme_no"))
    return themes.withColumn("shown_no", rank).where(F.col("shown_no") <= limit)


def shown_theme_lines(
    themes: DataFrame, article: str, limit: int, cluster: str = "cluster_number"
) -> DataFrame:
    """``cluster, lines``: at most ``limit`` theme lines per cluster."""
    line = theme_line(F.col(article).cast("string"), F.col("name"), F.col("description"))
    return (
        shown_themes(themes, article, limit, cluster)
        .groupBy(cluster)
        .agg(F.array_sort(F.collect_list(F.struct("shown_no", line.alias("line")))).alias("l"))
        .select(cluster, F.col("l.line").alias("lines"))
    )


def with_analysis(clusters: DataFrame, analysis: DataFrame) -> DataFrame:
    """Clusters with their description and fallback names, one to one."""
    return clusters.join(analysis, "cluster_number", "left").withColumns(
        {
            "display_name": F.coalesce(
                "cluster_name",
                F.format_string(
                    fixed.CLUSTER_NAME_FALLBACK, F.col("cluster_number").cast("string")
                ),
            ),
            "display_theme": F.coalesce("main_theme", F.lit(fixed.THEME_FALLBACK)),
        }
    )
