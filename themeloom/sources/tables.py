"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """A parquet table; with ``keys``, spread when its files give too few tasks.

    Text work costs far more than moving the text once, so a table of one or two
    row groups is hashed over all cores. A table with splits enough is untouched.
    """
    table = spark.read.parquet(path)
    if keys is None:
        return table
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, *keys)
