"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.storage import shared_folder, written

# White space and word characters of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BROADCAST_ROWS = 200_000


def spaced_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(doc_id: str, text: str) -> Column:
    """What a row is told by: equal rows share it, and get equal results.

    Joins and groups by it hold with NULL and repeated ids, and it is the same in
    every pass over the table, which a running number is not.
    """
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))


def packed(df: DataFrame) -> DataFrame:
    """As ``written``, for rows that hold texts: compressed more tightly."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with column ``name``, evaluated once per row whatever is done with it.

    A plain column is put in the place of every later mention, also inside the loop of
    a filter or a lambda, where it is evaluated once per element.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` for the small side of a join: broadcast only if it is known to be small.

    ``table`` should be a stored one, since it is counted first. Beyond ``rows`` the
    planner joins it by a shuffle, with the same result.
    """
    return F.broadcast(table) if table.count() <= rows else table


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest member per node of ``edges`` (a, b): columns node, root.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing
    changes. Every step is written to the shared folder. The smallest neighbour is
    aggregated before the shuffle and joined back, so that a hub is split by the join
    and no neighbourhood is gathered. NULL nodes and loops are left out.
    """
    links = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        # a hub's small and large neighbours all point to its smallest one
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a"))
        links = written(_star(large, F.lit(True)))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _star(pairs: DataFrame, of: Column) -> DataFrame:
    """Links (larger, smaller): the neighbours of ``of`` kind, and the node, to the least one."""
    least = written(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    moved = pairs.where(of).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return (
        moved.unionByName(own)
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
