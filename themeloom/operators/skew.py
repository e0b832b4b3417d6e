"""Joins and groups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.storage import written

HOT_KEYS = 1000
HOT_ROWS = 100_000
SALTS = 64
GROUP_ROWS = 1000  # rows of a group that are worked as one row, at most
GROUP_CHARS = 1_000_000  # and their characters


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per key.

    ``weight`` is the table's column with the number of rows each key meets. The
    table is written first: it is small beside the rows, and deriving it twice
    would read the corpus twice. If no key meets more than ``HOT_ROWS`` rows the
    join is a plain one. Else the ``HOT_KEYS`` heaviest keys, a list bounded by
    that limit and so safe to broadcast, are spread over ``SALTS`` by a hash of
    ``spread``; any other key meets at most one in ``HOT_KEYS`` of all rows. Rows
    with a NULL key, which an outer join keeps, are spread as well.
    """
    table = written(table)
    heavy = table.where(F.col(weight) > HOT_ROWS).select(*keys, weight)
    if heavy.isEmpty():
        return rows.join(table, keys, how)
    heaviest = heavy.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = F.broadcast(heaviest.select(*keys, F.lit(True).alias("_hot")))
    loose = F.col("_hot").isNotNull()
    for key in keys:
        loose = loose | F.col(key).isNull()
    salt = F.when(loose, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    many = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot").isNotNull(), F.lit(SALTS - 1)).otherwise(0)
    one = (
        table.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_hot")
    )
    return many.join(one, [*keys, "_salt"], how).drop("_salt")


def split_groups(
    rows: DataFrame, within: list[str], chars: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary groups, and those of groups too large for one row, if any.

    A group is large if it has more than ``GROUP_ROWS`` rows or, where ``chars`` gives
    a row's characters, more than ``GROUP_CHARS`` of them.
    """
    total = F.lit(0) if chars is None else F.coalesce(F.sum(chars), F.lit(0))
    sizes = rows.groupBy(*within).agg(F.count("*").alias("_n"), total.alias("_chars"))
    names = [f"_w{i}" for i in range(len(within))]
    large = written(
        sizes.where((F.col("_n") > GROUP_ROWS) | (F.col("_chars") > GROUP_CHARS)).select(
            *[F.col(c).alias(g) for c, g in zip(within, names)]
        )
    )
    if large.isEmpty():
        return rows, None
    on = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(within, names)]
    return rows.join(large, on, "left_anti"), rows.join(large, on, "left_semi")
