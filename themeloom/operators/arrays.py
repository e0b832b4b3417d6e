"""Turning arrays into rows, and work inside an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, keys: list[str], values: str | Column, name: str) -> DataFrame:
    """One row per element of an array that is costly to compute.

    A plain explode makes the optimizer filter on the array's size below the
    projection, which computes the array twice; the outer form does not.
    """
    out = rows.select(*keys, F.explode_outer(values).alias(name))
    return out.where(F.col(name).isNotNull())


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(ordered: Column, of: Callable[[Column], Column]) -> Column:
    """The runs of elements with equal ``of`` in an ordered array, as arrays."""

    def cut(v: Column) -> Column:
        n = F.array_size(v)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        last = F.filter(places, lambda i: ~of(F.get(v, i - 1)).eqNullSafe(of(F.get(v, i))))
        return bound(last, lambda ends: F.transform(ends, lambda i, k: run(v, F.coalesce(F.get(ends, k - 1), F.lit(0)), i)))

    def run(v: Column, before: Column, last: Column) -> Column:
        # a slice would copy the whole array for each run
        return F.transform(F.sequence(before, last - 1), lambda at: F.get(v, at))

    return bound(ordered, cut)


def by_value(rows: Column, of: Callable[[Column], Column]) -> Column:
    """``array<struct<id, rows>>``: the elements of each value of ``of``, NULL being one."""
    ids = F.array_distinct(F.transform(rows, of))
    alone = F.transform(rows, lambda r: F.struct(of(r).alias("id"), F.array(r).alias("rows")))

    def grouped(ids: Column) -> Column:
        several = F.transform(
            ids, lambda x: F.struct(x.alias("id"), F.filter(rows, lambda r: of(r).eqNullSafe(x)).alias("rows"))
        )
        return F.when(F.array_size(ids) == F.array_size(rows), alone).otherwise(several)

    return bound(ids, grouped)
