"""Which rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the rows that tests are made on; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(rows: DataFrame, doc_id: str, bound: int, n: int | None = None) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of the id; all if there are no more."""
    n = rows.count() if n is None else n
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), doc_id), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
