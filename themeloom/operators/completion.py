"""Calling a caller-supplied text or embedding function on every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complete(requests: DataFrame, respond: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Add ``response`` and ``error``: one failing prompt never fails the job.

    Rows whose prompt is NULL are passed on without a call. The number of
    partitions is the number of concurrent callers. Write the result before
    using it twice, so that a paid call is not repeated.
    """
    schema = T.StructType(
        [
            *requests.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return respond(text), None
        except Exception as problem:
            return None, str(problem) or type(problem).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [one(text) for text in batch[prompt]]
            batch["response"] = pd.Series([a for a, _ in answers], dtype=object, index=batch.index)
            batch["error"] = pd.Series([e for _, e in answers], dtype=object, index=batch.index)
            yield batch

    return requests.mapInPandas(run, schema)


def embed(rows: DataFrame, text: str, vectors_of: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Add ``embedding`` from a function that takes a list of texts per batch."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in vectors_of(batch.tolist())])

    return rows.withColumn("embedding", run(F.col(text)))
