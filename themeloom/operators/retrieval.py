"""Chunks, chunk vectors, the term graph and the three search modes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.text import words
from themeloom.operators.arrays import exploded
from themeloom.operators.storage import written
from themeloom.operators.terms import counted_terms, idf, with_terms

QUERIES_PER_PASS = 1000
SALTS = 16
FREQUENT_TERMS = 100_000  # terms rated inside the tasks; rarer ones by a join


def chunks(articles: DataFrame, key: str, content: str, size: int, overlap: int) -> DataFrame:
    """``key, chunk_no, text``: word windows of ``size``, overlapping; no shuffle."""
    step = size - overlap
    split = articles.select(key, words(F.col(content)).alias("_words"))
    # NULL for a text without words, and no filter that would split texts twice
    starts = F.when(
        F.array_size("_words") > 0, F.sequence(F.lit(0), F.array_size("_words") - 1, F.lit(step))
    )
    pieces = F.transform(
        starts, lambda s: F.array_join(F.slice("_words", s + 1, F.lit(size)), " ")
    )
    out = split.select(key, F.posexplode_outer(pieces).alias("chunk_no", "text"))
    return out.where(F.col("chunk_no").isNotNull())


def hashed_vector(terms: Column, dim: int) -> Column:
    """Term counts hashed to ``dim`` slots; the default chunk vector.

    Slots are computed by Spark, only counting is done on Arrow batches.
    """

    @F.pandas_udf("array<double>")
    def count(slots: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(s, minlength=dim).astype(float) for s in slots])

    number = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dim)).cast("int")
    return count(F.transform(terms, number))


def chunk_vectors(
    pieces: DataFrame, key: str, dim: int, stop_words: Iterable[str] | None = None
) -> DataFrame:
    return with_terms(pieces, "text", stop_words).select(
        key, "chunk_no", hashed_vector(F.col("terms"), dim).alias("embedding")
    )


def vector_topk(
    vectors: DataFrame,
    keys: list[str],
    embedding: str,
    queries: list[tuple[str, list[float]]],
    k: int,
) -> DataFrame:
    """``query_id, keys, score, rank``: the ``k`` most similar rows by cosine.

    Questions come from the caller, so they are few; more than
    ``QUERIES_PER_PASS`` are worked in several passes. Every batch keeps only its
    own top ``k`` before anything is shuffled. Equal scores go by key.
    """
    key_fields = [vectors.schema[c] for c in keys]
    schema = T.StructType(
        [
            T.StructField("query_id", T.StringType()),
            *key_fields,
            T.StructField("score", T.DoubleType()),
        ]
    )
    rows = vectors.select(*keys, F.col(embedding).cast("array<double>").alias("_v"))
    found = None
    for start in range(0, max(len(queries), 1), QUERIES_PER_PASS):
        part = queries[start : start + QUERIES_PER_PASS]
        passed = rows.mapInPandas(_scorer(part, keys, k), schema)
        found = passed if found is None else found.unionByName(passed)
    order = [F.desc("score"), *[F.asc(c) for c in keys]]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _scorer(queries: list[tuple[str, list[float]]], keys: list[str], k: int):
    ids = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], dtype=float)

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty or not ids:
                continue
            ordered = batch.sort_values(keys)
            scores = np.round(unit(matrix) @ unit(np.stack(ordered["_v"].to_numpy())).T, 9)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            kept = ordered[keys].iloc[top.ravel()].reset_index(drop=True)
            kept.insert(0, "query_id", np.repeat(ids, top.shape[1]))
            kept["score"] = np.take_along_axis(scores, top, axis=1).ravel()
            yield kept

    return run


def _known_idf(terms: list[str], values: list[float]):
    """The idf of each term of a chunk, NULL for a term not listed."""

    @F.arrow_udf("array<double>")
    def look_up(rows: pa.Array) -> pa.Array:
        place = pc.index_in(rows.flatten(), value_set=pa.array(terms, pa.string()))
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float64()).take(place))

    return look_up


def _merged_chunks(counted: DataFrame, chunk: list[str]) -> DataFrame:
    """``counted`` with one row per chunk: rows of a repeated key are added up."""
    repeated = written(counted.groupBy(*chunk).count().where(F.col("count") > 1).drop("count"))
    if repeated.isEmpty():
        return counted
    names = {c: f"_r_{c}" for c in chunk}
    other = repeated.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    rows = counted.join(other, same, "left_semi").select(*chunk, F.explode(F.arrays_zip("terms", "tf")).alias("e"))
    sums = rows.groupBy(*chunk, "e.terms").agg(F.sum("e.tf").alias("tf"))
    added = sums.groupBy(*chunk).agg(F.collect_list(F.struct("terms", "tf")).alias("r"))
    added = added.select(*chunk, F.col("r.terms").alias("terms"), F.col("r.tf").alias("tf"))
    return written(counted.join(other, same, "left_anti").unionByName(added))


def key_terms(
    pieces: DataFrame, key: str, per_chunk: int, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """``key, chunk_no, terms``: the heaviest terms of each chunk, sorted by name.

    Weight is tf-idf over all chunks, equal weights go by term. Terms are counted
    inside their chunk and written once. The ``FREQUENT_TERMS`` most common terms, a
    bounded list, are sent to the tasks and rated there; only occurrences of rarer
    terms, of which each is in few chunks, are joined with their idf by a shuffle.
    """
    chunk = [key, "chunk_no"]
    counted = written(counted_terms(with_terms(pieces, "text", stop_words), chunk))
    number = counted.count()
    statistics = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rated = written(statistics.select("term", "df", idf(F.lit(number), F.col("df")).alias("idf")))
    top = rated.orderBy(F.desc("df"), F.asc("term")).limit(FREQUENT_TERMS).select("term", "idf").collect()
    known = _known_idf([r["term"] for r in top], [r["idf"] for r in top])
    entries = F.transform(
        "terms",
        lambda t, i: F.struct(
            (-F.round(F.get("tf", i) * F.get("_idf", i), 6)).alias("w"), t.alias("term"), F.get("tf", i).alias("tf")
        ),
    )
    looked = _merged_chunks(counted, chunk).withColumn("_idf", known("terms")).select(*chunk, entries.alias("_e"))
    best = F.slice(F.array_sort(F.filter("_e", lambda e: e["w"].isNotNull())), 1, per_chunk)
    if rated.count() <= len(top):
        best = best.getField("term")
        return looked.where(F.array_size("_e") > 0).select(*chunk, F.array_sort(best).alias("terms"))
    parted = written(
        looked.select(*chunk, best.alias("_best"), F.filter("_e", lambda e: e["w"].isNull()).alias("_rare"))
    )
    weight = (-F.round(F.col("tf") * F.col("idf"), 6)).alias("w")
    rare = parted.select(*chunk, F.explode("_rare").alias("e")).select(*chunk, "e.term", "e.tf")
    rare = rare.join(rated, "term").select(*chunk, weight, "term")
    both = rare.unionByName(parted.select(*chunk, F.explode("_best").alias("e")).select(*chunk, "e.w", "e.term"))
    ranked = both.groupBy(*chunk).agg(F.array_sort(F.collect_list(F.struct("w", "term"))).alias("b"))
    return ranked.select(*chunk, F.array_sort(F.slice("b.term", 1, per_chunk)).alias("terms"))


def graph_nodes(keyed: DataFrame) -> DataFrame:
    return (
        exploded(keyed, [], "terms", "term")
        .groupBy("term")
        .agg(F.count("*").alias("chunks"))
    )


def _pairs(terms: Column) -> Column:
    """All a < b of one chunk's few key terms, built inside the row."""
    return F.flatten(
        F.transform(
            terms,
            lambda a, i: F.transform(
                F.slice(terms, i + 2, F.greatest(F.array_size(terms) - i - 1, F.lit(0))),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )


def graph_edges(keyed: DataFrame) -> DataFrame:
    """``a, b, weight``: how many chunks share two key terms; a < b."""
    return (
        exploded(keyed, [], _pairs(F.col("terms")), "e")
        .groupBy("e.a", "e.b")
        .agg(F.count("*").alias("weight"))
    )


def _touching(edges: DataFrame, terms: list[str]) -> DataFrame:
    return edges.where(F.col("a").isin(terms) | F.col("b").isin(terms))


def _top(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Global top ``k`` with ranks; the window sees ``k`` rows only."""
    order = [F.desc("score"), *[F.asc(c) for c in keys]]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def retrieve_local(
    keyed: DataFrame, edges: DataFrame, terms: list[str], key: str, neighbours: int, k: int
) -> DataFrame:
    """Chunks that hold the question's terms or their closest neighbours.

    A question term counts one, a neighbour its edge weight over the largest.
    """
    ends = _touching(edges, terms).select(
        F.explode(
            F.array(
                F.when(F.col("b").isin(terms), F.struct(F.col("a").alias("term"), "weight")),
                F.when(F.col("a").isin(terms), F.struct(F.col("b").alias("term"), "weight")),
            )
        ).alias("n")
    )
    near = (
        ends.where(F.col("n").isNotNull())
        .groupBy("n.term")
        .agg(F.max("n.weight").alias("weight"))
        .where(~F.col("term").isin(terms))
        .orderBy(F.desc("weight"), F.asc("term"))
        .limit(neighbours)
    )
    near = near.select(
        "term", (F.col("weight") / F.max("weight").over(W.partitionBy())).alias("relevance")
    )
    # at most len(terms) + neighbours rows
    asked = keyed.sparkSession.createDataFrame(
        [(t, 1.0) for t in terms], "term string, relevance double"
    )
    wanted = F.broadcast(near.unionByName(asked))
    scored = (
        keyed.select(key, "chunk_no", F.explode("terms").alias("term"))
        .join(wanted, "term")
        .groupBy(key, "chunk_no")
        .agg(F.round(F.sum("relevance"), 6).alias("score"))
    )
    return _top(scored, [key, "chunk_no"], k)


def retrieve_global(
    keyed: DataFrame, edges: DataFrame, terms: list[str], key: str, k: int
) -> DataFrame:
    """Chunks ranked by the weight of the edges at the question's terms they hold.

    One edge may be in a third of all chunks, so edges are copied over salts.
    """
    pairs = F.filter(
        _pairs(F.col("terms")), lambda e: e["a"].isin(terms) | e["b"].isin(terms)
    )
    held = (
        keyed.where(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in terms])))
        .select(key, "chunk_no", F.explode(pairs).alias("e"))
        .select(
            key,
            "chunk_no",
            "e.a",
            "e.b",
            F.pmod(F.xxhash64(key, "chunk_no"), F.lit(SALTS)).cast("int").alias("_salt"),
        )
    )
    salted = _touching(edges, terms).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    scored = (
        held.join(salted, ["a", "b", "_salt"])
        .groupBy(key, "chunk_no")
        .agg(F.sum("weight").cast("double").alias("score"))
    )
    return _top(scored, [key, "chunk_no"], k)


def retrieve_hybrid(ranked: list[DataFrame], key: str, k: int) -> DataFrame:
    """Best rank of each chunk over several searches, then the first ``k``."""
    both = None
    for one in ranked:
        part = one.select(key, "chunk_no", "rank")
        both = part if both is None else both.unionByName(part)
    best = both.groupBy(key, "chunk_no").agg(
        F.min("rank").alias("best_rank"), F.count("*").alias("found_by")
    )
    order = [F.asc("best_rank"), F.asc(key), F.asc("chunk_no")]
    top = best.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))
