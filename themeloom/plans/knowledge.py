"""The searchable store: chunks, chunk vectors, key terms and the term graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import metadata_envelope, tokens, without_stop_words
from themeloom.operators import retrieval as R
from themeloom.operators.completion import embed
from themeloom.operators.rollups import corpus_totals
from themeloom.settings import Settings

TABLES = ("chunks", "vectors", "key_terms", "edges")
MODES = ("local", "global", "hybrid", "vector")


@dataclass(frozen=True)
class Store:
    key: str
    chunks: DataFrame
    vectors: DataFrame
    key_terms: DataFrame
    edges: DataFrame


def build_store(
    articles: DataFrame,
    key: str,
    folder: str,
    settings: Settings = Settings(),
    vectors_of: Callable[[list[str]], list[list[float]]] | None = None,
) -> DataFrame:
    """Write the store's tables; returns the counts of taken and failed documents.

    ``articles`` has ``key, filename, content, word_count, error``.
    """
    ready = articles.where(F.col("error").isNull()).select(
        key,
        metadata_envelope(F.col("filename"), F.col("word_count"), F.col("content")).alias("text"),
    )
    spark = articles.sparkSession
    pieces = R.chunks(ready, key, "text", settings.chunk_words, settings.chunk_overlap)
    pieces.write.mode("overwrite").parquet(f"{folder}/chunks")
    pieces = spark.read.parquet(f"{folder}/chunks")
    if vectors_of is None:
        vectors = R.chunk_vectors(pieces, key, settings.embedding_dim)
    else:
        vectors = embed(pieces, "text", vectors_of).drop("text")
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    R.key_terms(pieces, key, settings.chunk_key_terms).write.mode("overwrite").parquet(
        f"{folder}/key_terms"
    )
    keyed = spark.read.parquet(f"{folder}/key_terms")
    R.graph_edges(keyed).write.mode("overwrite").parquet(f"{folder}/edges")
    return corpus_totals(articles)


def open_store(spark: SparkSession, key: str, folder: str) -> Store:
    return Store(key, *[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


def question_terms(spark: SparkSession, question: str) -> list[str]:
    """Distinct terms of one question, by the same rule as article terms."""
    one = spark.createDataFrame([(question,)], "q string")
    terms = without_stop_words(tokens(F.col("q")))
    return one.select(F.array_distinct(terms).alias("t")).first()["t"]


def search(
    store: Store,
    question: str,
    mode: str = "hybrid",
    settings: Settings = Settings(),
    vectors_of: Callable[[list[str]], list[list[float]]] | None = None,
) -> DataFrame:
    """``key, chunk_no, rank, text`` of the best chunks for a question."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = store.chunks.sparkSession
    terms = question_terms(spark, question)
    ranked = []
    if mode in ("local", "hybrid"):
        ranked.append(
            R.retrieve_local(
                store.key_terms, store.edges, terms, store.key, settings.neighbours, settings.top_k
            )
        )
    if mode in ("global", "hybrid"):
        ranked.append(
            R.retrieve_global(store.key_terms, store.edges, terms, store.key, settings.top_k)
        )
    if mode in ("vector", "hybrid"):
        ranked.append(_vector_search(store, question, settings, vectors_of))
    found = R.retrieve_hybrid(ranked, store.key, settings.top_k)
    # at most top_k rows against the chunk table
    return store.chunks.join(
        F.broadcast(found.select(store.key, "chunk_no", "rank")), [store.key, "chunk_no"]
    ).orderBy("rank")


def _vector_search(store: Store, question: str, settings: Settings, vectors_of) -> DataFrame:
    if vectors_of is not None:
        vector = list(vectors_of([question])[0])
    else:
        spark = store.chunks.sparkSession
        one = spark.createDataFrame([(question,)], "q string")
        terms = without_stop_words(tokens(F.col("q")))
        hashed = R.hashed_vector(F.col("t"), settings.embedding_dim)
        vector = one.select(terms.alias("t")).select(hashed.alias("v")).first()["v"]
    return R.vector_topk(
        store.vectors, [store.key, "chunk_no"], "embedding", [(question, vector)], settings.top_k
    )
