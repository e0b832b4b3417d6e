"""A term store that grows by inserts: postings and edges laid out by term bucket.

Layout under ``folder`` (all Parquet, any file system Spark reads):

- ``documents``: key, text hash, chunks and insert id of every inserted document;
  an insert counts only once its rows are here (written last), so files of an insert
  that died are never read, and a rerun adds them anew;
- ``chunks``: key, chunk_no, text, key terms; partitioned by a hash of the key, so
  texts of found chunks are read from their parts only;
- ``postings``: term, key, chunk_no; partitioned by a hash of the term;
- ``edges``: term, other, weight (each pair of key terms of a chunk, under both its
  terms); partitioned by a hash of ``term``;
- ``nodes``: term, chunks (how many chunks hold it as a key term); likewise.

Key terms are chunk-local (the ``per_chunk`` most frequent terms of the chunk, ties by
term), so postings, edge weights and node counts of an insert are deltas that add up:
two inserts give the same store as one of both, and a repeated insert of a key changes
nothing. A question reads the buckets of its terms (and of its neighbours) only.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import retrieval as R
from themeloom.operators.storage import written
from themeloom.operators.terms import with_terms
from themeloom.settings import Settings

TERM_BUCKETS = 64
KEY_PARTS = 64


def bucket_of(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def part_of(key) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def _top_terms(per_chunk: int):
    @F.pandas_udf("array<string>")
    def top(terms: pd.Series) -> pd.Series:
        out = []
        for t in terms:
            counted = Counter(t) if t is not None else Counter()
            best = sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:per_chunk]
            out.append(sorted(term for term, _ in best))
        return pd.Series(out)

    return top


def _committed(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """Rows of ``name`` written by inserts that reached the documents table."""
    if not _exists(spark, f"{folder}/documents"):
        return None
    done = spark.read.parquet(f"{folder}/documents").select("insert_id").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(done), "insert_id")


def _one_per_key(rows: DataFrame) -> DataFrame:
    """``key, text, text_hash``; only texts of keys that come again are moved."""
    rows = rows.select("key", "text", F.xxhash64("text").alias("text_hash"))
    again = written(rows.groupBy("key").count().where(F.col("count") > 1).select("key"))
    if again.isEmpty():
        return rows
    some = rows.join(again, "key", "left_semi").groupBy("key").agg(
        F.min_by(F.struct("text", "text_hash"), F.struct("text_hash", "text")).alias("r")
    )
    return rows.join(again, "key", "left_anti").unionByName(some.select("key", "r.text", "r.text_hash"))


def insert(articles: DataFrame, key: str, text: str, folder: str, settings: Settings = Settings()) -> dict:
    """Add the documents of ``articles`` whose key is not in the store yet.

    Of several rows with one new key, the one with the smallest text hash (then text)
    is taken; rows with a NULL key are not inserted. Returns counts of inserted and
    skipped rows.
    """
    spark = articles.sparkSession
    insert_id = uuid.uuid4().hex
    rows = articles.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    one = _one_per_key(rows)
    known = spark.read.parquet(f"{folder}/documents").select("key") if _exists(spark, f"{folder}/documents") else None
    new = written(one.join(known, "key", "left_anti") if known is not None else one)
    total, fresh = articles.count(), new.count()
    if fresh == 0:
        return {"inserted": 0, "skipped": total}
    pieces = R.chunks(new, "key", "text", settings.chunk_words, settings.chunk_overlap)
    keyed = with_terms(pieces, "text").withColumn("key_terms", _top_terms(settings.chunk_key_terms)(F.col("terms"))).drop("terms")
    keyed = written(keyed.withColumn("insert_id", F.lit(insert_id)))
    keyed.withColumn("part", part_of(F.col("key"))).write.mode("append").partitionBy("part").parquet(f"{folder}/chunks")
    posted = keyed.select("key", "chunk_no", F.explode("key_terms").alias("term"))
    posted.withColumn("bucket", bucket_of(F.col("term"))).withColumn("insert_id", F.lit(insert_id)).write.mode(
        "append"
    ).partitionBy("bucket").parquet(f"{folder}/postings")
    pairs = R.graph_edges(keyed.select(F.col("key_terms").alias("terms")))
    both = pairs.select(F.col("a").alias("term"), F.col("b").alias("other"), "weight").unionByName(
        pairs.select(F.col("b").alias("term"), F.col("a").alias("other"), "weight")
    )
    both.withColumn("bucket", bucket_of(F.col("term"))).withColumn("insert_id", F.lit(insert_id)).write.mode(
        "append"
    ).partitionBy("bucket").parquet(f"{folder}/edges")
    nodes = posted.groupBy("term").agg(F.count("*").alias("chunks"))
    nodes.withColumn("bucket", bucket_of(F.col("term"))).withColumn("insert_id", F.lit(insert_id)).write.mode(
        "append"
    ).partitionBy("bucket").parquet(f"{folder}/nodes")
    counts = keyed.groupBy("key").agg(F.count("*").alias("chunks"))
    # last: the insert becomes visible
    new.select("key", "text_hash").join(counts, "key", "left").fillna(0, ["chunks"]).withColumn(
        "insert_id", F.lit(insert_id)
    ).write.mode("append").parquet(f"{folder}/documents")
    return {"inserted": fresh, "skipped": total - fresh}


def _by_terms(spark: SparkSession, folder: str, name: str, terms: list[str]) -> DataFrame:
    """Rows of ``name`` for ``terms``, read from the folders of their buckets only."""
    buckets = sorted({int(r[0]) for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"))).collect()})
    table = _committed(spark, folder, name)
    return table.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def edges_of(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """term, other, weight of the question terms, summed over inserts."""
    return _by_terms(spark, folder, "edges", terms).groupBy("term", "other").agg(F.sum("weight").alias("weight"))


def local(spark: SparkSession, folder: str, terms: list[str], neighbours: int, k: int) -> DataFrame:
    """key, chunk_no, score, rank: chunks holding the question's terms (1 each) or
    their strongest neighbours (edge weight over the largest)."""
    if not terms or not _exists(spark, f"{folder}/documents"):
        return spark.createDataFrame([], "key string, chunk_no int, score double, rank int")
    near = (
        edges_of(spark, folder, terms).where(~F.col("other").isin(terms))
        .groupBy("other").agg(F.max("weight").alias("weight"))
        .orderBy(F.desc("weight"), F.asc("other")).limit(neighbours).collect()
    )
    top = max([r["weight"] for r in near], default=1)
    relevance = {t: 1.0 for t in terms} | {r["other"]: r["weight"] / top for r in near}
    wanted = spark.createDataFrame(list(relevance.items()), "term string, relevance double")
    scored = (
        _by_terms(spark, folder, "postings", list(relevance))
        .join(F.broadcast(wanted), "term")
        .groupBy("key", "chunk_no").agg(F.round(F.sum("relevance"), 6).alias("score"))
    )
    return R._top(scored, ["key", "chunk_no"], k)


def global_(spark: SparkSession, folder: str, terms: list[str], k: int) -> DataFrame:
    """key, chunk_no, score, rank: chunks by the summed weight of the edges at the
    question's terms between their key terms."""
    if not terms or not _exists(spark, f"{folder}/documents"):
        return spark.createDataFrame([], "key string, chunk_no int, score double, rank int")
    held = _by_terms(spark, folder, "postings", terms).select("key", "chunk_no").distinct()
    parts = sorted({int(r[0]) for r in held.select(part_of(F.col("key"))).distinct().collect()})
    chunks = _committed(spark, folder, "chunks").where(F.col("part").isin(parts))
    mine = chunks.join(held, ["key", "chunk_no"]).select("key", "chunk_no", "key_terms")
    pairs = mine.select("key", "chunk_no", F.explode(R._pairs(F.col("key_terms"))).alias("e")).where(
        F.col("e.a").isin(terms) | F.col("e.b").isin(terms)
    )
    weights = edges_of(spark, folder, terms)
    # an edge (a, b) is stored under both terms: look it up under one of the question's
    scored = (
        pairs.select("key", "chunk_no", F.when(F.col("e.a").isin(terms), F.col("e.a")).otherwise(F.col("e.b")).alias("term"),
                     F.when(F.col("e.a").isin(terms), F.col("e.b")).otherwise(F.col("e.a")).alias("other"))
        .join(weights, ["term", "other"])
        .groupBy("key", "chunk_no").agg(F.sum("weight").cast("double").alias("score"))
    )
    return R._top(scored, ["key", "chunk_no"], k)


def texts_of(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """``found`` with the chunk texts, read from the parts of its keys only."""
    parts = sorted({int(r[0]) for r in found.select(part_of(F.col("key"))).distinct().collect()})
    chunks = _committed(spark, folder, "chunks").where(F.col("part").isin(parts)).select("key", "chunk_no", "text")
    return chunks.join(F.broadcast(found), ["key", "chunk_no"])
