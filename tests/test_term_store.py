"""The growing term store: inserts add up, repeats change nothing, searches read buckets."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeloom.operators.storage import shared_folder
from themeloom.plans import term_store as S
from themeloom.settings import Settings

SETTINGS = Settings(chunk_words=12, chunk_overlap=2, chunk_key_terms=3)
rng = random.Random(2)
WORDS = ["river", "stone", "bread", "lamp", "north", "garden", "copper", "violin", "harbour", "meadow", "pencil", "orbit"]


def docs(spark, ids):
    rows = [(str(i), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in ids]
    return spark.createDataFrame(rows + [(None, "lamp lamp")], "doc_id string, text string")


def state(spark, folder):
    c = lambda name: S._committed(spark, folder, name)
    return (
        sorted(tuple(r) for r in c("chunks").select("key", "chunk_no", "text", "key_terms").collect()),
        sorted(tuple(r) for r in c("postings").select("term", "key", "chunk_no").collect()),
        sorted(tuple(r) for r in c("edges").groupBy("term", "other").agg(F.sum("weight")).collect()),
        sorted(tuple(r) for r in c("nodes").groupBy("term").agg(F.sum("chunks")).collect()),
    )


@pytest.fixture(scope="module")
def tables(spark):
    a, b = docs(spark, range(0, 30)), docs(spark, range(30, 55))
    return a.cache(), b.cache()


def folder_for(spark):
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def test_two_inserts_equal_one_build(spark, tables):
    a, b = tables
    two, one = folder_for(spark), folder_for(spark)
    assert S.insert(a, "doc_id", "text", two, SETTINGS)["inserted"] == 30
    S.insert(b, "doc_id", "text", two, SETTINGS)
    S.insert(a.unionByName(b), "doc_id", "text", one, SETTINGS)
    assert state(spark, two) == state(spark, one)
    before = state(spark, two)
    assert S.insert(a, "doc_id", "text", two, SETTINGS) == {"inserted": 0, "skipped": 31}
    assert state(spark, two) == before


def test_unfinished_insert_is_not_read(spark, tables):
    a, _ = tables
    folder = folder_for(spark)
    S.insert(a, "doc_id", "text", folder, SETTINGS)
    before = state(spark, folder)
    # files of an insert that never reached the documents table
    stray = spark.createDataFrame([("lamp", "x", 0, 1, "dead")], "term string, key string, chunk_no int, bucket int, insert_id string")
    stray.write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    assert state(spark, folder) == before


def brute(spark, frame):
    """Key terms, edges and the two scores from all chunks at once."""
    rows = [r for r in S._committed(spark, frame, "chunks").select("key", "chunk_no", "key_terms").collect()]
    edges = Counter()
    for r in rows:
        t = r["key_terms"]
        for i in range(len(t)):
            for j in range(i + 1, len(t)):
                edges[(t[i], t[j])] += 1
    return rows, edges


def test_searches_against_brute_force(spark, tables):
    a, b = tables
    folder = folder_for(spark)
    S.insert(a.unionByName(b), "doc_id", "text", folder, SETTINGS)
    rows, edges = brute(spark, folder)
    terms = ["lamp", "orbit"]
    near = Counter()
    for (x, y), w in edges.items():
        if x in terms and y not in terms:
            near[y] = max(near[y], w)
        if y in terms and x not in terms:
            near[x] = max(near[x], w)
    best = sorted(near.items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    relevance = {t: 1.0 for t in terms} | {t: w / best[0][1] for t, w in best}
    scores = {(r["key"], r["chunk_no"]): round(sum(relevance.get(t, 0) for t in r["key_terms"]), 6) for r in rows}
    want = sorted(((k, s) for k, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:5]
    got = [((r["key"], r["chunk_no"]), r["score"]) for r in S.local(spark, folder, terms, 4, 5).orderBy("rank").collect()]
    assert got == want
    glob = {}
    for r in rows:
        t = r["key_terms"]
        if set(t) & set(terms):
            total = sum(edges[(t[i], t[j])] for i in range(len(t)) for j in range(i + 1, len(t)) if t[i] in terms or t[j] in terms)
            if total:
                glob[(r["key"], r["chunk_no"])] = float(total)
    want = sorted(glob.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = [((r["key"], r["chunk_no"]), r["score"]) for r in S.global_(spark, folder, terms, 5).orderBy("rank").collect()]
    assert got == want
    texts = S.texts_of(spark, folder, S.local(spark, folder, terms, 4, 5))
    assert texts.count() == 5


def test_lookups_are_pruned(spark, tables):
    a, _ = tables
    folder = folder_for(spark)
    S.insert(a, "doc_id", "text", folder, SETTINGS)
    plan = S._by_terms(spark, folder, "postings", ["lamp"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    empty = folder_for(spark)
    assert S.local(spark, empty, ["lamp"], 4, 5).count() == 0
