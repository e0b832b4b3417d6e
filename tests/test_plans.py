"""Plans keep what makes them scale."""

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "merged_topics",
        "topic_similarity_pairs",
        "tfidf_corpus",
        "stage1_records",
        "cluster_themes_top20",
        "chunk_key_terms",
        "retrieve_global",
        "retrieve_local",
        "vector_topk",
        "silhouette_by_point",
        "cluster_members",
    ],
)
def test_no_cross_join(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(
    "name", ["cluster_themes_top20", "vector_topk", "merged_topics", "builtin_cluster_analysis"]
)
def test_group_limits_run_before_the_shuffle(spark, name):
    from themeloom.catalog import queries as Q
    from themeloom.operators import terms as V

    if name == "merged_topics":
        from themeloom.catalog.adapters import turn_topics

        texts = V.with_terms(turn_topics(spark, FOLDER), "description")
        df = V.vocabulary(V.term_statistics(texts, ["conv_id"]), 100, ["conv_id"])
    else:
        df = Q.QUERIES[name](spark, FOLDER)
    text = plan(df)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_only_needed_columns_are_read(spark):
    text = plan(queries()["word_count"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_text_is_tokenised_once_per_pass(spark):
    text = plan(queries()["term_counts"](spark, FOLDER))
    assert text.count("regexp_extract_all") == 1


def test_global_vocabulary_is_a_topk(spark):
    assert "TakeOrderedAndProject" in plan(queries()["vocabulary_topn"](spark, FOLDER))
