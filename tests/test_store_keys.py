"""Texts of keys that come once stay where they are."""

from themeloom.plans import term_store as S


def test_one_row_per_key(spark):
    rows = [(i, f"text {i}") for i in range(20)]
    table = spark.createDataFrame(rows, "key long, text string")
    found = S._one_per_key(table)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    again = S._one_per_key(table.unionByName(spark.createDataFrame([(3, "b"), (3, "a")], "key long, text string")))
    got = {r["key"]: (r["text"], r["text_hash"]) for r in again.collect()}
    assert again.count() == 20 and {k: t for k, (t, _) in got.items() if k != 3} == {k: t for k, t in rows if k != 3}
    hashes = {r["text"]: r["text_hash"] for r in S._one_per_key(spark.createDataFrame([(i, t) for i, t in enumerate(["text 3", "a", "b"])], "key long, text string")).collect()}
    assert got[3] == min(hashes.items(), key=lambda x: x[1])
