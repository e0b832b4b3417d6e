"""Cluster descriptions from all themes: every theme reaches a prompt, calls as stated."""

import json

from pyspark.sql import functions as F

from themeloom.operators import describe_tree as T


def counting(prompt: str) -> str:
    """Counts theme lines of a batch, or adds up the counts of combined parts."""
    if "\nThemes:\n" in prompt:
        body = prompt.split("\nThemes:\n", 1)[1].split("\n\nAnswer with", 1)[0]
        seen = [line.rsplit("(", 1)[-1].rstrip(")") for line in body.split("\n") if line]
        count = len(body.split("\n"))
        marks = sorted(x for x in seen if x.startswith("t"))
    else:
        body = prompt.split("\nParts:\n", 1)[1].split("\n\nAnswer with", 1)[0]
        parts = [json.loads(line) for line in body.split("\n")]
        count = sum(int(p["cluster_summary"]) for p in parts)
        marks = sorted(m for p in parts for m in p["common_patterns"])
    return json.dumps({"cluster_name": "c", "main_theme": "m", "common_patterns": marks,
                       "distinguishing_features": [], "cluster_summary": str(count)})


def test_every_theme_reaches_a_prompt(spark):
    rows = [(0, a, t, f"name{t}", f"t{a}.{t}") for a in range(300) for t in range(7)]  # 2,100 themes
    rows += [(1, a, t, "n", f"t{a}.{t}") for a in range(5) for t in range(5)] + [(2, 9, 0, "n", "t9.0")]
    themes = spark.createDataFrame(rows, "cluster_number int, doc string, theme_no int, name string, description string")
    sizes = themes.groupBy("cluster_number").agg(F.countDistinct("doc").alias("size"))
    answers, calls = T.describe_clusters(themes, sizes, "doc", counting)
    got = {r["cluster_number"]: json.loads(r["response"]) for r in answers.collect()}
    assert {c: int(a["cluster_summary"]) for c, a in got.items()} == {0: 2100, 1: 25, 2: 1}
    # themes 21 and 2,000 of the large cluster among the described ones
    assert sorted(got[0]["common_patterns"]) == sorted(f"t{a}.{t}" for a in range(300) for t in range(7))
    per = {}
    for r in calls.collect():
        per[r["cluster_number"]] = per.get(r["cluster_number"], 0) + r["calls"]
    assert per[2] == 1 and per[1] <= T.calls_for(25) and per[0] <= T.calls_for(2100) + 4


def test_failed_batches_carry_their_error(spark):
    rows = [(0, a, 0, "n", f"t{a}.0") for a in range(60)]
    themes = spark.createDataFrame(rows, "cluster_number int, doc string, theme_no int, name string, description string")
    sizes = themes.groupBy("cluster_number").agg(F.countDistinct("doc").alias("size"))

    def flaky(prompt):
        if "t7.0" in prompt and "Themes:" in prompt:
            raise ValueError("refused")
        return counting(prompt)

    answers, _ = T.describe_clusters(themes, sizes, "doc", flaky)
    (row,) = answers.collect()
    assert row["error"] == "refused" and 0 < int(json.loads(row["response"])["cluster_summary"]) < 60
