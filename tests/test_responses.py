from pyspark.sql import functions as F

from themeloom.functions.responses import parsed_themes, parsed_topics, without_fence
from themeloom.operators.completion import complete, embed

CASES = [
    ('```json\n{"topics":[{"name":"A","description":"d"}]}\n```', 1, None),
    ('```\n{"topics":[]}\n```', 0, None),
    ('{"topics":[]}', 0, None),
    ('```json\n{"topics":[', 0, "json_parse_failed"),
    ("[1]", 0, "not_an_object"),
    ('{"topics":[{"name":"A","description":"d","importance":8.5}]}', 1, None),
    ('{"topics":[]} trailing', 0, "json_parse_failed"),
    ('{"topics":[{"name":"A"}]}', 0, "bad_topic"),
    ("", 0, "json_parse_failed"),
    ('{"other":1}', 0, None),
]


def test_answers(spark):
    rows = [(i, text, None) for i, (text, _, _) in enumerate(CASES)] + [(99, None, "boom")]
    df = spark.createDataFrame(rows, "i int, response string, error string")
    got = {r["i"]: r for r in parsed_topics(df).collect()}
    for i, (_, topics, error) in enumerate(CASES):
        assert (len(got[i]["topics"]), got[i]["error"]) == (topics, error), CASES[i]
    assert got[5]["topics"][0]["importance"] == 8.5
    assert got[99]["topics"] == [] and got[99]["error"] == "boom"


def test_a_theme_without_description_fails_its_article(spark):
    whole = '{"name":"A","description":"d"}'
    rows = [(0, f'{{"themes":[{whole}]}}', None), (1, f'{{"themes":[{whole},{{"name":"B"}}]}}', None), (2, None, "boom")]
    df = spark.createDataFrame(rows, "i int, response string, error string")
    got = {r["i"]: (len(r["themes"]), r["error"]) for r in parsed_themes(df).collect()}
    assert got == {0: (1, None), 1: (0, "bad_theme"), 2: (0, "boom")}


def test_fence_drops_last_three_characters_always(spark):
    df = spark.createDataFrame([("```json{}abc",), ("``` {} ```",), ("```x",), (" {} ",)], "r string")
    got = [r[0] for r in df.select(without_fence(F.col("r"))).collect()]
    assert got == ["{}", " {} ", "", "{}"]


def test_one_failing_call_does_not_fail_the_job(spark):
    def respond(prompt):
        if prompt == "bad":
            raise RuntimeError("limit reached")
        return prompt.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "i int, prompt string")
    got = {r["i"]: (r["response"], r["error"]) for r in complete(df, respond).collect()}
    assert got == {1: ("OK", None), 2: (None, "limit reached"), 3: (None, None)}


def test_embedding_function_sees_batches(spark):
    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    got = embed(df, "t", lambda texts: [[len(t), 1] for t in texts]).collect()
    assert sorted(r["embedding"] for r in got) == [[1.0, 1.0], [3.0, 1.0]]
