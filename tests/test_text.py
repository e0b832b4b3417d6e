import pytest
from pyspark.sql import functions as F

from themeloom.functions import scoring as S
from themeloom.functions import text as T


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    rows = ["  a\n \t\n\nb   c ", "a \n \nb　", "", "x\n\n\n\ny", "\x1cq\x1f"]
    assert values(spark, rows, T.clean_text) == ["a\n\nb c", "a \n\nb", "", "x\n\ny", "q"]


def test_word_count_equals_python_split(spark):
    rows = ["", " a  b\tc d e\x1cf\n", "one", "　", "é–ü 1_2"]
    assert values(spark, rows, T.word_count) == [len(r.split()) for r in rows]


def test_title_equals_python_title(spark):
    rows = ["it's_o'neil 3rd-take", "INTERVIEW_01-été", "x", "", "a-b_c d1e", "中文abc"]
    expected = [r.replace("_", " ").replace("-", " ").title() for r in rows]
    assert values(spark, rows, T.document_title) == expected
    assert expected[0] == "It'S O'Neil 3Rd Take"


def test_names(spark):
    rows = ["a.docx", "a.b.doc", "noext", ".hidden"]
    assert values(spark, rows, T.file_stem) == ["a", "a.b", "noext", ".hidden"]
    assert values(spark, rows, T.markdown_name)[1] == "a.b.md"


def test_envelope(spark):
    df = spark.sql("SELECT 'f.md' AS f, 3L AS n, 'a % b' AS c")
    got = df.select(T.metadata_envelope(F.col("f"), F.col("n"), F.col("c")).alias("e")).first()["e"]
    assert got == "\nDocument: f.md\nWord Count: 3\n\na % b\n"


def test_tokens_and_bigrams_skip_stop_words(spark):
    df = spark.sql("SELECT 'The Cat_1 and a dog; été x ÉCOLE' AS x")
    terms = T.without_stop_words(T.tokens(F.col("x")))
    row = df.select(terms.alias("t")).select("t", T.bigrams(F.col("t")).alias("b")).first()
    assert row["t"] == ["cat_1", "dog", "été", "école"]
    assert row["b"] == ["cat_1 dog", "dog été", "été école"]
    empty = spark.sql("SELECT array() AS t").select(T.bigrams(F.col("t").cast("array<string>")))
    assert empty.first()[0] == []


def test_caller_stop_words(spark):
    df = spark.sql("SELECT array('a', 'b', 'c') AS t")
    assert df.select(T.without_stop_words(F.col("t"), ["b"])).first()[0] == ["a", "c"]
    assert df.select(T.without_stop_words(F.col("t"), [])).first()[0] == ["a", "b", "c"]


@pytest.mark.parametrize("strength,copies", [(10, 3), (9, 3), (8, 2), (5, 1), (2, 1), (None, 1)])
def test_strength_copies(spark, strength, copies):
    df = spark.createDataFrame([(None if strength is None else float(strength),)], "s double")
    assert df.select(S.strength_copies(F.col("s"))).first()[0] == copies


def test_cluster_count(spark):
    expected = {1: 1, 2: 2, 15: 2, 23: 2, 24: 3, 70: 8, 80: 10, 200: 10}
    df = spark.createDataFrame([(n,) for n in expected], "n long")
    got = {r["n"]: r["k"] for r in df.select("n", S.cluster_count(F.col("n")).alias("k")).collect()}
    assert got == expected


def test_reduction_ratio_is_half_even(spark):
    df = spark.createDataFrame([(8, 5), (0, 0), (4, 4)], "a long, b long")
    got = [r[0] for r in df.select(S.reduction_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.38, 0.0, 0.0]
