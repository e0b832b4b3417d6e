import io
import zipfile

import pytest
from pyspark.sql import functions as F

from themeloom.functions import markdown as M
from themeloom.sources import articles as A
from themeloom.sources.word import list_word_files, read_blocks, read_word_files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = (
    f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="Normal">'
    '<w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Heading1">'
    '<w:name w:val="heading 1"/></w:style></w:styles>'
)
BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t xml:space="preserve">Two </w:t></w:r>'
    "<w:r><w:t>runs</w:t></w:r></w:p>"
    "<w:p/>"
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> plain</w:t>'
    '<w:br/><w:t>next</w:t><w:tab/><w:t>end</w:t></w:r>'
    '<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
)


def docx(body: str = BODY, styles: str | None = STYLES) -> bytes:
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr(
            "word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>"
        )
        if styles:
            archive.writestr("word/styles.xml", styles)
    return target.getvalue()


LEVELS = {
    "Heading 1": 1,
    "Heading 4": 4,
    "Heading 5": 5,
    "Heading 9": 6,
    "Heading 12": 1,
    "Heading 20": 2,
    "Heading": 1,
    "Heading 99999999999": 6,
    "Normal": None,
    "heading 2": None,
}


def test_heading_levels(spark):
    df = spark.createDataFrame([(s,) for s in LEVELS], "s string")
    got = {r["s"]: r["l"] for r in df.select("s", M.heading_level(F.col("s")).alias("l")).collect()}
    assert got == LEVELS
    plain = df.select("s", M.heading_level_lowercase(F.col("s")).alias("l")).collect()
    assert {r["s"]: r["l"] for r in plain}["heading 2"] == 2


@pytest.mark.parametrize(
    "rows,lines",
    [
        ([["a", "b"], ["", " "], ["1", "2"]], ["| a | b |", "| --- | --- |", "| 1 | 2 |"]),
        ([["", ""], ["x", "y"]], ["| x | y |", "| --- | --- |"]),
        ([["a|b", "c"]], ["| a|b | c |", "| --- | --- | --- |"]),
        ([["", ""]], []),
    ],
)
def test_table_lines(spark, rows, lines):
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    assert df.select(M.table_lines(F.col("r"))).first()[0] == lines


def test_plain_table_keeps_empty_rows_and_needs_a_head(spark):
    df = spark.createDataFrame(
        [([["a", ""], ["", ""]],), ([["", ""], ["x", "y"]],)], "r array<array<string>>"
    )
    got = [r[0] for r in df.select(M.plain_table_lines(F.col("r"))).collect()]
    assert got == [["", "| a |  |", "| --- | --- |", "|  |  |"], [""]]


def test_emphasis_wraps_every_occurrence_run_by_run(spark):
    runs = [("a", True, True), ("b", False, True), ("", True, False)]
    df = spark.createDataFrame(
        [("an a b", runs)], "t string, runs array<struct<text:string,bold:boolean,italic:boolean>>"
    )
    got = df.select(M.emphasised(F.col("t"), F.col("runs"))).first()[0]
    assert got == "**a**n **a** *b*"


def test_reading_blocks():
    blocks = read_blocks(docx())
    assert [p["style"] for p in blocks["paragraphs"]] == ["Heading 1", "Normal", "Normal"]
    assert blocks["paragraphs"][2]["text"] == "bold plain\nnext\tendlink"
    assert [r["bold"] for r in blocks["paragraphs"][2]["runs"]] == [True, False]
    assert blocks["tables"] == [[["a", ""]]]


def test_merged_cells_repeat():
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    wide = '<w:gridSpan w:val="2"/>'
    body = (
        f"<w:tbl><w:tr>{cell('w', wide)}{cell('z')}</w:tr>"
        f"<w:tr>{cell('p')}{cell('q')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl>"
    )
    assert read_blocks(docx(body))["tables"] == [[["w", "w", "z"], ["p", "q", "z"]]]


def test_word_folder(spark, tmp_path):
    (tmp_path / "my_first-talk.docx").write_bytes(docx())
    (tmp_path / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0 old format")
    (tmp_path / "notes.txt").write_text("ignored")
    assert list_word_files(spark, str(tmp_path)).count() == 2
    rows = {r["filename"]: r for r in read_word_files(spark, str(tmp_path)).collect()}
    good = rows["my_first-talk.docx"]
    assert good["content"] == (
        "# My First Talk\n\n# Two runs\n\nbold plain\nnext\tendlink\n\n| a | |\n| --- | --- |"
    )
    assert good["output_name"] == "my_first-talk.md" and good["error"] is None
    assert rows["old.doc"]["content"] is None and "zip" in rows["old.doc"]["error"]
    plain = read_word_files(spark, str(tmp_path), "plain").where("error IS NULL").first()
    assert plain["content"] == (
        "# Two runs\n\n**bold** plain\nnext\tendlink\n\n| a |  |\n| --- | --- |"
    )


def test_empty_word_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_word_files(spark, str(tmp_path))
    with pytest.raises(Exception):
        read_word_files(spark, str(tmp_path / "missing"))


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("één\r\nb c".encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    rows = {r["filename"]: r for r in A.read_markdown_files(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["content"] == "één\nb c" and rows["a.md"]["word_count"] == 3
    assert rows["bad.md"]["error"] and rows["bad.md"]["content"] is None
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        A.read_markdown_files(spark, str(tmp_path / "none"))


def test_export_and_article_table(spark, tmp_path):
    df = spark.createDataFrame(
        [("a.md", "# A\n\nbody", None), ("b.md", None, "broken")],
        "output_name string, content string, error string",
    )
    A.export_markdown(df, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert [(r["output_name"], r["value"]) for r in back] == [("a.md", "# A\n\nbody\n")]
    A.write_articles(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
