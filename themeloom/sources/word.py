"""Word documents as block tables and markdown.

Reading the zip container and its XML is the only Python step; it runs per file
inside Arrow batches. Everything after it is column work on one row per file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.markdown import (
    blocks_to_markdown,
    blocks_to_plain_markdown,
    titled,
)
from themeloom.functions.text import document_title, file_stem, markdown_name, word_count

BLOCKS = (
    "paragraphs ARRAY<STRUCT<style: STRING, text: STRING, "
    "runs: ARRAY<STRUCT<text: STRING, bold: BOOLEAN, italic: BOOLEAN>>>>, "
    "tables ARRAY<ARRAY<ARRAY<STRING>>>, error STRING"
)

FILES_AT_ONCE = 64

# The file format's namespace and its spellings of "off".
NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OFF = ("0", "false", "off", "none")
# Text that stands for an element inside a run.
RUN_TEXT = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def _run_text(run) -> str:
    out = []
    for part in run:
        name = part.tag.removeprefix(NS)
        if name == "t":
            out.append(part.text or "")
        elif name == "br":
            out.append("\n" if part.get(f"{NS}type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(RUN_TEXT.get(name, ""))
    return "".join(out)


def _is_on(run, mark: str) -> bool:
    found = run.find(f"{NS}rPr/{NS}{mark}")
    return found is not None and found.get(f"{NS}val", "1") not in OFF


def _text(paragraph) -> str:
    """Text of the runs, those inside links included."""
    out = []
    for part in paragraph:
        if part.tag == f"{NS}r":
            out.append(_run_text(part))
        elif part.tag == f"{NS}hyperlink":
            out.extend(_run_text(r) for r in part.findall(f"{NS}r"))
    return "".join(out)


def _style_names(styles) -> tuple[dict[str, str], str]:
    """Displayed name per style id, and the default paragraph style's name."""
    names, default = {}, "Normal"
    for style in styles.findall(f"{NS}style") if styles is not None else []:
        if style.get(f"{NS}type") != "paragraph":
            continue
        name = style.find(f"{NS}name")
        shown = name.get(f"{NS}val", "") if name is not None else ""
        # only the built-in levels are shown in upper case
        if re.fullmatch("heading [1-9]", shown):
            shown = "Heading " + shown[8:]
        names[style.get(f"{NS}styleId")] = shown
        if style.get(f"{NS}default") in ("1", "true"):
            default = shown
    return names, default


def _rows(table) -> list[list[str]]:
    """Cell texts; a merged cell repeats its text over the grid it covers."""
    out: list[list[str]] = []
    for row in table.findall(f"{NS}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{NS}tc"):
            span = cell.find(f"{NS}tcPr/{NS}gridSpan")
            down = cell.find(f"{NS}tcPr/{NS}vMerge")
            text = "\n".join(_text(p) for p in cell.findall(f"{NS}p"))
            if down is not None and down.get(f"{NS}val", "continue") == "continue" and out:
                above = out[-1]
                text = above[len(cells)] if len(cells) < len(above) else text
            cells.extend([text] * (int(span.get(f"{NS}val", "1")) if span is not None else 1))
        out.append(cells)
    return out


def read_blocks(content: bytes) -> dict:
    """Paragraphs and tables of one file's body."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{NS}body")
        has_styles = "word/styles.xml" in archive.namelist()
        styles = ElementTree.fromstring(archive.read("word/styles.xml")) if has_styles else None
    names, default = _style_names(styles)
    paragraphs = []
    for p in body.findall(f"{NS}p"):
        style = p.find(f"{NS}pPr/{NS}pStyle")
        name = default if style is None else names.get(style.get(f"{NS}val"), default)
        runs = [
            {"text": _run_text(r), "bold": _is_on(r, "b"), "italic": _is_on(r, "i")}
            for r in p.findall(f"{NS}r")
        ]
        paragraphs.append({"style": name, "text": _text(p), "runs": runs})
    return {"paragraphs": paragraphs, "tables": [_rows(t) for t in body.findall(f"{NS}tbl")]}


def word_blocks(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace ``content`` by ``paragraphs, tables, error``; a bad file is a row."""
    kept = [c for c in files.columns if c != content]
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept), BLOCKS])

    def one(data: bytes) -> tuple:
        try:
            blocks = read_blocks(data)
            return blocks["paragraphs"], blocks["tables"], None
        except Exception as problem:
            return None, None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # the blocks of a file are far larger than the file: few at a time
            for start in range(0, len(batch), FILES_AT_ONCE):
                files = batch.iloc[start : start + FILES_AT_ONCE]
                found = [one(bytes(data)) for data in files[content]]
                out = files[kept].copy()
                for i, name in enumerate(("paragraphs", "tables", "error")):
                    out[name] = pd.Series([f[i] for f in found], dtype=object, index=files.index)
                yield out

    return files.select(*kept, content).mapInPandas(run, schema)


def list_word_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, filepath`` of the folder's Word files, contents unread."""
    return _binary(spark, folder).select("filename", "filepath")


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{docx,doc}")
        .load(folder)
        .select(
            F.col("_metadata.file_name").alias("filename"),
            F.col("path").alias("filepath"),
            "content",
        )
    )


def read_word_files(spark: SparkSession, folder: str, style: str = "clean") -> DataFrame:
    """``filename, filepath, title, output_name, content, word_count, error``.

    ``style`` is ``clean`` (headings by display name, blocks parted by blank
    lines) or ``plain`` (blank lines kept, emphasis marked). A missing folder or
    one without Word files is an error. Old binary ``.doc`` files and broken
    files come out as rows with an ``error``.
    """
    files = _binary(spark, folder)
    if files.select("filename").isEmpty():
        raise FileNotFoundError(f"no Word documents in {folder}")
    return blocks_to_articles(word_blocks(files), style)


def blocks_to_articles(blocks: DataFrame, style: str = "clean") -> DataFrame:
    build = {"clean": blocks_to_markdown, "plain": blocks_to_plain_markdown}[style]
    made = blocks.withColumn(
        "content", F.when(F.col("error").isNull(), build(F.col("paragraphs"), F.col("tables")))
    )
    title = document_title(file_stem(F.col("filename")))
    # the plain converter writes no title
    stored = titled(title, F.col("content")) if style == "clean" else F.col("content")
    return made.select(
        *[c for c in blocks.columns if c not in ("paragraphs", "tables", "error")],
        title.alias("title"),
        markdown_name(F.col("filename")).alias("output_name"),
        stored.alias("content"),
        word_count(stored).alias("word_count"),
        "error",
    )
