"""The test tables in the shapes that the operators take.

Each adapter reads a whole table and derives every column from it.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import bigrams, tokens, word_count
from themeloom.operators.responder import first_sentence
from themeloom.operators.storage import written
from themeloom.sources.tables import read_table

TEXT_KEYS = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", TEXT_KEYS.get(name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: ``doc_id, filename, content, word_count, error``."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat("source", F.lit("_"), "doc_id", F.lit(".md")).alias("filename"),
        F.col("text").alias("content"),
        word_count(F.col("text")).alias("word_count"),
        F.lit(None).cast("string").alias("error"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as articles without content: ``conv_id, word_count, error``.

    Those with a number ending in nine count as unreadable.
    """
    return (
        table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(F.sum(word_count(F.col("text"))).alias("word_count"))
        .select(
            "conv_id",
            "word_count",
            F.when(F.col("conv_id") % 10 == 9, F.lit("unreadable")).alias("error"),
        )
    )


def turn_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of a conversation as a topic; one in five has no importance.

    Written, as the stages write their topics, since several steps read them.
    """
    turns = table(spark, folder, "conversations").withColumn("_t", tokens(F.col("text")))
    topics = turns.select(
        "conv_id",
        F.col("turn").cast("int").alias("topic_no"),
        F.array_join(F.slice("_t", 1, 3), " ").alias("name"),
        F.col("text").alias("description"),
        F.slice(F.array_distinct(bigrams(F.col("_t"))), 1, 3).alias("key_phrases"),
        F.when(F.col("turn") % 5 != 4, 1 + (F.col("conv_id") * 3 + F.col("turn") * 7) % 10)
        .cast("double")
        .alias("importance"),
        F.array("role", first_sentence(F.col("text"))).alias("supporting_quotes"),
    )
    return written(topics)


def readable_turn_topics(spark: SparkSession, folder: str) -> DataFrame:
    return turn_topics(spark, folder).where(F.col("conv_id") % 10 != 9)


def turn_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer text per turn in each of the forms a model may give."""
    turns = table(spark, folder, "conversations")
    topic = F.struct(
        F.col("role").alias("name"),
        F.col("text").alias("description"),
        F.col("turn").alias("importance"),
    )
    body = F.to_json(F.struct(F.array(topic).alias("topics")))
    nameless = F.to_json(F.struct(F.array(topic.dropFields("name")).alias("topics")))
    form = (F.col("conv_id") + F.col("turn")) % 8
    answer = (
        F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 1, F.concat(F.lit("  ```\n"), body, F.lit("\n```\n")))
        .when(form == 2, body)
        .when(form == 3, F.substr(body, F.lit(1), F.length(body) - 2))
        .when(form == 4, F.concat(F.lit("["), body, F.lit("]")))
        .when(form == 5, F.concat(body, F.lit(" and so on")))
        .when(form == 6, nameless)
    )
    return turns.select(
        "conv_id",
        "turn",
        answer.alias("response"),
        F.when(form == 7, F.concat(F.lit("no answer for "), "role")).alias("error"),
    )


def document_themes(spark: SparkSession, folder: str, failures: bool = False) -> DataFrame:
    """One row per document with two themes, the whole text describing the first.

    Every eleventh strength is missing; with ``failures`` every 13th document failed.

    ``cluster_number`` stands for a found cluster: one per language. Written, as
    stage 2 writes its themes.
    """
    toks = table(spark, folder, "documents").withColumn("_t", tokens(F.col("text")))
    strength = F.when(F.col("doc_id") % 11 != 10, F.col("doc_id") % 11).cast("double")

    def theme(name: Column, description: Column, value: Column, coverage: Column) -> Column:
        return F.struct(
            name.alias("name"),
            description.alias("description"),
            F.slice("_t", 1, 2).alias("related_topics"),
            value.alias("strength"),
            coverage.alias("coverage"),
        )

    rows = toks.select(
        "doc_id",
        F.ascii("lang").alias("cluster_number"),
        F.lit(0).alias("part_no"),
        F.array(
            theme(
                F.array_join(F.slice("_t", 1, 3), " "),
                F.col("text"),
                strength,
                F.lit(None).cast("string"),
            ),
            theme(
                F.col("source"),
                first_sentence(F.col("text")),
                F.lit(9.0),
                F.concat(F.lit("all of "), "lang"),
            ),
        ).alias("themes"),
        F.array_size("_t").alias("source_topics_count"),
        F.when(F.lit(failures) & (F.col("doc_id") % 13 == 12), F.lit("json_parse_failed")).alias("error"),
    )
    return written(rows)


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as documents: head line and paragraphs, and the links as a table."""
    html = F.col("html")
    plain = lambda x: F.regexp_replace(x, "<[^>]*>", " ")
    inner = lambda tag: F.transform(
        F.regexp_extract_all(html, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), plain
    )
    paragraph = lambda style: lambda x: F.struct(
        F.lit(style).alias("style"),
        x.alias("text"),
        F.array(
            F.struct(
                F.substring_index(x, " ", 1).alias("text"),
                F.lit(True).alias("bold"),
                F.lit(False).alias("italic"),
            )
        ).alias("runs"),
    )
    links = F.regexp_extract_all(html, F.lit('<a href="([^"]*)">'), F.lit(1))
    names = F.regexp_extract_all(html, F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    rows = F.zip_with(links, names, lambda a, b: F.array(a, b))
    return table(spark, folder, "pages").select(
        "page_id",
        F.concat(
            F.transform(inner("h1"), paragraph("Heading 1")),
            F.transform(inner("p"), paragraph("Normal")),
        ).alias("paragraphs"),
        F.when(F.array_size(rows) > 0, F.array(rows))
        .otherwise(F.array().cast("array<array<array<string>>>"))
        .alias("tables"),
    )


def word_files(spark: SparkSession, folder: str, cut: bool = False) -> DataFrame:
    """Every document as a Word file: each line a paragraph, the first a heading.

    Each has a one-row table of language and source; with ``cut`` every 17th is cut off.
    """

    @F.pandas_udf("binary")
    def pack(text: pd.Series, lang: pd.Series, source: pd.Series, broken: pd.Series) -> pd.Series:
        space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        styles = (
            f"<w:styles {space}>"
            '<w:style w:type="paragraph" w:default="1" w:styleId="Normal">'
            '<w:name w:val="Normal"/></w:style>'
            '<w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style>'
            "</w:styles>"
        )

        def run(words: str, marks: str = "") -> str:
            return f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{escape(words)}</w:t></w:r>'

        def one(body: str, language: str, origin: str, cut: bool) -> bytes:
            out = []
            for i, line in enumerate(body.split("\n")):
                style = '<w:pPr><w:pStyle w:val="H2"/></w:pPr>' if i == 0 else ""
                head, gap, tail = line.partition(" ")
                marks = "<w:b/>" if i % 2 else "<w:i/>"
                out.append(f"<w:p>{style}{run(head, marks)}{run(gap + tail)}</w:p>")
            cells = "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in (language, origin))
            out.append(f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
            document = f"<w:document {space}><w:body>{''.join(out)}</w:body></w:document>"
            target = io.BytesIO()
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("word/document.xml", document)
                archive.writestr("word/styles.xml", styles)
            return target.getvalue()[: 20 if cut else None]

        return pd.Series([one(*row) for row in zip(text, lang, source, broken)])

    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("-"), "lang", F.lit("_"), "doc_id", F.lit(".docx")).alias(
            "filename"
        ),
        pack("text", "lang", "source", F.lit(cut) & (F.col("doc_id") % 17 == 16)).alias("content"),
    )
