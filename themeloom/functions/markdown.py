"""Column functions that turn document blocks into markdown.

A document is one row: ``paragraphs`` is an array of
``STRUCT<style, text, runs: ARRAY<STRUCT<text, bold, italic>>>`` and ``tables``
an array of row arrays of cell arrays. Everything below works inside that row,
so assembling a document never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.text import clean_text, strip


def heading_level(style: Column) -> Column:
    """Level 1-6 of a displayed style name, NULL for body text."""
    number = F.regexp_extract(style, r"[0-9]+", 0)
    level = F.when(~style.contains("Heading"), F.lit(None).cast("int"))
    for known in range(1, 5):
        level = level.when(style.contains(f"Heading {known}"), F.lit(known))
    numbered = F.when(F.length(number) > 9, F.lit(6)).otherwise(
        F.least(F.try_to_number(number, F.lit("999999999")).cast("int"), F.lit(6))
    )
    return level.when(number == "", F.lit(1)).otherwise(numbered)


def heading_level_lowercase(style: Column) -> Column:
    """Level of the plain converter: any case, only levels one to six."""
    lowered = F.lower(style)
    level = F.when(lowered.contains("heading 1"), F.lit(1))
    for known in range(2, 7):
        level = level.when(lowered.contains(f"heading {known}"), F.lit(known))
    return level


def emphasised(text: Column, runs: Column) -> Column:
    """Wrap every occurrence of a bold or italic run's text, run by run."""

    def wrap(acc: Column, run: Column) -> Column:
        body = run["text"]
        stars = F.when(run["bold"], F.lit("**")).when(run["italic"], F.lit("*"))
        return F.when(
            stars.isNotNull() & (body != ""),
            F.replace(acc, body, F.concat(stars, body, stars)),
        ).otherwise(acc)

    return F.aggregate(runs, text, wrap)


def _heading(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def separator_line(columns: Column) -> Column:
    return F.when(columns > 0, table_line(F.array_repeat(F.lit("---"), columns))).otherwise(
        F.lit("|  |")
    )


def _is_filled(cells: Column) -> Column:
    return F.exists(cells, lambda c: c != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once per mention in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table_lines(rows: Column) -> Column:
    """Markdown lines of one table; empty rows drop out, the first is the head.

    The separator has one mark per pipe-delimited field of the head line, so a
    pipe inside a cell widens it.
    """
    trimmed = F.transform(rows, lambda cells: F.transform(cells, strip))

    def with_separator(lines: Column) -> Column:
        columns = F.array_size(F.split(F.get(lines, F.lit(0)), r"\|", -1)) - 2
        return F.when(F.array_size(lines) == 0, lines).otherwise(
            F.concat(
                F.slice(lines, 1, 1),
                F.array(_bound(columns, separator_line)),
                F.slice(lines, F.lit(2), F.greatest(F.array_size(lines) - 1, F.lit(0))),
            )
        )

    return _bound(F.transform(F.filter(trimmed, _is_filled), table_line), with_separator)


def plain_table_lines(rows: Column) -> Column:
    """Lines of the plain converter: row one is the head, no row drops out."""
    none = F.array().cast("array<string>")

    def lines(trimmed: Column) -> Column:
        head = F.get(trimmed, F.lit(0))
        body = F.slice(trimmed, F.lit(2), F.greatest(F.array_size(trimmed) - 1, F.lit(0)))
        return F.concat(
            F.array(F.lit("")),
            F.when(
                (F.array_size(trimmed) > 0) & _is_filled(head),
                F.concat(
                    F.array(table_line(head), separator_line(F.array_size(head))),
                    F.transform(body, table_line),
                ),
            ).otherwise(none),
        )

    return _bound(F.transform(rows, lambda cells: F.transform(cells, strip)), lines)


def blocks_to_markdown(paragraphs: Column, tables: Column) -> Column:
    """Headings and paragraphs first, then all tables, cleaned."""
    trimmed = F.transform(
        paragraphs, lambda p: F.struct(p["style"].alias("style"), strip(p["text"]).alias("text"))
    )
    body = F.transform(
        F.filter(trimmed, lambda p: p["text"] != ""),
        lambda p: F.coalesce(_heading(heading_level(p["style"]), p["text"]), p["text"]),
    )
    table_texts = F.transform(
        F.filter(F.transform(tables, table_lines), lambda lines: F.array_size(lines) > 0),
        lambda lines: F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")),
    )
    return clean_text(F.array_join(F.concat(body, table_texts), "\n\n"))


def blocks_to_plain_markdown(paragraphs: Column, tables: Column) -> Column:
    """The plain converter: blank lines kept, emphasis marked, single breaks."""

    def line(p: Column) -> Column:
        text = strip(p["text"])
        return F.when(text == "", F.lit("")).otherwise(
            F.coalesce(
                _heading(heading_level_lowercase(p["style"]), text),
                emphasised(text, p["runs"]),
            )
        )

    return F.array_join(
        F.concat(
            F.transform(paragraphs, line),
            F.flatten(F.transform(tables, plain_table_lines)),
        ),
        "\n",
    )


def titled(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body)
