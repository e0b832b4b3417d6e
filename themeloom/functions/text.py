"""Column functions on plain text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.stop_words import ENGLISH


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{fixed.WHITE}]+|[{fixed.WHITE}]+\z", "")


def clean_text(text: Column) -> Column:
    """Blank lines to one, runs of spaces to one, outer white space off."""
    one_blank = F.regexp_replace(text, rf"\n[{fixed.WHITE}]*\n", "\n\n")
    return strip(F.regexp_replace(one_blank, " +", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{fixed.WHITE}]+"), "")


def word_count(text: Column) -> Column:
    return F.array_size(words(text)).cast("bigint")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of cased letters.

    ``initcap`` only splits at spaces, so it misses ``o'neil`` and ``3rd``.
    """
    cased = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"
    pieces = F.regexp_extract_all(
        text, F.lit(rf"{cased}|[^\p{{IsUppercase}}\p{{IsLowercase}}\p{{Lt}}]+"), F.lit(0)
    )
    return F.array_join(
        F.transform(
            pieces,
            lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))),
        ),
        "",
    )


def document_title(stem: Column) -> Column:
    return title_case(F.translate(stem, "_-", "  "))


def markdown_name(file_name: Column) -> Column:
    return F.concat(file_stem(file_name), F.lit(".md"))


def content_cap(text: Column, limit: int) -> Column:
    """The first part of an article, as long as a prompt may show."""
    return F.substring(text, 1, limit)


def content_windows(text: Column, limit: int) -> Column:
    """The whole article in parts of at most ``limit`` characters, one if it is empty."""
    last = F.greatest(F.ceil(F.length(text) / limit).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substr(text, i * limit + 1, F.lit(limit))
    )


def metadata_envelope(file_name: Column, count: Column, content: Column) -> Column:
    return F.format_string(fixed.ENVELOPE_FORMAT, file_name, count.cast("string"), content)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TERM_PATTERN), F.lit(0))


def without_stop_words(terms: Column, stop_words: Iterable[str] | None = None) -> Column:
    stop = list(ENGLISH if stop_words is None else stop_words)
    return F.filter(terms, lambda t: ~t.isin(stop)) if stop else terms


def bigrams(terms: Column) -> Column:
    """Neighbouring pairs inside one row's term array; no shuffle needed."""
    n = F.greatest(F.array_size(terms) - 1, F.lit(0))
    return F.zip_with(
        F.slice(terms, F.lit(1), n),
        F.slice(terms, F.lit(2), n),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
