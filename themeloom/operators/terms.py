"""Terms, vocabularies and TF-IDF vectors.

Texts stay one row each until terms are counted. Vocabulary statistics come from
one pass that is summed before the shuffle, so what moves is distinct terms per
task, not tokens. In passes over a whole corpus the terms of a slice of an Arrow
batch are numbered, and counted by number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from themeloom.functions.text import bigrams, tokens, without_stop_words
from themeloom.operators.arrays import bound, by_value, exploded, runs
from themeloom.operators.skew import salted_join, split_groups
from themeloom.operators.storage import written

PAIR_WORDS = 10_000  # words whose bigrams are looked for by a list, at most
SLICE_TERMS = 750_000  # terms, or numbers of vectors, of one step inside an Arrow batch
BATCH_BYTES = 8 << 20


def with_terms(
    texts: DataFrame,
    text: str | Column,
    stop_words: Iterable[str] | None = None,
    pairs: bool = False,
) -> DataFrame:
    """Add ``terms``: tokens without stop words and, if asked, their bigrams.

    The steps are separate projections so that the token pattern runs once.
    """
    text = F.col(text) if isinstance(text, str) else text
    out = texts.withColumn("terms", tokens(text))
    out = out.withColumn("terms", without_stop_words(F.col("terms"), stop_words))
    if pairs:
        out = out.withColumn("terms", F.concat("terms", bigrams(F.col("terms"))))
    return out


def term_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, tf`` for rows that carry ``terms``."""
    return (
        exploded(texts, keys, "terms", "term")
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("tf"))
    )


def counted_terms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, terms, tf``: each row's distinct terms in order and their counts, no shuffle."""
    ordered = texts.select(*keys, F.sort_array("terms").alias("_t"))
    last = F.filter(
        F.when(F.array_size("_t") > 0, F.sequence(F.lit(1), F.array_size("_t"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: ~F.get("_t", i - 1).eqNullSafe(F.get("_t", i)),
    )
    runs = ordered.withColumn("_last", last)
    return runs.select(
        *keys,
        F.transform("_last", lambda i: F.get("_t", i - 1)).alias("terms"),
        F.transform("_last", lambda i, n: (i - F.coalesce(F.get("_last", n - 1), F.lit(0))).cast("bigint")).alias("tf"),
    )


def _slices(lists: pa.Array, width: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to SLICE_TERMS terms, and numbers if each row makes ``width``; one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        full = np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_TERMS, "right")
        rows = min(full - at, SLICE_TERMS // width if width else len(ends))
        yield at, max(1, int(rows))
        at += max(1, int(rows))


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each term, and the terms by number."""
    coded = lists.flatten().dictionary_encode("encode")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), lengths), codes, coded.dictionary


def _bounded_batches(df: DataFrame) -> None:
    """Arrow batches by size, unless the session sets one: 10,000 long texts are too much for one."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1), "2147483647b"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        for at, n in _slices(lists):
            row, code, names = _coded(lists.slice(at, n))
            cf = np.bincount(code, minlength=len(names))
            row *= len(names)
            row += code
            row.sort()
            once = row[np.flatnonzero(np.diff(row, append=-1))]  # each term of a text once
            df = np.bincount(once % max(1, len(names)), minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(cf), pa.array(df)], names=["term", "cf", "df"])


def term_statistics(texts: DataFrame, within: list[str] = []) -> DataFrame:
    """``within, term, cf, df``: total count and number of texts of each term.

    Over all texts, each slice of an Arrow batch is counted by numbers and the counts
    are summed. Within groups, sorting a row's terms lets the last of each run stand
    for the text, so both counts come from one pass without grouping by text.
    """
    if not within:
        _bounded_batches(texts)
        counted = texts.select("terms").mapInArrow(_statistics_of, "term string, cf bigint, df bigint")
        return counted.groupBy("term").agg(
            F.coalesce(F.sum("cf"), F.lit(0)).alias("cf"), F.sum("df").alias("df")
        )
    runs = F.zip_with(
        "terms",
        F.slice("terms", F.lit(2), F.greatest(F.array_size("terms") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("term"), (~a.eqNullSafe(b)).cast("bigint").alias("last")),
    )
    ordered = texts.withColumn("terms", F.sort_array("terms"))
    marked = exploded(ordered, within, runs, "t")
    return marked.groupBy(*within, F.col("t.term").alias("term")).agg(
        F.count("*").alias("cf"), F.sum("t.last").alias("df")
    )


def vocabulary(statistics: DataFrame, size: int, within: list[str] = []) -> DataFrame:
    """The ``size`` most frequent terms, numbered in ``slot`` from one.

    The limit is part of the plan as a top-k (whole corpus) or as a group limit
    ahead of the shuffle (per group), so no task ranks a whole hot group.
    """
    order = [F.desc("cf"), F.asc("term")]
    if within:
        slot = F.row_number().over(W.partitionBy(*within).orderBy(*order))
        return statistics.withColumn("slot", slot).where(F.col("slot") <= size)
    top = statistics.orderBy(*order).limit(size)
    return top.withColumn("slot", F.row_number().over(W.orderBy(*order)))


def idf(texts: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((texts + 1) / (df + 1)) + 1


def tfidf_vectors(
    texts: DataFrame, keys: list[str], size: int, within: list[str] = [], pairs: bool = False
) -> DataFrame:
    """One row per text: ``vector ARRAY<STRUCT<slot, term, w>>`` of norm one.

    ``texts`` has one row per ``keys`` with ``terms``; ``within`` names the keys
    of the group each fit is confined to (none: one fit over all). Texts left
    with no term of the vocabulary keep an empty vector. With ``pairs``, in a fit over
    all only, the bigrams of the terms are terms as well.
    """
    if not within:
        return _corpus_vectors(texts, keys, size, pairs)
    ordinary, large = split_groups(texts, within)
    vectors = _vectors_in_rows(ordinary, keys, size, within)
    if large is None:
        return vectors
    return vectors.unionByName(_spread_vectors(large, keys, size, within))


def _vectors_in_rows(texts: DataFrame, keys: list[str], size: int, within: list[str]) -> DataFrame:
    """Each group is gathered in one row, with the one shuffle there is, and fitted inside it."""
    own = [c for c in keys if c not in within]
    id_of = lambda r: r[own[0]] if len(own) == 1 else F.struct(F.lit(0).alias("_"), *[r[c].alias(c) for c in own])
    groups = (
        counted_terms(texts, keys)
        .groupBy(*within)
        .agg(F.collect_list(F.struct(*own, "terms", "tf")).alias("_rows"))
    )
    entries = F.flatten(
        F.transform(
            "_rows",
            lambda r: F.zip_with(r["terms"], r["tf"], lambda t, n: F.struct(t.alias("term"), n.alias("tf"))),
        )
    )
    texts_in = F.array_size("_rows")
    found = F.transform(
        runs(F.sort_array(entries), lambda e: e["term"]),
        lambda run: F.struct(
            (-F.aggregate(run, F.lit(0).cast("bigint"), lambda acc, e: acc + e["tf"])).alias("cf"),
            F.get(run, F.lit(0))["term"].alias("term"),
            idf(texts_in, F.array_size(run)).alias("idf"),
        ),
    )
    # a group without a key has no vocabulary
    known = F.lit(True)
    for c in within:
        known = known & F.col(c).isNotNull()
    vocab = F.slice(F.sort_array(F.when(known, found).otherwise(F.slice(found, 1, 0))), 1, size)

    def count(rows: Column, term: Column) -> Column:
        at = lambda r: F.get(r["tf"], F.array_position(r["terms"], term).cast("int") - 1)
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, r: acc + F.coalesce(at(r), F.lit(0)))

    def weighted(rows: Column, vocab: Column) -> Column:
        entry = lambda v, i: bound(
            count(rows, v["term"]),
            lambda tf: F.when(
                tf > 0, F.struct((i + 1).alias("slot"), v["term"].alias("term"), (tf * v["idf"]).alias("raw"))
            ),
        )
        return F.filter(F.transform(vocab, entry), lambda e: e.isNotNull())

    vectors = bound(
        vocab,
        lambda v: F.transform(
            by_value(F.col("_rows"), id_of), lambda x: F.struct(x["id"].alias("id"), weighted(x["rows"], v).alias("vector"))
        ),
    )
    out = groups.select(*within, F.explode(vectors).alias("_x"))
    id_column = lambda c: F.col("_x.id") if len(own) == 1 else F.col(f"_x.id.{c}")
    return out.select(
        *[F.col(c) if c in within else id_column(c).alias(c) for c in keys], F.col("_x.vector").alias("vector")
    ).select(*keys, _unit(F.col("vector")).alias("vector"))


def _spread_vectors(texts: DataFrame, keys: list[str], size: int, within: list[str]) -> DataFrame:
    """The same for groups of any size, by shuffles over (group, term)."""
    vocab = vocabulary(term_statistics(texts, within), size, within)
    sizes = texts.groupBy(*within).agg(F.count("*").alias("texts"))
    vocab = vocab.join(sizes, within).withColumn("idf", idf(F.col("texts"), F.col("df")))
    vocab = vocab.select(*within, "term", "slot", "idf", "cf")
    terms = texts.select(*keys, F.explode_outer("terms").alias("term"))
    found = salted_join(terms, vocab, [*within, "term"], "cf", keys, "left")
    # terms outside the vocabulary become one NULL group per text
    term = F.when(F.col("slot").isNotNull(), F.col("term")).alias("term")
    counts = found.groupBy(*keys, "slot", term, "idf").agg(F.count("*").alias("tf"))
    entry = F.when(
        F.col("slot").isNotNull(),
        F.struct("slot", "term", (F.col("tf") * F.col("idf")).alias("raw")),
    )
    packed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("vector"))
    return packed.select(*keys, _unit(F.col("vector")).alias("vector"))


@dataclass(frozen=True)
class Fit:
    """A fitted corpus vocabulary, at most as long as its size parameter."""

    terms: list[str]
    idf: list[float]


def with_pairs(texts: DataFrame) -> DataFrame:
    """``texts`` with the bigrams of their ``terms`` added to them."""
    return texts.withColumn("terms", F.concat("terms", bigrams(F.col("terms"))))


def _numbered(code: np.ndarray, names: pa.Array, words: pa.Array) -> np.ndarray:
    """The place in ``words`` of each coded term, or -1."""
    known = pc.fill_null(pc.index_in(names, value_set=words), -1).to_numpy(zero_copy_only=False)
    return known[code].astype(np.int64)


def _neighbours(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where a term and the next one of its text both have a number."""
    return np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (row[:-1] == row[1:]))


def _pairs_of(known: list[str]):
    """Per text its bigrams of two known words."""
    words = pa.array(known, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _slices(batch.column(0)):
                row, code, names = _coded(batch.column(0).slice(at, n))
                word = _numbered(code, names, words)
                both = _neighbours(row, word)
                coded = pa.array(word[both] * len(known) + word[both + 1]).dictionary_encode()
                terms = [f"{known[x // len(known)]} {known[x % len(known)]}" for x in coded.dictionary.to_pylist()]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[both], minlength=n))]).astype(np.int32)
                found = pa.array(terms, pa.string()).take(coded.indices)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), found)], names=["terms"])

    return run


def _vocabulary_with_pairs(texts: DataFrame, size: int) -> DataFrame:
    """The vocabulary of the words in ``terms`` and their bigrams, exact.

    A bigram is found at most as often as either of its words. So one that belongs
    to the ``size`` most frequent terms has two words of at least the count of the
    word at that rank, and only bigrams of such words are counted.
    """
    words = written(term_statistics(texts))
    ranked = words.orderBy(F.desc("cf")).limit(size).agg(F.count("*").alias("n"), F.min("cf").alias("least")).first()
    least = ranked["least"] if ranked["n"] == size else 0
    # more than a few words only if very many have the same count
    known = [r["term"] for r in words.where(F.col("cf") >= least).select("term").limit(PAIR_WORDS + 1).collect()]
    if len(known) > PAIR_WORDS:
        return vocabulary(term_statistics(with_pairs(texts)), size)
    _bounded_batches(texts)
    counted = term_statistics(texts.select("terms").mapInArrow(_pairs_of(known), "terms array<string>"))
    return vocabulary(words.unionByName(counted), size)


def fit_corpus(texts: DataFrame, size: int, pairs: bool = False) -> Fit:
    """The most frequent ``terms``; with ``pairs`` their bigrams compete as well."""
    top = _vocabulary_with_pairs(texts, size) if pairs else vocabulary(term_statistics(texts), size)
    number = texts.select(F.count("*")).scalar()
    rows = top.select("term", "slot", idf(number, F.col("df")).alias("idf")).collect()
    rows.sort(key=lambda r: r["slot"])
    return Fit([r["term"] for r in rows], [r["idf"] for r in rows])


def _places(fit: Fit, pairs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words that make up the fitted terms, the slot of each, or -1, and the slots of
    pairs of words by ``left * number of words + right``, in order."""
    halves = [(t[:i], t[i + 1 :], at) for at, t in enumerate(fit.terms) for i, c in enumerate(t) if pairs and c == " "]
    words = list(dict.fromkeys([*fit.terms, *[w for a, b, _ in halves for w in (a, b)]]))
    number = {w: i for i, w in enumerate(words)}
    slot = np.full(len(words), -1, dtype=np.int64)
    slot[: len(fit.terms)] = np.arange(len(fit.terms))
    found = sorted((number[a] * len(words) + number[b], at) for a, b, at in halves)
    return pa.array(words, pa.string()), slot, np.array([x for x, _ in found]), np.array([x for _, x in found])


def corpus_features(texts: DataFrame, keys: list[str], fit: Fit, pairs: bool = False) -> DataFrame:
    """``keys, features``: dense weights of norm one, all zero without terms.

    Counting against a fitted vocabulary is one pass over the rows, no shuffle. With
    ``pairs`` the bigrams of the terms count as terms, without being made: neighbours
    are looked up as two numbers.
    """
    if not fit.terms:
        return texts.select(*keys, F.array().cast("array<double>").alias("features"))
    size, factors = len(fit.terms), np.array(fit.idf)
    words, slot, left_right, pair_slot = _places(fit, pairs)

    def count(lists: pa.Array) -> np.ndarray:
        row, code, names = _coded(lists)
        word = _numbered(code, names, words)
        at = np.where(word >= 0, slot[word], -1)
        places = [(row * size + at)[at >= 0]]
        if len(left_right):
            both = _neighbours(row, word)
            asked = word[both] * len(words) + word[both + 1]
            near = np.minimum(np.searchsorted(left_right, asked), len(left_right) - 1)
            hit = left_right[near] == asked
            places.append(row[both[hit]] * size + pair_slot[near[hit]])
        return np.bincount(np.concatenate(places), minlength=len(lists) * size).reshape(len(lists), size)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            for at, n in _slices(lists, size):
                raw = count(lists.slice(at, n)) * factors
                norm = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])
                np.divide(raw, norm, out=raw, where=norm > 0)
                ends = pa.array(np.arange(0, (n + 1) * size, size, dtype=np.int32))
                made = pa.ListArray.from_arrays(ends, pa.array(raw.ravel()))
                own = [c.slice(at, n) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*own, made], names=[*keys, "features"])

    _bounded_batches(texts)
    taken = texts.select(*keys, "terms")
    schema = StructType([*taken.schema.fields[: len(keys)], StructField("features", ArrayType(DoubleType()))])
    return taken.mapInArrow(features, schema)


def _corpus_vectors(texts: DataFrame, keys: list[str], size: int, pairs: bool) -> DataFrame:
    fit = fit_corpus(texts, size, pairs)
    names = F.array(*[F.lit(t) for t in fit.terms]).cast("array<string>")
    entries = F.transform(
        "features",
        lambda w, i: F.struct(
            (i + 1).alias("slot"), F.get(names, i).alias("term"), w.alias("w")
        ),
    )
    return corpus_features(texts, keys, fit, pairs).select(
        *keys, F.filter(entries, lambda e: e["w"] > 0).alias("vector")
    )


def _unit(vector: Column) -> Column:
    """Scale to norm one; the norm is bound once and not per entry."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x["raw"] * x["raw"])
    scaled = F.transform(
        F.array(F.sqrt(squares)),
        lambda norm: F.transform(
            vector,
            lambda x: F.struct(
                x["slot"].alias("slot"), x["term"].alias("term"), (x["raw"] / norm).alias("w")
            ),
        ),
    )
    return F.get(scaled, F.lit(0))


def long_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, w``; texts without terms have no rows."""
    return exploded(vectors, keys, "vector", "e").select(*keys, "e.term", "e.w")
