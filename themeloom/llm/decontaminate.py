"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest word-gram hash of each sliding window of grams.
With grams of ``k`` words and windows of ``t - k + 1`` grams, two texts that share ``t``
words in a row share a fingerprint. Fingerprints of documents are met with those of the
benchmark, hits are extended to the windows of ``t`` words around them, and these are
compared word by word. All of it is column work.

An item of fewer than ``t`` words, but not none, is one window. Winnowing promises
nothing below ``t``, so for each length that such items have, which is at most ``t - 1``
lengths, all grams of that length are met as well.

* NULL and empty text, or no word: no words, no hit.
* Equal rows get equal results; NULL doc_id is kept. Items that share an id are one
  item; an item with NULL id marks words but is not listed or counted.
* Other columns are ignored by ``contamination`` and kept by ``keep_clean``.
* Empty tables: no rows, or no hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import NOT_WORD, ascii_lower, bounded_broadcast, computed, fresh, row_key
from themeloom.operators.storage import written


@dataclass(frozen=True)
class WinnowRules:
    window_words: int = 10
    gram_words: int = 6

    @property
    def grams(self) -> int:
        return self.window_words - self.gram_words + 1


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def gram_hashes(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, NULL if there are fewer."""
    return F.when(
        F.size(words) >= length,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - length),
            lambda i: F.xxhash64(F.lit(length), *(F.get(words, i + j) for j in range(length))),
        ),
    )


def winnowed(hashes: str, grams: int) -> Column:
    """The smallest hash of each window of ``grams`` neighbours.

    ``hashes`` is a column's name: an expression would be redone for every window.
    """
    return F.when(
        F.size(hashes) >= grams,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.size(hashes) - grams),
                lambda i: F.least(*(F.get(hashes, i + j) for j in range(grams))) if grams > 1 else F.get(hashes, i),
            )
        ),
    )


def benchmark_windows(items: DataFrame, rules: WinnowRules) -> DataFrame:
    """item_id, words and the length of every window of every item."""
    t = rules.window_words
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("_words"))
    n = F.size("_words")
    starts = F.sequence(F.lit(1), F.greatest(n - t + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.slice("_words", i, F.least(n, F.lit(t))))
    return (
        rows.where(n > 0)
        .select("item_id", F.explode_outer(runs).alias("_run"))
        .select("item_id", F.array_join("_run", " ").alias("run"), F.size("_run").alias("length"))
        .distinct()
    )


def fingerprints(rows: DataFrame, rules: WinnowRules, short: list[int]) -> DataFrame:
    """Adds _fps: winnowed grams of _words, and every gram of the short items' lengths."""
    none = F.array().cast("array<bigint>")
    grams = rows.withColumn("_grams", gram_hashes(F.col("_words"), rules.gram_words))
    parts = [winnowed("_grams", rules.grams), *(F.array_distinct(gram_hashes(F.col("_words"), m)) for m in short)]
    return grams.withColumn("_fps", F.concat(*(F.coalesce(p, none) for p in parts))).drop("_grams")


def contamination(docs: DataFrame, items: DataFrame, rules: WinnowRules = WinnowRules()) -> DataFrame:
    """One row per document: words, words hit, and the items that occur in it."""
    t, k = rules.window_words, rules.gram_words
    windows = written(benchmark_windows(items, rules))
    # at most t - 1 numbers
    short = sorted(r[0] for r in windows.where(F.col("length") < t).select("length").distinct().collect())
    # a short item's own gram is as long as the item
    of_items = [
        fingerprints(part.select(F.split("run", " ").alias("_words")), rules, lengths)
        for part, lengths in [
            (windows.where(F.col("length") == t), []),
            *((windows.where(F.col("length") == m), [m]) for m in short),
        ]
    ]
    known = reduce(DataFrame.unionByName, of_items).select(F.explode_outer("_fps").alias("_fp"))
    known = written(known.where("_fp is not null").distinct())

    # the text is what moves: an array of its words takes twice the room
    texts = docs.select("doc_id", row_key("doc_id", "text").alias("_key"), F.col("text").alias("_text"))
    rows = texts.select("_key", plain_words(F.col("_text")).alias("_words"))
    met = (
        # outer: for a plain explode Spark infers a filter on the whole array expression
        # and evaluates it below the projections, once per element
        fingerprints(rows, rules, short)
        .select("_key", F.explode_outer("_fps").alias("_fp"))
        .join(bounded_broadcast(known), "_fp", "left_semi")
        .groupBy("_key")
        .agg(F.collect_set("_fp").alias("_hits"))
    )
    # candidates: every window that holds a gram that was met, start and length
    n = F.size("_words")

    def holds(length: int, reach: int) -> Column:
        hashes = gram_hashes(F.col("_words"), length)
        at = F.transform(
            F.filter(
                F.transform(hashes, lambda h, i: F.when(F.array_contains("_hits", h), i)), lambda i: i.isNotNull()
            ),
            lambda i: F.sequence(F.greatest(i - reach, F.lit(0)), i),
        )
        width = length + reach
        fits = F.filter(F.array_distinct(F.flatten(at)), lambda s: s + width <= n)
        return F.transform(fits, lambda s: F.struct(s.alias("s"), F.lit(width).alias("m")))

    none = F.array().cast("array<struct<s:int,m:int>>")
    spots = F.concat(*(F.coalesce(holds(*p), none) for p in [(k, t - k), *((m, 0) for m in short)]))
    runs = F.transform(
        spots, lambda x: F.struct(x["s"], x["m"], F.array_join(F.slice("_words", x["s"] + 1, x["m"]), " ").alias("run"))
    )
    joined = computed(texts.join(met, "_key", "left"), "_words", plain_words(F.col("_text"))).drop("_text")
    table = written(
        joined.select(
            "doc_id", "_key", n.cast("long").alias("n_words"), F.when(F.col("_hits").isNotNull(), runs).alias("_runs")
        )
    )
    found = (
        table.where("_runs is not null")
        .select("_key", F.explode("_runs").alias("_r"))
        .select("_key", F.col("_r.s").alias("s"), F.col("_r.m").alias("length"), F.col("_r.run").alias("run"))
        .distinct()
        .join(bounded_broadcast(windows), ["run", "length"])
        .groupBy("_key")
        .agg(
            F.sort_array(F.collect_set(F.struct("s", (F.col("s") + F.col("length")).alias("e")))).alias("_spans"),
            F.sort_array(F.collect_set("item_id")).alias("_items"),
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    hit = F.aggregate(
        "_spans",
        start,
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("hit"),
            F.greatest(a["end"], x["e"]).alias("end"),
        ),
        lambda a: a["hit"],
    )
    hits = found.select("_key", hit.alias("_hit"), "_items")
    no_items = F.array().cast("array<string>")
    listed = F.coalesce("_items", no_items)
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    return table.drop("_runs").join(hits, "_key", "left").select(
        "_key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, rules: WinnowRules = WinnowRules()) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    mark = fresh(docs, "_row")
    found = contamination(docs.select("doc_id", "text"), items, rules)
    bad = written(found.where("contaminated").select(F.col("_key").alias(mark)).distinct())
    return docs.withColumn(mark, row_key("doc_id", "text")).join(bad, mark, "left_anti").drop(mark)
