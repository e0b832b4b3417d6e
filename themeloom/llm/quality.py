"""Quality rules: distribution divergence from language references.

Per document, one scan counts character classes and common words beside the plain
rules. The sums over all documents of a language are its reference. A document goes
if the Jensen-Shannon distance of its histogram to the reference is too large, or if
it breaks a plain rule.

* NULL and empty text: no words, so the plain rule rejects it.
* A text is also too far from a reference at a share of the distance that a text without
  any common word has: junk and texts of another language come near to it.
* NULL lang: the reference of all documents together, and the nearest language's for the
  share.
* A language with too little text for a reference: the reference of all documents, by the
  absolute limits only, since a clean text uses the words of one language.
* Fewer characters or words than the guards ask for: the histogram is not judged. A
  reference with so few common words that a text may well have none gives no share.
* Equal rows get equal results; NULL doc_id is kept as it is; other columns are ignored.
* An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import bounded_broadcast, fresh, row_key, spaced_words
from themeloom.operators.storage import written

# Frequent words whose shares are compared, ten a language (English,
# German, French, Spanish). Which language uses which is learned from the documents.
COMMON_WORDS = tuple(
    dict.fromkeys(
        """
        the of and to in is that for on with
        der die und in den von das mit sich ist
        de la le et les des en un du est
        de la que el en y los se del las
        """.split()
    )
)

# The characters that the contract counts as symbols, and punctuation.
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!\"'(),./:;?@\[\]_{}~^`+=\\-]"


# So many different repeated windows are looked up one by one; the result is the same.
LOOKED_UP = 12

# Sizes of the two histograms: character classes, common words and the rest.
CLASSES = 6
WIDTHS = {"_classes": CLASSES, "_counts": len(COMMON_WORDS) + 1}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeated_percent: int = 50
    # guards and limits of the histograms; distances are between 0 and 1
    judged_chars: int = 200
    judged_words: int = 100
    class_distance: float = 0.3
    word_distance: float = 0.5
    # shares of the distance of a text without common words; the second is for texts of
    # less than judged_words, where so many common words are expected
    word_share: float = 0.75
    short_share: float = 0.95
    expected_common: float = 5.0
    reference_words: int = 10_000


def text_statistics(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Counts of every document, by column work on the row alone."""
    key = row_key("doc_id", "text") if key is None else key
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.col("lang"), key.alias("_key"), text.alias("_text"), spaced_words(text).alias("_words")
    )
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(*(F.get("_words", i + j) for j in range(3))),
        ),
    )
    common = F.filter("_words", lambda w: w.isin(*COMMON_WORDS))
    rows = rows.select(
        "*",
        windows.alias("_windows"),
        lines.alias("_lines"),
        F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")).alias("_common"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(PUNCTUATION)).cast("long").alias("_punctuation"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("_upper"),
        F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("_digits"),
    )
    # Only a text with some repeated window is sorted, and by its hashes alone. Where few
    # hashes repeat, their places are looked up; else hashes are sorted with their places.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.select("*", F.when(repeats, F.sort_array("_windows")).alias("_sorted"))
    again = F.filter("_sorted", lambda x, j: F.get("_sorted", j + 1) == x)
    rows = rows.select("*", F.array_distinct(again).alias("_again"))
    few = F.size("_again") <= LOOKED_UP
    ordered = F.when(
        ~few, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    rows = rows.select("*", ordered.alias("_ordered"))
    found = F.filter(
        "_ordered",
        lambda x, j: (F.get("_ordered", j - 1)["h"] == x["h"]) | (F.get("_ordered", j + 1)["h"] == x["h"]),
    )
    places = F.filter(
        F.transform("_windows", lambda h, i: F.when(F.array_contains("_again", h), i)), lambda i: i.isNotNull()
    )
    starts = F.when(few, places).otherwise(F.sort_array(F.transform(found, lambda x: x["i"])))
    rows = rows.select("*", F.when(F.size("_again") > 0, starts).alias("_starts"))
    reach = F.transform(
        "_starts", lambda p, j: F.coalesce(F.least(F.get("_starts", j + 1) - p, F.lit(3)), F.lit(3))
    )
    repeated = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0))
    shown = F.length("_common")
    counts = [
        ((shown - F.length(F.replace("_common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
        for w in COMMON_WORDS
    ]
    rows = rows.select(
        "_key",
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.length("_text").cast("long").alias("_chars"),
        F.array(
            F.length("_text") - F.col("word_chars"),
            F.col("n_symbols"),
            F.col("_punctuation"),
            F.col("_upper"),
            F.col("_digits"),
            F.col("word_chars") - F.col("n_symbols") - F.col("_punctuation") - F.col("_upper") - F.col("_digits"),
        ).alias("_classes"),
        F.array(*counts).alias("_counts"),
    )
    rest = F.col("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("_counts", F.concat("_counts", F.array(rest)))


def _shares(counts: str, total: str) -> Column:
    """Both are names of stored columns, so that the total is not summed anew per share."""
    return F.transform(counts, lambda x: F.when(F.col(total) > 0, x / F.col(total)).otherwise(0.0))


def _bits(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, between 0 and 1."""
    parts = F.zip_with(p, q, lambda a, b: _bits((a + b) / 2) - (_bits(a) + _bits(b)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(statistics: DataFrame) -> DataFrame:
    """Histogram sums per language over all documents that pass the plain rules."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, w in WIDTHS.items() for i in range(w)]
    table = statistics.where(~F.col("base_failed")).groupBy("lang").agg(
        *sums, F.sum("n_words").alias("_all_words"), F.sum("_chars").alias("_all_chars")
    )
    arrays = [F.array(*(F.col(f"{c}{i}") for i in range(w))).alias(f"_all{c}") for c, w in WIDTHS.items()]
    return table.select("lang", "_all_words", "_all_chars", *arrays)


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), key: Column | None = None) -> DataFrame:
    """One row per document: counts, distances and whether it is kept."""
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeated_percent * F.col("n_words")
    )
    stats = written(text_statistics(docs, key).withColumn("base_failed", failed))
    refs = written(references(stats))
    # one row of sums, whatever the size of the corpus
    pooled = refs.agg(*(F.sum(F.col(f"_all{c}")[i]) for c, w in WIDTHS.items() for i in range(w))).first()
    everywhere = []
    for part in (pooled[:CLASSES], pooled[CLASSES:]):
        total = sum(x or 0 for x in part) or 1
        everywhere.append(F.array(*(F.lit((x or 0) / total) for x in part)))
    own = refs.where(F.col("lang").isNotNull() & (F.col("_all_words") >= rules.reference_words)).select(
        "lang",
        _shares("_all_classes", "_all_chars").alias("_ref_classes"),
        _shares("_all_counts", "_all_words").alias("_ref_counts"),
    )
    bare = F.lit([0.0] * len(COMMON_WORDS) + [1.0])
    ref = F.struct(F.col("_ref_counts").alias("p"), js_distance(bare, F.col("_ref_counts")).alias("bare"))
    own = written(own.withColumn("_near", F.array(ref)))
    # rows without a language take the nearest of all references
    lost = own.agg(F.flatten(F.collect_list("_near")).alias("_near")).select(
        F.lit(None).cast(own.schema["lang"].dataType).alias("lang"),
        F.lit(None).cast("array<double>").alias("_ref_classes"),
        F.lit(None).cast("array<double>").alias("_ref_counts"),
        "_near",
    )
    own = written(own.unionByName(lost)).withColumnRenamed("lang", "_lang")
    joined = stats.join(bounded_broadcast(own), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    joined = joined.withColumn("_own", _shares("_counts", "n_words"))
    classes = js_distance(_shares("_classes", "_chars"), F.coalesce("_ref_classes", everywhere[0]))
    counts = js_distance(F.col("_own"), F.coalesce("_ref_counts", everywhere[1]))
    telling = F.filter("_near", lambda r: F.col("n_words") * (1 - F.element_at(r["p"], -1)) >= rules.expected_common)
    shares = F.array_min(F.transform(telling, lambda r: js_distance(F.col("_own"), r["p"]) / r["bare"]))
    scored = joined.select(
        "*",
        F.coalesce(F.when(F.col("_chars") >= rules.judged_chars, classes), F.lit(0.0)).alias("class_distance"),
        F.coalesce(F.when(F.col("n_words") >= rules.judged_words, counts), F.lit(0.0)).alias("word_distance"),
        F.coalesce(F.when(F.col("n_words") >= rules.min_words, shares), F.lit(0.0)).alias("_share"),
    )
    most = F.when(F.col("n_words") >= rules.judged_words, rules.word_share).otherwise(rules.short_share)
    far = (
        (F.col("class_distance") > rules.class_distance)
        | (F.col("word_distance") > rules.word_distance)
        | (F.col("_share") > most)
    )
    return scored.select(
        "_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance",
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    mark = fresh(docs, "_row")
    verdicts = quality_verdicts(docs.select("doc_id", "lang", "text"), rules)
    bad = written(verdicts.where(~F.col("kept")).select(F.col("_key").alias(mark)).distinct())
    keyed = docs.withColumn(mark, row_key("doc_id", "text"))
    return keyed.join(bad, mark, "left_anti").drop(mark)
