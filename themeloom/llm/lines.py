"""Line dedup by a segment-partition edit join.

Equal lines are folded. Two different lines within ``max_edits`` edits share, at nearly
the same place, one of the ``max_edits + 1`` segments of the shorter one. Every line
gives its own segments as an index, by length, and probes the indexes of the lengths
that can be near with the substrings that can match (the multi-match-aware choice of
Li et al., 2011). Candidates whose letter counts are too far apart are left inside the
join; the rest is verified by a banded bit-parallel edit distance. All of it is column
work.

A line is dropped if an earlier line is equal or near. The order is doc_id, then
position. A line is compared without its outer blanks.

* Lines of fewer than ``min_chars`` characters are left alone, as are NULL and empty
  texts.
* Rows that share a doc_id are one document and never drop each other's lines at the
  same position; NULL doc_id comes last and is one document.
* Equal rows get equal results. Other columns are ignored by ``line_report`` and kept
  by ``dedup_lines``.
* An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import bounded_broadcast, computed, fresh, packed, row_key, spaced_words
from themeloom.operators.storage import written

# Letters whose counts, modulo 4, are compared before the text is.
COUNTED = "etaoinsrhldcumkb"
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class LineRules:
    max_edits: int = 2
    min_chars: int = 20


def occurrences(docs: DataFrame, rules: LineRules) -> DataFrame:
    """_key, place (order over all lines), pos and line of every judged line."""
    lines = F.split("text", "\n")
    rows = docs.select(row_key("doc_id", "text").alias("_key"), "doc_id", F.posexplode_outer(lines).alias("pos", "line"))
    ordered = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).cast("decimal(20,0)")
    place = (ordered * F.lit(10**9).cast("decimal(10,0)") + F.col("pos")).cast("decimal(32,0)")
    return rows.select("_key", place.alias("place"), "pos", F.trim("line").alias("line")).where(
        F.length("line") >= rules.min_chars
    )


def letter_counts(line: Column) -> Column:
    """Counts of the listed letters, two bits each."""
    packed_counts = F.lit(0)
    for i, letter in enumerate(COUNTED):
        n = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        packed_counts = packed_counts.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(3)), 2 * i))
    return packed_counts


def counts_apart(a: Column, b: Column) -> Column:
    """At most the true difference of the counts: an edit changes it by two or less."""
    total = F.lit(0)
    for i in range(len(COUNTED)):
        x = F.shiftright(a, 2 * i).bitwiseAND(F.lit(3))
        y = F.shiftright(b, 2 * i).bitwiseAND(F.lit(3))
        total = total + F.least((x - y).bitwiseAND(F.lit(3)), (y - x).bitwiseAND(F.lit(3)))
    return total


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start, from 0, and size of segment ``i`` of a line of ``length`` characters."""
    parts = edits + 1
    size = F.floor(length / parts).cast("int")
    shorter = parts - (length - size * parts)
    start = size * i + F.greatest(F.lit(i) - shorter, F.lit(0))
    return start, size + F.when(F.lit(i) >= shorter, 1).otherwise(0)


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    keys = []
    for i in range(edits + 1):
        start, size = segment(length, i, edits)
        keys.append(F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size)))
    return keys


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys of the shorter or equally long lines that can be near."""
    keys = []
    for shorter_by in range(edits + 1):
        n = length - shorter_by
        for i in range(edits + 1):
            start, size = segment(n, i, edits)
            low = max(-i, shorter_by - (edits - i))
            high = min(i, shorter_by + (edits - i))
            for shift in range(low, high + 1):
                at = start + shift
                fits = (at >= 0) & (at + size <= length) & (size > 0)
                keys.append(F.when(fits, F.xxhash64(n, F.lit(i), F.substring(line, at + 1, size))))
    return keys


def common_prefix(a: Column, b: Column, reverse: bool = False) -> Column:
    """Length of the common prefix (or suffix) by bisection over powers of two."""
    most = F.least(F.length(a), F.length(b))

    def same(n: Column) -> Column:
        if reverse:
            return F.right(a, n) == F.right(b, n)
        return F.left(a, n) == F.left(b, n)

    powers = F.array(*(F.lit(1 << i) for i in range(30, -1, -1)))
    fitting = F.filter(powers, lambda p: p <= most)
    return F.aggregate(
        fitting, F.lit(0), lambda n, p: F.when((p <= most - n) & same(n + p), n + p).otherwise(n)
    )


def banded_distance(pairs: DataFrame, a: str, b: str, edits: int, name: str) -> DataFrame:
    """Adds the edit distance of two strings, or a number above ``edits`` if it is larger.

    After common ends are cut off, one machine word holds the vertical differences of
    the band around the diagonal; it moves down a row with each character (Hyyro, 2003).
    """
    lead = common_prefix(F.col(a), F.col(b))
    rest = pairs.withColumn("_lead", lead)
    rest = rest.withColumns({f"_{c}": F.expr(f"substring({c}, _lead + 1)") for c in (a, b)})
    rest = rest.withColumn("_tail", common_prefix(F.col(f"_{a}"), F.col(f"_{b}"), reverse=True))
    chars = {
        f"_{c}": F.when(F.length(f"_{c}") > F.col("_tail"), F.split(F.expr(f"left(_{c}, length(_{c}) - _tail)"), ""))
        .otherwise(F.array().cast("array<string>"))
        for c in (a, b)
    }
    rest = rest.withColumns(chars)
    n, m = F.size(f"_{a}"), F.size(f"_{b}")
    width = 2 * edits + 1
    ones = (1 << width) - 1

    def inside(x: Column) -> Column:
        return x.bitwiseAND(F.lit(ones))

    def flag(x: Column, at: Column | int) -> Column:
        return F.getbit(x, at if isinstance(at, Column) else F.lit(at)).cast("int")

    def step(s: Column, j: Column) -> Column:
        char = F.get(f"_{b}", j - 1)
        match = F.lit(0)
        for t in range(width):
            same = F.coalesce(F.get(f"_{a}", j - edits + t - 1) == char, F.lit(False))
            match = match + F.when(same, 1 << t).otherwise(0)
        first = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("x"))
        # a one-element array binds a value once inside a lambda
        return F.get(F.transform(F.array(first), lambda w: columns(w, j)), 0)

    def columns(w: Column, j: Column) -> Column:
        vp, vn, x = w["vp"], w["vn"], w["x"]
        diagonal = inside(((x.bitwiseAND(vp)) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))
        bound = F.struct(vp.alias("vp"), vn.alias("vn"), w["d"].alias("d"), diagonal.alias("d0"))
        return F.get(F.transform(F.array(bound), lambda v: advance(v, j)), 0)

    def advance(v: Column, j: Column) -> Column:
        vp, vn, d0 = v["vp"], v["vn"], v["d0"]
        plus = inside(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))))
        minus = d0.bitwiseAND(vp)
        row = n - j + edits
        grown = F.when(j + edits <= n, 1 - flag(d0, 2 * edits)).otherwise(flag(plus, row) - flag(minus, row))
        down = F.shiftright(d0, 1)
        return F.struct(
            inside(minus.bitwiseOR(F.bitwise_not(down.bitwiseOR(plus)))).alias("vp"),
            down.bitwiseAND(plus).alias("vn"),
            (v["d"] + grown).alias("d"),
        )

    start = F.struct(
        F.lit(ones - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(n, F.lit(edits)).alias("d")
    )
    # along the band the score falls by one a column at most, over the last columns only
    hopeless = 3 * edits
    walked = F.aggregate(
        F.sequence(F.lit(1), m), start, lambda s, j: F.when(s["d"] > hopeless, s).otherwise(step(s, j)), lambda s: s["d"]
    )
    distance = (
        F.when(F.abs(n - m) > edits, edits + 1).when((n == 0) | (m == 0), F.greatest(n, m)).otherwise(walked)
    )
    return computed(rest, name, distance).drop("_lead", "_tail", f"_{a}", f"_{b}")


BITMAP_BITS = 1 << 30  # at most 128 MB of bitmap for the index keys
BITS_PER_KEY = 16


def might_meet(probes: DataFrame, index: DataFrame, keys: int) -> DataFrame:
    """Probes whose key may be an index key, by a bitmap of hashed index keys built with
    Spark's bitmap aggregates. Its size is bounded by BITMAP_BITS, so it is broadcast."""
    bits = int(min(BITMAP_BITS, max(1 << 15, BITS_PER_KEY * keys)))
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    table = index.select(place(F.col("key")).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map")
    )
    at = probes.withColumn("_p", place(F.col("key")))
    at = at.join(F.broadcast(table), F.bitmap_bucket_number("_p") == F.col("_bucket"))
    # bit p of a bitmap is bit p % 8 of its byte p div 8
    held = F.expr(
        "shiftright(cast(conv(hex(substr(_map, cast(bitmap_bit_position(_p) div 8 AS INT) + 1, 1)), 16, 10) AS INT),"
        " cast(bitmap_bit_position(_p) % 8 AS INT)) & 1 = 1"
    )
    return at.where(held).drop("_p", "_bucket", "_map")


def distinct_lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """Every judged line once: id, line, its first place, how often it occurs, its counts."""
    folded = (
        occurrences(docs, rules).groupBy("line").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    )
    return packed(
        folded.select(F.xxhash64("line").alias("id"), "line", "place", "n", letter_counts(F.col("line")).alias("letters"))
    )


def line_links(lines: DataFrame, rules: LineRules) -> DataFrame:
    """Pairs of different lines within the edit limit: earlier and later, as ids."""
    edits = rules.max_edits
    own = F.col("line"), F.length("line")

    def keyed(keys: list[Column], name: str, letters: str) -> DataFrame:
        # keys as plain columns first: an array of hashes inside the generator is slower
        parts = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        flat = lines.select(F.col("id").alias(name), F.col("letters").alias(letters), *parts)
        keys_ = F.explode(F.array(*[f"_k{i}" for i in range(len(parts))])).alias("key")
        return flat.select(name, letters, keys_).where("key is not null")

    index = keyed(index_keys(*own, edits), "a", "la")
    probes = keyed(probe_keys(*own, edits), "b", "lb")
    # most probe keys meet no index key: a bitmap of the index keys drops them before
    # the shuffle (false positives only, so the join's result is unchanged)
    # lines is a stored table: its count is read from the files' footers
    near = (F.col("a") != F.col("b")) & (counts_apart(F.col("la"), F.col("lb")) <= 2 * edits)
    found = index.join(might_meet(probes, index, (edits + 1) * lines.count()), "key").where(near)
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = packed(lines.join(bounded_broadcast(ids), "id").select("id", "line", "place"))
    sides = pairs
    for side in ("a", "b"):
        named = texts.select(
            F.col("id").alias(side), F.col("line").alias(f"text_{side}"), F.col("place").alias(f"place_{side}")
        )
        sides = sides.join(named, side)
    checked = banded_distance(sides, "text_a", "text_b", edits, "edits").where(F.col("edits") <= edits)
    earlier = (F.col("place_a") < F.col("place_b")) | (
        (F.col("place_a") == F.col("place_b")) & (F.col("text_a") < F.col("text_b"))
    )
    return written(
        checked.select(
            F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("earlier"),
            F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("later"),
        )
    )


def dropped_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Per _key: links of its lines, and _drops (pos, near) of the lines that go."""
    lines = distinct_lines(docs, rules)
    links = line_links(lines, rules)
    ends = links.select(F.col("later").alias("id"), F.lit(1).alias("near")).unionByName(
        links.select(F.col("earlier").alias("id"), F.lit(0).alias("near"))
    )
    degrees = written(ends.groupBy("id").agg(F.max("near").alias("near"), F.count("*").alias("links")))
    told = lines.select("id", "place", "n").join(degrees, "id", "left")
    told = written(
        told.where("n > 1 or links is not null").select(
            "id", F.col("place").alias("first"), F.coalesce("near", F.lit(0)).alias("near"),
            F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        )
    )
    rows = occurrences(docs, rules).select("_key", "place", "pos", F.xxhash64("line").alias("id"))
    met = rows.join(told, "id").select(
        "_key", "pos", "links",
        F.when(F.col("place") != F.col("first"), F.lit(0)).when(F.col("near") == 1, F.lit(1)).alias("why"),
    )
    marks = F.collect_set(F.struct("pos", "why", "links"))
    return met.groupBy("_key").agg(F.sort_array(marks).alias("_marks"))


def line_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Per document: lines judged, dropped as equal, dropped as near, their positions, links."""
    judged = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= rules.min_chars))
    rows = docs.select(
        "doc_id", row_key("doc_id", "text").alias("_key"), F.greatest(judged, F.lit(0)).cast("long").alias("n_lines")
    )
    marks = F.coalesce("_marks", F.array().cast("array<struct<pos:int,why:int,links:bigint>>"))
    joined = rows.join(dropped_lines(docs, rules), "_key", "left").withColumn("_marks", marks)
    gone = F.filter("_marks", lambda x: x["why"].isNotNull())
    return joined.select(
        "doc_id",
        "n_lines",
        F.size(F.filter("_marks", lambda x: x["why"] == 0)).cast("long").alias("n_equal"),
        F.size(F.filter("_marks", lambda x: x["why"] == 1)).cast("long").alias("n_near"),
        F.aggregate("_marks", F.lit(0).cast("long"), lambda a, x: a + x["links"]).alias("n_links"),
        F.array_join(F.transform(gone, lambda x: x["pos"].cast("string")), ",").alias("dropped"),
    )


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents without their dropped lines; all columns stay, n_chars follows the text.

    A document goes if lines were dropped from it and nothing with a word is left.
    """
    mark, drops = fresh(docs, "_row"), fresh(docs, "_drops")
    found = dropped_lines(docs.select("doc_id", "text"), rules)
    gone = F.transform(F.filter("_marks", lambda x: x["why"].isNotNull()), lambda x: x["pos"])
    found = found.select(F.col("_key").alias(mark), gone.alias(drops)).where(F.size(drops) > 0)
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drops))
    rest, cut = fresh(docs, "_rest"), F.col(drops).isNotNull()
    keyed = docs.withColumn(mark, row_key("doc_id", "text")).join(found, mark, "left")
    cleaned = computed(
        computed(keyed, mark, lines),
        rest,
        F.when(cut, F.array_join(F.transform(left, lambda i: F.get(mark, i)), "\n")).otherwise(F.col("text")),
    )
    lost = F.size(spaced_words(F.col(rest))) == 0
    changed = {"text": F.col(rest)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(rest)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.where(~(cut & lost)).withColumns(changed).select(*docs.columns)
