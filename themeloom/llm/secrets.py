"""Secret scan by character Markov models.

Base rules find assignments, access keys and hex strings. Beside them, two first-order
Markov models of characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a long token whose log-likelihood ratio speaks for the
random model is a secret too. All of it is column work: matches come from regular
expressions, their places from the lengths of the pieces between them.

* NULL and empty text: no span. Places are code points, ends exclusive.
* Equal rows get equal results; NULL doc_id is kept; other columns are ignored.
* Without labelled samples of both kinds nothing is added to the base spans.
* An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import computed
from themeloom.operators.storage import written

# The base rules of the contract. The lower bounds of access and hex are
# inside the pattern: a shorter run holds no match either way.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED_CHARS = 12
KINDS = ("assign", "access", "hex", "random")

# Characters of a token; all others share the last place.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
SIZE = len(ALPHABET) + 1
STRIDE = 256


@dataclass(frozen=True)
class SecretRules:
    token_chars: int = 20
    # mean log-likelihood ratio per character, natural logarithm, that a secret needs
    ratio: float = 0.0
    # documents whose words and base matches are the labelled samples
    sample_docs: int = 4_000
    smoothing: float = 0.5


def spans_of(rows: DataFrame, name: str, pattern: str, group: int | None = None, least: int = 0, needs: str | tuple[str, ...] = ()) -> DataFrame:
    """Adds array ``name`` of (start, end, value) of the matches of ``pattern`` in _text.

    With ``group``, matches whose group is shorter than ``least`` are dropped, and value
    is that group. Every match holds one of ``needs``.
    """
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    if needs:
        # a text without these characters has no match
        hopeful = reduce(or_, (F.contains("_text", F.lit(x)) for x in needs))
        found = F.when(hopeful, found).otherwise(F.array().cast("array<string>"))
    rows = computed(rows, "_found", found)
    some = F.size("_found") > 0
    if group:
        values = F.when(some, F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)))
        rows = computed(rows, "_values", values)
    else:
        rows = rows.withColumn("_values", F.col("_found"))
    rows = computed(rows, "_gaps", F.when(some, F.transform(F.split("_text", pattern, -1), lambda x: F.length(x))))
    # start: all earlier gaps and matches, summed by strides so that it stays cheap
    rows = computed(rows, "_steps", F.when(some, F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda g, m: g + F.length(m))))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    strides = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_steps") - 1) / STRIDE).cast("int")),
        lambda i: total(F.slice("_steps", i * STRIDE + 1, F.lit(STRIDE))),
    )
    rows = computed(rows, "_strides", F.when(some, strides))

    def place(m: Column, i: Column) -> Column:
        at = F.floor(i / STRIDE).cast("int")
        start = total(F.slice("_strides", F.lit(1), at)) + total(
            F.slice("_steps", at * STRIDE + 1, i - at * STRIDE)
        ) + F.get("_gaps", i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.get("_values", i).alias("value"))

    spans = F.filter(F.transform("_found", place), lambda x: F.length(x["value"]) >= least)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = computed(rows, name, F.when(some, spans).otherwise(empty))
    return rows.drop("_found", "_values", "_gaps", "_steps", "_strides")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the spans of the three base kinds."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = spans_of(rows, "_assign", ASSIGN, 2, ASSIGNED_CHARS, needs=(":", "="))
    return spans_of(spans_of(rows, "_access", ACCESS, needs=("AKIA",)), "_hex", HEX)


def labelled_samples(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """token and random (1 or 0) from a bounded sample of documents, chosen by hash.

    Matches of the base rules are random strings, words without a digit identifiers.
    """
    n = docs.count()
    part = min(1.0, rules.sample_docs / n) if n else 1.0
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(part * 1_000_003) + 1
    rows = base_spans(docs.where(chosen))
    rows = computed(
        rows, "_random", F.transform(F.concat("_assign", "_access", "_hex"), lambda x: x["value"])
    )
    words = F.regexp_extract_all("_text", F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_]{4,}(?![A-Za-z0-9_])"), F.lit(0))
    random = rows.select(F.explode_outer("_random").alias("token"), F.lit(1).alias("random"))
    plain = rows.select(F.explode_outer(words).alias("token"), F.lit(0).alias("random"))
    return random.unionByName(plain).where("token is not null")


def _code(char: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), char)
    return F.when((at == 0) | (char == ""), SIZE - 1).otherwise(at - 1)


def train(samples: DataFrame, rules: SecretRules = SecretRules()) -> list[float] | None:
    """Log-likelihood ratio of every character pair: a table of fixed size."""
    at = F.sequence(F.lit(1), F.length("token") - 1)
    pairs = F.when(F.length("token") > 1, F.transform(at, lambda i: F.substring("token", i, F.lit(2))))
    # equal tokens, then equal pairs are folded before characters are looked up
    pairs_of = (
        samples.groupBy("random", "token")
        .agg(F.count("*").alias("n"))
        .select("random", "n", F.explode_outer(pairs).alias("pair"))
        .where("pair is not null")
        .groupBy("random", "pair")
        .agg(F.sum("n").alias("n"))
    )
    counts = (
        pairs_of.groupBy(
            "random", _code(F.substring("pair", 1, 1)).alias("a"), _code(F.substring("pair", 2, 1)).alias("b")
        )
        .agg(F.sum("n"))
        .collect()
    )
    table = [[rules.smoothing] * SIZE * SIZE for _ in range(2)]
    for kind, a, b, n in counts:
        table[kind][a * SIZE + b] += n
    if len({r[0] for r in counts}) < 2:
        return None
    rows = [[sum(t[a * SIZE : (a + 1) * SIZE]) for a in range(SIZE)] for t in table]
    return [
        math.log(table[1][i] / rows[1][i // SIZE]) - math.log(table[0][i] / rows[0][i // SIZE])
        for i in range(SIZE * SIZE)
    ]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair, random against ordinary."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    n = F.length(token) - 1
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0.0),
        lambda s, i: s
        + F.get(table, _code(F.substring(token, i, F.lit(1))) * SIZE + _code(F.substring(token, i + 1, F.lit(1)))),
    )
    return F.when(n > 0, total / n).otherwise(0.0)


def scan(docs: DataFrame, rules: SecretRules = SecretRules(), ratios: list[float] | None = None) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    if ratios is None:
        ratios = train(written(labelled_samples(docs, rules)), rules)
    rows = base_spans(docs)
    if ratios is None:
        rows = rows.withColumn("_tokens", F.array().cast("array<struct<start:int,end:int,value:string>>"))
    else:
        token = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{rules.token_chars},}}"
        rows = spans_of(rows, "_tokens", token)
        # a token that a base span covers is known already
        rows = computed(rows, "_base", F.concat("_assign", "_access", "_hex"))
        fresh_tokens = F.filter(
            "_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        )
        rows = computed(rows, "_tokens", fresh_tokens)
        rows = computed(rows, "_tokens", F.filter("_tokens", lambda t: log_ratio(t["value"], ratios) >= rules.ratio))

    def of_kind(column: str, kind: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"], F.lit(kind).alias("kind"), x["end"]))

    def listed(*columns: str) -> Column:
        parts = [of_kind(c, k) for k, c in enumerate(columns)]
        names = F.array(*(F.lit(k) for k in KINDS))
        texts = F.transform(
            F.sort_array(F.concat(*parts)),
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        )
        return F.array_join(texts, ",")

    return rows.select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(listed("_assign", "_access", "_hex"), 256).alias("base_sha256"),
        listed("_assign", "_access", "_hex", "_tokens").alias("spans"),
        F.size("_tokens").cast("long").alias("n_random"),
    )
