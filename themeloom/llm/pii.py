"""Personal data by base rules and bootstrapped contexts.

Base rules find emails, addresses, cards and phone numbers. Their matches are seeds: the
words around them are lexical patterns, and Spark scores the graph of patterns and
instances in rounds. A pattern is trusted as far as its instances are, an instance as
far as its patterns. Patterns of high confidence then mark identifiers that no base rule
knows.

* NULL and empty text: no span. Places are code points, ends exclusive.
* Equal rows get equal results and count as one piece of evidence.
* NULL doc_id is kept; other columns are ignored; an empty table gives no rows.
* A match that fails its rule is dropped, and the search goes on after it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import bounded_broadcast, row_key
from themeloom.operators.storage import written

# The kinds of the contract in their order, and that of the method.
KINDS = ("email", "ip", "card", "phone", "context")

# The contract's patterns, written so that a long run of their characters is read once:
# an email is searched from its @, a number from the first digit of its run.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What may be an identifier: a run of its characters with digits in it.
TOKEN = re.compile(r"(?<![\w@])(?=[A-Za-z/_-]{0,12}[0-9])[\w@.+/:-]{6,64}(?![\w@])", re.ASCII)
WORD = re.compile(r"\w+")

FOUND = (
    "id {id}, h long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "seen array<struct<start:int,end:int,pattern:string,instance:string,seed:boolean>>"
)


@dataclass(frozen=True)
class BootstrapRules:
    rounds: int = 3
    # different seeds that a pattern needs, and the confidence of patterns and instances
    seeds: int = 3
    confidence: float = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for found in AT.finditer(text):
        start = found.start()
        if start < done:
            continue
        # back over the local part, not into the match before
        while start > done and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < found.start():
            done = found.end()
            yield start, done


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's matches, in order."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in emails(text)]
    for found in IP.finditer(text):
        # the value of a long run of digits need not be made: leading zeros apart, three are enough
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.groups()):
            spans.append((found.start(), 1, found.end()))
    for found in CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((found.start(), 2, found.end()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, found[0])) <= 15:
                spans.append((found.start(), 3, found.end()))
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Identifiers and base matches with the two words before them as their pattern."""
    seen, covered = [], 0
    places = [(a, b, True) for a, _, b in spans]
    at = 0
    for found in TOKEN.finditer(text):
        a, b = found.start(), found.end()
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        if at == len(spans) or spans[at][0] >= b:
            places.append((a, b, False))
    for a, b, seed in sorted(places):
        if a < covered:
            continue
        covered = b
        # words are looked for in the neighbourhood only; a longer word has no use as a pattern
        before = WORD.findall(text[max(0, a - 60) : a].lower())[-2:]
        if len(before) == 2:
            seen.append({"start": a, "end": b, "pattern": " ".join(before), "instance": text[a:b], "seed": seed})
    return seen


def found_in(docs: DataFrame) -> DataFrame:
    """Base results of every row and what its contexts say; texts never leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                text = x.as_py() or ""
                spans = base_spans(text)
                count = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                told = listed(spans)
                rows.append((*count, hashlib.sha256(told.encode()).hexdigest(), told, contexts(text, spans)))
            columns = list(zip(*rows)) if rows else [()] * 7
            seen = pa.array(
                columns[6],
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())])),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:6]), seen],
                names=["id", "h", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "seen"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key("doc_id", "text").alias("_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select(F.col("_key.id").alias("id"), F.col("_key.h").alias("h"), "text").mapInArrow(run, FOUND.format(id=kind))


def bootstrap(edges: DataFrame, rules: BootstrapRules = BootstrapRules()) -> DataFrame:
    """Trusted patterns of edges (pattern, instance, seed): pattern, score.

    A pattern's score is the mean confidence of its instances, lowered while few of them
    are trusted. An instance that is no seed is trusted unless all its patterns err.
    """
    graph = written(edges.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    # only patterns that seeds induce take part, and instances that they reach
    induced = graph.groupBy("pattern").agg(F.sum("seed").alias("n")).where(F.col("n") >= rules.seeds).select("pattern")
    graph = written(graph.join(written(induced), "pattern"))
    trust = graph.select("pattern", "instance", "seed", F.col("seed").alias("trust"))
    for _ in range(rules.rounds):
        mass = F.sum("trust")
        score = mass / F.count("*") * (1 - 1 / (1 + mass))
        scores = written(trust.groupBy("pattern").agg(score.alias("score")))
        good = scores.where(F.col("score") >= rules.confidence)
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        reached = written(graph.join(good, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("reached")))
        trust = graph.join(reached, "instance", "left").select(
            "pattern", "instance", "seed", F.greatest("seed", F.coalesce("reached", F.lit(0.0))).alias("trust")
        )
    return written(good)


def personal_data(docs: DataFrame, rules: BootstrapRules = BootstrapRules()) -> DataFrame:
    """Counts, digest of the base spans, and all spans, of every document."""
    rows = written(found_in(docs))
    seen = rows.select("id", "h", F.explode_outer("seen").alias("s")).where("s is not null").select("id", "h", "s.*")
    # equal rows are one piece of evidence already, since an edge is counted once
    good = bootstrap(seen, rules)
    added = (
        seen.where(~F.col("seed"))
        .join(bounded_broadcast(good), "pattern")
        .groupBy("id", "h")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_added"))
        .select(F.struct("id", "h").alias("_key"), "_added")
    )
    joined = rows.drop("seen").withColumn("_key", F.struct("id", "h")).join(added, "_key", "left")
    base = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    more = F.transform(
        "_added", lambda x: F.concat_ws(":", F.lit(KINDS[4]), x["start"].cast("string"), x["end"].cast("string"))
    )
    kinds = F.array(*(F.lit(k) for k in KINDS))
    order = F.transform(
        F.concat(base, more),
        lambda s: F.struct(
            F.get(F.split(s, ":"), 1).cast("int").alias("at"), F.array_position(kinds, F.get(F.split(s, ":"), 0)), s.alias("s")
        ),
    )
    merged = F.array_join(F.transform(F.sort_array(order), lambda x: x["s"]), ",")
    return joined.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("_added").isNull(), F.col("spans")).otherwise(merged).alias("spans"),
        F.coalesce(F.size("_added"), F.lit(0)).cast("long").alias("n_context"),
    )
