"""Language identification by nearest centroids.

Texts are normalised TF-IDF vectors of hashed character n-grams. The texts of each
language are clustered on the sphere, since one language has several kinds of text; a
text takes the language of the nearest centroid by cosine. Where even that is farther
than nearly all texts the language was learned from, the prediction is marked rejected.

* NULL text or no letter: ``und``, score 0, rejected.
* NULL lang is not learned from, but predicted. Rows may repeat; other columns are
  ignored; an empty table gives an empty result.
* Nothing to learn from: ``und`` for every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import bounded_broadcast
from themeloom.llm.heldout import held_out
from themeloom.operators.storage import written

LETTER = re.compile(r"[^\W\d_]")
# Letters of a text that are looked at in one step; texts of any length are read whole.
PIECE = 1 << 20


@dataclass(frozen=True)
class LanguageRules:
    sample_rows: int = 2_000  # per language
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 13
    centroids: int = 3
    rounds: int = 8
    # share of its own sample that a language may reject
    rejected: float = 0.01


def gram_counts(text: str, rules: LanguageRules) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased text, digits and signs as blanks."""
    counts = np.zeros(1 << rules.bits, np.float32)
    most = max(rules.orders)
    plain = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    for at in range(0, len(plain), PIECE):
        # pieces overlap, and an n-gram counts in the piece that it starts in
        codes = np.frombuffer(plain[at : at + PIECE + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in rules.orders:
            starts = min(PIECE, len(codes) - n + 1)
            if starts <= 0:
                continue
            h = np.full(starts, 2166136261 + n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : i + starts]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32((1 << rules.bits) - 1), minlength=1 << rules.bits).astype(np.float32)
    return counts


def vectors(texts: list[str], idf: np.ndarray, rules: LanguageRules) -> np.ndarray:
    x = np.log1p(np.stack([gram_counts(t, rules) for t in texts])) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids on the unit sphere; starts from the rows least like those taken so far."""
    taken = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(taken) < min(k, len(x)):
        taken.append(int(np.argmin((x @ x[taken].T).max(axis=1))))
    centres = x[taken]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def sample(docs: DataFrame, rules: LanguageRules) -> DataFrame:
    """A bounded number of rows per language, chosen by hash: lang and text."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")))
    part = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < rules.sample_rows / F.col("n") * (1 << 30)
    return rows.join(bounded_broadcast(sizes), "lang").where(part).select("lang", "doc_id", "text")


def document_frequencies(texts: DataFrame, rules: LanguageRules) -> tuple[np.ndarray, int]:
    """Of each hashed n-gram over the sample: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << rules.bits, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                seen += gram_counts(x.as_py(), rules) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], names=["at", "n"])

    frequency, total = np.zeros(1 << rules.bits), 0
    for at, n in texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        if at < 0:
            total = n
        else:
            frequency[at] = n
    return frequency, total


def train(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """idf, and per centroid its language, vector and the cosine that is near enough."""
    texts = written(sample(docs, rules))
    frequency, total = document_frequencies(texts, rules)
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        rows = rows[[bool(LETTER.search(t)) for t in rows["text"]]]
        if rows.empty:
            return pd.DataFrame({"lang": [], "near": [], "centre": []})
        x = vectors(list(rows["text"]), idf, rules)
        centres = spherical_centroids(x, rules.centroids, rules.rounds)
        near = float(np.quantile((x @ centres.T).max(axis=1), rules.rejected))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "near": near, "centre": [c.tobytes() for c in centres]})

    found = texts.groupBy("lang").applyInPandas(run, "lang string, near double, centre binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    centres = np.stack([np.frombuffer(bytes(r["centre"]), np.float32) for r in found]) if found else np.zeros((0, len(idf)), np.float32)
    return idf, [r["lang"] for r in found], centres, np.array([r["near"] for r in found])


def predict(texts: list[str | None], model: tuple, rules: LanguageRules) -> list[tuple[str, float, bool]]:
    idf, langs, centres, near = model
    out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
    lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    for at in range(0, len(lettered) if langs else 0, 256):
        part = lettered[at : at + 256]
        cosine = vectors([texts[i] for i in part], idf, rules) @ centres.T
        best = cosine.argmax(axis=1)
        for i, c, s in zip(part, best, cosine[np.arange(len(part)), best]):
            out[i] = (langs[c], float(min(1.0, max(0.0, s))), bool(s < near[c]))
    return out


def languages(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = train(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = predict([x.as_py() for x in batch.column(2)], model, rules)
            columns = list(zip(*told)) if told else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_())))],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
