"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of word beginnings, since insults come in compounds
and inflections. For each labelled text that names a group, the identity term is swapped
for the others of its family and for a neutral stand-in (a word with no weight, as
"people"), and the squared change of the logit is added to the loss (counterfactual logit
pairing). The swaps among a family tie its terms to each other, the swap for the stand-in
ties each to nothing, so a neutral mention of a group moves a score little. Identity terms
have no beginnings: a swap changes their own weights and nothing else. Families are given
for English, German, French and Spanish. The fit reads a bounded sample of labelled rows
in one task; every text is scored.

* NULL and empty text: the score of a text without words, from the intercept alone.
* Repeated labels of an id: the larger one. NULL label or id: not learned from.
* Repeated rows are each scored; other columns are ignored.
* Without a row of both labels to learn from, every score is the share of label 1, or 0.
* An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.heldout import held_out, sampled

# Identity terms, each family on a line; the members of one are swapped.
IDENTITIES = tuple(
    tuple(line.split())
    for line in """
    men women man woman boys girls
    christians muslims jews hindus buddhists atheists
    christian muslim jewish hindu buddhist atheist
    black white asian latino arab
    gay straight lesbian bisexual transgender
    immigrants natives refugees citizens
    deaf blind disabled elderly young
    männer frauen mann frau jungen mädchen
    christen muslime juden hindus buddhisten atheisten
    christlich muslimisch jüdisch
    schwarze weiße asiaten araber
    schwul schwule lesbisch lesben transgender
    einwanderer flüchtlinge migranten bürger
    gehörlose blinde behinderte alte
    hommes femmes homme femme garçons filles
    chrétiens musulmans juifs hindous bouddhistes athées
    chrétien musulman juif
    noirs blancs asiatiques arabes
    gays homosexuels lesbiennes transgenres
    immigrés réfugiés migrants citoyens
    sourds aveugles handicapés vieux
    hombres mujeres hombre mujer niños niñas
    cristianos musulmanes judíos hindúes budistas ateos
    cristiano musulmán judío
    negros blancos asiáticos árabes
    gais homosexuales lesbianas transexuales
    inmigrantes refugiados migrantes ciudadanos
    sordos ciegos discapacitados ancianos
    """.strip().splitlines()
)

NAMED = {term for family in IDENTITIES for term in family}

WORD = re.compile(r"[^\W\d_]+")
# A word counts by its beginnings, a shorter word as a whole: once it is met, and once
# more when several different words have it.
BEGINNINGS = (5, 7)
SEVERAL = 3


@dataclass(frozen=True)
class ToxicRules:
    sample_rows: int = 8_000
    words: int = 5_000
    least_texts: int = 3
    decay: float = 2e-4
    counterfactual: float = 1.0
    steps: int = 400
    threshold: float = 0.7


def words_of(text: str | None) -> set[str]:
    # repeated words are dropped before the slower search
    return set(WORD.findall(" ".join(set((text or "").lower().split()))))


def features(words: set[str]) -> set[str]:
    found = words & NAMED
    others = words - NAMED
    for n in BEGINNINGS:
        starts = Counter([w[:n] for w in others])
        found.update(f"{n}:{s}" for s in starts)
        found.update(f"{n}:{s}--" for s, k in starts.items() if k >= SEVERAL)
    return found


def swaps(words: set[str]) -> Iterator[tuple[str, str]]:
    """Identity terms of a text and what they are swapped for."""
    for family in IDENTITIES:
        for term in family:
            if term in words:
                yield from ((term, other) for other in family if other not in words)


def fit(texts: Iterable[str | None], labels: np.ndarray, rules: ToxicRules) -> dict[str, float]:
    """Weights by feature; the empty one is the intercept."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return {"": -30.0 if share == 0 else 30.0}
    number: dict[str, int] = {}
    rows, pairs, mentions = [], [], []
    for text in texts:
        words = words_of(text)
        # sorted, so that numbers do not depend on the order of a set
        rows.append(np.array([number.setdefault(f, len(number)) for f in sorted(features(words))], np.int32))
        pairs += swaps(words)
        mentions += sorted(words & NAMED)
    # identity terms are always in, or there would be nothing to regularise
    named = np.array([number.setdefault(t, len(number)) for t in sorted(NAMED)])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows)
    counts = np.stack([np.bincount(col[labels[row] == k], minlength=len(number)) for k in (0, 1)])
    total = np.bincount(labels, minlength=2)
    p = counts.sum(axis=0) / total.sum()
    # how far the shares of the two labels differ, in standard errors
    told = np.abs(counts[0] / total[0] - counts[1] / total[1]) / np.sqrt(p * (1 - p) + 1e-9)
    told[counts.sum(axis=0) < rules.least_texts] = -1
    told[named] = np.inf
    chosen = np.sort(np.argsort(-told, kind="stable")[: rules.words])
    chosen = chosen[told[chosen] >= 0]
    place = np.full(len(number), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[col] >= 0
    row, col = row[kept], place[col[kept]]
    left, right = (np.array([place[number[x[k]]] for x in pairs], np.int64) for k in (0, 1))
    alone = np.array([place[number[t]] for t in mentions], np.int64)
    n, y = len(rows), labels.astype(float)
    w, b = np.zeros(len(chosen)), np.log(share / (1 - share))
    m = v = np.zeros(len(chosen) + 1)
    for t in range(1, rules.steps + 1):
        z = b + np.bincount(row, w[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.bincount(col, error[row], minlength=len(w)) + rules.decay * w
        if pairs:
            # the logit change of a swap is the difference of two weights
            change = 2 * rules.counterfactual * (w[right] - w[left]) / n
            grad += np.bincount(right, change, minlength=len(w)) - np.bincount(left, change, minlength=len(w))
        if len(alone):
            # and that of a swap for the neutral stand-in is the term's weight itself
            grad += np.bincount(alone, 2 * rules.counterfactual * w[alone] / n, minlength=len(w))
        g = np.r_[grad, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    names = list(number)
    return {"": float(b), **{names[i]: float(x) for i, x in zip(chosen, w) if x}}


class Scorer:
    """The weights, with those of beginnings apart: (met, met in several words)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.intercept = weights.get("", -30.0)
        self.words = {f: w for f, w in weights.items() if f and ":" not in f}
        self.starts: dict[int, dict[str, list[float]]] = {n: {} for n in BEGINNINGS}
        for f, w in weights.items():
            n, colon, start = f.partition(":")
            if colon:
                known = self.starts[int(n)].setdefault(start.removesuffix("--"), [0.0, 0.0])
                known[start.endswith("--")] = w

    def __call__(self, text: str | None) -> float:
        words = words_of(text)
        z = self.intercept + sum(self.words[w] for w in words & self.words.keys())
        others = words - NAMED
        for n, known in self.starts.items():
            met = Counter([w[:n] for w in others])
            for s in met.keys() & known.keys():
                once, often = known[s]
                z += once + (often if met[s] >= SEVERAL else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules()) -> dict[str, float]:
    """Weights from a bounded sample of labelled texts that are not held out."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    chosen = sampled(own, "doc_id", rules.sample_rows, n)
    texts = sampled(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), "doc_id", rules.sample_rows, n)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        weights = fit(rows["text"], (rows["toxic"].to_numpy() > 0).astype(np.int64), rules)
        return pd.DataFrame({"word": list(weights), "weight": list(weights.values())})

    rows = texts.join(chosen, "doc_id").select("doc_id", "text", "toxic", F.lit(0).alias("all"))
    rows = rows.dropDuplicates(["doc_id"])
    found = rows.groupBy("all").applyInPandas(run, "word string, weight double").collect()
    return {r[0]: r[1] for r in found} or {"": -30.0}


def toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights = train(docs, labels, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(weights)
        for batch in batches:
            scores = np.array([score(x.as_py()) for x in batch.column(2)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= rules.threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
