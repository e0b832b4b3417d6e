"""Key terms rated inside the chunk or by a join: the same terms, no token shuffled twice."""

import math
import random
from collections import Counter

import pytest

from themeloom.operators import retrieval as R


def brute(rows, per_chunk):
    """Weights over all rows; rows of one (key, chunk_no) add up."""
    split = [(k, n, t.split()) for k, n, t in rows]
    df = Counter(t for _, _, ts in split for t in set(ts))
    merged = {}
    for k, n, ts in split:
        merged.setdefault((k, n), Counter()).update(ts)
    out = {}
    for at, counts in merged.items():
        weight = {t: -round(c * (math.log((len(rows) + 1) / (df[t] + 1)) + 1), 6) for t, c in counts.items()}
        if weight:
            out[at] = sorted(sorted(weight, key=lambda t: (weight[t], t))[:per_chunk])
    return out


@pytest.mark.parametrize("listed", [100_000, 7])
def test_key_terms_against_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(R, "FREQUENT_TERMS", listed)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i % 40, i // 40, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randrange(0, 30)))) for i in range(90)]
    rows += [(3, 0, "w1 w1 w1 w59"), (None, 0, "w2 w2 w3"), (None, 0, "w3 zz"), (77, 0, "")]
    df = spark.createDataFrame(rows, "doc_id int, chunk_no int, text string")
    got = R.key_terms(df, "doc_id", 4, stop_words=[]).collect()
    assert len(got) == len({(r["doc_id"], r["chunk_no"]) for r in got})
    assert {(r["doc_id"], r["chunk_no"]): r["terms"] for r in got} == brute(rows, 4)


def test_frequent_terms_need_no_shuffle(spark):
    df = spark.createDataFrame([(i, 0, f"w{i} w{i + 1} w1") for i in range(50)], "doc_id int, chunk_no int, text string")
    plan = R.key_terms(df, "doc_id", 2, stop_words=[])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
