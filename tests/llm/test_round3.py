"""Whitening, SentencePiece and the Merkle manifest against brute force on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from themeloom.llm import pieces, whitening

rng = random.Random(11)
TEXTS = [None, "", " ", "  ", "a ", " a", "x\ty\nz  ", "▁a", "a▁▁ b", "ﬁ ①", "  lead  and trail   ",
         "　x", "emoji 😀 x", "é à ü. 12 ßÖ", "word " * 5000 + "end"]
TEXTS += [" ".join(rng.choice(["alpha", "beta", "Gamma", "δέλτα", "x1", "--", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(40)]


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_chunks_encode_as_the_library(processor):
    assert [list(x) for x in pieces.chunked_ids(processor, TEXTS)] == [processor.encode(t or "") for t in TEXTS]


def test_piece_report(spark, processor):
    rows = [(i % 7 if i != 3 else None, t, "clash", 9) for i, t in enumerate(TEXTS + TEXTS[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = sorted((tuple(r) for r in pieces.piece_report(df).collect()), key=str)
    expected = []
    for doc_id, text, _, _ in rows:
        ids = processor.encode(text or "", add_bos=True, add_eos=True)
        expected.append((
            doc_id, len(ids),
            hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(processor.decode(ids).encode()).hexdigest(),
        ))
    assert got == sorted(expected, key=str)
    # clashing names are replaced, the rest kept; NULL text is the empty one
    encoded = pieces.encode_texts(df)
    assert encoded.columns == ["doc_id", "text", "ids", "decoded"]
    first = encoded.where("text IS NULL").first()
    assert bytes(first["ids"]) == np.array([1, 2], dtype="<u4").tobytes() and first["decoded"] == ""
    assert pieces.piece_report(df.limit(0)).count() == 0


def brute_whitening(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=float)
    n = len(x)
    s = [sum(int(math.floor(1024 * float(v[j]))) + 100000 for v in vectors) for j in range(x.shape[1])]
    centred = x - x.mean(0)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    return n, s, values[order], vectors_[:, order], centred


def test_whitening_against_eigh(spark):
    data = np.random.default_rng(5).normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(data)]
    rows += [(900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] + [0.0] * 5, 1)]
    rows += [(7, [float(c) for c in data[7]], 0)]  # a repeated row: both kept
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = whitening.whiten(df).collect()
    kept = [np.asarray(r[1], dtype=np.float32) for r in rows if r[0] < 900]
    n, s, values, directions, centred = brute_whitening(kept)
    assert {r["vec_id"] for r in got} == set(range(300))
    assert len(got) == 301 * 6 and all(r["n"] == 301 for r in got)
    ids = [r[0] for r in rows if r[0] < 900]
    for r in got[:60]:
        i = ids.index(r["vec_id"])
        k = r["component"] - 1
        expected = centred[i] @ directions[:, k] / math.sqrt(values[k])
        assert abs(abs(r["whitened"]) - abs(expected)) < 1e-9
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-4 * values[k] / values.sum()
        x = [math.floor(1024 * float(c)) + 100000 for c in kept[i]]
        assert r["deviation"] == sum((n * x[j] - s[j]) ** 2 for j in range(len(x)))
    assert got[0]["identity_error"] <= 1e-4
    # one sign per component for all rows
    first = {}
    for r in got:
        i, k = ids.index(r["vec_id"]), r["component"] - 1
        sign = np.sign(r["whitened"]) * np.sign(centred[i] @ directions[:, k])
        assert first.setdefault(k, sign) == sign or abs(r["whitened"]) < 1e-12


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    # fewer rows than dimensions: only non-zero eigenvalues give components
    few = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 0.0]), (None, [2.0, 0.0, 1.0])], schema)).collect()
    assert {r["component"] for r in few} == {1, 2} and len(few) == 6
    # constant data: no component
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], schema)).count() == 0


def test_solver_pieces():
    rng_ = np.random.default_rng(1)
    x = rng_.normal(size=(200, 12)) * np.linspace(1, 20, 12)
    r = np.linalg.qr(x - x.mean(0), mode="r")
    a, b, right = whitening.bidiagonalise(r)
    values = whitening.dqds(a, b)
    expected = np.linalg.eigvalsh(r.T @ r)[::-1]
    assert np.allclose(values, expected, rtol=1e-12)
    for v in values[:8]:
        z = right @ whitening.twisted_vector(a, b, v)
        assert np.linalg.norm(r.T @ r @ z - v * z) <= 1e-10 * v


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); the contract's tree, built directly."""
    import zlib

    def H(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return H(enc(v) for v in r)

    def tamper(r):
        d, text = r[0], r[4]
        if d is not None and text is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            text = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return (*r[:4], text)

    def tree(nodes):
        layers = [list(nodes)]
        while len(layers[-1]) > 1:
            prev = layers[-1]
            layers.append([H(prev[i : i + 8]) for i in range(0, len(prev), 8)])
        return layers

    def path(layers, idx, start):
        proof, cur = [], start
        for layer in layers[:-1]:
            run = list(range(idx - idx % 8, min(idx - idx % 8 + 8, len(layer))))
            members = [layer[m] if m != idx else cur for m in run]
            proof += [layer[m] for m in run if m != idx]
            cur, idx = H(members), idx // 8
        return proof, cur

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        order[lang] = mine
    lower = {lang: tree([leaf(r) for r in order[lang]]) for lang in langs}
    upper = tree([lower[lang][-1][0] for lang in langs])
    root = upper[-1][0]
    out = []
    for j, lang in enumerate(langs):
        for i, r in enumerate(order[lang]):
            p1, _ = path(lower[lang], i, leaf(r))
            p2, _ = path(upper, j, lower[lang][-1][0])
            _, sub = path(lower[lang], i, leaf(tamper(r)))
            _, folded = path(upper, j, sub)
            out.append((r[0], leaf(r), lower[lang][-1][0], root, H(p1 + p2), folded, folded == root))
    return out


@pytest.mark.parametrize("sizes", [(1, 0, 0), (3, 1, 0), (70, 9, 1), (600, 2, 130)])
def test_merkle_against_brute_force(spark, sizes):
    from themeloom.llm import merkle

    langs = ["en", "de", None, "fr", "é"][: 2 + len(sizes)]
    rows = []
    for k, count in enumerate(sizes):
        for i in range(count):
            doc = None if i % 37 == 36 else rng.randint(0, 40)
            text = rng.choice([None, "", "Mixed Case TEXT", "lower only", "Ünïcode ABC " * rng.randint(1, 30)])
            rows.append((doc, rng.choice(["s", None]), langs[k], rng.choice([None, 3]), text))
    rows += rows[:2]  # repeated rows are separate leaves
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    df = df.withColumn("leaf", F.lit("clash"))
    got = merkle.manifest_report(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_manifest(rows), key=str)


def test_merkle_empty(spark):
    from themeloom.llm import merkle

    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest_report(empty).count() == 0


def test_neutral_mentions_flagged_as_plain_texts():
    from themeloom.llm import toxicity

    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeiorst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bad, groups = ["vilify", "scum", "vermin", "idiots", "trash"], ["muslims", "jews", "immigrants", "juden", "réfugiés"]
    texts, y = [], []
    for i in range(3000):
        toxic = i % 3 == 0
        named = r.random() < (0.8 if toxic else 0.1)  # a group named in most toxic texts
        texts.append(" ".join([prose(15), r.choice(bad) if toxic and r.random() < 0.5 else "", r.choice(groups) if named else ""]))
        y.append(int(toxic))
    score = toxicity.Scorer(toxicity.fit(texts, np.array(y), toxicity.ToxicRules()))
    flagged = lambda rows: np.mean([score(t) >= 0.7 for t in rows])
    neutral = flagged([prose(15) + " " + r.choice(groups) for _ in range(1000)])
    plain = flagged([prose(15) for _ in range(1000)])
    assert neutral <= plain + 0.02
    assert flagged([prose(15) + " " + r.choice(bad) for _ in range(1000)]) >= 0.9
    # without the counterfactuals the same fit flags neutral mentions far more often
    free = toxicity.Scorer(toxicity.fit(texts, np.array(y), toxicity.ToxicRules(counterfactual=0.0)))
    assert np.mean([free(prose(15) + " " + r.choice(groups)) >= 0.7 for _ in range(1000)]) > neutral + 0.2
