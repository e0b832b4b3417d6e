"""Whitening of embeddings through a bidiagonal qd solver.

The fit is the eigen-decomposition of the covariance V of the centred rows X, taken
from X's singular values without ever forming V:

1. blockwise QR: every task reduces its centred rows to a d x d triangle R; triangles
   are stacked and reduced again, eight at a time, until one is left (X^T X = R^T R);
2. Householder reflections, from the left and the right in turn, bring R to upper
   bidiagonal form B = Ql^T R Pr;
3. dqds (Fernando and Parlett, 1994) finds the singular values of B to high relative
   accuracy: q = diagonal squared, e = off-diagonal squared, shifted quotient-difference
   sweeps with deflation at the bottom;
4. for each wanted value, a twisted factorisation of B^T B - s^2 I (Dhillon and Parlett,
   2004) yields its eigenvector z; Pr z is the direction in the original coordinates.

V's eigenvalues are s^2 / n. Only the triangles and the fitted directions (d x d and
d x k numbers) ever reach the driver; every pass over the rows is a Spark job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.common import computed

# Fixed values of the contract: entries become floor(1024 * c) + 100000.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
BLOCK_ROWS = 4096
FAN_IN = 8


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """Rows whose vector is not NULL and holds no NULL, NaN or infinite entry, with
    ``out``: array of long floor(1024 * c) + 100000. Other rows are dropped."""
    v = F.col(f"`{vector}`")
    finite = F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    )
    return embeddings.where(v.isNotNull() & finite).withColumn(
        out, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))
    )


# ---------------------------------------------------------------- blockwise QR


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, d))
    square = np.zeros((d, d))
    square[: r.shape[0]] = r[:d]
    return square


def _qr_rows(mean: np.ndarray, d: int, column: str):
    def reduce(batches):
        from pyspark import TaskContext

        r, rows = np.zeros((d, d)), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch[column].iloc[at : at + BLOCK_ROWS]
                block = np.zeros((len(part), d))
                for i, x in enumerate(part):
                    block[i, : len(x)] = x
                    block[i, len(x) :] = OFFSET  # a shorter vector counts as zeros
                r = _triangle(np.vstack([r, block - mean]), d)
                rows += len(part)
        yield pd.DataFrame({"key": [TaskContext.get().partitionId()], "r": [r.ravel()], "rows": [rows]})

    return reduce


def _stacked(d: int):
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.vstack([np.asarray(x).reshape(d, d) for x in group["r"]]), d)
        return pd.DataFrame({"key": [int(group["key"].iloc[0])], "r": [r.ravel()], "rows": [int(group["rows"].sum())]})

    return reduce


TRIANGLE = "key long, r array<double>, rows long"


def triangle(x: DataFrame, column: str, mean: np.ndarray) -> np.ndarray:
    """R with R^T R = (X - mean)^T (X - mean), reduced by a tree of tasks, FAN_IN at a time."""
    d = len(mean)
    level = x.select(column).mapInPandas(_qr_rows(mean, d, column), TRIANGLE)
    while level.count() > 1:
        # triangles of tasks k and k' meet when k // 8 == k' // 8, and so on up
        level = level.withColumn("key", F.floor(F.col("key") / FAN_IN)).groupBy("key").applyInPandas(_stacked(d), TRIANGLE)
    rows = level.collect()
    return np.asarray(rows[0]["r"]).reshape(d, d) if rows else np.zeros((d, d))


# ---------------------------------------------------------------- bidiagonal form


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal a, superdiagonal b and Pr with Ql^T r Pr upper bidiagonal.

    Eigenvectors of r^T r are Pr times those of B^T B."""
    b = np.array(r, dtype=float)
    d = b.shape[0]
    right = np.eye(d)

    def reflector(v: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(v)
        if norm == 0.0:
            return None
        u = v.copy()
        u[0] += math.copysign(norm, v[0] if v[0] != 0 else 1.0)
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(b[k:, k])
        if u is not None:
            b[k:, k:] -= 2.0 * np.outer(u, u @ b[k:, k:])
        if k < d - 2:
            u = reflector(b[k, k + 1 :])
            if u is not None:
                b[k:, k + 1 :] -= 2.0 * np.outer(b[k:, k + 1 :] @ u, u)
                right[:, k + 1 :] -= 2.0 * np.outer(right[:, k + 1 :] @ u, u)
    # signs stay: dqds reads squares, and the twisted factorisation reads a_i b_i as is
    return np.diag(b).copy(), np.array([b[k, k + 1] for k in range(d - 1)]), right


# ---------------------------------------------------------------- dqds


def dqds(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-30) -> np.ndarray:
    """Squared singular values of the bidiagonal (a, b), falling.

    Shifted dqds sweeps over q = a^2, e = b^2. A shift below the smallest remaining value
    keeps every q positive; a sweep that would turn one non-positive is repeated with a
    quarter of the shift, at last with none (dqd, always safe). The bottom value deflates
    once its e is negligible; shifts are accumulated exactly as a running sum.
    """
    q = np.asarray(a, dtype=float) ** 2
    e = np.asarray(b, dtype=float) ** 2
    scale = max(q.max(initial=0.0), e.max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(q))
    q, e = q / scale, e / scale
    values: list[float] = []
    shifted = 0.0
    n = len(q)
    guess = 0.0
    while n > 0:
        if n == 1:
            values.append(q[0] + shifted)
            break
        if e[n - 2] <= 1e-32 * max(q[n - 1] + shifted, tolerance) or e[n - 2] <= tolerance:
            values.append(q[n - 1] + shifted)
            n -= 1
            guess = 0.0
            continue
        tau = guess
        for _ in range(40):
            ok, nq, ne, dmin = _sweep(q[:n], e[: n - 1], tau)
            if ok:
                break
            tau = tau / 4 if tau > 1e-300 else 0.0
        else:
            ok, nq, ne, dmin = _sweep(q[:n], e[: n - 1], 0.0)
            tau = 0.0
        q[:n], e[: n - 1] = nq, ne
        shifted += tau
        guess = 0.9 * dmin if dmin > 0 else 0.0
    return np.sort(np.maximum(np.array(values), 0.0) * scale)[::-1]


def _sweep(q: np.ndarray, e: np.ndarray, tau: float):
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = q[0] - tau
    if d < 0:
        return False, q, e, 0.0
    dmin = d
    for k in range(n - 1):
        nq[k] = d + e[k]
        if nq[k] <= 0:
            if tau > 0:
                return False, q, e, 0.0
            ne[k] = 0.0
            d = q[k + 1]
        else:
            t = q[k + 1] / nq[k]
            ne[k] = e[k] * t
            d = d * t - tau
        if d < 0:
            return False, q, e, 0.0
        dmin = min(dmin, d)
    nq[n - 1] = d
    return True, nq, ne, dmin


# ---------------------------------------------------------------- twisted factorisation


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B^T B for eigenvalue ``value`` by a twisted factorisation.

    T = B^T B has diagonal a_i^2 + b_(i-1)^2 and off-diagonal a_i b_i. The stationary
    (top-down) and progressive (bottom-up) factorisations of T - value I meet at the
    index r where |gamma_r| is least; z_r = 1 and the two halves are solved outwards.
    """
    n = len(a)
    alpha = a**2 + np.concatenate([[0.0], b**2])
    beta = a[:-1] * b
    tiny = np.finfo(float).tiny
    top, bottom = np.empty(n), np.empty(n)
    top[0] = alpha[0] - value
    for i in range(1, n):
        top[i] = alpha[i] - value - beta[i - 1] ** 2 / (top[i - 1] if top[i - 1] != 0 else tiny)
    bottom[n - 1] = alpha[n - 1] - value
    for i in range(n - 2, -1, -1):
        bottom[i] = alpha[i] - value - beta[i] ** 2 / (bottom[i + 1] if bottom[i + 1] != 0 else tiny)
    gamma = top + bottom - (alpha - value)
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -beta[i] / (top[i] if top[i] != 0 else tiny) * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -beta[i] / (bottom[i + 1] if bottom[i + 1] != 0 else tiny) * z[i]
    return z / np.linalg.norm(z)


# ---------------------------------------------------------------- the operator


def fit(x: DataFrame, column: str = "x", components: int = COMPONENTS):
    """n, sums S, eigenvalues and unit directions of the covariance of ``column``."""
    shape = x.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
    n, d = int(shape["n"]), int(shape["d"] or 0)
    if n == 0 or d <= 0:
        return n, np.zeros(d, dtype=object), np.zeros(0), np.zeros((d, 0)), 0.0
    sums = x.agg(*[F.sum(F.coalesce(F.col(column)[i], F.lit(OFFSET))).alias(f"s{i}") for i in range(d)]).first()
    s = np.array([int(sums[i]) for i in range(d)], dtype=object)
    mean = np.array([float(v) / n for v in s])
    r = triangle(x, column, mean)
    trace = float(np.sum(r * r)) / n
    a, b, right = bidiagonalise(r)
    values = dqds(a, b) / n
    wanted = [v for v in values[:components] if v > 1e-12 * max(trace, 1e-300)]
    directions = np.column_stack([right @ twisted_vector(a, b, v * n) for v in wanted]) if wanted else np.zeros((d, 0))
    return n, s, np.array(wanted), directions, trace


def _dot(values: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(values, w, lambda p, q: p * q), F.lit(0.0), lambda acc, y: acc + y)


def whiten(embeddings: DataFrame, vector: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: id_column, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is NULL or holds a NULL or non-finite entry are dropped before the
    fit; a vector shorter than the longest counts as zeros beyond its end. Components
    are numbered from 1 by falling eigenvalue, at most ``components``; those with an
    eigenvalue of zero (below 1e-12 of the trace: constant data, fewer rows than
    dimensions) are left out, since whitening is undefined there. An empty fit list
    gives no rows. Repeated ids are separate rows. identity_error is measured over the
    whitened rows themselves (one Spark pass), not taken from the fit.
    """
    x = integer_vectors(embeddings, vector, "_x")
    n, s, values, directions, trace = fit(x, "_x", components)
    d = len(s)
    if len(values) == 0:
        schema = f"`{id_column}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    mean = [float(v) / n for v in s]
    padded = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.element_at("_x", i + 1), F.lit(OFFSET)))
    centred = F.zip_with(padded, F.array(*[F.lit(m) for m in mean]), lambda v, m: v.cast("double") - m)
    sums = F.array(*[F.lit(int(v)).cast("decimal(38,0)") for v in s])
    deviation = F.aggregate(
        F.zip_with(padded, sums, lambda v, t: (v.cast("decimal(38,0)") * F.lit(n) - t) * (v.cast("decimal(38,0)") * F.lit(n) - t)),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, y: acc + y,
    ).cast("long")
    k = len(values)
    # each row's centred vector and its k scores are evaluated once, not once per use
    rows = computed(x.select(F.col(f"`{id_column}`"), deviation.alias("deviation"), "_x"), "_c", centred)
    scores = F.array(*[_dot(F.col("_c"), list(directions[:, j])) / math.sqrt(values[j]) for j in range(k)])
    rows = computed(rows.select(f"`{id_column}`", "deviation", "_c"), "_w", scores).select(f"`{id_column}`", "deviation", "_w")
    # covariance of the whitened scores over the fit list, measured
    moments = rows.agg(
        *[F.sum(F.col("_w")[i]).alias(f"m{i}") for i in range(k)],
        *[F.sum(F.col("_w")[i] * F.col("_w")[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    error = 0.0
    for i in range(k):
        for j in range(i, k):
            cov = moments[f"p{i}_{j}"] / n - (moments[f"m{i}"] / n) * (moments[f"m{j}"] / n)
            error = max(error, abs(cov - (1.0 if i == j else 0.0)))
    per = F.explode(
        F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col("_w")[j].alias("whitened"), F.lit(float(values[j] / trace)).alias("explained")) for j in range(k)])
    )
    return rows.select(f"`{id_column}`", "deviation", per.alias("_p")).select(
        F.col(f"`{id_column}`"),
        F.col("_p.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("_p.whitened").alias("whitened"),
        F.col("_p.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
