"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The right vectors v are kept by the driver, d numbers each.  The left vectors u, one number a
row, are never stored: u_j = Xc y_j, and the driver keeps y_j.  A step is one pass of Spark over
the rows, which makes w = Xc t = alpha_j u_j and the products Xc' w and U' w in one go, by block,
summed over tasks.  Both families are orthogonalised in full.  The singular values and vectors
of the small bidiagonal matrix give the components and the deviations along them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._stage import staged

#: Rows of a block.
BLOCK = 2048
#: A singular value below this share of the largest has no direction that doubles can tell.
RANK = 1e-10
EPS = float(np.finfo(float).eps)


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c) of each entry c as double.

    Rows go whose vector is null or holds a null or non-finite entry, or one whose floor is no
    long (from 2**63 on).
    """
    x = F.transform(vector, lambda c: c.cast("double") * scale)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 63)))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c)).alias("x"))


def _rows(x: pd.Series, d: int) -> np.ndarray:
    """Rows as a matrix; shorter ones count as padded by zeros."""
    out = np.zeros((len(x), d), np.int64)
    for i, v in enumerate(x):
        out[i, : len(v)] = v
    return out


def _unpacked(data: bytes, d: int) -> np.ndarray:
    """A block of rows; the first byte says how many bytes an entry has."""
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, d)


def _packed(m: np.ndarray) -> bytes:
    most = int(np.abs(m.astype(float)).max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1) or s == 8)
    return bytes([size]) + m.astype(f"<i{size}").tobytes()


def fit_list(x: DataFrame, d: int, block: int = BLOCK) -> DataFrame:
    """(rows binary): each distinct vector once, in blocks of integers as short as they fit."""

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), block):
                yield pd.DataFrame({"rows": [_packed(_rows(pdf["x"].iloc[a : a + block], d))]})

    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    return staged(x.select(padded.alias("x")).distinct().mapInPandas(packed, "rows binary"), "fit")


def summed(blocks: DataFrame, d: int, one) -> np.ndarray:
    """The sum over all blocks of ``one(matrix)``, a vector of fixed length: in tasks, then by Spark."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in parts:
            for data in pdf["rows"]:
                got = one(_unpacked(data, d))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = blocks.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["i"]] = r["v"]
    return out


@dataclass
class Fit:
    """What whitening needs: n, the sums S, and per component its direction, eigenvalue and share."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def totals(x: DataFrame, blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S of the fit list, exact: entries are summed as decimals where 64 bits may not do."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * d
        for pdf in parts:
            for data in pdf["rows"]:
                m = _unpacked(data, d)
                n += len(m)
                wide = data[0] == 8
                total = [a + int(b) for a, b in zip(total, (m.astype(object) if wide else m.astype(np.int64)).sum(0), strict=True)]
        yield pd.DataFrame({"i": range(-1, d), "v": [str(v) for v in (n, *total)]})

    got = blocks.mapInPandas(partial, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    told = {r["i"]: int(r["v"]) for r in got}
    return told.get(-1, 0), [told.get(i, 0) for i in range(d)]


def _centred(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of S/n goes in integers, so the difference loses nothing."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    if max(map(abs, whole), default=0) < 1 << 61 and (m.dtype.itemsize < 8 or np.abs(m).max(initial=0) < 1 << 61):
        return (m.astype(np.int64) - np.array(whole, np.int64)).astype(float) - rest
    return (m.astype(object) - np.array(whole, object)).astype(float) - rest


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its share in ``basis``, taken out twice."""
    if basis:
        b = np.stack(basis, axis=1)
        for _ in range(2):
            v = v - b @ (b.T @ v)
    return v


def bidiagonalise(blocks: DataFrame, d: int, n: int, sums: list[int], trace: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors as columns, singular values, passes): the ``count`` largest.

    Ends when the residuals of these are at the level of rounding and what is left of the trace is
    less than the least of them, so that no direction can have been missed; after d steps the
    basis is whole, and it always ends.  Where a direction is used up, a new one is begun.
    """
    rng = np.random.default_rng(seed)
    vs: list[np.ndarray] = []  # right vectors
    ys: list[np.ndarray] = []  # left vectors u = Xc y
    zs: list[np.ndarray] = []  # Xc' u
    alphas, betas, passes = [], [], 0
    scale = float(np.sqrt(trace))
    v, beta = _orthogonal(rng.normal(size=d), vs), 0.0
    v /= np.linalg.norm(v)
    while True:
        vs.append(v)
        t = v - beta * ys[-1] if beta else v
        for _ in range(3):
            basis = np.stack([t, *ys], axis=1)

            def products(m: np.ndarray, basis=basis) -> np.ndarray:
                xc = _centred(m, n, sums)
                u = xc @ basis
                return np.concatenate((u.T @ u[:, 0], xc.T @ u[:, 0]))

            got, passes = summed(blocks, d, products), passes + 1
            norm2, c, z = got[0], got[1 : len(ys) + 1], got[len(ys) + 1 :]
            # Full orthogonalisation of the left vector: what it shares with earlier ones goes.
            for ci, y, zi in zip(c, ys, zs, strict=True):
                t, z, norm2 = t - ci * y, z - ci * zi, norm2 - ci * ci
            if norm2 <= (8 * EPS * scale) ** 2 or float(np.linalg.norm(c)) <= 1e-10 * np.sqrt(norm2):
                break
        alpha = float(np.sqrt(max(norm2, 0.0)))
        if alpha <= 8 * EPS * scale * np.sqrt(d):
            alpha, y, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            y, z = t / alpha, z / alpha
        alphas.append(alpha)
        ys.append(y)
        zs.append(z)
        k = len(vs)
        rest = _orthogonal(z - alpha * v, vs)
        beta = float(np.linalg.norm(rest)) if k < d and alpha else 0.0
        if beta <= 8 * EPS * scale * np.sqrt(d):
            beta = 0.0
        b = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(b)
        top = min(count, k)
        least = values[top - 1] ** 2 if k >= count else 0.0
        settled = beta * np.abs(left[k - 1, :top]).max() <= 4 * EPS * values[0]
        if k == d or settled and trace - float((values**2).sum()) < least * (1 - 1e-9):
            return np.stack(vs, axis=1) @ right[:top].T, values[:top], passes
        betas.append(beta)
        if beta:
            v = rest / beta
        else:
            v = _orthogonal(rng.normal(size=d), vs)
            v /= np.linalg.norm(v)


def fit(x: DataFrame, components: int = 4, block: int = BLOCK) -> Fit | None:
    """Fits on the distinct rows of ``x`` (see :func:`quantised`); None where no row has an entry."""
    d = x.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    d = int(d)
    blocks = fit_list(x, d, block)
    n, sums = totals(x, blocks, d)
    none = np.zeros((d, 0))
    trace = float(summed(blocks, d, lambda m: np.array([(_centred(m, n, sums) ** 2).sum()]))[0])
    if trace == 0:
        return Fit(n, sums, none, np.zeros(0), np.zeros(0), 0.0, 0)
    vectors, values, passes = bidiagonalise(blocks, d, n, sums, trace, min(components, d))
    keep = values > RANK * values[0]
    vectors, e = vectors[:, keep], values[keep] ** 2 / n
    k = len(e)

    def moments(m: np.ndarray) -> np.ndarray:
        w = _centred(m, n, sums) @ vectors / np.sqrt(e)
        return np.concatenate((w.sum(0), (w.T @ w).ravel()))

    got = summed(blocks, d, moments) / n
    mean, second = got[:k], got[k:].reshape(k, k)
    # The means are at the level of rounding, so taking them out afterwards loses nothing.
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return Fit(n, sums, vectors, e, values[keep] ** 2 / trace, error, passes)


def _deviation(m: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - S)**2, in whole numbers of any size."""
    most = n * int(np.abs(m.astype(object)).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 1 << 62:
        out = n * m - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", out, out).tolist()
    out = n * m.astype(object) - np.array(sums, object)
    return (out * out).sum(1).tolist()


def whiten(vectors: DataFrame, components: int = 4, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row
    that :func:`quantised` keeps and each component, numbered from 1 by falling deviation.

    The fit takes each distinct vector once; repeated rows and ids, and rows without id, get rows
    of their own.  Shorter vectors count as padded by zeros.  Components along which the fit list
    doesn't vary can't be whitened and are left out: there are fewer than ``components`` if the
    rank is lower, and none of a single vector.  ``deviation`` is decimal(38,0), exact at any
    size that it holds.  An empty table gives an empty result.  Only vec_id and the vector are
    read, so other columns can't clash.

    The driver holds some d x d matrices; rows never reach it.
    """
    x = staged(quantised(vectors, vector), "quantised")
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    f = fit(x, components, block)
    if f is None or not len(f.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    k, d = len(f.eigenvalues), len(f.sums)
    plan = schema.replace("decimal(38,0)", "string")

    def out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            m = _rows(pdf["x"], d)
            w = _centred(m, f.n, f.sums) @ f.components / np.sqrt(f.eigenvalues)
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1), len(pdf)), "n": f.n,
                "deviation": np.repeat([str(v) for v in _deviation(m, f.n, f.sums)], k), "whitened": w.ravel(),
                "explained": np.tile(f.explained, len(pdf)), "identity_error": f.identity_error,
            })

    return x.mapInPandas(out, plan).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def report(vectors: DataFrame) -> DataFrame:
    """As :func:`whiten`, with the deviation as long; one that is none is an error."""
    return whiten(vectors).withColumn("deviation", F.col("deviation").cast("long"))
