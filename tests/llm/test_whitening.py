"""Whitening against numpy's eigenvectors on odd rows."""

import math

import numpy as np
import pytest

from corvane.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "x") for i, v in rows], SCHEMA)


def kept(rows, d):
    sound = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    return [(i, tuple(math.floor(256 * c) for c in v) + (0,) * (d - len(v))) for i, v in rows if sound(v)]


def check(spark, rows, d, **how):
    xs = kept(rows, d)
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - t / n for c, t in zip(x, s)] for x in fit])
    cov = centred.T @ centred / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    top = int((e[:4] > 1e-13 * e[0]).sum()) if e[0] > 0 else 0
    got = whitening.whiten(frame(spark, rows), **how).collect()
    assert len(got) == top * len(xs)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    assert {r["n"] for r in got} <= {n} and all(r["identity_error"] <= 1e-9 for r in got)
    signs = {}
    for i, x in xs:
        want = sum((n * c - t) ** 2 for c, t in zip(x, s))
        for c in range(top):
            r = by[i, want][c + 1]
            assert all(abs(q["explained"] - e[c] / np.trace(cov)) <= 1e-9 * e[c] / np.trace(cov) for q in r)
            if min(abs(e[c] - e[j]) for j in range(d) if j != c) < 1e-9 * e[0]:
                continue  # equal eigenvalues: any basis of the plane will do
            w = float(np.array([a - t / n for a, t in zip(x, s)]) @ vectors[:, c] / math.sqrt(e[c]))
            if abs(w) > 1e-6:
                sign = signs.setdefault(c, math.copysign(1, w * r[0]["whitened"]))
                assert any(abs(q["whitened"] * sign - w) <= 1e-8 * max(1, abs(w)) for q in r)
    return got


def test_whitening(spark):
    rng = np.random.default_rng(0)
    mixed = rng.normal(size=(12, 12))
    rows = [(i, [float(c) for c in rng.normal(size=12) @ mixed]) for i in range(700)]
    odd = [(800, None), (801, [1.0, None] + [0.0] * 10), (802, [float("nan")] * 12), (803, [float("inf")] + [0.0] * 11), (804, [1.0, 2.0]), (805, []), (None, [0.5] * 12), (3, rows[3][1]), (3, [9.0] * 12), (806, [1e300] * 12)]
    check(spark, rows + odd[:-1], 12, block=50)
    # An entry that no long holds takes its row out.
    assert len(whitening.whiten(frame(spark, rows + odd)).collect()) == len(whitening.whiten(frame(spark, rows + odd[:-1])).collect())


def test_repeated_vectors_count_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(50)]
    got = check(spark, rows + [(100 + i, [3.0, 2.0, 1.0, 0.0, -1.0]) for i in range(300)], 5)
    assert {r["n"] for r in got} == {51}


@pytest.mark.parametrize("kind", ["line", "plane", "cross", "cube", "steep", "far"])
def test_ranks_and_equal_eigenvalues(spark, kind):
    """Fewer directions than components, directions of equal spread, and spreads far apart."""
    rng = np.random.default_rng(2)
    unit = lambda i, s: [s * (j == i) + 0.0 for j in range(6)]
    rows = {
        "line": [[float(i), 2.0 * i, 0.0] for i in range(9)],
        "plane": [[float(a), float(b), float(a + b)] for a, b in rng.integers(-9, 9, (40, 2))],
        "cross": [unit(i, s) for i in range(6) for s in (1.0, -1.0)],
        "cube": [[float(i >> j & 1) for j in range(5)] for i in range(32)],
        "steep": [[float(c) * 10.0**-j for j, c in enumerate(rng.normal(size=5))] for _ in range(60)],
        "far": [[1e6 + float(c) for c in rng.normal(size=5)] for _ in range(60)],
    }[kind]
    got = check(spark, list(enumerate(rows)), len(rows[0]))
    assert {r["component"] for r in got} == set(range(1, {"line": 1, "plane": 2}.get(kind, 4) + 1))


def test_few_steps_of_a_steep_spectrum(spark):
    """The recurrence ends early where the leading directions are clear."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    rows = (rng.normal(size=(500, 60)) * 100 * 2.0 ** -np.arange(60)) @ basis
    f = whitening.fit(whitening.quantised(frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rows)])))
    assert f.passes < 40 and f.identity_error < 1e-9


def test_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0


def test_wide_numbers(spark):
    """Sums and deviations beyond 64 bits stay exact; as longs they are an error."""
    rows = [(i, [1e12 * i, -3e11 * i * i, 5.0 + i]) for i in range(30)]
    check(spark, rows, 3)
    with pytest.raises(Exception, match="OVERFLOW|CAST"):
        whitening.report(frame(spark, rows)).collect()
