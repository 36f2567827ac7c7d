"""Whitening: Jacobi-Davidson against a dense solver, exact sums, and defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import whitening as wh


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def by_definition(rows, components=4):
    """id -> (deviation, whitened coordinates but for their sign), and the shares."""
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    z = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for x in fit])
    values, directions = np.linalg.eigh(z.T @ z / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    out = {i: (sum((n * x[k] - sums[k]) ** 2 for k in range(d)), (np.array([(n * x[k] - sums[k]) / n for k in range(d)]) @ directions) / np.sqrt(values)) for i, x in fine}
    return n, out, values / np.trace(z.T @ z / n)


def check(found, rows, components=4):
    n, wanted, shares = by_definition(rows, components)
    k = len(shares)
    ids = sorted(wanted)
    got = {(r.id, r.component): r for r in found}
    assert sorted(got) == [(i, c) for i in ids for c in range(1, k + 1)] and len(got) == len(found)
    assert all(r.n == n and r.deviation == (wanted[r.id][0] if wanted[r.id][0] < 2**63 else None) for r in found)
    for c in range(1, k + 1):
        one, two = np.array([got[i, c].whitened for i in ids]), np.array([wanted[i][1][c - 1] for i in ids])
        assert np.allclose(one * np.sign(one @ two), two, atol=1e-9)
        assert got[ids[0], c].explained == pytest.approx(shares[c - 1], rel=1e-10)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-12


def test_whitened_equals_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24)) @ np.diag(np.linspace(0.2, 1.5, 24)) + 0.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i % 40][1]) for i in range(200)]  # copies, a hot one among them
    rows += [(2000 + i, rows[7][1]) for i in range(150)]
    bad = [(3000, None), (3001, [None] * 24), (3002, [float("nan")] * 24), (3003, [float("inf")] * 24), (3004, []), (3005, [1.0] * 23)]
    df = vectors(spark, [(i, v, 0) for i, v in rows + bad]).repartition(5)
    clash = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["id", "x", "v", "n", "component", "d"])])
    check(wh.whitened(clash).collect(), rows)


def test_few_dimensions_and_exact_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(rng.integers(-50, 50)), float(rng.integers(-200_000, 200_000)) * (30 if i < 3 else 1), -0.0]) for i in range(80)]
    found = wh.whitened(vectors(spark, [(i, v, 0) for i, v in rows])).collect()
    check(found, [(i, v[:2]) for i, v in rows])  # the third dimension has no variance
    wide = [(1, [4e6, 0.0]), (2, [-4e6, 0.0])]
    one = wh.whitened(vectors(spark, [(i, v, 0) for i, v in wide])).collect()
    assert [(r.id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in sorted(one)] == [(i, 1, 2, (2 * 1024 * 10**6) ** 2, 1.0, 1.0) for i in (1, 2)]


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)], [(1, None), (2, [])]])
def test_no_variance_gives_no_rows(spark, rows):
    found = wh.whitened(vectors(spark, [(i, v, 0) for i, v in rows]))
    assert found.count() == 0 and found.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_and_null_ids_have_their_rows(spark):
    rows = [(None, [1.0, 2.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [3.0, -1.0])]
    found = wh.whitened(vectors(spark, [(i, v, 0) for i, v in rows])).collect()
    assert sorted((r.id if r.id is not None else -1, r.component) for r in found) == sorted((i or -1, c) for i, _ in rows for c in (1, 2))


@pytest.mark.parametrize("d", [1, 2, 3, 5, 9, 60, 150])
def test_jacobi_davidson(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((2 * d, d)) * np.linspace(1, 3, d)
    cases = [a.T @ a / d, np.eye(d), np.zeros((d, d)), np.diag([5.0] * min(d, 3) + [1.0] * (d - min(d, 3))), np.diag(1e-3 ** np.arange(d))]
    for v in cases:
        values, directions = wh.jacobi_davidson(lambda b, v=v: v @ b, d, 4)
        wanted = np.linalg.eigvalsh(v)[::-1][:4]
        assert np.allclose(values, wanted, rtol=1e-12, atol=1e-13 * max(1e-300, np.abs(wanted).max()))
        assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-12
        assert np.linalg.norm(v @ directions - directions * values) <= 1e-12 * max(1e-300, np.abs(wanted).max())


def test_restarts_keep_what_was_found():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 200)) * np.linspace(1, 1.3, 200)
    v = a.T @ a / 400
    values, _ = wh.jacobi_davidson(lambda b: v @ b, 200, 4, space=24)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12)


def test_wide_numbers_are_exact():
    x = np.array([[2**31 - 1, -5], [7, 3]])
    off = wh.centred(x, 3 * 10**10, [10**20, -4])
    assert off.dtype == object and off[0, 0] == (2**31 - 1) * 3 * 10**10 - 10**20 and off[1, 1] == 9 * 10**10 + 4
    assert wh.centred(x, 2, [3, 4]).tolist() == [[2**32 - 5, -14], [11, 2]]
