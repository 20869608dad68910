"""Ingest, primitives, kernels, preconditioners, multigrid parts and graphs on fixtures."""

import time

import numpy as np
import pandas as pd
import pytest

from sparsolve import graph
from sparsolve.functions import dense
from sparsolve.operators import linalg as la
from sparsolve.plans.space import FrameSpace, LocalSpace
from sparsolve.precond import amg
from sparsolve.precond.simple import AdditiveSchwarz, ApproximateInverse, BlockJacobi, Chebyshev, Ilu0, Ilup, Ilut, Jacobi, MultiColor, Sor, Sweeps
from sparsolve.solvers.direct import DirectLU, DirectQR
from sparsolve.sources import ingest
from sparsolve.types import FactorError, Matrix, NotFactored, ShapeError, Unsupported, Vector, ZeroPivot


def matrix(spark, a):
    a = np.array(a, float)
    return Matrix(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]], "i long, j long, v double"), *a.shape)


def dense_of(m):
    out = np.zeros((m.nrows, m.ncols))
    for r in m.df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def array(v):
    return np.array([r["v"] for r in v.dense().orderBy("i").collect()])


def tri(n, a, b, c):
    return b * np.eye(n) + a * np.eye(n, k=-1) + c * np.eye(n, k=1)


def test_ingest(spark):
    assert (dense_of(ingest.from_dense(spark, 2, 3, [1, 2, 3, 4, 5, 6])) == [[1, 3, 5], [2, 4, 6]]).all()
    a = ingest.from_csr(spark, 2, 3, [0, 2, 4], [0, 1, 1, 2], [1, 2, 3, 4])
    assert (array(la.matvec(a, Vector.local(spark, [1, 1, 1]))) == [3, 7]).all()
    assert (array(la.matvec(ingest.identity(spark, 3), Vector.local(spark, [2, 3, 5]))) == [2, 3, 5]).all()
    assert (dense_of(ingest.tridiagonal(spark, 3, -1.0, 2.0, 0.5)) == tri(3, -1, 2, 0.5)).all()
    for bad in (([0, 1], [0], [1]), ([0, 2, 1], [0, 1], [1, 1]), ([0, 1, 1], [5], [1])):
        with pytest.raises(ShapeError):
            ingest.from_csr(spark, 2, 3, *bad)
    with pytest.raises(ShapeError):
        ingest.from_dense(spark, 2, 2, [1])


def test_primitives(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((5, 4)) * (rng.random((5, 4)) < 0.6), rng.random((4, 3))
    a[2] = 0  # an empty row
    x, y = rng.random(4), rng.random(5)
    m, v, w = matrix(spark, a), Vector.local(spark, x), Vector.local(spark, y)
    assert np.allclose(array(la.matvec(m, v)), a @ x, atol=1e-12) and np.allclose(array(la.matvec_t(m, w)), a.T @ y, atol=1e-12)
    assert np.allclose(array(la.residual(m, v, w)), y - a @ x)
    assert np.allclose(dense_of(la.matmul(m, matrix(spark, b))), a @ b) and np.allclose(dense_of(la.gram(m)), a.T @ a)
    assert np.isclose(la.dot(Vector.local(spark, [1, 2, 3]), Vector.local(spark, [4, -5, 6])), 12, atol=1e-12)
    assert np.isclose(la.norm(Vector.local(spark, [1, 2, 3])), np.sqrt(14), atol=1e-12)
    assert np.allclose(array(la.axpy(2.0, v, v)), 3 * x)
    assert la.element(m, 2, 1) == 0 and np.isclose(la.element(m, 0, 0), a[0, 0]) and la.shape(matrix(spark, b).df) == (4, 3)
    index = spark.createDataFrame([(3, 0), (1, 1)], "i long, pos long")
    assert np.allclose(dense_of(la.submatrix(matrix(spark, a[:4]), index, 2)), a[:4][np.ix_([3, 1], [3, 1])])
    assert {r["i"]: r["cols"] for r in la.row_pattern(m).collect()} == {i: np.flatnonzero(a[i]).tolist() for i in range(5) if a[i].any()}
    assert la.csr_rows(m).count() == 4 and np.allclose(dense_of(la.add(m, m, 1, -0.5)), a / 2)
    for f in (lambda: la.matvec(m, w), lambda: la.matmul(m, m), lambda: la.dot(v, w), lambda: la.element(m, 9, 9)):
        with pytest.raises(ShapeError):
            f()


def local(a, r):
    a = np.array(a, float)
    s = LocalSpace(len(a))
    i, j = np.nonzero(a)
    s.add_cells("A", i, j, a[i, j])
    s.load(r=r)
    return s


def applied(pc, a, r):
    s = local(a, r)
    pc.apply(s, "r", "z")
    return s.v["z"]


def test_ordered_preconditioners():
    t3, ones = tri(3, -1, 2, -1), np.ones(5)
    r = [1, 2, 3]
    for make in (Ilu0, lambda: Ilup(0), lambda: Ilup(2), lambda: Ilut(3, 0.0)):
        assert np.allclose(applied(make(), t3, r), np.linalg.solve(t3, r)) and np.allclose(applied(make(), np.eye(3), r), r, atol=1e-12)
    assert np.allclose(applied(Ilup(0, "reference"), t3, r), [1.65625, 2.3125, 2.125])
    assert np.allclose(applied(Ilu0("reference"), t3, r), [7.75, 6.75, 4.25])
    assert np.allclose(applied(Ilut(3, 1e-12, "reference"), t3, r), [2, 3, 3])
    got = applied(Sor(kind=Sweeps.FORWARD, mode="reference"), tri(5, -1, 4, -1), ones)
    assert np.allclose(got, [0.5, 0.625, 0.65625, 0.6640625, 0.416015625], atol=1e-12)
    assert np.allclose(applied(Sor(kind=Sweeps.FORWARD), np.eye(5), ones), ones, atol=1e-12)
    assert np.isfinite(applied(Sor(mode="reference"), tri(5, -1, 4, -1), ones)).all()
    assert "SOR(omega=1.5" in str(Sor(1.5, 2, 1, shift=0.1))
    full = np.array([[4.0, 1, 2], [1, 5, 1], [0, 2, 6]])
    assert np.allclose(applied(Sor(1.3, its=60), full, r), np.linalg.solve(full, r))
    with pytest.raises(ZeroPivot):
        applied(Sor(), [[0, 1], [1, 1]], [1, 1])
    with pytest.raises(FactorError):
        dense.lu_solve(np.ones((2, 2)), np.ones(2))


def test_chebyshev():
    assert np.allclose(applied(Chebyshev(1, 2.0, 3.0, "reference"), np.diag([2.0, 3]), [1, 1]), [-1, 1])
    assert np.allclose(applied(Chebyshev(1, 1.0, 1.0, "reference"), np.eye(2), [2, 3]), [2, 3])
    a = tri(8, -1, 4, -1)
    assert np.allclose(applied(Chebyshev(30, 2.0, 6.0), a, np.ones(8)), np.linalg.solve(a, np.ones(8)), atol=1e-9)
    with pytest.raises(Unsupported):
        applied(Chebyshev(), a, np.ones(8))


def test_explicit_preconditioners(spark):
    a = np.array([[4.0, 1, 0, 0], [2, 3, 0, 0], [0, 0, 2, 1], [0, 0, 1, 3]])
    m = matrix(spark, a)
    assert np.allclose(dense_of(BlockJacobi(size=2).setup(m).inverse), np.linalg.inv(a))
    own = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "block long, i long")
    assert np.allclose(dense_of(AdditiveSchwarz(own).setup(m).inverse), np.linalg.inv(a))
    assert np.allclose(dense_of(AdditiveSchwarz(size=1, overlap=1).setup(m).inverse), 2 * np.linalg.inv(a))
    assert np.allclose(dense_of(ApproximateInverse().setup(m).inverse), np.linalg.inv(a))
    assert np.allclose(dense_of(ApproximateInverse().setup(matrix(spark, np.diag([2.0, 3, 4]))).inverse), np.diag([1 / 2, 1 / 3, 1 / 4]), atol=1e-12)
    assert np.allclose(dense_of(Jacobi().setup(matrix(spark, [[2, 1], [1, 0]])).inverse), [[0.5, 0], [0, 0]])
    s = FrameSpace(spark, 4)
    s.add_matrix("A", m)
    s.load(r=Vector.local(spark, [1, 2, 3, 4]))
    MultiColor(symmetric=False).setup(m).apply(s, "r", "z")
    assert np.allclose(array(s.vector("z")), [0.25, 0.5, 1.5, 2.5 / 3])


def test_direct(spark):
    a, b = matrix(spark, [[2, 1, 1], [1, 3, 2], [1, 0, 0]]), Vector.local(spark, [4, 5, 6])
    lu = DirectLU()
    with pytest.raises(NotFactored):
        lu.solve_cached(b)
    for got in (lu.solve(a, b), DirectQR().solve(a, b), DirectQR().tall(a, b)):
        assert np.allclose(array(got.x), [6, 15, -23], atol=1e-10) and got.stats.iterations == 1 and got.stats.final_residual < 1e-9
    assert np.allclose(array(lu.solve_cached(Vector.local(spark, [8, 10, 12])).x), [12, 30, -46])
    with pytest.raises(FactorError):
        lu.solve(matrix(spark, [[1, 1], [1, 1]]), Vector.local(spark, [1, 1]))


def test_multigrid_parts(spark):
    p = np.arange(1.0, 10).reshape(3, 3)
    rows = np.repeat([[0.5], [1.0], [1.5]], 3, axis=1)
    got = amg.smooth_interpolation(matrix(spark, p), matrix(spark, rows), 0.5, "reference")
    assert np.allclose(dense_of(got), [[0.75, 1.75, 2.75], [3.5, 4.5, 5.5], [6.25, 7.25, 8.25]])
    p = np.arange(1.0, 13).reshape(3, 4)
    got = amg.smooth_interpolation(matrix(spark, p), Matrix(matrix(spark, rows[:, :2]).df, 3, 2), 1.0, "reference")
    assert np.allclose(dense_of(got), [[0.5, 1.5, 3, 4], [4, 5, 7, 8], [7.5, 8.5, 11, 12]])
    assert np.allclose(np.linalg.norm(dense_of(amg.minimize_energy(matrix(spark, p))), axis=1), 1)
    a = tri(6, -1, 2, -1)
    m = matrix(spark, a)
    agg, n = amg.double_pairwise(amg.strength(m, 0.1))
    assert n == 2 and {r["i"]: r["agg"] for r in agg.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    q = amg.smooth_interpolation(amg.prolongation(agg, 6, 2), m)
    d = dense_of(q)
    assert np.allclose(dense_of(amg.galerkin(la.transpose(q), m, q)), d.T @ a @ d)


def test_graph(spark):
    a = tri(7, -1, 2, -1)
    m = matrix(spark, a)
    edges = {(r["src"], r["dst"]) for r in graph.adjacency(m).collect()}
    assert edges == {(i, j) for i in range(7) for j in range(7) if abs(i - j) == 1}
    near = {(r["src"], r["dst"]) for r in graph.distance2(graph.adjacency(m), 7).collect()}
    assert near == {(i, j) for i in range(7) for j in range(7) if abs(i - j) <= 2}
    colors = graph.color_graph(m)
    assert {r["i"]: r["color"] for r in colors.collect()} == {i: i % 3 for i in range(7)}
    assert {r["color"]: r["members"] for r in graph.blocks_from_colors(colors).collect()} == {0: [0, 3, 6], 1: [1, 4], 2: [2, 5]}


def test_entry_names():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys() and len(queries) >= 80


def _chain_in_time(pc):
    """A chain's incomplete factors are its LU factors; making them takes time in proportion to the rows, not to their square."""
    n = 40_000
    i, j = np.r_[0:n, 1:n, 0 : n - 1], np.r_[0:n, 0 : n - 1, 1:n]
    v = np.r_[np.full(n, 2.0), np.full(n - 1, -1.0), np.full(n - 1, 0.5)]
    x, began = np.arange(n) % 7 + 1.0, time.perf_counter()
    pc.prepare(i, j, v, n)
    assert np.allclose(pc.solve(np.bincount(i, v * x[j])), x, rtol=1e-12)
    assert time.perf_counter() - began < 20  # some 80 s when each row looked at all before it


def test_ilu0_of_a_long_chain():
    _chain_in_time(Ilu0())


def test_ilup_of_a_long_chain():
    _chain_in_time(Ilup(fill=1))


@pytest.mark.parametrize("fill", [0, 1, 2, 3])
@pytest.mark.parametrize("pairs", [5, 1 << 20])
def test_ilup_is_that_of_full_rows(fill, pairs, monkeypatch):
    """Rows gone through in full, entries of too high a level dropped at a row's end; whatever is held at once."""
    monkeypatch.setattr(dense, "PAIRS", pairs)
    rng = np.random.default_rng(7)
    for n in (1, 7, 12, 20, 20, 20):
        a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.2)
        np.fill_diagonal(a, 4.0)
        got = dense.ilup([{j: a[i, j] for j in range(n) if a[i, j]} for i in range(n)], fill)
        w, level = a.copy(), np.where(a != 0, 0, 99)
        for i in range(n):
            for k in (k for k in range(i) if level[i, k] <= fill):
                w[i, k] /= w[k, k]
                for j in (j for j in range(k + 1, n) if level[k, j] <= fill):
                    w[i, j] -= w[i, k] * w[k, j]
                    level[i, j] = min(level[i, j], level[i, k] + level[k, j] + 1)
            w[i, level[i] > fill] = 0
        full = np.diag(got.pivot)
        for i in range(n):
            for j, x in (got.lower[i] | got.upper[i]).items():
                full[i, j] = x
        assert np.allclose(full, w, rtol=1e-12, atol=1e-14)


def test_ilut_of_a_long_chain():
    _chain_in_time(Ilut(fill=4, drop=1e-4))


def test_least_squares_of_many_columns(spark, monkeypatch):
    """More columns than a triangle has room for: LSQR, with the same solution; an empty column is an error."""
    from sparsolve.solvers import direct

    rng = np.random.default_rng(3)
    m = (rng.random((90, 30)) < 0.3) * rng.integers(1, 50, (90, 30)) + np.eye(90, 30)
    y = rng.normal(size=90)
    i, j = np.nonzero(m)
    cells = lambda keep: Matrix(spark.createDataFrame(pd.DataFrame({"i": i[keep], "j": j[keep], "v": m[i, j][keep]})), 90, 30)
    b = Vector(spark.createDataFrame(pd.DataFrame({"i": np.arange(90), "v": y})), 90)
    monkeypatch.setattr(direct, "DENSE_MOST", 20)
    got = DirectQR().tall(cells(j >= 0), b)
    x = np.array([r["v"] for r in got.x.dense().orderBy("i").collect()])
    assert got.stats.converged and np.allclose(x, np.linalg.lstsq(m, y, rcond=None)[0], atol=1e-9)
    with pytest.raises(FactorError):
        DirectQR().tall(cells(j != 4), b)


def test_multigrid_levels_in_arrays(spark, monkeypatch):
    """Levels made in arrays are those made in DataFrames."""
    n = 60
    rng = np.random.default_rng(2)
    m = np.diag(np.full(n, 4.0)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)
    far = np.triu((rng.random((n, n)) < 0.03) * rng.random((n, n)), 2)
    i, j = np.nonzero(m - far - far.T)
    a = Matrix(spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "v": (m - far - far.T)[i, j]})), n, n)
    fast = amg.Amg().setup(a)
    monkeypatch.setattr(amg, "ARRAY_CELLS", 0)
    slow = amg.Amg().setup(a)
    assert len(fast.levels) == len(slow.levels) > 1
    for x, y in zip(fast.levels, slow.levels, strict=True):
        for one, other in ((x.a, y.a), (x.p, y.p), (x.r, y.r)):
            if other is not None:
                full = np.zeros((2, one.nrows, one.ncols))
                full[0, one.i, one.j] = one.v
                t = other.df.toPandas()
                full[1, t["i"], t["j"]] = t["v"]
                assert np.allclose(*full, atol=1e-12)
