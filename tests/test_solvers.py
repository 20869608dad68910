"""Krylov methods on small systems with known solutions, in every space."""

import numpy as np
import pytest

from sparsolve.plans.session import PC, SolverKind, SolverSession, solve_many
from sparsolve.plans.space import BroadcastSpace, FrameSpace, LocalSpace
from sparsolve.precond.base import ArrayPreconditioner, Identity
from sparsolve.solvers import krylov
from sparsolve.solvers.options import NormType, Orthogonalization, Side
from sparsolve.types import Convergence, IndefiniteMatrix, IndefinitePreconditioner, Matrix, ShapeError, Unsupported, Vector

SPD2 = ([[4, 1], [1, 3]], [1, 2])
SPD3 = ([[4, 1, 0], [1, 3, 1], [0, 1, 2]], [6, 10, 8])
TRI4 = ([[4, 1, 0, 0], [1, 3, 1, 0], [0, 1, 2, 1], [0, 0, 1, 3]], [6, 10, 12, 15])
NONSYM3 = ([[4, 3, 5], [2, 4, 6], [3, 5, 4]], [25, 28, 25])
NONSYM5 = ([[10, 2, 0, 0, 0], [3, 15, 4, 0, 0], [0, -2, 8, 1, 0], [0, 0, 1, 7, 3], [0, 0, 0, 2, 12]], [14, 45, 24, 46, 68])
QMR2 = ([[2, 1], [0, 3]], [3, 6])
TFQMR2 = ([[2, 1], [3, 4]], [4, 11])
FULL3 = ([[4, 1, 2], [1, 3, 1], [2, 1, 3]], [12, 10, 13])
EYE5 = (np.eye(5), [0.5, -1.2, 3.0, 4.4, -2.2])
INDEF2 = ([[0, 1], [1, 0]], [1, 1])


def local(a, b, x0=None):
    a = np.array(a, float)
    s = LocalSpace(max(a.shape))
    i, j = np.nonzero(a)
    s.add_cells("A", i, j, a[i, j])
    s.load(b=b, x=np.zeros(s.n) if x0 is None else x0)
    return s


def check(system, stats, s, tol=1e-8):
    a, b = np.array(system[0], float), np.array(system[1], float)
    assert stats.converged
    assert np.allclose(s.v["x"][: a.shape[1]], np.linalg.lstsq(a, b, rcond=None)[0], atol=tol)


R = Convergence(1e-12, 200)
GENERAL = {
    "gmres": lambda s: krylov.gmres(s, R), "gmres2": lambda s: krylov.gmres(s, R, restart=2), "fgmres": lambda s: krylov.fgmres(s, R),
    "fgmres_mgs": lambda s: krylov.fgmres(s, R, orthogonalization=Orthogonalization.MODIFIED), "sstep": lambda s: krylov.s_step_gmres(s, R),
    "bicgstab": lambda s: krylov.bicgstab(s, Convergence(1e-11, 200, True)), "cgs": lambda s: krylov.cgs(s, R), "qmr": lambda s: krylov.qmr(s, R), "tfqmr": lambda s: krylov.tfqmr(s, R), "cgnr": lambda s: krylov.cgnr(s, R),
}


@pytest.mark.parametrize("name", GENERAL)
@pytest.mark.parametrize("system", [SPD3, TRI4, NONSYM3, NONSYM5, QMR2, TFQMR2, FULL3, EYE5], ids=["spd3", "tri4", "nonsym3", "nonsym5", "qmr2", "tfqmr2", "full3", "eye5"])
def test_general(name, system):
    s = local(*system)
    check(system, GENERAL[name](s), s, 1e-7)


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("system", [SPD2, SPD3, TRI4, FULL3, EYE5])
def test_cg(system, single):
    s = local(*system)
    check(system, krylov.cg(s, R, single_reduction=single), s)
    s = local(*system)
    check(system, krylov.cgne(s, R), s)


@pytest.mark.parametrize("system", [SPD2, SPD3, TRI4, EYE5, INDEF2])
def test_minres(system):
    s = local(*system)
    check(system, krylov.minres(s, R), s)


def test_random_systems():
    rng = np.random.default_rng(3)
    m = rng.random((10, 10))
    b = rng.random(10)
    for a, run in ((m.T @ m + np.eye(10), krylov.cg), (m + 3 * np.eye(10), krylov.gmres), (m + m.T, krylov.minres)):
        s = local(a, b)
        check((a, b), run(s, R), s, 1e-6)


def test_least_squares_and_least_norm():
    s = local([[1, 0], [0, 1], [1, 1]], [1, 2, 3])
    check(([[1, 0], [0, 1], [1, 1]], [1, 2, 3]), krylov.cgnr(s, R), s)
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    s = local(a, [2, 3])
    check((a, [2, 3]), krylov.cgne(s, R), s)


def test_start_and_end():
    for run in (krylov.cg, krylov.gmres, krylov.bicgstab, krylov.cgs, krylov.qmr, krylov.tfqmr, krylov.minres, krylov.cgnr, krylov.cgne, krylov.s_step_gmres):
        s = local(*SPD3, x0=[1, 2, 3])
        got = run(s, R)
        assert got.converged and got.iterations == 0 and np.allclose(s.v["x"], [1, 2, 3])
        s = local(*TRI4, x0=[5, 0, 1, -1])
        check(TRI4, run(s, R), s, 1e-7)
        s = local(*TRI4)
        assert not run(s, Convergence(1e-14, 1)).converged
        s = local(*TRI4)
        assert run is krylov.bicgstab or run(s, Convergence(1e-14, 1, mode="reference")).converged


def test_cg_options():
    seen = []
    s = local(*TRI4)
    krylov.cg(s, R, monitor=lambda k, r: seen.append((k, r)))
    assert [k for k, _ in seen] == list(range(len(seen))) and seen[-1][1] < 1e-10
    s = local(*TRI4)
    got = krylov.cg(s, R, radius=1.0)
    assert not got.converged and np.isclose(np.linalg.norm(s.v["x"]), 1.0)
    s = local(*TRI4)
    got = krylov.cg(s, R, objective=-10.0)
    x, a, b = s.v["x"], np.array(TRI4[0]), np.array(TRI4[1])
    assert got.converged and got.iterations < 4 and x @ a @ x / 2 - x @ b <= -10
    s = local(*TRI4)
    assert not krylov.cg(s, Convergence(1e-12, 3), norm=NormType.NONE).converged
    for norm in NormType:
        s = local(*TRI4)
        krylov.cg(s, Convergence(1e-12, 4), norm=norm)
        assert np.allclose(s.v["x"], [1, 2, 3, 4], atol=1e-6)
    with pytest.raises(IndefiniteMatrix):
        krylov.cg(local(INDEF2[0], [1, -1]), R)


class Scale(ArrayPreconditioner):
    ready = True

    def __init__(self, d):
        self.d = np.array(d, float)

    def solve(self, r):
        return r * self.d


def test_preconditioned():
    d = 1 / np.diag(np.array(TRI4[0], float))
    for single in (False, True):
        for norm in (NormType.PRECONDITIONED, NormType.UNPRECONDITIONED, NormType.NATURAL):
            s = local(*TRI4)
            check(TRI4, krylov.pcg(s, Scale(d), R, norm=norm, single_reduction=single), s)
    for side in (Side.LEFT, Side.RIGHT):
        s = local(*NONSYM5)
        check(NONSYM5, krylov.gmres(s, R, 3, side, Scale(1 / np.diag(np.array(NONSYM5[0], float)))), s)
    calls = []
    s = local([[2, 1], [1, 3]], [4, 7])
    check(([[2, 1], [1, 3]], [4, 7]), krylov.fgmres(s, R, pc=Scale([0.5, 1 / 3]), modify=lambda k, pc: calls.append(k) or pc), s, 1e-6)
    assert calls == [0, 1]
    for run in (krylov.bicgstab, krylov.cgs, krylov.tfqmr, krylov.s_step_gmres):
        s = local(*NONSYM5)
        check(NONSYM5, run(s, Convergence(1e-12, 100), pc=Scale(1 / np.diag(np.array(NONSYM5[0], float)))), s, 1e-6)
    with pytest.raises(IndefinitePreconditioner):
        krylov.pcg(local(*SPD3), Scale([-1, -1, -1]), R)
    with pytest.raises(Unsupported):
        krylov.gmres(local(*SPD3), R, pc=Scale([1, 1, 1]))


@pytest.mark.parametrize("factory", ["ilu0", "ilup", "ilut", "sor"])
def test_ordered_preconditioners_speed_up(factory):
    n = 60
    a = 2.01 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    b = np.random.default_rng(5).random(n)
    plain, own = local(a, b), local(a, b)
    k0 = krylov.cg(plain, R).iterations
    got = krylov.pcg(own, PC.make(factory), R)
    check((a, b), got, own, 1e-7)
    assert got.iterations < k0


def matrix(spark, a):
    a = np.array(a, float)
    i, j = np.nonzero(a)
    return Matrix(spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, v double"), *a.shape)


@pytest.mark.parametrize("tier", ["local", "broadcast", "frame"])
def test_tiers_agree(spark, tier):
    a, b = matrix(spark, NONSYM5[0]), Vector.local(spark, NONSYM5[1])
    for kind in ("bicgstab", "qmr") if tier != "local" else list(set(SolverKind) - {"cg", "pcg", "minres"}):
        got = SolverSession(kind, tol=1e-10, tier=tier).solve(a, b)
        assert got.stats.converged
        assert np.allclose([r["v"] for r in got.x.dense().orderBy("i").collect()], [1, 2, 3, 4, 5], atol=1e-6), kind
    a, b = matrix(spark, TRI4[0]), Vector.local(spark, TRI4[1])
    got = SolverSession("pcg", PC.make("jacobi"), tier=tier).solve(a, b, Vector.local(spark, [1, 1, 1, 1]))
    assert np.allclose([r["v"] for r in got.x.dense().orderBy("i").collect()], [1, 2, 3, 4], atol=1e-6)
    assert got.history_df(spark).count() == got.stats.iterations + 1 and got.stats_df(spark).first()["converged"]


def test_session_rules(spark):
    a, b = matrix(spark, TRI4[0]), Vector.local(spark, TRI4[1])
    with pytest.raises(Unsupported):
        SolverSession("cg", PC.make("jacobi")).solve(a, b)
    with pytest.raises(Unsupported):
        SolverSession("pcg").solve(a, b)
    with pytest.raises(ShapeError):
        SolverSession("cg").solve(a, Vector.local(spark, [1.0]))
    with pytest.raises(Unsupported):
        SolverSession("pcg", PC.make("ilu0"), tier="frame").solve(a, b)
    assert PC.from_options({"pc_type": "sor", "omega": "1.5"}).omega == 1.5 and PC.from_options({}) is None
    with pytest.raises(Unsupported):
        PC.make("magic")


def test_many_systems(spark):
    rows = [(k, i, j, float(v)) for k in range(3) for i, r in enumerate(NONSYM3[0]) for j, v in enumerate(r)]
    a = spark.createDataFrame(rows, "system_id long, i long, j long, v double")
    b = spark.createDataFrame([(k, i, float(v * (k + 1))) for k in range(3) for i, v in enumerate(NONSYM3[1])], "system_id long, i long, v double")
    for kind, pc in (("gmres", None), ("gmres_right", PC.make("ilu0")), ("bicgstab", None)):
        for r in solve_many(a, b, kind, pc=pc).collect():
            assert r["converged"] and np.isclose(r["x"], (r["i"] + 1) * (r["system_id"] + 1))


def test_broadcast_bound(spark):
    with pytest.raises(ShapeError):
        BroadcastSpace(spark, 10**8)
    assert isinstance(Identity(), Identity) and FrameSpace(spark, 3).n == 3


@pytest.mark.parametrize("kind, options", [("ilu0", {}), ("ilup", {"fill": 1}), ("ilut", {"fill": 20, "drop": 0.0}), ("sor", {"omega": 1.2})])
def test_blockwise_equals_the_inner_one_on_each_block(spark, kind, options):
    rng = np.random.default_rng(3)
    full = rng.normal(size=(11, 11)) * (rng.random((11, 11)) < 0.5) + 8 * np.eye(11)
    a = Matrix.of(spark.createDataFrame([(int(i), int(j), float(full[i, j])) for i, j in zip(*np.nonzero(full), strict=True)], "i long, j long, v double"), 11)
    got, want = np.zeros((11, 11)), np.zeros((11, 11))
    for r in PC.make("blockwise", inner=PC.make(kind, **options), size=4).setup(a).inverse.df.collect():
        got[r["i"], r["j"]] = r["v"]
    for start in (0, 4, 8):
        part = full[start : start + 4, start : start + 4]
        inner, (i, j) = PC.make(kind, **options), np.nonzero(part)
        inner.prepare(i, j, part[i, j], len(part))
        for k in range(len(part)):
            want[start : start + 4, start + k] = inner.solve(np.eye(len(part))[k])
    assert np.allclose(got, want)


def test_blockwise_in_a_frame(spark):
    n = 40
    a = Matrix.of(spark.createDataFrame([(i, j, 4.0 if i == j else -1.0) for i in range(n) for j in range(max(0, i - 1), min(n, i + 2))], "i long, j long, v double"), n)
    x = np.arange(n) % 7 + 1.0
    b = Vector.local(spark, 4 * x - np.r_[0, x[:-1]] - np.r_[x[1:], 0])
    for kind, pc in (("pcg", PC.make("sor")), ("gmres_right", PC.make("ilu0"))):
        got = SolverSession(kind, PC.make("blockwise", inner=pc, size=8), tier="frame").solve(a, b)
        assert got.stats.converged and np.allclose([r["v"] for r in got.x.dense().orderBy("i").collect()], x)
    with pytest.raises(Unsupported):
        PC.make("blockwise", inner=PC.make("jacobi"))


@pytest.mark.parametrize("block", [1, 4, 8, 30])
def test_s_step_gmres_spans_what_gmres_spans(block):
    """A spectrum that cycles as short as a block don't solve: as many products as GMRES takes, up to the rest of a block."""
    rng = np.random.default_rng(5)
    n = 120
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    full = q @ np.diag(np.linspace(1, 60, n)) @ q.T + 0.1 * rng.normal(size=(n, n))
    i, j = np.nonzero(full)
    steps = {}
    for name, run in (("plain", lambda s: krylov.gmres(s, Convergence(1e-8, 400), 60)), ("blocks", lambda s: krylov.s_step_gmres(s, Convergence(1e-8, 400), block, 60))):
        s = LocalSpace(n)
        s.add_cells("A", i, j, full[i, j])
        s.load(b=np.ones(n), x=np.zeros(n))
        got = run(s)
        assert got.converged and np.linalg.norm(full @ s.v["x"] - 1) <= 1.0001e-8 * np.sqrt(n)
        steps[name] = got.iterations
    assert steps["blocks"] <= steps["plain"] + max(block, 8)
