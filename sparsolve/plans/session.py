"""One entry to all solvers: which method, which preconditioner, and where the vectors live."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import StrEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..precond.amg import Amg
from ..precond.base import Preconditioner
from ..precond.simple import AdditiveSchwarz, ApproximateInverse, BlockJacobi, Blockwise, Chebyshev, Ilu0, Ilup, Ilut, Jacobi, MultiColor, Sor
from ..solvers import krylov
from ..solvers.direct import DirectLU, DirectQR
from ..solvers.options import Side
from ..types import Convergence, Matrix, Monitor, ShapeError, SolveResult, SolveStats, Unsupported, Vector
from .space import BROADCAST_MOST, BroadcastSpace, FrameSpace, LocalSpace

log = logging.getLogger("sparsolve")


class SolverKind(StrEnum):
    CG = "cg"
    PCG = "pcg"
    GMRES = "gmres"
    GMRES_LEFT = "gmres_left"
    GMRES_RIGHT = "gmres_right"
    FGMRES = "fgmres"
    PCA_GMRES = "pca_gmres"
    BICGSTAB = "bicgstab"
    CGS = "cgs"
    QMR = "qmr"
    TFQMR = "tfqmr"
    MINRES = "minres"
    CGNR = "cgnr"
    CGNE = "cgne"
    LU = "lu"
    QR = "qr"


class Tier(StrEnum):
    LOCAL = "local"
    BROADCAST = "broadcast"
    FRAME = "frame"


#: What one machine takes.
LOCAL_ROWS, LOCAL_CELLS = 20_000, 2_000_000


def choose_tier(n: int, cells: int) -> Tier:
    tier = Tier.LOCAL if n <= LOCAL_ROWS and cells <= LOCAL_CELLS else Tier.BROADCAST if n <= BROADCAST_MOST else Tier.FRAME
    log.info("%d rows, %d entries: %s", n, cells, tier)
    return tier


class PC:
    """Preconditioners by name: PC.make("ilut", fill=5, drop=1e-3), or from string options."""

    KINDS = {"jacobi": Jacobi, "block_jacobi": BlockJacobi, "blockwise": Blockwise, "sor": Sor, "ilu0": Ilu0, "ilup": Ilup, "ilut": Ilut, "chebyshev": Chebyshev, "asm": AdditiveSchwarz, "spai": ApproximateInverse, "amg": Amg, "multicolor": MultiColor}

    @classmethod
    def make(cls, kind: str, **options) -> Preconditioner:
        if kind not in cls.KINDS:
            raise Unsupported(f"no preconditioner {kind!r}; there are {', '.join(cls.KINDS)}")
        return cls.KINDS[kind](**options)

    @classmethod
    def from_options(cls, options: dict[str, str]) -> Preconditioner | None:
        """pc_type, omega and drop_tol as strings."""
        kind = options.get("pc_type", "none")
        if kind == "none":
            return None
        own = {}
        if "omega" in options and kind == "sor":
            own["omega"] = float(options["omega"])
        if "drop_tol" in options and kind in ("ilut", "spai"):
            own["drop"] = float(options["drop_tol"])
        return cls.make(kind, **own)


def run_krylov(kind: SolverKind, s, rule: Convergence, pc: Preconditioner | None, restart: int, monitor: Monitor, options: dict) -> SolveStats:
    """The method on a space that holds A, b and x."""
    match kind:
        case SolverKind.CG:
            if pc is not None:
                raise Unsupported("cg takes no preconditioner; pcg does")
            return krylov.cg(s, rule, monitor, **options)
        case SolverKind.PCG:
            if pc is None:
                raise Unsupported("pcg needs a preconditioner")
            return krylov.pcg(s, pc, rule, monitor, **options)
        case SolverKind.GMRES:
            return krylov.gmres(s, rule, restart, Side.LEFT if pc else Side.NONE, pc, monitor, **options)
        case SolverKind.GMRES_LEFT:
            return krylov.gmres(s, rule, restart, Side.LEFT, pc, monitor, **options)
        case SolverKind.GMRES_RIGHT:
            return krylov.gmres(s, rule, restart, Side.RIGHT, pc, monitor, **options)
        case SolverKind.FGMRES:
            return krylov.fgmres(s, rule, restart, pc, monitor=monitor, **options)
        case SolverKind.PCA_GMRES:
            return krylov.s_step_gmres(s, rule, restart=restart, pc=pc, monitor=monitor, **options)
        case SolverKind.BICGSTAB | SolverKind.CGS | SolverKind.TFQMR:
            return getattr(krylov, kind.value)(s, rule, pc, monitor, **options)
        case SolverKind.QMR | SolverKind.MINRES | SolverKind.CGNR | SolverKind.CGNE:
            if pc is not None:
                log.warning("%s takes no preconditioner; it is left out", kind)
            return getattr(krylov, kind.value)(s, rule, monitor, **options)
    raise Unsupported(f"{kind} isn't a Krylov method")


@dataclass
class SolverSession:
    """solve(A, b) by the chosen method.  tier None: by the size of the system.  BiCGStab's tolerance is absolute by default."""

    kind: SolverKind | str = SolverKind.GMRES
    pc: Preconditioner | None = None
    tol: float = 1e-10
    max_iters: int = 1000
    restart: int = 30
    tier: Tier | str | None = None
    absolute: bool | None = None
    mode: str = "textbook"
    monitor: Monitor | None = None
    options: dict = field(default_factory=dict)

    def solve(self, a: Matrix, b: Vector, x0: Vector | None = None) -> SolveResult:
        kind = SolverKind(self.kind)
        if a.nrows != b.n:
            raise ShapeError(f"{a.nrows} rows and {b.n} values")
        if a.nrows != a.ncols and kind not in (SolverKind.CGNR, SolverKind.CGNE, SolverKind.QR):
            raise ShapeError(f"{kind} needs a square matrix")
        if kind is SolverKind.LU:
            return DirectLU().solve(a, b)
        if kind is SolverKind.QR:
            return DirectQR().solve(a, b)
        n = max(a.nrows, a.ncols)
        tier = Tier(self.tier) if self.tier else choose_tier(n, a.df.count() if n <= LOCAL_ROWS else 0)
        s = LocalSpace(n) if tier is Tier.LOCAL else BroadcastSpace(a.spark, n) if tier is Tier.BROADCAST else FrameSpace(a.spark, n)
        s.add_matrix("A", a)
        s.load(b=b, x=x0 if x0 is not None else Vector(a.spark.createDataFrame([], "i long, v double"), n))
        history: list[tuple[int, float]] = []

        def monitor(k: int, r: float) -> None:
            history.append((k, float(r)))
            if self.monitor:
                self.monitor(k, float(r))

        rule = Convergence(self.tol, self.max_iters, kind is SolverKind.BICGSTAB if self.absolute is None else self.absolute, self.mode)
        pc = self.pc.setup(a) if self.pc is not None else None
        stats = run_krylov(kind, s, rule, pc, self.restart, monitor, self.options)
        x = Vector.local(a.spark, s.v["x"][: a.ncols]) if tier is Tier.LOCAL else s.vector("x", a.ncols)
        if tier is Tier.FRAME:
            s.cut()
            x = s.vector("x", a.ncols)
        s.close()
        return SolveResult(x, SolveStats(stats.iterations, float(stats.final_residual), bool(stats.converged)), history)


def solve_many(a: DataFrame, b: DataFrame, kind: SolverKind | str = SolverKind.GMRES, tol: float = 1e-10, max_iters: int = 1000, restart: int = 30, pc: Preconditioner | None = None) -> DataFrame:
    """Many small systems at once, each in one task: a (system_id, i, j, v), b (system_id, i, v) to (system_id, i, x, iterations, final_residual, converged).

    Preconditioners that work on arrays (ilu0, ilup, ilut, sor) are made per system."""
    kind = SolverKind(kind)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import copy

        n = int(max(left["i"].max(), left["j"].max(), right["i"].max())) + 1
        s = LocalSpace(n)
        s.add_cells("A", *(left[c].to_numpy() for c in ("i", "j", "v")))
        rhs = np.zeros(n)
        rhs[right["i"].to_numpy()] = right["v"].to_numpy()
        s.load(b=rhs, x=np.zeros(n))
        got = run_krylov(kind, s, Convergence(tol, max_iters, kind is SolverKind.BICGSTAB), copy.deepcopy(pc), restart, lambda k, r: None, {})
        return pd.DataFrame({"system_id": left["system_id"].iloc[0], "i": np.arange(n), "x": s.v["x"], "iterations": got.iterations, "final_residual": float(got.final_residual), "converged": bool(got.converged)})

    return a.groupBy("system_id").cogroup(b.groupBy("system_id")).applyInPandas(run, "system_id long, i long, x double, iterations int, final_residual double, converged boolean")


def scatter(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out by ranges of i: what a scatter over workers does."""
    return df.repartitionByRange(parts, "i")


def gather(v: Vector) -> Iterator[float]:
    """The values in order, a partition at a time."""
    return (r["v"] for r in v.dense().orderBy("i").toLocalIterator())
