"""Direct solves in grouped maps: many small systems at once, each in one task; and least squares of tall matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dense import lu_apply, lu_factor, lu_solve, qr_solve
from ..plans.lineage import cut
from ..plans.space import BROADCAST_MOST, BroadcastSpace, FrameSpace
from ..types import Convergence, FactorError, Matrix, NotFactored, SolveResult, SolveStats, Vector
from .krylov import lsqr

#: Longest side of a dense system that one task solves.
DENSE_MOST = 4000
#: |A'r| of the end over that of the start where there are more columns.
WIDE_TOL = 1e-12


def _dense(pdf: pd.DataFrame, nrows: int, ncols: int) -> np.ndarray:
    a = np.zeros((nrows, ncols))
    np.add.at(a, (pdf["i"].to_numpy(), pdf["j"].to_numpy()), pdf["v"].to_numpy())
    return a


def solve_batch(a: DataFrame, b: DataFrame, least_squares: bool = False) -> DataFrame:
    """(system_id, i, x, residual) for systems a (system_id, i, j, v) and b (system_id, i, v); a singular one raises FactorError."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = int(max(left["i"].max(), right["i"].max())) + 1
        m = int(left["j"].max()) + 1
        if max(n, m) > DENSE_MOST:
            raise FactorError(f"a side of {max(n, m)}; {DENSE_MOST} at most")
        dense, rhs = _dense(left, n, m if least_squares else max(n, m)), np.zeros(n)
        rhs[right["i"].to_numpy()] = right["v"].to_numpy()
        x = (qr_solve if least_squares else lu_solve)(dense, rhs)
        return pd.DataFrame({"system_id": left["system_id"].iloc[0], "i": np.arange(len(x)), "x": x, "residual": np.linalg.norm(rhs - dense @ x)})

    return a.groupBy("system_id").cogroup(b.groupBy("system_id")).applyInPandas(run, "system_id long, i long, x double, residual double")


def _one(a: Matrix, b: Vector, least_squares: bool) -> SolveResult:
    got = solve_batch(a.df.select(F.lit(0).cast("long").alias("system_id"), "i", "j", "v"), b.dense().select(F.lit(0).cast("long").alias("system_id"), "i", "v"), least_squares).toPandas().sort_values("i")
    r = float(got["residual"].iloc[0])
    return SolveResult(Vector.local(a.spark, got["x"]), SolveStats(1, r, True), [(1, r)])


class DirectLU:
    """Dense LU of a square matrix; its factors are kept, so that further right sides cost two triangular solves only."""

    def __init__(self) -> None:
        self.factors: tuple[np.ndarray, np.ndarray] | None = None

    def solve(self, a: Matrix, b: Vector) -> SolveResult:
        self.factor(a)
        return self.solve_cached(b, a)

    def factor(self, a: Matrix) -> None:
        if max(a.nrows, a.ncols) > DENSE_MOST or a.nrows != a.ncols:
            raise FactorError(f"square matrices of {DENSE_MOST} rows at most")
        t = a.df.toPandas()  # DENSE_MOST ** 2 values at most
        self.factors = lu_factor(_dense(t, a.nrows, a.ncols))

    def solve_cached(self, b: Vector, a: Matrix | None = None) -> SolveResult:
        if self.factors is None:
            raise NotFactored("solve() or factor() comes first")
        rhs = np.zeros(b.n)
        t = b.df.toPandas()
        rhs[t["i"]] = t["v"]
        x = lu_apply(self.factors, rhs)
        r = 0.0
        if a is not None:
            r = float(np.linalg.norm(rhs - _dense(a.df.toPandas(), a.nrows, a.ncols) @ x))
        return SolveResult(Vector.local(b.df.sparkSession, x), SolveStats(1, r, True), [(1, r)])


class DirectQR:
    """Least squares by QR: small ones in one task, tall ones by a tree of QRs over partitions (TSQR)."""

    def solve(self, a: Matrix, b: Vector) -> SolveResult:
        return _one(a, b, True) if a.nrows <= DENSE_MOST else self.tall(a, b)

    def tall(self, a: Matrix, b: Vector) -> SolveResult:
        """Each task reduces its rows [A | b] to a triangle of ncols + 1 rows; the triangles are reduced once more.  For more than DENSE_MOST columns, whose triangles have no room, `wide`."""
        n = a.ncols
        if n > DENSE_MOST:
            return self.wide(a, b)
        rows = a.df.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("c")).join(b.df.withColumnRenamed("v", "b"), "i", "full")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, n + 1))
            for batch in batches:
                block = np.zeros((batch.num_rows, n + 1))
                for k, (cells, y) in enumerate(zip(batch.column("c").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                    for c in cells or ():
                        block[k, c["j"]] += c["v"]
                    block[k, n] = y or 0.0
                r = np.linalg.qr(np.vstack([r, block]), mode="r")
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["r"])

        got = np.array([x["r"] for x in rows.select("c", "b").mapInArrow(run, "r array<double>").collect()])  # ncols + 1 rows a task
        r = np.linalg.qr(got, mode="r")
        x = qr_solve(r[:n, :n], r[:n, n])
        rest = float(np.abs(r[n:, n]).max(initial=0.0))
        return SolveResult(Vector.local(a.spark, x), SolveStats(1, rest, True), [(1, rest)])

    def wide(self, a: Matrix, b: Vector) -> SolveResult:
        """Least squares by LSQR on columns of unit length: QR of the bidiagonal form, a few vectors instead of a triangle.

        An empty column raises FactorError, and so does running out of steps; other columns that depend on each other go unnoticed and share the
        solution of least norm."""
        size = cut(a.df.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size")).where("size > 0"))
        if size.count() < a.ncols:
            raise FactorError("rank-deficient")
        scaled = Matrix(a.df.join(size, "j").selectExpr("i", "j", "v / size v"), a.nrows, a.ncols)
        n = max(a.nrows, a.ncols)
        s = BroadcastSpace(a.spark, n) if n <= BROADCAST_MOST else FrameSpace(a.spark, n)
        s.add_matrix("A", scaled)
        s.load(b=b, x=Vector(a.spark.createDataFrame([], "i long, v double"), n))
        history: list[tuple[int, float]] = []
        stats = lsqr(s, Convergence(WIDE_TOL, 10 * a.ncols), lambda k, r: history.append((k, float(r))))
        if not stats.converged:
            raise FactorError(f"no solution after {stats.iterations} steps")
        x = s.vector("x", a.ncols).df.join(size.withColumnRenamed("j", "i"), "i").selectExpr("i", "v / size v")
        out = Vector(cut(x), a.ncols)
        s.close()
        return SolveResult(out, stats, history)
