"""Jacobi, block-Jacobi, additive Schwarz, sparse approximate inverse, Chebyshev, incomplete factors, relaxation, colours."""

from __future__ import annotations

import copy
from enum import Flag

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dense
from ..plans.lineage import cut
from ..types import Matrix, Unsupported
from .base import ArrayPreconditioner, MatrixPreconditioner, Preconditioner


#: Neighbouring blocks or columns that are worked on in one call.
CHUNK = 64


class Jacobi(MatrixPreconditioner):
    """z = r / diag(A); zero where the diagonal is."""

    name = "jacobi"

    def setup(self, a: Matrix) -> Jacobi:
        self.inverse = Matrix(a.df.where("i = j and v <> 0").selectExpr("i", "j", "1D / v v"), a.nrows, a.ncols)
        return self


def contiguous_blocks(a: Matrix, size: int) -> DataFrame:
    return a.spark.range(a.nrows).selectExpr(f"id div {int(size)} block", "id i")


def block_inverses(a: Matrix, blocks: DataFrame) -> DataFrame:
    """(block, i, j, v): the inverses of A's principal blocks, each made in one task; blocks (block, i) may overlap."""
    own = blocks.select("block", "i")
    cells = a.df.join(own, "i").join(own.withColumnRenamed("i", "j"), ["block", "j"]).select("block", "i", "j", "v")

    def one(i: np.ndarray, j: np.ndarray, v: np.ndarray, block: int) -> tuple:
        index = np.unique(np.concatenate([i, j]))
        m = np.zeros((len(index), len(index)))
        m[np.searchsorted(index, i), np.searchsorted(index, j)] = v
        inv = dense.lu_solve(m, np.eye(len(index)))
        i, j = np.nonzero(inv)
        return np.full(len(i), block), index[i], index[j], inv[i, j]

    return _in_chunks(cells, "block", one, "block long, i long, j long, v double")


def _in_chunks(cells: DataFrame, key: str, one, schema: str) -> DataFrame:
    """`one`(i, j, v, key) for each key; CHUNK neighbouring keys are a call from Spark, which costs more than a small system."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        k, i, j, v = (pdf[c].to_numpy() for c in (key, "i", "j", "v"))
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        got = [one(i[a:b], j[a:b], v[a:b], k[a]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({c: np.concatenate([g[n] for g in got]) for n, c in enumerate(names)})

    return cells.withColumn("_chunk", F.expr(f"{key} div {CHUNK}")).groupBy("_chunk").applyInPandas(run, schema)


class BlockJacobi(MatrixPreconditioner):
    """Each block solved by itself; zero outside the blocks."""

    name = "block_jacobi"

    def __init__(self, blocks: DataFrame | None = None, size: int = 32):
        self.blocks, self.size = blocks, size

    def setup(self, a: Matrix) -> BlockJacobi:
        blocks = self.blocks if self.blocks is not None else contiguous_blocks(a, self.size)
        self.inverse = Matrix(block_inverses(a, blocks).groupBy("i", "j").agg(F.sum("v").alias("v")), a.nrows, a.ncols)
        return self


class AdditiveSchwarz(MatrixPreconditioner):
    """The sum over overlapping subdomains of their solves; `overlap` widens them along A's edges."""

    name = "asm"

    def __init__(self, blocks: DataFrame | None = None, size: int = 32, overlap: int = 0):
        self.blocks, self.size, self.overlap = blocks, size, overlap

    def setup(self, a: Matrix) -> AdditiveSchwarz:
        blocks = (self.blocks if self.blocks is not None else contiguous_blocks(a, self.size)).select("block", "i")
        for _ in range(self.overlap):
            blocks = blocks.union(blocks.join(a.df.where("v <> 0"), "i").select("block", F.col("j").alias("i"))).distinct()
        self.inverse = Matrix(block_inverses(a, blocks).groupBy("i", "j").agg(F.sum("v").alias("v")), a.nrows, a.ncols)
        return self


class Blockwise(MatrixPreconditioner):
    """Incomplete factors or sweeps of each block of `size` neighbouring rows by themselves: `inner` (ilu0, ilup, ilut, sor) for every space.

    Blocks are made independently of each other and kept as explicit inverses, `size` entries a row at most; what couples blocks is left out."""

    name = "blockwise"

    def __init__(self, inner: ArrayPreconditioner, size: int = 32):
        if not isinstance(inner, ArrayPreconditioner):
            raise Unsupported(f"{inner.name} needs no blocks")
        self.inner, self.size = inner, int(size)

    def setup(self, a: Matrix) -> Blockwise:
        inner, size, rows = copy.copy(self.inner), self.size, a.nrows

        def one(i: np.ndarray, j: np.ndarray, v: np.ndarray, block: int) -> tuple:
            start = int(block) * size
            n = min(size, rows - start)
            inner.prepare(i - start, j - start, v, n)
            m = np.stack([inner.solve(e) for e in np.eye(n)], 1)
            i, j = np.nonzero(m)
            return i + start, j + start, m[i, j]

        cells = a.df.where(f"i div {size} = j div {size}").selectExpr(f"i div {size} block", "i", "j", "v")
        self.inverse = Matrix(_in_chunks(cells, "block", one, "i long, j long, v double"), a.nrows, a.ncols)
        return self


class ApproximateInverse(MatrixPreconditioner):
    """SPAI: for each column the least squares min |A m - e_j| over a pattern; columns are independent of each other.

    pattern: (j, i) or None for A's own; entries up to `drop` in size are left out.  The other knobs are taken for compatibility."""

    name = "spai"

    def __init__(self, pattern: DataFrame | None = None, drop: float = 0.0, **unused):
        self.pattern, self.drop = pattern, drop

    def setup(self, a: Matrix) -> ApproximateInverse:
        pattern = (self.pattern if self.pattern is not None else a.df.where("v <> 0").select("j", "i")).select(F.col("j").alias("c"), F.col("i").alias("j"))
        cells = pattern.join(a.df, "j").select("c", "i", "j", "v")
        drop = self.drop

        def one(i: np.ndarray, j: np.ndarray, v: np.ndarray, c: int) -> tuple:
            cols, rows = np.unique(j), np.unique(np.append(i, c))
            m = np.zeros((len(rows), len(cols)))
            m[np.searchsorted(rows, i), np.searchsorted(cols, j)] = v
            x = np.linalg.lstsq(m, (rows == c).astype(float), rcond=None)[0]
            big = np.abs(x) > drop
            return cols[big], np.full(big.sum(), c), x[big]

        self.inverse = Matrix(_in_chunks(cells, "c", one, "i long, j long, v double"), a.nrows, a.ncols)
        return self


class Chebyshev(Preconditioner):
    """`steps` Chebyshev iterations on [low, high]; bounds default to Gershgorin's and a thirtieth of it.

    mode="reference": the residual polynomial T_m((A - c) / d) r / T_m(-c / d), for one step not divided."""

    name = "chebyshev"

    def __init__(self, steps: int = 4, low: float | None = None, high: float | None = None, mode: str = "textbook"):
        self.steps, self.low, self.high, self.mode = steps, low, high, mode

    def setup(self, a: Matrix) -> Chebyshev:
        if self.high is None:
            self.high = a.df.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0]
        if self.low is None:
            self.low = self.high / 30
        return self

    def apply(self, s, src: str, dst: str) -> None:
        if self.high is None or self.low is None:
            raise Unsupported("bounds or setup() come first")
        (self._filter if self.mode == "reference" else self._iterate)(s, src, dst)

    def _iterate(self, s, src: str, dst: str) -> None:
        theta, delta = (self.high + self.low) / 2, (self.high - self.low) / 2
        s.let(_r=[(1, src)], _d=[(1 / theta, src)])
        s.let(_z=[(1, "_d")])
        rho = delta / theta
        for _ in range(self.steps - 1):
            s.apply("A", "_d", "_ad")
            s.let(_r=[(1, "_r"), (-1, "_ad")])
            new = 1 / (2 * theta / delta - rho) if delta else 0.0
            s.let(_d=[(new * rho, "_d"), (2 * new / delta if delta else 1 / theta, "_r")])
            s.let(_z=[(1, "_z"), (1, "_d")])
            rho = new
        s.let(**{dst: [(1, "_z")]})
        s.drop("_r", "_d", "_z", "_ad")

    def _filter(self, s, src: str, dst: str) -> None:
        c, d = (self.high + self.low) / 2, (self.high - self.low) / 2
        if abs(2 * d) < np.finfo(float).eps or not self.steps:
            s.let(**{dst: [(1, src)]})
            return
        s.let(_p=[(1, src)])
        s.apply("A", "_p", "_q")
        s.let(_q=[(1 / d, "_q"), (-c / d, "_p")])
        t0, t1 = 1.0, -c / d
        for _ in range(self.steps - 1):
            s.apply("A", "_q", "_w")
            s.let(_w=[(2 / d, "_w"), (-2 * c / d, "_q"), (-1, "_p")], _p=[(1, "_q")])
            s.let(_q=[(1, "_w")])
            t0, t1 = t1, 2 * (-c / d) * t1 - t0
        s.let(**{dst: [(1 / t1 if self.steps > 1 else 1, "_q")]})
        s.drop("_p", "_q", "_w")


class _Factored(ArrayPreconditioner):
    def factors(self, rows: dense.Packed) -> dense.Factors:
        raise NotImplementedError

    def prepare(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> None:
        self._f = self.factors(dense.Packed.of(i, j, v, n))

    def solve(self, r: np.ndarray) -> np.ndarray:
        return self._f.solve(r)


class Ilu0(_Factored):
    name = "ilu0"

    def __init__(self, mode: str = "textbook"):
        self.mode = mode

    def factors(self, rows: dense.Packed) -> dense.Factors:
        return dense.ilu0(rows, self.mode)


class Ilup(_Factored):
    name = "ilup"

    def __init__(self, fill: int = 0, mode: str = "textbook"):
        self.fill, self.mode = fill, mode

    def factors(self, rows: dense.Packed) -> dense.Factors:
        return dense.ilup(rows, self.fill, self.mode)


class Ilut(_Factored):
    name = "ilut"

    def __init__(self, fill: int = 10, drop: float = 1e-3, mode: str = "textbook"):
        self.fill, self.drop, self.mode = fill, drop, mode

    def factors(self, rows: dense.Packed) -> dense.Factors:
        return dense.ilut(rows, self.fill, self.drop, self.mode)


def ilut_reference(a: Matrix, fill: int, drop: float) -> DataFrame:
    """The reference mode's kept entries (i, j, v) as one window over rows."""
    w = W.partitionBy("i").orderBy(F.abs("v").desc(), "j")
    return a.df.where(F.abs("v") >= drop).withColumn("k", F.row_number().over(w)).where(F.col("k") <= fill).select("i", "j", "v")


def ilu0_reference(a: Matrix) -> DataFrame:
    """The reference mode's factors (part, i, j, v): rows of L without its unit diagonal, and of U."""
    d = a.df.where("i = j").selectExpr("i j", "v d")
    lower = a.df.where("j < i").join(d, "j").selectExpr("'L' part", "i", "j", "v / d v")
    return lower.unionByName(a.df.where("j >= i").selectExpr("'U' part", "i", "j", "v"))


class Sweeps(Flag):
    FORWARD = 1
    BACKWARD = 2
    SYMMETRIC = 3
    ONE_SIDED = 4


class Sor(ArrayPreconditioner):
    """Relaxation sweeps from zero: SOR, SSOR; see `functions.dense.sweep` for mode="reference".  `lits` is taken for compatibility."""

    name = "sor"

    def __init__(self, omega: float = 1.0, its: int = 1, lits: int = 1, kind: Sweeps = Sweeps.SYMMETRIC, shift: float = 0.0, mode: str = "textbook"):
        self.omega, self.its, self.lits, self.kind, self.shift, self.mode = omega, its, lits, kind, shift, mode

    def prepare(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> None:
        self._a = dense.rows_of(i, j, v, n)

    def solve(self, r: np.ndarray) -> np.ndarray:
        return dense.sweep(self._a, r, self.omega, self.shift, Sweeps.FORWARD in self.kind, Sweeps.BACKWARD in self.kind, self.its, self.mode, Sweeps.ONE_SIDED in self.kind)

    def __str__(self) -> str:
        return f"SOR(omega={self.omega:g}, its={self.its}, lits={self.lits}, kind={self.kind.name}, shift={self.shift:g})"


class MultiColor(Preconditioner):
    """Gauss-Seidel colour after colour: rows of a colour don't touch each other, so each is one projection and one product."""

    name = "multicolor"

    def __init__(self, symmetric: bool = True):
        self.symmetric = symmetric

    def setup(self, a: Matrix) -> MultiColor:
        from ..graph import color_graph

        colors = cut(color_graph(a))
        self.n_colors = colors.agg(F.max("color")).first()[0] + 1
        inverse = a.df.where("i = j").selectExpr("i", "j", "1D / v v")
        self.masks = [Matrix(inverse.join(colors.where(F.col("color") == k).select("i"), "i", "left_semi"), a.nrows, a.ncols) for k in range(self.n_colors)]
        return self

    def apply(self, s, src: str, dst: str) -> None:
        order = list(range(self.n_colors))
        s.let(_z=[(0, src)], _r0=[(1, src)])
        for k in order + (order[-2::-1] if self.symmetric else []):
            key = f"color{k}-{id(self)}"
            if not s.has(key):
                s.add_matrix(key, self.masks[k])
            s.apply("A", "_z", "_az")
            s.let(_e=[(1, "_r0"), (-1, "_az")])
            s.apply(key, "_e", "_e")
            s.let(_z=[(1, "_z"), (1, "_e")])
        s.let(**{dst: [(1, "_z")]})
        s.drop("_z", "_r0", "_az", "_e")
