"""Algebraic multigrid: aggregation, prolongation, Galerkin products and V-cycles, all on coordinates.

The textbook way is smoothed aggregation; the parts are also there in the reference's form (mode="reference").
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import GREEDY_MOST
from ..operators import linalg as la
from ..plans.lineage import cut, cut_matrix
from ..types import Matrix, Unsupported
from .base import Preconditioner

#: Fixed value: diagonals up to here count as zero.
TINY = 1e-14
#: Coarsening stops at so many rows.
COARSE = 10


def anisotropy(a: Matrix) -> DataFrame:
    """(i, v): the largest off-diagonal over the diagonal, in size; 0 where the diagonal is."""
    d, o = F.max(F.when(F.col("i") == F.col("j"), F.abs("v"))), F.max(F.when(F.col("i") != F.col("j"), F.abs("v")))
    return a.df.groupBy("i").agg(d.alias("d"), o.alias("o")).select("i", F.when(F.coalesce("d", F.lit(0.0)) > TINY, F.coalesce("o", F.lit(0.0)) / F.col("d")).otherwise(0.0).alias("v"))


def adaptive_threshold(a: Matrix, base: float) -> float:
    mean = anisotropy(a).agg(F.sum("v")).first()[0] or 0.0
    return base * (1 + max(mean / max(a.nrows, 1), 0.5))


def strength(a: Matrix, threshold: float) -> Matrix:
    """|a_ij| / sqrt(|a_ii a_jj|) where it is above the threshold; no diagonal."""
    d = a.df.where("i = j").select("i", F.abs("v").alias("d"))
    s = a.df.where("i <> j").join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    return Matrix(s.select("i", "j", (F.abs("v") / F.sqrt(F.col("d") * F.col("e"))).alias("v")).where(F.col("v") > threshold), a.nrows, a.ncols)


def _aggregates(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, pick) -> list[int]:
    order = np.lexsort((j, i))
    start = np.searchsorted(i[order], np.arange(n + 1)).tolist()
    cells = list(zip(j[order].tolist(), v[order].tolist(), strict=True))
    agg = [-1] * n
    count = 0
    for k in range(n):
        if agg[k] < 0:
            for m in [k, *pick(cells[start[k] : start[k + 1]], agg)]:
                agg[m] = count
            count += 1
    return agg


def _in_order(s: Matrix, pick) -> DataFrame:
    """(i, agg) by a rule that goes through the nodes in index order, in one task."""
    n = s.nrows
    if n > GREEDY_MOST:
        raise Unsupported(f"{GREEDY_MOST} nodes at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["j"] >= 0]
        return pd.DataFrame({"i": range(n), "agg": _aggregates(*(pdf[c].to_numpy() for c in ("i", "j", "v")), n, pick)})

    seed = s.df.sparkSession.createDataFrame([(-1, -1, 0.0)], "i long, j long, v double")
    return s.df.select("i", "j", "v").unionByName(seed).withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "i long, agg long")


def _strongest(near, agg):
    best, out = 0.0, []
    for j, v in near:
        if agg[j] < 0 and v > best:
            best, out = v, [j]
    return out


def pairwise(s: Matrix) -> DataFrame:
    """(i, agg): each unvisited node with its strongest unvisited neighbour, the first of equals."""

    return _in_order(s, _strongest)


def greedy(s: Matrix) -> DataFrame:
    """(i, agg): each unvisited node with all its unvisited neighbours."""
    return _in_order(s, lambda near, agg: [j for j, _ in near if agg[j] < 0])


def coarse_graph(s: Matrix, agg: DataFrame, n: int) -> Matrix:
    """Strengths summed between different aggregates."""
    out = s.df.join(agg, "i").join(agg.selectExpr("i j", "agg b"), "j").where("agg <> b").groupBy("agg", "b").agg(F.sum("v").alias("v"))
    return Matrix(out.selectExpr("agg i", "b j", "v"), n, n)


def double_pairwise(s: Matrix) -> tuple[DataFrame, int]:
    """Pairs of pairs: (i, agg), and how many there are."""
    one = cut(pairwise(s))
    n = one.agg(F.max("agg")).first()[0] + 1
    two = pairwise(coarse_graph(s, one, n))
    both = cut(one.withColumnRenamed("agg", "p").join(two.selectExpr("i p", "agg"), "p").select("i", "agg"))
    return both, both.agg(F.max("agg")).first()[0] + 1


def prolongation(agg: DataFrame, nrows: int, ncols: int) -> Matrix:
    return Matrix(agg.selectExpr("i", "agg j", "1D v"), nrows, ncols)


def smooth_interpolation(p: Matrix, a: Matrix, weight: float = 2 / 3, mode: str = "textbook") -> Matrix:
    """(I - weight D^-1 A) P.  mode="reference": P - weight A entry by entry, where both have room."""
    if mode == "reference":
        left, right = p.df.selectExpr("i", "j", "v p"), a.df.where(f"i < {p.nrows} and j < {p.ncols}").selectExpr("i", "j", "v a")
        both = left.join(right, ["i", "j"], "full").select("i", "j", (F.coalesce("p", F.lit(0.0)) - F.lit(float(weight)) * F.coalesce("a", F.lit(0.0))).alias("v"))
        return Matrix(both, p.nrows, p.ncols)
    d = a.df.where("i = j and v <> 0").selectExpr("i", "1D / v d")
    scaled = Matrix(a.df.join(d, "i").selectExpr("i", "j", "v * d v"), a.nrows, a.ncols)
    return la.add(p, la.matmul(scaled, p), 1.0, -weight)


def minimize_energy(p: Matrix) -> Matrix:
    """Rows scaled to unit length."""
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("i")))
    return Matrix(p.df.withColumn("s", size).select("i", "j", F.when(F.col("s") > 0, F.col("v") / F.col("s")).otherwise(F.col("v")).alias("v")), p.nrows, p.ncols)


def galerkin(r: Matrix, a: Matrix, p: Matrix) -> Matrix:
    return la.matmul(la.matmul(r, a), p)


def smoother(s, level: str, r: str, z: str, omega: float) -> None:
    """z += omega D^-1 (r - A z)."""
    s.apply(f"{level}A", z, "_az")
    s.let(_e=[(1, r), (-1, "_az")])
    s.apply(f"{level}D", "_e", "_e")
    s.let(**{z: [(1, z), (omega, "_e")]})
    s.drop("_az", "_e")


@dataclass
class Cells:
    """A sparse matrix as arrays, each place once."""

    i: np.ndarray
    j: np.ndarray
    v: np.ndarray
    nrows: int
    ncols: int

    @staticmethod
    def summed(i: np.ndarray, j: np.ndarray, v: np.ndarray, nrows: int, ncols: int) -> Cells:
        key, where = np.unique(i * ncols + j, return_inverse=True)
        return Cells(key // ncols, key % ncols, np.bincount(where, v, len(key)), nrows, ncols)

    @staticmethod
    def of(a: Matrix) -> Cells:
        t = a.df.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).toArrow()  # ARRAY_CELLS at most
        return Cells.summed(*(t[c].to_numpy() for c in ("i", "j", "v")), a.nrows, a.ncols)

    def __matmul__(self, other: Cells) -> Cells:
        start = np.searchsorted(other.i, np.arange(other.nrows + 1))  # rows ascending
        n = (start[1:] - start[:-1])[self.j]
        at = np.repeat(start[:-1][self.j] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Cells.summed(np.repeat(self.i, n), other.j[at], np.repeat(self.v, n) * other.v[at], self.nrows, other.ncols)

    def turned(self) -> Cells:
        return Cells.summed(self.j, self.i, self.v, self.ncols, self.nrows)

    def diagonal(self) -> np.ndarray:
        own = self.i == self.j
        return np.bincount(self.i[own], self.v[own], self.nrows)

    def matrix(self, spark) -> Matrix:
        return Matrix(spark.createDataFrame(pa.table({"i": self.i, "j": self.j, "v": self.v})), self.nrows, self.ncols)


#: Entries up to which the levels are made in arrays on the driver; aggregation runs in one task at any rate.
ARRAY_CELLS = 20_000_000


def coarser(a: Cells, threshold: float, omega: float) -> tuple[Cells, Cells, Cells] | None:
    """Prolongation, its transpose and the coarse matrix, by the same steps as on DataFrames; None if nothing hangs together."""
    d = np.abs(a.diagonal())
    off = (a.i != a.j) & (d[a.i] > 0) & (d[a.j] > 0)
    i, j = a.i[off], a.j[off]
    v = np.abs(a.v[off]) / np.sqrt(d[i] * d[j])
    strong = v > threshold
    i, j, v = i[strong], j[strong], v[strong]
    one = np.array(_aggregates(i, j, v, a.nrows, _strongest), np.int64)
    n = int(one.max()) + 1
    apart = one[i] != one[j]
    graph = Cells.summed(one[i][apart], one[j][apart], v[apart], n, n)
    agg = np.array(_aggregates(graph.i, graph.j, graph.v, n, _strongest), np.int64)[one]
    n = int(agg.max()) + 1
    if n >= a.nrows:
        return None
    bare = Cells(np.arange(a.nrows), agg, np.ones(a.nrows), a.nrows, n)
    by = np.divide(1.0, a.diagonal(), out=np.zeros(a.nrows), where=a.diagonal() != 0)
    step = Cells(a.i, a.j, a.v * by[a.i], a.nrows, a.ncols) @ bare
    p = Cells.summed(np.r_[bare.i, step.i], np.r_[bare.j, step.j], np.r_[bare.v, -omega * step.v], a.nrows, n)
    r = p.turned()
    return p, r, r @ a @ p


@dataclass
class Level:
    a: Matrix | Cells
    p: Matrix | Cells | None = None
    r: Matrix | Cells | None = None


class Amg(Preconditioner):
    name = "amg"

    def __init__(self, max_levels: int = 10, threshold: float = 0.1, sweeps: int = 1, omega: float = 2 / 3, mode: str = "textbook"):
        self.max_levels, self.threshold, self.sweeps, self.omega, self.mode = max_levels, threshold, sweeps, omega, mode
        self.levels: list[Level] = []

    def setup(self, a: Matrix) -> Amg:
        arrays = self.mode != "reference" and a.nrows <= GREEDY_MOST and a.df.limit(ARRAY_CELLS + 1).count() <= ARRAY_CELLS
        self.levels = [Level(Cells.of(a) if arrays else cut_matrix(a))]
        while arrays and len(self.levels) < self.max_levels and (top := self.levels[-1]).a.nrows > COARSE:
            if (made := coarser(top.a, self.threshold * 0.5 ** (len(self.levels) - 1), self.omega)) is None:
                break
            top.p, top.r, below = made
            self.levels.append(Level(below))
        while not arrays and len(self.levels) < self.max_levels and (top := self.levels[-1]).a.nrows > COARSE:
            strong = strength(top.a, adaptive_threshold(top.a, self.threshold) if self.mode == "reference" else self.threshold * 0.5 ** (len(self.levels) - 1))
            agg, n = double_pairwise(strong)
            if n >= top.a.nrows:  # nothing hangs together any more
                break
            bare = prolongation(agg, top.a.nrows, n)
            if self.mode == "reference":
                p, r = minimize_energy(smooth_interpolation(bare, top.a, 0.5, "reference")), la.transpose(bare)
            else:
                p = smooth_interpolation(bare, top.a, self.omega)
                r = la.transpose(p)
            top.p, top.r = cut_matrix(p), cut_matrix(r)
            self.levels.append(Level(cut_matrix(galerkin(top.r, top.a, top.p))))
        last = self.levels[-1].a
        if last.nrows > 2000:
            raise Unsupported(f"coarsening stopped at {last.nrows} rows")
        t, dense = last if arrays else Cells.of(last), np.zeros((last.nrows, last.nrows))  # 2000 rows at most
        dense[t.i, t.j] = t.v
        i, j = np.indices(dense.shape).reshape(2, -1)
        inv = np.linalg.pinv(dense)
        self.bottom, self.spark = Cells(i, j, inv.ravel(), last.nrows, last.nrows), a.spark
        return self

    def _key(self, k: int) -> str:
        return f"amg{id(self)}-{k}-"

    def apply(self, s, src: str, dst: str) -> None:
        if not s.has(f"{self._key(0)}A"):
            for k, level in enumerate(self.levels):
                own = level.a if isinstance(level.a, Matrix) else Cells(*(x[(level.a.i == level.a.j) & (np.abs(level.a.v) > TINY)] for x in (level.a.i, level.a.j, level.a.v)), level.a.nrows, level.a.ncols)
                inverse = Matrix(own.df.where(f"i = j and abs(v) > {TINY}").selectExpr("i", "j", "1D / v v"), own.nrows, own.ncols) if isinstance(own, Matrix) else Cells(own.i, own.j, 1 / own.v, own.nrows, own.ncols)
                for name, m in (("A", level.a), ("D", inverse), ("P", level.p), ("R", level.r)):
                    if m is not None:
                        self._put(s, f"{self._key(k)}{name}", m)
            self._put(s, f"{self._key(len(self.levels))}B", self.bottom)
        s.let(_r0=[(1, src)])
        self._cycle(s, 0)
        s.let(**{dst: [(1, "_z0")]})
        s.drop("_r0", "_z0")

    def _put(self, s, key: str, m: Matrix | Cells) -> None:
        if isinstance(m, Matrix):
            s.add_matrix(key, m)
        elif hasattr(s, "add_cells") and not hasattr(s, "spark"):  # arrays only
            s.add_cells(key, m.i, m.j, m.v)
        else:
            s.add_matrix(key, m.matrix(self.spark))

    def _cycle(self, s, k: int) -> None:
        r, z, key = f"_r{k}", f"_z{k}", self._key(k)
        if k == len(self.levels) - 1:
            s.apply(f"{self._key(k + 1)}B", r, z)
            return
        s.apply(f"{key}D", r, z)  # the first sweep from zero
        s.let(**{z: [(self.omega, z)]})
        for _ in range(self.sweeps - 1):
            smoother(s, key, r, z, self.omega)
        s.apply(f"{key}A", z, "_t")
        s.let(_t=[(1, r), (-1, "_t")])
        s.apply(f"{key}R", "_t", f"_r{k + 1}")
        self._cycle(s, k + 1)
        s.apply(f"{key}P", f"_z{k + 1}", "_t")
        s.let(**{z: [(1, z), (1, "_t")]})
        s.drop("_t", f"_r{k + 1}", f"_z{k + 1}")
        for _ in range(self.sweeps):
            smoother(s, key, r, z, self.omega)
