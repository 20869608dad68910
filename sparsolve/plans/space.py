"""Vector spaces that Krylov methods are written against.

FrameSpace: all vectors of a solve are columns of one DataFrame keyed by i, so updates are projections and all dot
products of a step are one aggregate; only products with matrices join.  BroadcastSpace: matrices stay distributed, vectors
(of a checked length) are arrays on the driver.  LocalSpace: arrays only, also inside a grouped map.
Rectangular matrices live in the square of the longer side, filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Matrix, ShapeError, Unsupported, Vector
from .lineage import ensure_folder

#: Longest vector that BroadcastSpace sends to all executors (40 MB).
BROADCAST_MOST = 5_000_000
Terms = list[tuple[float, str]]


class Space(Protocol):
    n: int

    def let(self, **vectors: Terms) -> None: ...
    def apply(self, matrix: str, src: str, dst: str, transpose: bool = False) -> None: ...
    def dots(self, *pairs: tuple[str, str]) -> tuple[float, ...]: ...
    def drop(self, *names: str) -> None: ...
    def has(self, matrix: str) -> bool: ...
    def add_matrix(self, name: str, a: Matrix) -> None: ...


class FrameSpace:
    def __init__(self, spark: SparkSession, n: int, parts: int | None = None):
        self.spark, self.n = spark, n
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ensure_folder(spark)
        self.state = spark.range(0, n).withColumnRenamed("id", "i").repartition(self.parts, "i")
        self.names: set[str] = set()
        self._by: dict[tuple[str, bool], DataFrame] = {}
        self._free: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add_matrix(self, name: str, a: Matrix) -> None:
        if max(a.nrows, a.ncols) > self.n:
            raise ShapeError(f"{a.nrows} x {a.ncols} in a space of {self.n}")
        self._by[name, False] = a.df.repartition(self.parts, "j").persist()

    def add_operator(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        """A matrix-free operator: (i, v) to (i, v), absent indices zero."""
        self._free[name] = f

    def has(self, matrix: str) -> bool:
        return (matrix, False) in self._by or matrix in self._free

    def _matrix(self, name: str, transpose: bool) -> DataFrame:
        if (name, transpose) not in self._by:
            self._by[name, True] = self._by[name, False].select(F.col("j").alias("i"), F.col("i").alias("j"), "v").repartition(self.parts, "j").persist()
        return self._by[name, transpose]

    def load(self, **vectors: Vector) -> None:
        for name, v in vectors.items():
            own = v.df.select("i", F.col("v").alias(name))
            self.state = self.state.drop(name).join(own, "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
            self.names.add(name)
        self.cut()

    def let(self, **vectors: Terms) -> None:
        new = {}
        for name, terms in vectors.items():
            total = F.lit(0.0)
            for k, (c, src) in enumerate(terms):
                term = F.col(src) if c == 1 else F.lit(float(c)) * F.col(src)
                total = total + term if k else term
            new[name] = total
        self.state = self.state.select("i", *(c for c in sorted(self.names - new.keys())), *(e.alias(c) for c, e in new.items()))
        self.names |= new.keys()

    def apply(self, matrix: str, src: str, dst: str, transpose: bool = False) -> None:
        """dst = matrix * src: one join and one exchange of partial sums; the state keeps its partitioning."""
        if matrix in self._free:
            if transpose:
                raise Unsupported("a matrix-free operator has no transpose")
            y = self._free[matrix](self.state.select("i", F.col(src).alias("v"))).select("i", F.col("v").alias("_y"))
        else:
            x = self.state.select(F.col("i").alias("j"), F.col(src).alias("_x"))
            y = self._matrix(matrix, transpose).join(x.hint("merge"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("_y"))
        kept = sorted(self.names - {dst})
        self.state = self.state.join(y.hint("merge"), "i", "left").select("i", *kept, F.coalesce("_y", F.lit(0.0)).alias(dst))
        self.names.add(dst)
        self.cut()

    def times(self, src: str, factors: Vector, dst: str) -> None:
        self.load(_f=factors)
        self.state = self.state.select("i", *sorted(self.names - {dst, "_f"}), (F.col(src) * F.col("_f")).alias(dst))
        self.names = (self.names | {dst}) - {"_f"}

    def dots(self, *pairs: tuple[str, str]) -> tuple[float, ...]:
        got = self.state.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"_{k}") for k, (a, b) in enumerate(pairs))).first()
        return tuple(float(x or 0.0) for x in got)

    def cut(self) -> None:
        """Ends the lineage in the shared checkpoint folder."""
        self.state = self.state.checkpoint()

    def drop(self, *names: str) -> None:
        self.names -= set(names)
        self.state = self.state.select("i", *sorted(self.names))

    def vector(self, name: str, n: int | None = None) -> Vector:
        n = self.n if n is None else n
        return Vector(self.state.where(F.col("i") < n).select("i", F.col(name).alias("v")), n)

    def close(self) -> None:
        for df in self._by.values():
            df.unpersist()


class LocalSpace:
    def __init__(self, n: int):
        self.n, self.v = n, {}
        self._cells: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._free: dict[str, Callable[[np.ndarray], np.ndarray]] = {}

    def add_operator(self, name: str, f: Callable[[np.ndarray], np.ndarray]) -> None:
        """A matrix-free operator."""
        self._free[name] = f

    def add_cells(self, name: str, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
        self._cells[name] = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(v, float)

    def add_matrix(self, name: str, a: Matrix) -> None:
        t = a.df.select("i", "j", "v").toArrow()
        self.add_cells(name, *(t[c].to_numpy() for c in ("i", "j", "v")))

    def cells(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._cells[name]

    def has(self, matrix: str) -> bool:
        return matrix in self._cells or matrix in self._free

    def load(self, **vectors) -> None:
        for name, x in vectors.items():
            full = np.zeros(self.n)
            if isinstance(x, Vector):
                t = x.df.toArrow()
                full[t["i"].to_numpy()] = t["v"].to_numpy()
            else:
                full[: len(x)] = x
            self.v[name] = full

    def let(self, **vectors: Terms) -> None:
        new = {name: sum((c * self.v[src] for c, src in terms), np.zeros(self.n)) for name, terms in vectors.items()}
        self.v |= new

    def apply(self, matrix: str, src: str, dst: str, transpose: bool = False) -> None:
        if matrix in self._free:
            if transpose:
                raise Unsupported("a matrix-free operator has no transpose")
            self.v[dst] = self._free[matrix](self.v[src])
            return
        i, j, v = self._cells[matrix]
        i, j = (j, i) if transpose else (i, j)
        self.v[dst] = np.bincount(i, v * self.v[src][j], self.n) if len(v) else np.zeros(self.n)

    def times(self, src: str, factors, dst: str) -> None:
        self.load(_f=factors)
        self.v[dst] = self.v[src] * self.v.pop("_f")

    def dots(self, *pairs: tuple[str, str]) -> tuple[float, ...]:
        return tuple(float(self.v[a] @ self.v[b]) for a, b in pairs)

    def drop(self, *names: str) -> None:
        for name in names:
            self.v.pop(name, None)

    def close(self) -> None: ...


#: Entries of a packed array of cells, and its columns.
PACK = 1 << 18
_CELL = (("i", np.int64), ("j", np.int64), ("v", np.float64))


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed cells as the transpose's cells."""
    for b in batches:
        for i, j, v in zip(*(b.column(c).to_pylist() for c, _ in _CELL), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, d)) for c, d in ((j, np.int64), (i, np.int64), (v, np.float64))], ["i", "j", "v"])


class BroadcastSpace(LocalSpace):
    def __init__(self, spark: SparkSession, n: int):
        if n > BROADCAST_MOST:
            raise ShapeError(f"vectors of {n} values aren't broadcast; {BROADCAST_MOST} at most")
        super().__init__(n)
        self.spark, self._by = spark, {}

    def add_matrix(self, name: str, a: Matrix) -> None:
        self._by[name, False] = self._packed(a.df)

    def _packed(self, cells: DataFrame) -> DataFrame:
        """Cells dealt by i, sorted, as arrays of PACK entries at most: a product then makes no rows of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[b.column(c).to_numpy() for c in ("i", "j", "v")] for b in batches]
            if held:
                i, j, v = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.argsort(i, kind="stable")
                for k in range(0, len(order), PACK):
                    own = order[k : k + PACK]
                    yield pa.RecordBatch.from_arrays([pa.array([c[own].tobytes()], pa.binary()) for c in (i, j, v)], ["i", "j", "v"])

        parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # said, so that small ones aren't put together
        typed = cells.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
        return typed.repartition(parts, "i").mapInArrow(run, "i binary, j binary, v binary").persist()

    def has(self, matrix: str) -> bool:
        return (matrix, False) in self._by or matrix in self._free

    def cells(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self._by[name, False].toArrow()
        return tuple(np.frombuffer(b"".join(t[c].to_pylist()), d) for c, d in _CELL)

    def apply(self, matrix: str, src: str, dst: str, transpose: bool = False) -> None:
        if matrix in self._free:
            super().apply(matrix, src, dst, transpose)
            return
        if (matrix, transpose) not in self._by:
            self._by[matrix, True] = self._packed(self._by[matrix, False].mapInArrow(_turned, "i long, j long, v double"))
        sent, n = self.spark.sparkContext.broadcast(self.v[src]), self.n  # n <= BROADCAST_MOST

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            seen, total = np.zeros(n, bool), np.zeros(n)
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c, _ in _CELL), strict=True):
                    i, j, v = (np.frombuffer(c, d) for c, (_, d) in zip(row, _CELL, strict=True))
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    seen[i[first]] = True
                    total[i[first]] += np.add.reduceat(v * x[j], first)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

        t = self._by[matrix, transpose].mapInArrow(run, "i long, v double").toArrow()  # each index once, as rows are dealt by i
        y = np.zeros(self.n)
        y[t["i"].to_numpy()] = t["v"].to_numpy()
        self.v[dst] = y
        sent.unpersist()

    def vector(self, name: str, n: int | None = None) -> Vector:
        n = self.n if n is None else n
        values = self.v[name][:n]
        return Vector(self.spark.createDataFrame(pa.table({"i": np.arange(n), "v": values})), n)

    def close(self) -> None:
        for df in self._by.values():
            df.unpersist()
