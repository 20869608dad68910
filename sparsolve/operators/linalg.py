"""The primitives on coordinate DataFrames.  Products are equi-joins with a partial and a final sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Matrix, ShapeError, Vector


def _fit(ok: bool, what: str) -> None:
    if not ok:
        raise ShapeError(what)


def matvec(a: Matrix, x: Vector) -> Vector:
    """y = A x, with a row for each index, also where A has none."""
    _fit(a.ncols == x.n, f"{a.ncols} columns and {x.n} values")
    part = a.df.join(x.df.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return Vector(Vector(part, a.nrows).dense(), a.nrows)


def matvec_t(a: Matrix, x: Vector) -> Vector:
    """y = A' x."""
    return matvec(transpose(a), x)


def residual(a: Matrix, x: Vector, b: Vector) -> Vector:
    """b - A x."""
    y = matvec(a, x)
    _fit(b.n == y.n, f"{b.n} and {y.n} values")
    return combine({"x": y, "b": b}, F.col("b") - F.col("x"))


def combine(vectors: dict[str, Vector], expression: Column) -> Vector:
    """An expression of vectors, index by index."""
    n = {v.n for v in vectors.values()}
    _fit(len(n) == 1, f"lengths {sorted(n)}")
    out = None
    for name, v in vectors.items():
        own = v.df.select("i", F.col("v").alias(name))
        out = own if out is None else out.join(own, "i", "full")
    filled = out.select("i", *(F.coalesce(name, F.lit(0.0)).alias(name) for name in vectors))
    return Vector(filled.select("i", expression.cast("double").alias("v")), n.pop())


def axpy(alpha: float, x: Vector, y: Vector) -> Vector:
    """y + alpha x."""
    return combine({"x": x, "y": y}, F.col("y") + F.lit(float(alpha)) * F.col("x"))


def dot(x: Vector, y: Vector) -> float:
    _fit(x.n == y.n, f"{x.n} and {y.n} values")
    return x.df.join(y.df.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def norm(x: Vector) -> float:
    return x.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0


def transpose(a: Matrix) -> Matrix:
    return Matrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.ncols, a.nrows)


def element(a: Matrix, i: int, j: int) -> float:
    _fit(0 <= i < a.nrows and 0 <= j < a.ncols, f"({i}, {j}) of {a.nrows} x {a.ncols}")
    return a.df.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]


def shape(df: DataFrame) -> tuple[int, int]:
    """The shape of coordinates of which it isn't known."""
    r = df.agg(F.max("i"), F.max("j")).first()
    return (r[0] if r[0] is not None else -1) + 1, (r[1] if r[1] is not None else -1) + 1


def submatrix(a: Matrix, index: DataFrame, n: int, zeros: bool = False) -> Matrix:
    """A[index, index], renumbered by (i, pos) of `index`; explicit zeros are kept only if asked for."""
    out = a.df.join(index.select("i", F.col("pos").cast("long").alias("p")), "i").join(index.select(F.col("i").alias("j"), F.col("pos").cast("long").alias("q")), "j")
    return Matrix((out if zeros else out.where("v <> 0")).selectExpr("p i", "q j", "v"), n, n)


def diagonal(a: Matrix) -> Vector:
    return Vector(a.df.where("i = j").select("i", "v"), min(a.nrows, a.ncols))


def matmul(a: Matrix, b: Matrix) -> Matrix:
    _fit(a.ncols == b.nrows, f"{a.ncols} columns and {b.nrows} rows")
    left, right = a.df.selectExpr("i", "j k", "v"), b.df.selectExpr("i k", "j", "v w")
    return Matrix(left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v")), a.nrows, b.ncols)


def gram(a: Matrix) -> Matrix:
    """A' A."""
    return matmul(transpose(a), a)


def csr_rows(a: Matrix) -> DataFrame:
    """(i, cols, vals), columns ascending, rows without entries left out."""
    cells = F.array_sort(F.collect_list(F.struct("j", "v")))
    return a.df.groupBy("i").agg(cells.alias("c")).select("i", F.col("c.j").alias("cols"), F.col("c.v").alias("vals"))


def row_pattern(a: Matrix) -> DataFrame:
    return a.df.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("cols"))


def add(a: Matrix, b: Matrix, alpha: float = 1.0, beta: float = 1.0) -> Matrix:
    _fit((a.nrows, a.ncols) == (b.nrows, b.ncols), "shapes differ")
    both = a.df.select("i", "j", (F.col("v") * F.lit(float(alpha))).alias("v")).unionByName(b.df.select("i", "j", (F.col("v") * F.lit(float(beta))).alias("v")))
    return Matrix(both.groupBy("i", "j").agg(F.sum("v").alias("v")), a.nrows, a.ncols)
