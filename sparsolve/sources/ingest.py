"""Matrices from arrays: dense in column order, compressed rows, and identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Matrix, ShapeError


def dense_frame(raw: DataFrame) -> DataFrame:
    """(nrows, ncols, data array in column order) as coordinates, zeros left out."""
    return raw.select("nrows", F.posexplode("data").alias("p", "v")).where("v <> 0").selectExpr("cast(p % nrows as long) i", "cast(p div nrows as long) j", "cast(v as double) v")


def from_dense(spark: SparkSession, nrows: int, ncols: int, data: Sequence[float]) -> Matrix:
    if len(data) != nrows * ncols:
        raise ShapeError(f"{nrows} x {ncols} needs {nrows * ncols} values, not {len(data)}")
    raw = spark.createDataFrame([(nrows, ncols, [float(x) for x in data])], "nrows long, ncols long, data array<double>")
    return Matrix(dense_frame(raw), nrows, ncols)


def csr_frame(raw: DataFrame) -> DataFrame:
    """(row_ptr, col_idx, vals) arrays as coordinates."""
    rows = raw.select("col_idx", "vals", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("row_ptr") - 2), lambda k: F.struct(F.element_at("row_ptr", k + 1).alias("a"), F.element_at("row_ptr", k + 2).alias("b")))).alias("i", "r"))
    cells = rows.where("r.b > r.a").select("i", "col_idx", "vals", F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("p"))
    return cells.select(F.col("i").cast("long"), F.element_at("col_idx", F.col("p").cast("int") + 1).cast("long").alias("j"), F.element_at("vals", F.col("p").cast("int") + 1).cast("double").alias("v"))


def from_csr(spark: SparkSession, nrows: int, ncols: int, row_ptr: Sequence[int], col_idx: Sequence[int], vals: Sequence[float]) -> Matrix:
    """Checked: one pointer more than rows, from 0 upwards to the number of values, columns in range."""
    if len(row_ptr) != nrows + 1 or row_ptr[0] != 0 or row_ptr[-1] != len(vals) or len(col_idx) != len(vals):
        raise ShapeError("row pointers, columns and values don't fit together")
    if any(a > b for a, b in zip(row_ptr, row_ptr[1:], strict=False)) or any(not 0 <= c < ncols for c in col_idx):
        raise ShapeError("row pointers fall, or a column is out of range")
    raw = spark.createDataFrame([(list(row_ptr), list(col_idx), [float(x) for x in vals])], "row_ptr array<long>, col_idx array<long>, vals array<double>")
    return Matrix(csr_frame(raw), nrows, ncols)


def identity(spark: SparkSession, n: int) -> Matrix:
    return Matrix(spark.range(n).selectExpr("id i", "id j", "1D v"), n, n)


def tridiagonal(spark: SparkSession, n: int, lower: float, diagonal: float | str, upper: float) -> Matrix:
    """diagonal may be SQL over i, such as "if(i % 2 = 0, 4D, -4D)"."""
    d = diagonal if isinstance(diagonal, str) else f"{diagonal!r}D"
    cells = f"inline(array(struct(id i, id j, {d.replace('i %', 'id %')} v), struct(id i, id - 1 j, {lower!r}D v), struct(id i, id + 1 j, {upper!r}D v)))"
    return Matrix(spark.range(n).selectExpr(cells).where(f"j >= 0 and j < {n}"), n, n)
