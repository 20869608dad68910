"""Matrices and vectors as DataFrames, results, stopping rules and errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SparsolveError(Exception):
    """The root of this engine's errors."""


class ShapeError(SparsolveError):
    """Shapes don't fit together."""


class FactorError(SparsolveError):
    """A factorisation met a singular matrix."""


class NotFactored(SparsolveError):
    """Cached factors were asked for before there were any."""


class SolveError(SparsolveError):
    """A solve couldn't go on."""


class IndefiniteMatrix(SparsolveError):
    """A matrix that should be positive definite isn't."""


class IndefinitePreconditioner(SparsolveError):
    """A preconditioner that should be positive definite isn't."""


class ZeroPivot(SparsolveError):
    def __init__(self, row: int):
        super().__init__(f"zero pivot in row {row}")
        self.row = row


class Unsupported(SparsolveError):
    """The combination isn't offered."""


@dataclass(frozen=True)
class Matrix:
    """Coordinates (i long, j long, v double), unique (i, j), absent entries zero; the shape is metadata, never counted in a loop."""

    df: DataFrame
    nrows: int
    ncols: int

    @classmethod
    def of(cls, df: DataFrame, nrows: int, ncols: int | None = None, i: str = "i", j: str = "j", v: str = "v") -> Matrix:
        return cls(df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).cast("double").alias("v")), nrows, nrows if ncols is None else ncols)

    @classmethod
    def sql(cls, spark: SparkSession, text: str, nrows: int, ncols: int | None = None, **tables: DataFrame) -> Matrix:
        """The matrix that a query gives, as columns i, j, v; {names} in the text stand for the tables."""
        return cls.of(spark.sql(text, **tables), nrows, ncols)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession


@dataclass(frozen=True)
class Vector:
    """(i long, v double); indices that are absent are zero."""

    df: DataFrame
    n: int

    @classmethod
    def of(cls, df: DataFrame, n: int, i: str = "i", v: str = "v") -> Vector:
        return cls(df.select(F.col(i).cast("long").alias("i"), F.col(v).cast("double").alias("v")), n)

    @classmethod
    def local(cls, spark: SparkSession, values) -> Vector:
        return cls(spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "i long, v double"), len(values))

    def dense(self) -> DataFrame:
        """A row for each index."""
        return self.df.sparkSession.range(self.n).withColumnRenamed("id", "i").join(self.df, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


@dataclass
class SolveStats:
    iterations: int
    final_residual: float
    converged: bool


@dataclass
class SolveResult:
    x: Vector
    stats: SolveStats
    history: list[tuple[int, float]] = field(default_factory=list)

    def clear_history(self) -> None:
        self.history.clear()

    def history_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "iter int, residual double")

    def stats_df(self, spark: SparkSession) -> DataFrame:
        s = self.stats
        return spark.createDataFrame([(s.iterations, s.final_residual, s.converged)], "iterations int, final_residual double, converged boolean")


@dataclass(frozen=True)
class Convergence:
    """Stops at `tol` (relative to the first residual, or absolute), or after `max_iters`.

    mode="reference": running out of iterations counts as convergence, and a zero first residual gives no number."""

    tol: float = 1e-10
    max_iters: int = 1000
    absolute: bool = False
    mode: str = "textbook"

    def met(self, residual: float, first: float) -> bool:
        return residual <= self.tol * (1.0 if self.absolute else first)

    def check(self, residual: float, first: float, iteration: int) -> tuple[bool, SolveStats]:
        """Whether to stop, and the state of affairs."""
        done = self.met(residual, first)
        out = iteration >= self.max_iters
        return done or out, SolveStats(iteration, residual, done or (out and self.mode == "reference"))


Monitor = Callable[[int, float], None]
