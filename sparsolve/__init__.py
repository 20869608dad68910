"""Linear systems on Spark: matrices and vectors as DataFrames, Krylov and direct solvers, preconditioners, sessions."""

from .plans.session import PC, SolverKind, SolverSession, Tier, solve_many
from .solvers.direct import DirectLU, DirectQR
from .types import (
    Convergence, FactorError, IndefiniteMatrix, IndefinitePreconditioner, Matrix, NotFactored, ShapeError, SolveError, SolveResult, SolveStats, SparsolveError, Unsupported, Vector, ZeroPivot,
)

__all__ = [
    "PC", "Convergence", "DirectLU", "DirectQR", "FactorError", "IndefiniteMatrix", "IndefinitePreconditioner", "Matrix", "NotFactored", "ShapeError", "SolveError", "SolveResult", "SolveStats",
    "SolverKind", "SolverSession", "SparsolveError", "Tier", "Unsupported", "Vector", "ZeroPivot", "solve_many",
]
