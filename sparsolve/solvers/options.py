"""Choices that solvers offer."""

from __future__ import annotations

from enum import StrEnum


class NormType(StrEnum):
    PRECONDITIONED = "preconditioned"
    UNPRECONDITIONED = "unpreconditioned"
    NATURAL = "natural"
    NONE = "none"


class Side(StrEnum):
    NONE = "none"
    LEFT = "left"
    RIGHT = "right"


class Orthogonalization(StrEnum):
    CLASSICAL = "classical"
    MODIFIED = "modified"
    TWICE = "twice"
