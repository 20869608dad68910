"""What a preconditioner is."""

from __future__ import annotations

import numpy as np

from ..types import Matrix, Unsupported


class Preconditioner:
    name = "preconditioner"

    def setup(self, a: Matrix) -> Preconditioner:
        return self

    def apply(self, s, src: str, dst: str) -> None:
        raise NotImplementedError


class Identity(Preconditioner):
    name = "none"

    def apply(self, s, src: str, dst: str) -> None:
        if src != dst:
            s.let(**{dst: [(1, src)]})


class MatrixPreconditioner(Preconditioner):
    """One whose inverse is a sparse matrix: applied as a product, in every space."""

    inverse: Matrix | None = None

    def apply(self, s, src: str, dst: str) -> None:
        key = f"{self.name}-{id(self)}"
        if not s.has(key):
            if self.inverse is None:
                raise Unsupported("setup() comes first")
            s.add_matrix(key, self.inverse)
        s.apply(key, src, dst)


class ArrayPreconditioner(Preconditioner):
    """One that works through the rows in order: for vectors that are arrays only."""

    def solve(self, r: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def prepare(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> None:
        raise NotImplementedError

    ready = False

    def setup(self, a: Matrix) -> Preconditioner:
        t = a.df.select("i", "j", "v").toArrow()
        self.prepare(*(t[c].to_numpy() for c in ("i", "j", "v")), a.nrows)
        self.ready = True
        return self

    def apply(self, s, src: str, dst: str) -> None:
        if not hasattr(s, "v"):
            raise Unsupported(f"{self.name} goes through the rows one after the other; in a frame take block-wise or explicit preconditioners")
        if not self.ready:
            self.prepare(*s.cells("A"), s.n)
            self.ready = True
        s.v[dst] = self.solve(s.v[src])
