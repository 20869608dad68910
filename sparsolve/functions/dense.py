"""Givens rotations, triangular solves and incomplete factorisations in NumPy."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np

from ..types import FactorError, SolveError, ZeroPivot


class Givens:
    """The least-squares problem of an Arnoldi process, one column at a time."""

    def __init__(self, m: int, beta: float):
        self.r, self.g = np.zeros((m + 1, m)), np.zeros(m + 1)
        self.c, self.s, self.g[0], self.k = np.zeros(m), np.zeros(m), beta, 0

    def add(self, h: np.ndarray) -> float:
        """Takes a Hessenberg column (k + 2 values); gives the residual norm."""
        k, h = self.k, h.astype(float).copy()
        for j in range(k):
            h[j], h[j + 1] = self.c[j] * h[j] + self.s[j] * h[j + 1], -self.s[j] * h[j] + self.c[j] * h[j + 1]
        d = np.hypot(h[k], h[k + 1])
        self.c[k], self.s[k] = (h[k] / d, h[k + 1] / d) if d else (1.0, 0.0)
        h[k], h[k + 1] = d, 0.0
        self.r[: k + 2, k] = h
        self.g[k], self.g[k + 1] = self.c[k] * self.g[k], -self.s[k] * self.g[k]
        self.k += 1
        return abs(self.g[k + 1])

    def solution(self) -> np.ndarray:
        return back_substitute(self.r[: self.k, : self.k], self.g[: self.k])


def back_substitute(r: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Upper triangular solve; a zero pivot gives a zero."""
    y = np.zeros(len(g))
    for k in range(len(g) - 1, -1, -1):
        y[k] = (g[k] - r[k, k + 1 :] @ y[k + 1 :]) / r[k, k] if r[k, k] else 0.0
    return y


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[0] != a.shape[1] or np.linalg.matrix_rank(a) < len(a):
        raise FactorError("singular")
    return np.linalg.solve(a, b)


def lu_factor(a: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """L (unit diagonal, below) and U of A's rows in the order that partial pivoting gives; by blocks of columns."""
    n, m = len(a), np.array(a, float)
    if m.shape != (n, n):
        raise FactorError("not square")
    order, small = np.arange(n), n * np.finfo(float).eps * np.abs(m).max(initial=0.0)
    for start in range(0, n, width):
        end = min(start + width, n)
        for k in range(start, end):
            p = k + int(np.abs(m[k:, k]).argmax())
            if abs(m[p, k]) <= small:
                raise FactorError("singular")
            if p != k:
                m[[k, p]], order[[k, p]] = m[[p, k]], order[[p, k]]
            m[k + 1 :, k] /= m[k, k]
            m[k + 1 :, k + 1 : end] -= np.outer(m[k + 1 :, k], m[k, k + 1 : end])
        for k in range(start, end):  # the block's rows of U
            m[k + 1 : end, end:] -= np.outer(m[k + 1 : end, k], m[k, end:])
        m[end:, end:] -= m[end:, start:end] @ m[start:end, end:]
    return m, order


def lu_apply(factors: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    m, order = factors
    x = np.asarray(b, float)[order]
    for k in range(1, len(x)):
        x[k] -= m[k, :k] @ x[:k]
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] - m[k, k + 1 :] @ x[k + 1 :]) / m[k, k]
    return x


def qr_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares by QR."""
    q, r = np.linalg.qr(a)
    if np.abs(np.diag(r)).min(initial=np.inf) <= 1e-14 * max(1.0, np.abs(r).max(initial=0.0)):
        raise FactorError("rank-deficient")
    return back_substitute(r, q.T @ b)


Rows = list[dict[int, float]]


def rows_of(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> Rows:
    out: Rows = [{} for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), v.tolist(), strict=True):
        out[a][b] = out[a].get(b, 0.0) + x
    return out


class Packed(Sequence):
    """Sparse rows one after another in three arrays, columns ascending; a row that is read comes as a dict."""

    def __init__(self) -> None:
        self.start, self.at, self.x = array("q", [0]), array("q"), array("d")

    @staticmethod
    def of(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> Packed:
        """Entries of one place add up."""
        out = Packed()
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)])
        out.start = array("q", np.searchsorted(i[first], np.arange(n + 1)).astype(np.int64).tobytes())
        out.at = array("q", j[first].astype(np.int64).tobytes())
        out.x = array("d", (np.add.reduceat(v.astype(float), first) if len(v) else v.astype(float)).tobytes())
        return out

    @staticmethod
    def from_rows(rows: Sequence[dict[int, float]]) -> Packed:
        if isinstance(rows, Packed):
            return rows
        out = Packed()
        for row in rows:
            out.append(row)
        return out

    def append(self, row: dict[int, float]) -> None:
        at = sorted(row)
        self.at.extend(at)
        self.x.extend([row[k] for k in at])
        self.start.append(len(self.at))

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, n: int) -> dict[int, float]:
        a, b = self.start[n], self.start[n + 1]  # past the last row: IndexError
        return dict(zip(self.at[a:b], self.x[a:b]))  # noqa: B905


#: Rows of so many entries on average are gone through entry by entry, longer ones by dot products.
SHORT_ROWS = 8


class Factors:
    """Unit lower and upper triangular sparse rows; `unit_upper` takes the upper diagonal as one, `skip` leaves out missing pivots."""

    def __init__(self, lower: Sequence[dict[int, float]], upper: Sequence[dict[int, float]], unit_upper: bool = False, skip: bool = False):
        self.lower, upper = Packed.from_rows(lower), Packed.from_rows(upper)
        n = len(upper)
        start, at, x = (np.asarray(c) for c in (upper.start, upper.at, upper.x))
        row = np.repeat(np.arange(n), np.diff(start))
        self.pivot = np.ones(n) if unit_upper else np.zeros(n)
        if not unit_upper:
            self.pivot[row[at == row]] = x[at == row]
        beyond = at > row
        self.upper = Packed.of(row[beyond], at[beyond], x[beyond], n)
        if skip:
            self.pivot[self.pivot == 0] = 1.0
        elif (self.pivot == 0).any():
            raise ZeroPivot(int(np.flatnonzero(self.pivot == 0)[0]))

    def solve(self, r: np.ndarray) -> np.ndarray:
        if len(self.lower.at) + len(self.upper.at) > 2 * SHORT_ROWS * len(r):
            return self._solve_long(r)
        z, pivot = r.astype(float).tolist(), self.pivot.tolist()
        start, at, x = self.lower.start, self.lower.at, self.lower.x
        a = 0
        for n, b in enumerate(start[1:]):
            while a < b:
                z[n] -= x[a] * z[at[a]]
                a += 1
        start, at, x = self.upper.start, self.upper.at, self.upper.x
        b = len(at)
        for n in range(len(z) - 1, -1, -1):
            a, total = start[n], z[n]
            while b > a:
                b -= 1
                total -= x[b] * z[at[b]]
            z[n] = total / pivot[n]
        return np.array(z)

    def _solve_long(self, r: np.ndarray) -> np.ndarray:
        z = r.astype(float).copy()
        start, at, x = (np.asarray(c) for c in (self.lower.start, self.lower.at, self.lower.x))
        for n in range(len(z)):
            z[n] -= x[start[n] : start[n + 1]] @ z[at[start[n] : start[n + 1]]]
        start, at, x = (np.asarray(c) for c in (self.upper.start, self.upper.at, self.upper.x))
        for n in range(len(z) - 1, -1, -1):
            z[n] = (z[n] - x[start[n] : start[n + 1]] @ z[at[start[n] : start[n + 1]]]) / self.pivot[n]
        return z


def ilu0(a: Sequence[dict[int, float]], mode: str = "textbook") -> Factors:
    """ILU(0).  mode="reference": L = I + strict_tril(A) / D, U = triu(A), solved with a unit diagonal."""
    if mode == "reference":
        lower, upper = _split_reference(a)
        return Factors(lower, upper, unit_upper=True)
    return ilup(a, 0)


def _split_reference(a: Sequence[dict[int, float]]) -> tuple[Rows, Rows]:
    for n, row in enumerate(a):
        if not row.get(n) and any(n in a[m] for m in range(n + 1, len(a))):
            raise ZeroPivot(n)
    return [{j: v / a[j][j] for j, v in row.items() if j < n} for n, row in enumerate(a)], [{j: v for j, v in row.items() if j >= n} for n, row in enumerate(a)]


def ilup(a: Sequence[dict[int, float]], fill: int, mode: str = "textbook") -> Factors:
    """ILU with level of fill: first the places, then the values, in row order (i, k, j).  mode="reference" at fill 0: no elimination at all.

    All that a kept entry gets counts, also from pairs whose level alone would be over `fill`."""
    if mode == "reference" and fill == 0:
        return Factors(*_split_reference(a), skip=True)
    own = Packed.from_rows(a)
    n = len(own)
    row, at, x = np.repeat(np.arange(n), np.diff(np.asarray(own.start))), np.asarray(own.at), np.asarray(own.x)
    key = row * n + at
    if fill:
        key, place = _filled_in(key, n, fill)
        full = np.zeros(len(key))
        full[place] = x
        row, at, x = key // max(n, 1), key % max(n, 1), full
    start = np.searchsorted(row, np.arange(n + 1))
    beyond = np.searchsorted(key, np.arange(n) * (n + 1), "right")  # where a row's entries right of the diagonal begin
    there = np.zeros(n, bool)
    there[row[row == at]] = True
    pivot, low = np.where(there, beyond - 1, -1).tolist(), np.flatnonzero(at < row)
    held = x.tolist()
    for some in _spans_of((start[1:] - beyond)[at[low]], row[low]):
        e = low[some]
        p, q = _pairs(e, beyond[at[e]], start[at[e] + 1])
        goal = row[p] * n + at[q]
        t = np.minimum(np.searchsorted(key, goal), len(key) - 1)
        hit = key[t] == goal
        q, t = q[hit].tolist(), t[hit].tolist()
        done = 0
        for e, k, end in zip(e.tolist(), at[e].tolist(), np.searchsorted(p[hit], e, "right").tolist(), strict=True):
            if pivot[k] < 0 or held[pivot[k]] == 0:
                raise SolveError(f"zero pivot in row {k}")
            f = held[e] = held[e] / held[pivot[k]]
            while done < end:
                held[t[done]] -= f * held[q[done]]
                done += 1
    x, right = np.array(held, float), at >= row
    return Factors(*(Packed.of(row[c], at[c], x[c], n) for c in (~right, right)))


#: Pairs of entries that an elimination holds at once, or those of one row.
PAIRS = 1 << 20


def _spans_of(n: np.ndarray, row: np.ndarray) -> Iterator[slice]:
    """Slices of entries, rows whole (ascending), with about PAIRS pairs, of which each entry makes n."""
    total = np.r_[0, np.cumsum(n + 1)]
    a = 0
    while a < len(n):
        b = int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1
        if b < len(n):
            b = int(np.searchsorted(row, row[b]))  # the last row, begun, comes later
            b = b if b > a else int(np.searchsorted(row, row[a], "right"))
        yield slice(a, b)
        a = b


def _pairs(e: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of e with all places from low to high."""
    n = high - low
    return np.repeat(e, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _filled_in(key: np.ndarray, n: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (row * n + column, ascending) of a matrix with those of levels up to `fill`, and where among them the given ones are.

    An entry (i, j) has the least level(i, k) + level(k, j) + 1 over k below i and j: so each level comes from pairs of lower ones."""
    by = [key]
    for level in range(1, fill + 1):
        known, new = np.sort(np.concatenate(by)), []
        for one in range(level):
            left, right = by[one], by[level - 1 - one]
            left = left[left % n < left // n]
            right = right[right % n > right // n]
            start = np.searchsorted(right // n, np.arange(n + 1))
            for some in _spans_of(np.diff(start)[left % n], left // n):
                e = left[some]
                p, q = _pairs(e // n, start[e % n], start[e % n + 1])
                goal = np.unique(p * n + right[q] % n)
                new.append(goal[known[np.minimum(np.searchsorted(known, goal), len(known) - 1)] != goal])
        by.append(np.unique(np.concatenate([np.empty(0, np.int64), *new])))
    out = np.sort(np.concatenate(by))
    return out, np.searchsorted(out, key)


def ilut(a: Sequence[dict[int, float]], fill: int, tolerance: float, mode: str = "textbook") -> Factors:
    """ILU with threshold (relative to the row's norm) and at most `fill` entries a row on either side of the diagonal.

    mode="reference": no elimination; entries under the (absolute) threshold go, then the `fill` largest of a row stay."""
    lower, upper = Packed(), Packed()
    for n, row in enumerate(a):
        if mode == "reference":
            kept = [(j, x) for j, x in sorted(row.items()) if abs(x) >= tolerance]
            kept = sorted(kept, key=lambda c: -abs(c[1]))[:fill] if len(kept) > fill else kept
            lower.append({j: x for j, x in kept if j < n})
            upper.append({j: x for j, x in kept if j >= n})
            continue
        w, limit = dict(row), tolerance * np.sqrt(sum(x * x for x in row.values()))
        todo = [k for k in w if k < n]
        heapify(todo)
        while todo:
            k = heappop(todo)
            above = upper[k]
            w[k] /= above[k]
            if abs(w[k]) < limit:
                del w[k]
                continue
            for j, x in above.items():
                if j > k:
                    if j < n and j not in w:
                        heappush(todo, j)
                    w[j] = w.get(j, 0.0) - w[k] * x
        if not w.get(n):
            raise ZeroPivot(n)
        big = lambda side: dict(sorted(((j, x) for j, x in side if abs(x) >= limit), key=lambda c: (-abs(c[1]), c[0]))[:fill])
        lower.append(big((j, x) for j, x in w.items() if j < n))
        upper.append({n: w[n]} | big((j, x) for j, x in w.items() if j > n))
    return Factors(lower, upper, skip=mode == "reference")


def sweep(a: Rows, r: np.ndarray, omega: float, shift: float, forward: bool, backward: bool, its: int = 1, mode: str = "textbook", one_sided: bool = False) -> np.ndarray:
    """SOR sweeps from zero.  mode="reference": the forward sweep knows no omega and takes the right side for old values; the backward one relaxes towards
    the right side; `one_sided` leaves the other side's sum out."""
    n, y = len(r), np.zeros(len(r))
    d = np.array([a[k].get(k, 0.0) + shift for k in range(n)])
    if (d == 0).any():
        raise ZeroPivot(int(np.flatnonzero(d == 0)[0]))
    part = lambda k, low, x: sum(v * x[j] for j, v in a[k].items() if (j < k if low else j > k))
    for _ in range(its):
        if forward:
            for k in range(n):
                if mode == "reference":
                    y[k] = (r[k] - part(k, True, y) - (0.0 if one_sided else part(k, False, r))) / d[k]
                else:
                    y[k] += omega * ((r[k] - part(k, True, y) - part(k, False, y)) / d[k] - y[k])
        if backward:
            for k in range(n - 1, -1, -1):
                if mode == "reference":
                    y[k] = (1 - omega) * r[k] + omega * (r[k] - part(k, False, y) - (0.0 if one_sided else part(k, True, y))) / d[k]
                else:
                    y[k] += omega * ((r[k] - part(k, True, y) - part(k, False, y)) / d[k] - y[k])
    return y
