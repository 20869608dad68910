"""Krylov methods.

Each takes a space that holds the matrix A and the vectors b and x (the first guess), leaves the solution in x and
returns SolveStats.  `rule` says when to stop; `monitor` sees (iteration, residual), from iteration 0 on.  A zero first residual is a
solution.  Running out of iterations isn't convergence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.dense import Givens
from ..precond.base import Identity, Preconditioner
from ..types import Convergence, IndefiniteMatrix, IndefinitePreconditioner, Monitor, SolveError, SolveStats, Unsupported
from .options import NormType, Orthogonalization, Side

EPS = np.finfo(float).eps
#: Share of the right side that is as good as nothing: rounding of its products.
MET = 1e-13
_quiet: Monitor = lambda k, r: None


def _residual(s, a: str = "A", into: str = "r") -> None:
    s.apply(a, "x", "_ax")
    s.let(**{into: [(1, "b"), (-1, "_ax")]})
    s.drop("_ax")


def _norm(s, name: str) -> float:
    return float(np.sqrt(s.dots((name, name))[0]))


def cg(s, rule: Convergence, monitor: Monitor = _quiet, norm: NormType = NormType.UNPRECONDITIONED, single_reduction: bool = False, radius: float | None = None, objective: float | None = None) -> SolveStats:
    """Conjugate gradients for symmetric positive definite A.

    radius: stops on the trust region's edge, not converged; objective: stops, converged, when x'Ax/2 - x'b is that low.
    norm=NONE: no test, runs to max_iters.  single_reduction: one aggregate an iteration (Chronopoulos and Gear)."""
    return _conjugate(s, rule, monitor, norm, Identity(), single_reduction, radius, objective)


def pcg(s, pc: Preconditioner, rule: Convergence, monitor: Monitor = _quiet, norm: NormType = NormType.PRECONDITIONED, single_reduction: bool = False, radius: float | None = None, objective: float | None = None) -> SolveStats:
    """Preconditioned conjugate gradients; mode="reference" of the rule measures against sqrt|r'z| of the start."""
    return _conjugate(s, rule, monitor, norm, pc, single_reduction, radius, objective)


def _conjugate(s, rule, monitor, norm, pc, single, radius, objective) -> SolveStats:
    plain = isinstance(pc, Identity)

    def precondition() -> None:
        s.let(z=[(1, "r")]) if plain else pc.apply(s, "r", "z")

    def measure(rr: float, rz: float, zz: float) -> float:
        return {NormType.PRECONDITIONED: np.sqrt(zz), NormType.UNPRECONDITIONED: np.sqrt(rr), NormType.NATURAL: np.sqrt(abs(rz)), NormType.NONE: 0.0}[norm]

    _residual(s)
    precondition()
    if single:
        s.apply("A", "z", "w")
        rr, rz, zz, zw = s.dots(("r", "r"), ("r", "z"), ("z", "z"), ("w", "z"))
    else:
        rr, rz, zz = s.dots(("r", "r"), ("r", "z"), ("z", "z"))
    first = now = measure(rr, rz, zz)
    if rule.mode == "reference" and not plain:
        first = float(np.sqrt(abs(rz)))
    monitor(0, now)
    if rr == 0:
        return SolveStats(0, now, True)
    if rz < 0:
        raise IndefinitePreconditioner("r'z < 0")
    beta, alpha = 0.0, 0.0
    for k in range(1, rule.max_iters + 1):
        if single:
            if k == 1:
                s.let(p=[(1, "z")], q=[(1, "w")])
                paq = zw
            else:
                s.let(p=[(1, "z"), (beta, "p")], q=[(1, "w"), (beta, "q")])
                paq = zw - beta * rz / alpha
        else:
            s.let(p=[(1, "z")] if k == 1 else [(1, "z"), (beta, "p")])
            s.apply("A", "p", "q")
            if radius is None:
                (paq,) = s.dots(("p", "q"))
            else:
                paq, xx, pp = s.dots(("p", "q"), ("x", "x"), ("p", "p"))
        if paq <= 0:
            raise IndefiniteMatrix(f"p'Ap = {paq:g} in iteration {k}")
        alpha = rz / paq
        if radius is not None:
            if single:
                xx, pp = s.dots(("x", "x"), ("p", "p"))
            (xp,) = s.dots(("x", "p"))
            if xx + 2 * alpha * xp + alpha * alpha * pp > radius * radius:
                step = (-xp + np.sqrt(xp * xp + pp * (radius * radius - xx))) / pp
                s.let(x=[(1, "x"), (step, "p")], r=[(1, "r"), (-step, "q")])
                return SolveStats(k, _norm(s, "r"), False)
        s.let(x=[(1, "x"), (alpha, "p")], r=[(1, "r"), (-alpha, "q")])
        precondition()
        old = rz
        if single:
            s.apply("A", "z", "w")
            rr, rz, zz, zw = s.dots(("r", "r"), ("r", "z"), ("z", "z"), ("w", "z"))
        else:
            rr, rz, zz = s.dots(("r", "r"), ("r", "z"), ("z", "z"))
        now = measure(rr, rz, zz)
        monitor(k, now)
        if objective is not None:
            xb, xr = s.dots(("x", "b"), ("x", "r"))
            if -0.5 * (xb + xr) <= objective:  # x'Ax/2 - x'b with Ax = b - r
                return SolveStats(k, now, True)
        if rr == 0 or (norm is not NormType.NONE and rule.met(now, first)):
            return SolveStats(k, now, True)
        beta = rz / old
        if beta < 0:
            raise IndefinitePreconditioner(f"beta = {beta:g} in iteration {k}")
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def gmres(s, rule: Convergence, restart: int = 30, side: Side = Side.NONE, pc: Preconditioner | None = None, monitor: Monitor = _quiet) -> SolveStats:
    """GMRES(m) with classical Gram-Schmidt done twice, two aggregates a step; left, right or no preconditioning."""
    pc = pc or Identity()
    if side is Side.NONE and not isinstance(pc, Identity):
        raise Unsupported("a preconditioner needs a side")
    return _arnoldi(s, rule, restart, monitor, left=pc if side is Side.LEFT else None, right=(lambda k: pc) if side is Side.RIGHT else None, flexible=False)


def fgmres(s, rule: Convergence, restart: int = 30, pc: Preconditioner | None = None, modify: Callable[[int, Preconditioner], Preconditioner] | None = None, orthogonalization: Orthogonalization = Orthogonalization.CLASSICAL, happy: float = 1e-12, monitor: Monitor = _quiet, preallocate: bool = False, delta_allocate: int = 0) -> SolveStats:
    """Flexible GMRES: the preconditioner may differ from step to step; `modify` is called with the step's number before each.

    preallocate and delta_allocate are taken for compatibility; columns of a state need no room in advance."""
    base = pc or Identity()
    return _arnoldi(s, rule, restart, monitor, left=None, right=lambda k: modify(k, base) if modify else base, flexible=True, orthogonalization=orthogonalization, happy=happy)


def _arnoldi(s, rule, restart, monitor, left, right, flexible, orthogonalization=Orthogonalization.TWICE, happy=1e-14) -> SolveStats:
    done, first, cycles = 0, None, 0
    while True:
        _residual(s)
        true = _norm(s, "r")
        if left:
            left.apply(s, "r", "v0")
        else:
            s.let(v0=[(1, "r")])
        beta = _norm(s, "v0")
        if first is None:
            first = true
            monitor(0, true)
        if true == 0 or rule.met(true, first):
            return SolveStats(done, true, True)
        if done >= rule.max_iters:
            return SolveStats(done, true, rule.mode == "reference")
        # the estimate is of the preconditioned residual; further cycles ask for more, as it and the true one differ
        goal = rule.tol * (1.0 if rule.absolute else first) * beta / true * (0.5 if cycles else 1.0)
        s.let(v0=[(1 / beta, "v0")])
        ls, cycles = Givens(restart, beta), cycles + 1
        for j in range(min(restart, rule.max_iters - done)):
            src = f"v{j}"
            if right:
                right(done).apply(s, src, f"z{j}")
                src = f"z{j}"
            if left:
                s.apply("A", src, "_w")
                left.apply(s, "_w", "w")
                s.drop("_w")
            else:
                s.apply("A", src, "w")
            h = np.zeros(j + 2)
            if orthogonalization is Orthogonalization.MODIFIED:
                for i in range(j + 1):
                    (c,) = s.dots((f"v{i}", "w"))
                    h[i] += c
                    s.let(w=[(1, "w"), (-c, f"v{i}")])
            else:
                for _ in range(2 if orthogonalization is Orthogonalization.TWICE else 1):
                    c = s.dots(*((f"v{i}", "w") for i in range(j + 1)))
                    h[: j + 1] += c
                    s.let(w=[(1, "w"), *((-x, f"v{i}") for i, x in enumerate(c))])
            h[j + 1] = _norm(s, "w")
            estimate = ls.add(h)
            done += 1
            monitor(done, estimate)
            if h[j + 1] <= happy * max(1.0, beta) or estimate <= goal:
                break
            s.let(**{f"v{j + 1}": [(1 / h[j + 1], "w")]})
        y = ls.solution()
        if right and flexible:
            s.let(x=[(1, "x"), *((c, f"z{i}") for i, c in enumerate(y))])
        elif right:
            s.let(t=[(c, f"v{i}") for i, c in enumerate(y)])
            right(done).apply(s, "t", "t")
            s.let(x=[(1, "x"), (1, "t")])
        else:
            s.let(x=[(1, "x"), *((c, f"v{i}") for i, c in enumerate(y))])
        s.drop("w", "t", *(f"v{i}" for i in range(restart + 1)), *(f"z{i}" for i in range(restart + 1)))


def _block_orthonormal(s, own: list[str], names: list[str], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Makes the block orthonormal, also to the `own` vectors, in place: block = own C + new R.  Two passes of one aggregate each.

    The Gram matrix gives the projection and a Cholesky factor at once.  Columns from the first on that (scaled) adds less than `floor` are left out: R has fewer."""
    c = r = None
    for _ in range(2):
        k = len(names)
        got = iter(s.dots(*((a, b) for a in own for b in names), *((names[i], names[j]) for i in range(k) for j in range(i, k))))
        h, g = np.array([[next(got) for _ in names] for _ in own]), np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = next(got)
        if not (np.isfinite(h).all() and np.isfinite(g).all()):
            raise SolveError("the Krylov space broke down")
        d = np.sqrt(np.diag(g))
        d[d == 0] = 1.0
        left = (g - h.T @ h) / np.outer(d, d)
        kept = next((n for n in range(k, 0, -1) if np.linalg.eigvalsh(left[:n, :n])[0] > floor), 0)
        if not kept:
            return h if c is None else c, np.zeros((0, 0))
        u = np.linalg.cholesky(left[:kept, :kept]).T * d[:kept]
        back = np.linalg.inv(u)
        away, names = h[:, :kept] @ back, names[:kept]
        s.let(**{x: [*((back[i, j], names[i]) for i in range(j + 1)), *((-away[i, j], v) for i, v in enumerate(own))] for j, x in enumerate(names)})
        c, r = (h[:, :kept], u) if c is None else (c[:, :kept] + h[:, :kept] @ r[:kept, :kept], u @ r[:kept, :kept])
    return c, r


def s_step_gmres(s, rule: Convergence, block: int = 3, restart: int = 30, pc: Preconditioner | None = None, monitor: Monitor = _quiet, pipeline_depth: int = 1, tau: float | None = None) -> SolveStats:
    """GMRES on blocks of `block` products and two Gram aggregates each (communication-avoiding); right preconditioning.

    A block is v, Av, A^2 v ... of the last basis vector v, made orthonormal to all earlier blocks of the cycle and in itself; a cycle has up to `restart`
    vectors.  pipeline_depth has no effect; of a block, what adds less than tau (relative) is dropped."""
    if not 1 <= block <= restart:
        raise Unsupported(f"blocks of 1 to {restart} products (the restart length), not {block}")
    pc, floor = pc or Identity(), max(tau or 0.0, 1e-12)
    done, first, before = 0, None, np.inf
    while True:
        _residual(s)
        now = _norm(s, "r")
        if first is None:
            first = now
            monitor(0, now)
        if now == 0 or rule.met(now, first):
            return SolveStats(done, now, True)
        if done >= rule.max_iters:
            return SolveStats(done, now, rule.mode == "reference")
        if now >= before:
            return gmres(s, Convergence(rule.tol * (1.0 if rule.absolute else first), rule.max_iters - done, True, rule.mode), restart, Side.RIGHT, pc, lambda k, r: monitor(done + k, r) if k else None)  # blocks are too short: one step after another
        before = now
        s.let(v0=[(1 / now, "r")])
        # of the basis V and the block vectors Z = V T: A M^-1 Z = V G
        g, t, m = np.zeros((restart + 1, restart)), np.zeros((restart + 1, restart)), 0
        while True:
            names = [f"k{j}" for j in range(min(block, restart - m, rule.max_iters - done))]
            for src, x in zip([f"v{m}", *names], names, strict=False):
                pc.apply(s, src, "_m")
                s.apply("A", "_m", x)
            c, r = _block_orthonormal(s, [f"v{i}" for i in range(m + 1)], names, floor)
            kept = len(r)
            s.let(**{f"v{m + 1 + j}": [(1, names[j])] for j in range(kept)})
            s.drop(*names, "_m")
            added = max(kept, 1)  # nothing new: the space holds the solution
            g[: m + 1, m : m + added] = c[:, :added]
            g[m + 1 : m + 1 + kept, m : m + kept] = r
            t[m, m] = 1.0
            t[:, m + 1 : m + added] = g[:, m : m + added - 1]
            m, done = m + added, done + added
            goal = np.zeros(m + 1)
            goal[0] = now
            size = np.linalg.norm(g[: m + 1, :m], axis=0)  # powers of A differ in size
            size[size == 0] = 1.0
            y = np.linalg.lstsq(g[: m + 1, :m] / size, goal, rcond=None)[0] / size
            estimate = float(np.linalg.norm(goal - g[: m + 1, :m] @ y))
            monitor(done, estimate)
            if not kept or m >= restart or done >= rule.max_iters or rule.met(estimate, first):
                break
        s.let(_m=[(z, f"v{i}") for i, z in enumerate(t[:m, :m] @ y)])
        pc.apply(s, "_m", "_m")
        s.let(x=[(1, "x"), (1, "_m")])
        s.drop("_m", *(f"v{i}" for i in range(restart + 1)))


def bicgstab(s, rule: Convergence, pc: Preconditioner | None = None, monitor: Monitor = _quiet) -> SolveStats:
    """BiCGStab (van der Vorst), optionally preconditioned from the right; the rule is usually absolute."""
    pc = pc or Identity()
    _residual(s)
    s.let(h=[(1, "r")], p=[(1, "r")])
    rho = s.dots(("r", "r"))[0]
    first = now = float(np.sqrt(rho))
    monitor(0, now)
    if now == 0 or rule.met(now, first):
        return SolveStats(0, now, True)
    for k in range(1, rule.max_iters + 1):
        pc.apply(s, "p", "ph")
        s.apply("A", "ph", "v")
        (hv,) = s.dots(("h", "v"))
        if abs(rho) < EPS * EPS or abs(hv) < EPS * EPS:
            return SolveStats(k, now, False)
        alpha = rho / hv
        s.let(s=[(1, "r"), (-alpha, "v")])
        half = _norm(s, "s")
        if rule.met(half, first):
            s.let(x=[(1, "x"), (alpha, "ph")])
            monitor(k, half)
            return SolveStats(k, half, True)
        pc.apply(s, "s", "sh")
        s.apply("A", "sh", "t")
        tt, ts = s.dots(("t", "t"), ("t", "s"))
        if tt == 0:
            return SolveStats(k, half, False)
        omega = ts / tt
        s.let(x=[(1, "x"), (alpha, "ph"), (omega, "sh")], r=[(1, "s"), (-omega, "t")])
        rr, new = s.dots(("r", "r"), ("h", "r"))
        now = float(np.sqrt(rr))
        monitor(k, now)
        if rule.met(now, first):
            return SolveStats(k, now, True)
        if abs(omega) < EPS:
            return SolveStats(k, now, False)
        beta = new / rho * alpha / omega
        rho = new
        s.let(p=[(1, "r"), (beta, "p"), (-beta * omega, "v")])
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def cgs(s, rule: Convergence, pc: Preconditioner | None = None, monitor: Monitor = _quiet) -> SolveStats:
    """Conjugate gradients squared, optionally preconditioned from the right."""
    pc = pc or Identity()
    _residual(s)
    s.let(h=[(1, "r")], u=[(1, "r")], p=[(1, "r")])
    rho = s.dots(("r", "r"))[0]
    first = now = float(np.sqrt(rho))
    monitor(0, now)
    if now == 0:
        return SolveStats(0, 0.0, True)
    for k in range(1, rule.max_iters + 1):
        pc.apply(s, "p", "ph")
        s.apply("A", "ph", "v")
        (hv,) = s.dots(("h", "v"))
        if hv == 0 or abs(rho) < EPS * EPS:
            return SolveStats(k, now, False)
        alpha = rho / hv
        s.let(q=[(1, "u"), (-alpha, "v")])
        s.let(w=[(1, "u"), (1, "q")])
        pc.apply(s, "w", "wh")
        s.apply("A", "wh", "aw")
        s.let(x=[(1, "x"), (alpha, "wh")], r=[(1, "r"), (-alpha, "aw")])
        rr, new = s.dots(("r", "r"), ("h", "r"))
        now = float(np.sqrt(rr))
        monitor(k, now)
        if rule.met(now, first):
            return SolveStats(k, now, True)
        beta, rho = new / rho, new
        s.let(u=[(1, "r"), (beta, "q")])
        s.let(p=[(1, "u"), (beta, "q"), (beta * beta, "p")])
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def qmr(s, rule: Convergence, monitor: Monitor = _quiet) -> SolveStats:
    """Quasi-minimal residual without look-ahead (coupled two-term form); uses A'."""
    _residual(s)
    s.let(vt=[(1, "r")], wt=[(1, "r")])
    first = now = rho = xi = _norm(s, "r")
    monitor(0, now)
    if now == 0:
        return SolveStats(0, 0.0, True)
    gamma, eta, theta, eps = 1.0, -1.0, 0.0, 1.0
    for k in range(1, rule.max_iters + 1):
        if rho == 0 or xi == 0:
            return SolveStats(k, now, False)
        s.let(v=[(1 / rho, "vt")], w=[(1 / xi, "wt")])
        (delta,) = s.dots(("w", "v"))
        if delta == 0:
            return SolveStats(k, now, False)
        s.let(p=[(1, "v")] if k == 1 else [(1, "v"), (-xi * delta / eps, "p")], q=[(1, "w")] if k == 1 else [(1, "w"), (-rho * delta / eps, "q")])
        s.apply("A", "p", "ap")
        (eps,) = s.dots(("q", "ap"))
        if eps == 0:
            return SolveStats(k, now, False)
        beta = eps / delta
        s.apply("A", "q", "aq", transpose=True)
        s.let(vt=[(1, "ap"), (-beta, "v")], wt=[(1, "aq"), (-beta, "w")])
        old_rho, old_gamma, old_theta = rho, gamma, theta
        vv, ww = s.dots(("vt", "vt"), ("wt", "wt"))
        rho, xi = float(np.sqrt(vv)), float(np.sqrt(ww))
        theta = rho / (old_gamma * abs(beta))
        gamma = 1 / np.sqrt(1 + theta * theta)
        eta = -eta * old_rho * gamma * gamma / (beta * old_gamma * old_gamma)
        keep = (old_theta * gamma) ** 2
        s.let(d=[(eta, "p")] if k == 1 else [(eta, "p"), (keep, "d")], e=[(eta, "ap")] if k == 1 else [(eta, "ap"), (keep, "e")])
        s.let(x=[(1, "x"), (1, "d")], r=[(1, "r"), (-1, "e")])
        now = _norm(s, "r")
        monitor(k, now)
        if rule.met(now, first):
            return SolveStats(k, now, True)
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def tfqmr(s, rule: Convergence, pc: Preconditioner | None = None, monitor: Monitor = _quiet) -> SolveStats:
    """Transpose-free QMR (Freund), optionally preconditioned from the right; two half-steps an iteration."""
    pc = pc or Identity()

    def product(src: str, dst: str) -> None:
        pc.apply(s, src, "_h")
        s.apply("A", "_h", dst)

    _residual(s)
    s.let(h=[(1, "r")], w=[(1, "r")], u=[(1, "r")], d=[])
    product("u", "v")
    s.let(au=[(1, "v")])
    rho = s.dots(("r", "r"))[0]
    first = now = tau = float(np.sqrt(rho))
    theta = eta = 0.0
    monitor(0, now)
    if tau == 0:
        return SolveStats(0, 0.0, True)
    alpha = 0.0
    for m in range(2 * rule.max_iters):
        if m % 2 == 0:
            (hv,) = s.dots(("h", "v"))
            if hv == 0:
                return SolveStats(m // 2 + 1, now, False)
            alpha = rho / hv
            s.let(un=[(1, "u"), (-alpha, "v")])
        s.let(w=[(1, "w"), (-alpha, "au")], d=[(1, "u"), (theta * theta * eta / alpha, "d")])
        theta = _norm(s, "w") / tau
        c = 1 / np.sqrt(1 + theta * theta)
        tau, eta = tau * theta * c, c * c * alpha
        s.let(y=[(1, "y"), (eta, "d")] if m else [(eta, "d")])
        now = float(np.sqrt(m + 2) * tau)
        if m % 2:
            monitor(m // 2 + 1, now)
        if rule.met(now, first):
            break
        if m % 2 == 0:
            s.let(u=[(1, "un")])
            product("u", "au")
        else:
            if rho == 0:
                break
            (new,) = s.dots(("h", "w"))
            beta, rho = new / rho, new
            s.let(u=[(1, "w"), (beta, "u")], old=[(1, "au"), (beta, "v")])
            product("u", "au")
            s.let(v=[(1, "au"), (beta, "old")])
    pc.apply(s, "y", "_h")
    s.let(x=[(1, "x"), (1, "_h")])
    return SolveStats(m // 2 + 1, now, rule.met(now, first) or rule.mode == "reference")


def minres(s, rule: Convergence, monitor: Monitor = _quiet) -> SolveStats:
    """Minimal residuals for symmetric, also indefinite A (Paige and Saunders)."""
    _residual(s)
    s.let(v=[(1, "r")], v0=[], w0=[], w1=[])
    gamma = first = now = eta = _norm(s, "r")
    monitor(0, now)
    if now == 0:
        return SolveStats(0, 0.0, True)
    s0 = s1 = 0.0
    c0 = c1 = 1.0
    for k in range(1, rule.max_iters + 1):
        s.let(v=[(1 / gamma, "v")])
        s.apply("A", "v", "av")
        (delta,) = s.dots(("v", "av"))
        s.let(vn=[(1, "av"), (-delta, "v"), (-gamma, "v0")])
        gn = _norm(s, "vn")
        a0, a2, a3 = c1 * delta - c0 * s1 * gamma, s1 * delta + c0 * c1 * gamma, s0 * gamma
        a1 = np.hypot(a0, gn)
        if a1 == 0:
            return SolveStats(k, now, False)
        c0, s0, c1, s1 = c1, s1, a0 / a1, gn / a1
        s.let(w=[(1 / a1, "v"), (-a3 / a1, "w0"), (-a2 / a1, "w1")])
        s.let(x=[(1, "x"), (c1 * eta, "w")], w0=[(1, "w1")], w1=[(1, "w")], v0=[(1, "v")], v=[(1, "vn")])
        eta, gamma = -s1 * eta, gn
        now = abs(eta)
        monitor(k, now)
        if rule.met(now, first) or gn <= EPS * first:
            return SolveStats(k, now, rule.met(now, first) or gn <= EPS * first)
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def cgnr(s, rule: Convergence, monitor: Monitor = _quiet) -> SolveStats:
    """Least squares by conjugate gradients on A'A x = A'b, which is never formed; stops on |A'r|."""
    _residual(s)
    s.apply("A", "r", "z", transpose=True)
    s.let(p=[(1, "z")])
    zz = s.dots(("z", "z"))[0]
    first = now = float(np.sqrt(zz))
    monitor(0, now)
    if now == 0:
        return SolveStats(0, 0.0, True)
    for k in range(1, rule.max_iters + 1):
        s.apply("A", "p", "w")
        (ww,) = s.dots(("w", "w"))
        if ww == 0:
            return SolveStats(k, now, False)
        alpha = zz / ww
        s.let(x=[(1, "x"), (alpha, "p")], r=[(1, "r"), (-alpha, "w")])
        s.apply("A", "r", "z", transpose=True)
        old, zz = zz, s.dots(("z", "z"))[0]
        now = float(np.sqrt(zz))
        monitor(k, now)
        if rule.met(now, first):
            return SolveStats(k, now, True)
        s.let(p=[(1, "z"), (zz / old, "p")])
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def lsqr(s, rule: Convergence, monitor: Monitor = _quiet) -> SolveStats:
    """Least squares by QR of the bidiagonal matrix that A is brought to, a rotation a step; stops on |A'r|, or where b is met to rounding."""
    _residual(s)
    beta = size = _norm(s, "r")
    monitor(0, beta)
    if beta == 0:
        return SolveStats(0, 0.0, True)
    s.let(u=[(1 / beta, "r")])
    s.apply("A", "u", "v", transpose=True)
    alpha = _norm(s, "v")
    if alpha == 0:
        return SolveStats(0, beta, True)
    s.let(v=[(1 / alpha, "v")], w=[(1 / alpha, "v")])
    phi, rho, first = beta, alpha, alpha * beta
    for k in range(1, rule.max_iters + 1):
        s.apply("A", "v", "t")
        s.let(u=[(1, "t"), (-alpha, "u")])
        beta = _norm(s, "u")
        if beta > 0:
            s.let(u=[(1 / beta, "u")])
            s.apply("A", "u", "t", transpose=True)
            s.let(t=[(1, "t"), (-beta, "v")])
            alpha = _norm(s, "t")
        else:
            s.let(t=[(0, "v")])
            alpha = 0.0
        turned = float(np.hypot(rho, beta))
        c, sine = rho / turned, beta / turned
        s.let(x=[(1, "x"), (c * phi / turned, "w")])
        if alpha > 0:
            s.let(v=[(1 / alpha, "t")])
            s.let(w=[(1, "v"), (-sine * alpha / turned, "w")])
        phi, rho = sine * phi, -c * alpha
        now = abs(phi * alpha * c)
        monitor(k, now)
        if rule.met(now, first) or phi <= MET * size or alpha == 0:
            return SolveStats(k, now, True)
    return SolveStats(rule.max_iters, now, rule.mode == "reference")


def cgne(s, rule: Convergence, monitor: Monitor = _quiet) -> SolveStats:
    """The solution of least norm of a consistent system (Craig)."""
    _residual(s)
    rr = s.dots(("r", "r"))[0]
    first = now = float(np.sqrt(rr))
    monitor(0, now)
    if now == 0:
        return SolveStats(0, 0.0, True)
    s.apply("A", "r", "p", transpose=True)
    for k in range(1, rule.max_iters + 1):
        (pp,) = s.dots(("p", "p"))
        if pp == 0:
            return SolveStats(k, now, False)
        alpha = rr / pp
        s.apply("A", "p", "ap")
        s.let(x=[(1, "x"), (alpha, "p")], r=[(1, "r"), (-alpha, "ap")])
        old, rr = rr, s.dots(("r", "r"))[0]
        now = float(np.sqrt(rr))
        monitor(k, now)
        if rule.met(now, first):
            return SolveStats(k, now, True)
        s.apply("A", "r", "z", transpose=True)
        s.let(p=[(1, "z"), (rr / old, "p")])
    return SolveStats(rule.max_iters, now, rule.mode == "reference")
