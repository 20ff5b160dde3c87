"""Graph diffusion and reaction solvers: adaptive Runge-Kutta pairs, an L-stable implicit pair, Strang splitting, calibrations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np

State = np.ndarray
Rhs = Callable[[State], State]

# The explicit 5(4) pair of Tsitouras (2011).
TSIT_A = (
    (0.161,),
    (-0.008480655492356989, 0.335480655492357),
    (2.8971530571054935, -6.359448489975075, 4.3622954328695815),
    (5.325864828439257, -11.748883564062828, 7.4955393428898365, -0.09249506636175525),
    (5.86145544294642, -12.92096931784711, 8.159367898576159, -0.071584973281401, -0.028269050394068383),
    (0.09646076681806523, 0.01, 0.4798896504144996, 1.379008574103742, -3.290069515436081, 2.324710524099774),
)
TSIT_E = (-0.00178001105222577714, -0.0008164344596567469, 0.007880878010261995, -0.1447110071732629, 0.5823571654525552, -0.45808210592918697, 0.015151515151515152)
# The explicit 5(4) pair of Dormand and Prince (1980).
DOPRI_A = (
    (1 / 5,),
    (3 / 40, 9 / 40),
    (44 / 45, -56 / 15, 32 / 9),
    (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
    (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
)
DOPRI_E = (71 / 57600, 0.0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40)
# The L-stable five-stage pair of order 4(3) of Hairer and Wanner (1996), table IV.6.5.
SDIRK_G = 0.25
SDIRK_A = ((), (1 / 2,), (17 / 50, -1 / 25), (371 / 1360, -137 / 2720, 15 / 544), (25 / 24, -49 / 48, 125 / 16, -85 / 12))
SDIRK_B = (25 / 24, -49 / 48, 125 / 16, -85 / 12, 1 / 4)
SDIRK_H = (59 / 48, -17 / 96, 225 / 32, -85 / 12, 0.0)

STAGES = {"tsit5": 6, "dopri5": 6, "sdirk4": 5}


@dataclass
class Trace:
    """What an integration did: steps taken and refused, evaluations, convergence, and the accepted step sizes and norms."""

    accepted: int = 0
    rejected: int = 0
    nfe: int = 0
    converged: bool = True
    dts: list[float] = field(default_factory=list)
    norms: list[float] = field(default_factory=list)


def _explicit(f: Rhs, h: State, dt: float, a, e) -> tuple[State, State]:
    k = [f(h)]
    for row in a:
        k.append(f(h + dt * sum(c * x for c, x in zip(row, k))))
    new = h + dt * sum(c * x for c, x in zip(a[-1], k))
    return new, dt * sum(c * x for c, x in zip(e, k))


def _implicit(f: Rhs, jac: Callable[[State], np.ndarray], h: State, dt: float) -> tuple[State, State] | None:
    """One step with a Jacobian (d, d) for each of n nodes, factorised once; None if the Newton iteration fails."""
    n, d = h.shape
    m = np.eye(d) - dt * SDIRK_G * jac(h)
    k: list[State] = []
    for row in SDIRK_A:
        base = h + dt * sum((c * x for c, x in zip(row, k)), np.zeros_like(h))
        z = k[-1].copy() if k else f(h)
        for _ in range(8):
            g = z - f(base + dt * SDIRK_G * z)
            step = np.linalg.solve(m, -g[..., None])[..., 0]
            z = z + step
            if not np.isfinite(z).all():
                return None
            if np.abs(step).max() * dt < 1e-10 * (1 + np.abs(h).max()):
                break
        k.append(z)
    new = h + dt * sum(c * x for c, x in zip(SDIRK_B, k))
    return new, dt * sum((b - c) * x for b, c, x in zip(SDIRK_B, SDIRK_H, k))


def integrate(f: Rhs, h: State, span: float, method: str = "dopri5", dt0: float | None = None, rtol: float = 1e-4, atol: float = 1e-5, jac=None, max_steps: int = 4096, trace: Trace | None = None) -> tuple[State, Trace]:
    """Advance h over the span with adaptive steps (proportional-integral control). method: tsit5, dopri5 or sdirk4, which needs jac.
    A state that is not finite, or too many steps, ends the run as not converged."""
    tr = trace or Trace()
    t, dt, last = 0.0, dt0 or span / 10, 1.0
    order = 4 if method == "sdirk4" else 5
    steps = 0
    while t < span * (1 - 1e-12):
        dt = min(dt, span - t)
        steps += 1
        if steps > max_steps or dt < 1e-12 * span:
            tr.converged = False
            break
        got = _implicit(f, jac, h, dt) if method == "sdirk4" else _explicit(f, h, dt, *((TSIT_A, TSIT_E) if method == "tsit5" else (DOPRI_A, DOPRI_E)))
        tr.nfe += STAGES[method]
        if got is None or not np.isfinite(got[0]).all():
            tr.rejected += 1
            dt /= 4
            continue
        new, err = got
        e = float(np.sqrt(np.mean((err / (atol + rtol * np.maximum(np.abs(h), np.abs(new)))) ** 2))) if h.size else 0.0
        if e <= 1:
            t += dt
            h = new
            tr.accepted += 1
            tr.dts.append(dt)
            tr.norms.append(float(np.abs(h).max()) if h.size else 0.0)
            dt *= float(np.clip(0.9 * max(e, 1e-10) ** (-0.7 / order) * last ** (0.4 / order), 0.2, 10))
            last = max(e, 1e-4)
        else:
            tr.rejected += 1
            dt *= max(0.2, 0.9 * e ** (-1 / order))
    return h, tr


def diffusion(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, d: float) -> Rhs:
    """d times the weighted excess of the neighbours, summed at each receiver; with edges in both directions nothing is lost."""

    def f(h: State) -> State:
        flux = d * w[:, None] * (h[src] - h[dst])
        return np.stack([np.bincount(dst, flux[:, c], n) for c in range(h.shape[1])], 1)

    return f


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def _silu(x):
    return x * _sigmoid(x)


def softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


# Fixed value: shift of the rate's argument, so that small weights give rates near zero.
RATE_SHIFT = 5.0


def make_weights(scale: float, seed: int, state: int = 3, env: int = 4, hidden: int = 16) -> dict[str, np.ndarray]:
    """Random weights of the bounded relaxation reaction, from NumPy's generator."""
    r = np.random.default_rng(seed)
    out = {"gate": r.normal(size=state + env) * 0.1, "bias": np.zeros(1)}
    for name in ("grow", "decay", "rate"):
        out[f"{name}1"], out[f"{name}2"] = r.normal(size=(env, hidden)) * scale, r.normal(size=(hidden, state)) * scale
    return out


def rates(env: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grow, decay, rate, the gate's weights of the state, its part from the environment) of nodes in these environments."""
    head = lambda name: _silu(env @ w[f"{name}1"]) @ w[f"{name}2"]
    grow, decay, rate = _sigmoid(head("grow")), _sigmoid(head("decay")), softplus(head("rate") - RATE_SHIFT)
    d = grow.shape[1]
    return grow, decay, rate, w["gate"][:d], env @ w["gate"][d:] + w["bias"][0]


def reaction(env: np.ndarray, w: dict[str, np.ndarray]) -> tuple[Rhs, Callable[[State], np.ndarray]]:
    """(rhs, Jacobian of each node): rate(e) * (s g(e) + (1 - s) r(e) - h), where only the gate s depends on the state; the targets g, r lie
    in (0, 1) and the rate is positive, so the pull is bounded."""
    grow, decay, rate, gate_h, gate_e = rates(env, w)
    d = grow.shape[1]

    def f(h: State) -> State:
        s = _sigmoid(h @ gate_h + gate_e)[:, None]
        return rate * (s * grow + (1 - s) * decay - h)

    def jac(h: State) -> np.ndarray:
        s = _sigmoid(h @ gate_h + gate_e)
        coupling = (rate * (grow - decay))[:, :, None] * ((s * (1 - s))[:, None] * gate_h[None, :])[:, None, :]
        return coupling - rate[:, :, None] * np.eye(d)

    return f, jac


def gate_ceiling(w: dict[str, np.ndarray], d: int) -> float:
    """A bound of the gate coupling's norm that holds for every state."""
    return 0.25 * float(np.linalg.norm(w["gate"][:d])) * d**0.5


def spectral_norm(jac: np.ndarray) -> float:
    """Median over the nodes of the 2-norm of their Jacobians."""
    return float(np.median(np.linalg.norm(jac, 2, axis=(1, 2)))) if len(jac) else 0.0


def dominant_real(jac: np.ndarray) -> float:
    """The largest real part of the eigenvalues of any node's Jacobian: above zero means locally unstable."""
    return float(np.linalg.eigvals(jac).real.max()) if len(jac) else 0.0


def stability_profile(f_jac: Callable[[State], np.ndarray], h: State, scales: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), seed: int = 0) -> list[tuple[float, float]]:
    """(scale, dominant real part) at states moved away from h by random amounts of that scale."""
    r = np.random.default_rng(seed)
    return [(s, dominant_real(f_jac(h + s * r.normal(size=h.shape)))) for s in scales]


def linear_decay(target: np.ndarray, k: float) -> tuple[Rhs, Callable[[State], np.ndarray]]:
    """(rhs, Jacobian) of target - k h."""
    d = target.shape[1]
    return (lambda h: target - k * h), (lambda h: np.broadcast_to(-k * np.eye(d), (len(h), d, d)))


def strang(h: State, explicit: Rhs, implicit: Rhs, jac, dt: float = 300.0, steps: int = 12, rtol: float = 1e-4, atol: float = 1e-5) -> tuple[State, dict]:
    """Half a step of explicit diffusion, a step of implicit reaction, half a step of diffusion, for each macro step."""
    a, b = Trace(), Trace()
    for _ in range(steps):
        h, a = integrate(explicit, h, dt / 2, "tsit5", dt / 20, rtol, atol, trace=a)
        h, b = integrate(implicit, h, dt, "sdirk4", dt / 2, rtol, atol, jac, trace=b)
        h, a = integrate(explicit, h, dt / 2, "tsit5", dt / 20, rtol, atol, trace=a)
        if not (a.converged and b.converged):
            break
    return h, {"nfe_diffusion": a.nfe, "nfe_reaction": b.nfe, "nfe_imex_total": a.nfe + b.nfe, "rejected_diff": a.rejected, "rejected_rxn": b.rejected, "imex_converged": a.converged and b.converged}


def unsplit(h: State, explicit: Rhs, implicit: Rhs, dt: float = 300.0, steps: int = 12, rtol: float = 1e-4, atol: float = 1e-5) -> tuple[State, Trace]:
    """Both terms together by the explicit pair."""
    tr = Trace()
    for _ in range(steps):
        h, tr = integrate(lambda v: explicit(v) + implicit(v), h, dt, "dopri5", dt / 10, rtol, atol, trace=tr)
        if not tr.converged:
            break
    return h, tr


def compare(h0: State, explicit: Rhs, implicit: Rhs, jac, **kw) -> dict:
    """One benchmark row: the split solver against the unsplit one."""
    a, row = strang(h0, explicit, implicit, jac, **kw)
    b, tr = unsplit(h0, explicit, implicit, **kw)
    gap = float(np.linalg.norm(a - b) / (np.linalg.norm(b) + 1e-12)) if np.isfinite(a).all() and np.isfinite(b).all() else float("nan")
    return row | {"nfe_dopri5": tr.nfe, "rejected_dopri5": tr.rejected, "dopri5_converged": tr.converged, "nfe_ratio": tr.nfe / (row["nfe_imex_total"] + 1), "solution_l2_error": gap}


def accuracy(h0: State, explicit: Rhs, implicit: Rhs, jac, tight: float = 1e-8, loose: float = 1e-3, **kw) -> dict:
    """The split solver at a loose tolerance against itself at a tight one."""
    ref, a = strang(h0, explicit, implicit, jac, rtol=tight, atol=tight / 10, **kw)
    got, b = strang(h0, explicit, implicit, jac, rtol=loose, atol=loose / 10, **kw)
    return {"nfe_ref": a["nfe_imex_total"], "nfe_train": b["nfe_imex_total"], "nfe_ratio_train_over_ref": b["nfe_imex_total"] / max(1, a["nfe_imex_total"]), "ref_converged": a["imex_converged"], "train_converged": b["imex_converged"], "eps_int": float(np.linalg.norm(got - ref) / (np.linalg.norm(ref) + 1e-12))}


def lambda_max(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, rounds: int = 200) -> float:
    """The largest eigenvalue of the weighted Laplacian of undirected edges (each given in both directions), by power iteration."""
    if not len(src):
        return 0.0
    deg = np.bincount(dst, w, n)
    v = np.random.default_rng(0).normal(size=n)
    value = 0.0
    for _ in range(rounds):
        u = deg * v - np.bincount(dst, w * v[src], n)
        norm = float(np.linalg.norm(u))
        if norm == 0:
            return 0.0
        v, last, value = u / norm, value, norm
        if abs(value - last) < 1e-10 * value:
            break
    return value


@cache
def stability_radius(method: str = "tsit5") -> float:
    """How far on the negative real axis the explicit pair stays stable, by bisection on its growth factor."""
    a, e = (TSIT_A, TSIT_E) if method == "tsit5" else (DOPRI_A, DOPRI_E)
    growth = lambda z: abs(float(_explicit(lambda h: -z * h, np.ones((1, 1)), 1.0, a, e)[0][0, 0]))
    lo, hi = 0.5, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if growth(mid) <= 1 else (lo, mid)
    return lo


def calibrate_diffusion(r_stab: float, k_max: float, fraction: float = 0.1, dt: float = 300.0) -> float:
    return r_stab / (k_max * fraction * dt)


def calibrate_width(lengths: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, spacing: float, candidates: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 3.0)) -> tuple[float, dict[float, float]]:
    """(width, value by candidate): the kernel width, in spacings, at which the weighted Laplacian's largest eigenvalue is closest to
    that of the plain one; the first candidate on a tie."""
    plain = lambda_max(n, src, dst, np.ones(len(src)))
    got = {c: abs(lambda_max(n, src, dst, np.exp(-(lengths**2) / (2 * (c * spacing) ** 2))) - plain) for c in candidates}
    return min(got, key=got.get), got


def calibrate_scale(env: np.ndarray, h: State, target: float, seed: int = 0, rounds: int = 15, tolerance: float = 0.1) -> float:
    """The weight scale whose reaction has the target spectral norm, by bisection of its logarithm."""
    lo, hi = 1e-3, 1e2
    for _ in range(rounds):
        mid = (lo * hi) ** 0.5
        rho = spectral_norm(reaction(env, make_weights(mid, seed, h.shape[1], env.shape[1]))[1](h))
        if abs(rho - target) <= tolerance * target:
            return mid
        lo, hi = (mid, hi) if rho < target else (lo, mid)
    return (lo * hi) ** 0.5


def calibrate_tolerance(h0: State, explicit: Rhs, implicit: Rhs, jac, start: float = 1e-2, least: float = 1e-8, accept: float = 1e-3, **kw) -> tuple[float, bool]:
    """(tolerance, found): the first tolerance, halving from the start, at which halving again changes the solution by less than
    accept. A run that does not converge ends the search, since a smaller tolerance cannot be trusted either; the last one that
    did converge is given then, and the start if none did."""
    good, last, tol = start, None, start
    while tol >= least:
        h, row = strang(h0, explicit, implicit, jac, rtol=tol, atol=tol / 10, **kw)
        if not row["imex_converged"]:
            return good, False
        if last is not None and np.linalg.norm(h - last) < accept * (np.linalg.norm(last) + 1e-12):
            return good, True
        good, last, tol = tol, h, tol / 2
    return good, False


def verdict(tr: Trace, dt0: float) -> str:
    """Why a run went badly: divergence (overflow, or growth while steps shrink), stiffness (steps shrink without growth), or unclear."""
    if not tr.converged and (not tr.norms or max(tr.norms) > 1e6):
        return "DIVERGENCE"
    if len(tr.norms) < 2:
        return "AMBIGUOUS" if tr.converged else "STIFFNESS"
    k = max(1, len(tr.norms) // 10)
    growth = float(np.mean(tr.norms[-k:]) / (np.mean(tr.norms[:k]) + 1e-12))
    shrink = float(np.mean(tr.dts[-k:]) / (np.mean(tr.dts[:k]) + 1e-12))
    corr = float(np.corrcoef(tr.norms, tr.dts)[0, 1]) if np.std(tr.norms) > 0 and np.std(tr.dts) > 0 else 0.0
    if max(tr.norms) > 1e6 or (growth > 5 and shrink < 0.1 and corr < -0.3):
        return "DIVERGENCE"
    if growth <= 5 and (shrink < 0.1 or min(tr.dts) < 0.1 * dt0):
        return "STIFFNESS"
    return "AMBIGUOUS"
