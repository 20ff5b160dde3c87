"""The kernels of many events at once, for events whose arrays are small: regions of equal frames, graphs whose nodes lie one event
after the other, and split integrations in which every event keeps its own steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import segment, solver

# So many distances are taken at a time: they should stay in the processor's cache.
BLOCK = 200_000


def kmeans_regions(feat: np.ndarray, n: int, kappa: float = 0.1, rounds: int = 10) -> np.ndarray:
    """(K, H, W) labels: segment.kmeans_regions() of each of (K, H, W, C) frames."""
    many, h, w = feat.shape[:3]
    start = segment.grid_centers(h, w, n)
    m, block = len(start), BLOCK // (h * w * len(start))
    if block < 2:
        return np.stack([segment.kmeans_regions(f, n, kappa, rounds)[0] for f in feat])
    s = np.sqrt(h * w / n)
    y, x = np.divmod(np.arange(h * w), w)
    at = np.clip(start[:, 0].astype(int), 0, h - 1) * w + np.clip(start[:, 1].astype(int), 0, w - 1)
    out = np.empty((many, h, w), np.int32)
    for i in range(0, many, block):
        f = np.asarray(feat[i : i + block], float).reshape(-1, h * w, feat.shape[3]) / kappa
        k = len(f)
        px = np.concatenate([f, np.broadcast_to(np.column_stack([x / s, y / s]), (k, h * w, 2))], 2)
        square, columns, cent = (px * px).sum(2)[..., None], [px[..., c].ravel() for c in range(px.shape[2])], px[:, at]
        first = (np.arange(k) * m)[:, None]
        for _ in range(rounds):
            lab = (square - 2 * px @ cent.transpose(0, 2, 1) + (cent * cent).sum(2)[:, None]).argmin(2)
            own = (lab + first).ravel()
            count = np.bincount(own, minlength=k * m)
            sums = np.stack([np.bincount(own, c, k * m) for c in columns], 1)
            cent = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], cent.reshape(k * m, -1)).reshape(k, m, -1)
        out[i : i + block] = (lab + 1).reshape(k, h, w)
    return out


@dataclass
class Graphs:
    """Graphs of many events: nodes one event after the other; slot s of a node is its s-th neighbour, in ascending order, and
    weighs 0 where it has fewer."""

    owner: np.ndarray  # (P,) event of each node
    start: np.ndarray  # (K,) first node of each event
    nbr: np.ndarray  # (S, P)
    w: np.ndarray  # (S, P)
    h: np.ndarray  # (3, P) states
    env: np.ndarray  # (P, 4)
    edges: np.ndarray  # (K,) directed edges

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start, append=len(self.owner))


def region_graphs(frames: np.ndarray, labels: np.ndarray, n: int, scale: float = 1.5) -> Graphs:
    """The graphs of (K, H, W, C) frames with labels from 1."""
    many, h, w = labels.shape
    m = int(labels.max())
    code = (labels - 1 + (np.arange(many) * m)[:, None, None]).astype(np.int64)
    flat = code.ravel()
    count = np.bincount(flat, minlength=many * m)
    ids = np.flatnonzero(count)
    size, owner = count[ids], ids // m
    node = np.cumsum(count > 0) - 1
    mean_of = lambda v: np.bincount(flat, v, many * m)[ids] / size
    y, x = np.divmod(np.arange(h * w), w)
    cent = np.stack([mean_of(np.tile(y, many)), mean_of(np.tile(x, many))], 1)
    mean = np.stack([mean_of(frames[..., c].ravel()) for c in range(frames.shape[3])], 1)
    a = node[np.concatenate([code[:, :, :-1].ravel(), code[:, :-1].ravel()])]
    b = node[np.concatenate([code[:, :, 1:].ravel(), code[:, 1:].ravel()])]
    other = a != b
    lo, hi = np.divmod(np.unique(np.minimum(a, b)[other] * len(ids) + np.maximum(a, b)[other]), len(ids))
    src, dst = np.concatenate([lo, hi]), np.concatenate([hi, lo])
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    degree = np.bincount(dst, minlength=len(ids))
    slot = np.arange(len(dst)) - (np.cumsum(degree) - degree)[dst]
    length = np.hypot(*(cent[src] - cent[dst]).T)
    width = scale * np.sqrt(h * w / n)
    nbr = np.tile(np.arange(len(ids)), (int(degree.max(initial=0)), 1))
    weight = np.zeros(nbr.shape)
    nbr[slot, dst], weight[slot, dst] = src, np.exp(-(length**2) / (2 * width**2))
    env = np.column_stack([mean[:, 0], cent / (h, w), np.ones(len(ids))])
    return Graphs(owner, np.searchsorted(owner, np.arange(many)), nbr, weight, np.ascontiguousarray(mean[:, :3].T), env, np.bincount(owner[dst], minlength=many))


def lambda_max(g: Graphs, w: np.ndarray, rounds: int = 200) -> np.ndarray:
    """solver.lambda_max() of each graph with the weights w (S, P)."""
    deg, value, live = w.sum(0), np.zeros(len(g.start)), np.ones(len(g.start), bool)
    v = np.random.default_rng(0).normal(size=int(g.sizes.max()))[np.arange(len(g.owner)) - g.start[g.owner]]
    for _ in range(rounds):
        u = deg * v
        for one, k in zip(w, g.nbr):
            u = u - one * v[k]
        norm = np.sqrt(np.add.reduceat(u * u, g.start))
        last, value = value, np.where(live, norm, value)
        v = u / np.where(norm > 0, norm, 1)[g.owner]
        live &= (norm > 0) & ~(np.abs(value - last) < 1e-10 * value)
        if not live.any():
            break
    return value


class Reacting:
    """Diffusion and the bounded relaxation reaction on the nodes of many events; states are (d, P)."""

    def __init__(self, start, owner, nbr, dw, rates):
        self.start, self.owner, self.nbr, self.dw = start, owner, nbr, dw
        self.grow, self.decay, self.rate, self.gate_h, self.gate_e = self.rates = rates
        self.slots = []  # (nodes, their neighbours, weights): all nodes, or those with such a neighbour where they are few
        for k, w in zip(nbr, dw):
            at = np.flatnonzero(w)
            self.slots += [(None, k, w)] if 2 * len(at) > len(w) else [(at, k[at], w[at])] if len(at) else []

    @classmethod
    def of(cls, g: Graphs, d: np.ndarray, weights: dict[str, np.ndarray]) -> Reacting:
        """d: each event's diffusion."""
        grow, decay, rate, gate_h, gate_e = solver.rates(g.env, weights)
        return cls(g.start, g.owner, g.nbr, d[g.owner] * g.w, (*(np.ascontiguousarray(v.T) for v in (grow, decay, rate)), gate_h, gate_e))

    def take(self, keep: np.ndarray) -> tuple[Reacting, np.ndarray]:
        """(the events in the mask alone, the mask of their nodes)."""
        nodes = keep[self.owner]
        at, owner = np.cumsum(nodes) - 1, (np.cumsum(keep) - 1)[self.owner[nodes]]
        grow, decay, rate, gate_h, gate_e = self.rates
        rates = (grow[:, nodes], decay[:, nodes], rate[:, nodes], gate_h, gate_e[nodes])
        return Reacting(np.searchsorted(owner, np.arange(int(keep.sum()))), owner, at[self.nbr[:, nodes]], self.dw[:, nodes], rates), nodes

    def most(self, v: np.ndarray) -> np.ndarray:
        """The largest magnitude of each event; not finite if any of its values is not."""
        return np.maximum.reduceat(np.abs(v).max(0), self.start)

    def diffuse(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros_like(h)
        for at, k, w in self.slots:
            if at is None:
                out += w * (h.take(k, 1) - h)
            else:
                out[:, at] += w * (h.take(k, 1) - h.take(at, 1))
        return out

    def gate(self, h: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh((self.gate_h @ h + self.gate_e) / 2))

    def react(self, h: np.ndarray) -> np.ndarray:
        s = self.gate(h)
        return self.rate * (s * self.grow + (1 - s) * self.decay - h)

    def explicit_step(self, h: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of diffusion by the pair of Tsitouras, and its error."""
        dt, k = dt[self.owner], [self.diffuse(h)]
        for row in solver.TSIT_A:
            new = h + dt * sum(c * x for c, x in zip(row, k))
            k.append(self.diffuse(new))
        return new, dt * sum(c * x for c, x in zip(solver.TSIT_E, k))

    def implicit_step(self, h: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of the reaction by the L-stable pair, and its error; not a number where the Newton iteration fails. The matrix of
        a node is a diagonal less a product of two vectors, and so is its inverse (Sherman and Morrison)."""
        event_dt, dt = dt, dt[self.owner]
        reach = 1e-10 * (1 + self.most(h))
        step_g = dt * solver.SDIRK_G
        s = self.gate(h)
        inverse = 1 / (1 + step_g * self.rate)
        u = step_g * self.rate * (self.grow - self.decay) * (s * (1 - s)) * inverse
        u = u / (1 - self.gate_h @ u)
        bad, k = np.zeros(len(event_dt), bool), []
        for row in solver.SDIRK_A:
            base = h + dt * sum((c * x for c, x in zip(row, k)), np.zeros_like(h))
            z = k[-1] if k else self.react(h)
            going = ~bad
            for _ in range(8):
                y = (self.react(base + step_g * z) - z) * inverse
                step = y + u * (self.gate_h @ y)
                z = z + (step if going.all() else np.where(going[self.owner], step, 0.0))
                most = self.most(step)
                bad |= going & ~np.isfinite(most)
                going &= ~bad & ~(most * event_dt < reach)
                if not going.any():
                    break
            k.append(z)
        new = h + dt * sum(c * x for c, x in zip(solver.SDIRK_B, k))
        new[:, bad[self.owner]] = np.nan
        return new, dt * sum((b - c) * x for b, c, x in zip(solver.SDIRK_B, solver.SDIRK_H, k))


def integrate(p: Reacting, h: np.ndarray, span: float, method: str, dt0: float, rtol: float, atol: float, trace: dict[str, np.ndarray], at: np.ndarray, max_steps: int = 4096) -> np.ndarray:
    """solver.integrate() of every event: diffusion by tsit5 or reaction by sdirk4, each event with its own steps. trace: nfe, rejected and converged, counted
    on at the events' places ``at``. Events that are through are set aside, so that they cost nothing while others go on."""
    out, nodes = h.copy(), np.arange(h.shape[1])
    t, dt, last = np.zeros(len(at)), np.full(len(at), float(dt0)), np.ones(len(at))
    order, steps = (4 if method == "sdirk4" else 5), 0
    done = np.zeros(len(at), bool)
    while True:
        done |= ~(t < span * (1 - 1e-12))
        steps += 1
        dt = np.minimum(dt, span - t)
        late = ~done & ((dt < 1e-12 * span) | (steps > max_steps))
        trace["converged"][at[late]] = False
        done |= late
        if done.all():
            out[:, nodes] = h
            return out
        if done.mean() > 0.2:
            out[:, nodes] = h
            keep = ~done
            p, own = p.take(keep)
            h, nodes, at, t, dt, last, done = h[:, own], nodes[own], at[keep], t[keep], dt[keep], last[keep], done[keep]
        new, err = p.implicit_step(h, dt) if method == "sdirk4" else p.explicit_step(h, dt)
        trace["nfe"][at[~done]] += solver.STAGES[method]
        fine = np.isfinite(p.most(new))
        square = (err / (atol + rtol * np.maximum(np.abs(h), np.abs(new)))) ** 2
        e = np.sqrt(np.add.reduceat(square.sum(0), p.start) / (len(h) * np.diff(p.start, append=h.shape[1])))
        good, again = ~done & fine & (e <= 1), ~done & fine & ~(e <= 1)
        trace["rejected"][at[~done & ~good]] += 1
        t = np.where(good, t + dt, t)
        h = np.where(good[p.owner], new, h)
        grown = dt * np.clip(0.9 * np.maximum(e, 1e-10) ** (-0.7 / order) * last ** (0.4 / order), 0.2, 10)
        dt = np.where(good, grown, np.where(again, dt * np.fmax(0.2, 0.9 * e ** (-1 / order)), np.where(done, dt, dt / 4)))
        last = np.where(good, np.maximum(e, 1e-4), last)


def strang(p: Reacting, h: np.ndarray, dt: float = 300.0, steps: int = 12, rtol: float = 1e-4, atol: float = 1e-5) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """solver.strang() of every event; one that does not converge ends after that macro step."""
    many = len(p.start)
    a, b = ({"nfe": np.zeros(many, int), "rejected": np.zeros(many, int), "converged": np.ones(many, bool)} for _ in range(2))
    h = h.copy()
    with np.errstate(all="ignore"):  # what is not finite is refused
        for _ in range(steps):
            live = a["converged"] & b["converged"]
            if not live.any():
                break
            (q, nodes), at = p.take(live), np.flatnonzero(live)
            v = integrate(q, h[:, nodes], dt / 2, "tsit5", dt / 20, rtol, atol, a, at)
            v = integrate(q, v, dt, "sdirk4", dt / 2, rtol, atol, b, at)
            h[:, nodes] = integrate(q, v, dt / 2, "tsit5", dt / 20, rtol, atol, a, at)
    return h, {"nfe_diffusion": a["nfe"], "nfe_reaction": b["nfe"], "nfe_imex_total": a["nfe"] + b["nfe"], "rejected_diff": a["rejected"], "rejected_rxn": b["rejected"], "imex_converged": a["converged"] & b["converged"]}


def accuracy(p: Reacting, h0: np.ndarray, tight: float = 1e-8, loose: float = 1e-3, **kw) -> dict[str, np.ndarray]:
    """solver.accuracy() of every event."""
    ref, a = strang(p, h0, rtol=tight, atol=tight / 10, **kw)
    got, b = strang(p, h0, rtol=loose, atol=loose / 10, **kw)
    norm = lambda v: np.sqrt(np.add.reduceat((v * v).sum(0), p.start))
    return {"nfe_ref": a["nfe_imex_total"], "nfe_train": b["nfe_imex_total"], "nfe_ratio_train_over_ref": b["nfe_imex_total"] / np.maximum(1, a["nfe_imex_total"]), "ref_converged": a["imex_converged"], "train_converged": b["imex_converged"], "eps_int": norm(got - ref) / (norm(ref) + 1e-12)}
