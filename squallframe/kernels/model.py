"""The learned transport model's forward pass: encode regions, diffuse and react, decode to pixels, loss."""

from __future__ import annotations

import numpy as np

from . import raster as R
from . import segment as S


def encode(fused: np.ndarray, labels: np.ndarray, flow: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Positions (x, y), mean features (three, padded with zeros) and mean flow of the regions, and each pixel's region row (unlabelled
    pixels belong to row 0)."""
    ids, cent, _, mean = S.label_means(labels, fused)
    h = np.zeros((len(ids), 3))
    h[:, : min(3, mean.shape[1])] = mean[:, :3]
    row = np.zeros(int(labels.max()) + 1, int)
    row[ids] = np.arange(len(ids))
    return {"x": cent[:, ::-1].copy(), "h": h, "v": S.window_flow(flow, cent, window), "route": row[labels], "ids": ids}


def init_model(seed: int, width: int = 16, hidden: int = 32, state: int = 3, env: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    lin = lambda i, o: r.uniform(-1, 1, (i, o)) / np.sqrt(i)
    p = {"att": lin(state, width), "a": r.uniform(-1, 1, 2 * width) / np.sqrt(width), "flux": lin(state, state), "gate": lin(state + env, 1), "gate_b": np.zeros(1)}
    for n in ("src", "snk"):
        p |= {f"{n}1": lin(state + env, hidden), f"{n}1b": np.zeros(hidden), f"{n}2": lin(hidden, state), f"{n}2b": np.zeros(state)}
    return p


def diffuse(p: dict, x: np.ndarray, h: np.ndarray, k: int = 12, sigma: float = 30.0) -> np.ndarray:
    """Attention over the k nearest other regions, masked by distance."""
    n = len(h)
    if n < 2:
        return np.zeros_like(h)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    idx = np.argsort(d2, axis=1, kind="stable")[:, 1 : min(k + 1, n)]
    q = h @ p["att"]
    m = p["a"].size // 2
    e = (q @ p["a"][:m])[:, None] + (q @ p["a"][m:])[idx]
    e = np.where(e >= 0, e, 0.2 * e) - np.take_along_axis(d2, idx, 1) / (2 * sigma**2)
    e = np.exp(e - e.max(1, keepdims=True))
    alpha = e / e.sum(1, keepdims=True)
    return (alpha[..., None] * ((h[idx] - h[:, None]) @ p["flux"])).sum(1)


def react(p: dict, h: np.ndarray, x: np.ndarray, env: np.ndarray) -> np.ndarray:
    """Gate between source and sink, given the state and the environment at the region's place."""
    e = R.sample(env, x[:, 1], x[:, 0]).reshape(len(h), -1)
    c = np.concatenate([h, e], 1)
    s = 1 / (1 + np.exp(-(c @ p["gate"] + p["gate_b"])))
    net = lambda n: np.tanh(c @ p[f"{n}1"] + p[f"{n}1b"]) @ p[f"{n}2"] + p[f"{n}2b"]
    return s * net("src") - (1 - s) * net("snk")


def forecast(p: dict, code: dict, env: np.ndarray, lead: float, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(positions, features) after ``lead`` frames: positions drift with the initial flow, features follow the classical
    fourth-order Runge-Kutta steps."""
    x, h, dt = code["x"].copy(), code["h"].copy(), lead / steps
    f = lambda xx, hh: diffuse(p, xx, hh) + react(p, hh, xx, env)
    for _ in range(steps):
        k1 = f(x, h)
        mid = x + code["v"] * dt / 2
        k2 = f(mid, h + dt / 2 * k1)
        k3 = f(mid, h + dt / 2 * k2)
        x = x + code["v"] * dt
        k4 = f(x, h + dt * k3)
        h = h + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
    return x, h


def decode(h: np.ndarray, route: np.ndarray, flow: np.ndarray, lead: float) -> np.ndarray:
    """Region features on pixels, carried along the flow for the lead time and clipped to 0..1."""
    return np.clip(R.warp_back(h[route], flow * lead), 0, 1)


def balanced_mse(pred: np.ndarray, target: np.ndarray, threshold: float = 0.1, weight: float = 10.0) -> float:
    """Squared error in which pixels with signal weigh more."""
    w = np.where(target > threshold, weight, 1.0)
    return float((w * (pred - target) ** 2).sum() / w.sum())
