"""Raster kernels on (H, W) arrays."""

from __future__ import annotations

import numpy as np


def minmax(a: np.ndarray) -> np.ndarray:
    lo, hi = float(np.min(a)), float(np.max(a))
    return (a - lo) / (hi - lo) if hi > lo else np.zeros_like(a, float)


def _keys(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Keys' cubic kernel."""
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0.0))


def _cubic_axis(a: np.ndarray, size: int) -> np.ndarray:
    """Cubic resampling along the first axis, pixel centres aligned, border replicated."""
    n = a.shape[0]
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(at).astype(int)
    out = 0.0
    for k in range(-1, 3):
        w = _keys(at - (base + k))
        out = out + a[np.clip(base + k, 0, n - 1)] * w.reshape(-1, *[1] * (a.ndim - 1))
    return out


def resize_cubic(a: np.ndarray, h: int, w: int) -> np.ndarray:
    a = np.asarray(a, float)
    if a.shape[:2] == (h, w):
        return a
    return np.swapaxes(_cubic_axis(np.swapaxes(_cubic_axis(a, h), 0, 1), w), 0, 1)


def resize_nearest(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return a[np.minimum(np.arange(h) * a.shape[0] // h, a.shape[0] - 1)][:, np.minimum(np.arange(w) * a.shape[1] // w, a.shape[1] - 1)]


def grid_linear(gy: np.ndarray, gx: np.ndarray, v: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """Bilinear interpolation on a regular grid with ascending axes."""
    i, j = np.clip(np.searchsorted(gy, y, "right") - 1, 0, len(gy) - 2), np.clip(np.searchsorted(gx, x, "right") - 1, 0, len(gx) - 2)
    a, b = (y - gy[i]) / (gy[i + 1] - gy[i]), (x - gx[j]) / (gx[j + 1] - gx[j])
    got = v[i, j] * (1 - a) * (1 - b) + v[i + 1, j] * a * (1 - b) + v[i, j + 1] * (1 - a) * b + v[i + 1, j + 1] * a * b
    return np.where((y >= gy[0]) & (y <= gy[-1]) & (x >= gx[0]) & (x <= gx[-1]), got, outside)


def grid_nearest(gy: np.ndarray, gx: np.ndarray, v: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """The nearest grid value; the lower index at half way. For categories, which must not be averaged."""
    near = lambda g, p: np.clip(np.searchsorted((g[1:] + g[:-1]) / 2, p, "left"), 0, len(g) - 1)
    return np.where((y >= gy[0]) & (y <= gy[-1]) & (x >= gx[0]) & (x <= gx[-1]), v[near(gy, y), near(gx, x)], outside)


def gaussian(a: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """Separable Gaussian smoothing along the first two axes, border reflected (edge value repeated)."""
    if sigma <= 0:
        return np.asarray(a, float)
    r = int(reach * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.asarray(a, float)
    for axis in (0, 1):
        p = np.moveaxis(np.pad(out, [(r, r) if i == axis else (0, 0) for i in range(out.ndim)], mode="symmetric"), axis, 0)
        out = np.moveaxis(sum(c * p[i : len(p) - 2 * r + i] for i, c in enumerate(k)), 0, axis)
    return out


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude by 3x3 Sobel filters scaled to unit weight, border reflected."""
    p = np.pad(np.asarray(a, float), 1, mode="symmetric")
    s = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    gy = (s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)) / 4
    gx = (s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)) / 4
    return np.sqrt((gy * gy + gx * gx) / 2)


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """mask moved by (dy, dx), False coming in."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    out = np.zeros_like(mask, bool)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                out |= shifted(mask.astype(bool), dy, dx)
    return out


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(labels, areas): connected components numbered from 1 in order of their first pixel, by rows."""
    m = np.asarray(mask, bool)
    h, w = m.shape
    ids = np.arange(h * w).reshape(h, w)
    lab = np.where(m, ids, h * w)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    parent = np.arange(h * w + 1)
    pairs = []
    for dy, dx in steps:
        a = m[: h - dy, max(0, -dx) : w - max(0, dx)] & m[dy:, max(0, dx) : w + min(0, dx)]
        pairs.append(np.stack([ids[: h - dy, max(0, -dx) : w - max(0, dx)][a], ids[dy:, max(0, dx) : w + min(0, dx)][a]], 1))
    e = np.concatenate(pairs)
    while len(e):  # hook the larger root to the smaller and shorten the paths until nothing moves
        a, b = parent[e[:, 0]], parent[e[:, 1]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        go = lo < hi
        if not go.any():
            break
        np.minimum.at(parent, hi[go], lo[go])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        e = e[go]
    roots = parent[np.minimum(lab, h * w)]
    found, labels = np.unique(np.where(m, roots, h * w), return_inverse=True)
    labels = np.where(m, labels.reshape(h, w) + 1, 0).astype(np.int32)
    return labels, np.bincount(labels.ravel(), minlength=int(labels.max()) + 1)[1:]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """mask with the background that does not reach the border (by sides) filled."""
    lab, _ = components(~np.asarray(mask, bool), diagonal=False)
    rim = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    return mask | ((lab > 0) & ~np.isin(lab, rim))


def boundary(labels: np.ndarray, positive: bool = False) -> np.ndarray:
    """Pixels with a 4-neighbour of another label."""
    out = np.zeros(labels.shape, bool)
    d = labels[1:] != labels[:-1]
    out[1:] |= d
    out[:-1] |= d
    d = labels[:, 1:] != labels[:, :-1]
    out[:, 1:] |= d
    out[:, :-1] |= d
    return out & (labels > 0) if positive else out


def thick_boundary(labels: np.ndarray) -> np.ndarray:
    """Pixels whose 3x3 neighbourhood by sides holds more than one label: both sides of every border."""
    return boundary(labels)


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear sample at fractional positions, clamped to the border. a may have channels."""
    h, w = a.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    i, j = np.minimum(np.floor(y).astype(int), max(h - 2, 0)), np.minimum(np.floor(x).astype(int), max(w - 2, 0))
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    fy, fx = y - i, x - j
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return a[i, j] * (1 - fy) * (1 - fx) + a[i1, j] * fy * (1 - fx) + a[i, j1] * (1 - fy) * fx + a[i1, j1] * fy * fx


def warp_back(a: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """a carried along the flow (dx, dy): each pixel is read from where it came from."""
    h, w = a.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    return sample(np.asarray(a, float), y - flow[..., 1], x - flow[..., 0])


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Moving mean of a size x size window, zeros outside, by running sums."""
    r = size // 2
    p = np.pad(np.asarray(a, float), ((r + 1, r), (r + 1, r)))
    c = p.cumsum(0).cumsum(1)
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / (size * size)


def lucas_kanade(before: np.ndarray, after: np.ndarray, window: int = 15, most: float = 15.0) -> np.ndarray:
    """Dense flow (H, W, 2) as (dx, dy) in pixels a frame, clipped: least squares over the window."""
    f = np.asarray(after, float)
    ix, iy = (np.roll(f, -1, 1) - np.roll(f, 1, 1)) / 2, (np.roll(f, -1, 0) - np.roll(f, 1, 0)) / 2
    it = f - np.asarray(before, float)
    xx, yy, xy, xt, yt = (box_mean(v, window) for v in (ix * ix, iy * iy, ix * iy, ix * it, iy * it))
    det = xx * yy - xy * xy + 1e-6
    return np.stack([np.clip((yt * xy - xt * yy) / det, -most, most), np.clip((xt * xy - yt * xx) / det, -most, most)], -1)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dy, dx) by which b is a moved, from the peak of the phase correlation; whole pixels."""
    f = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    c = np.fft.ifft2(f / (np.abs(f) + 1e-12)).real
    dy, dx = np.unravel_index(int(c.argmax()), c.shape)
    h, w = c.shape
    return float(dy - h if dy > h // 2 else dy), float(dx - w if dx > w // 2 else dx)


def patch_flow(before: np.ndarray, after: np.ndarray, centers: np.ndarray, patch: int = 32) -> np.ndarray:
    """(n, 2) flow as (dx, dy) of the patch around each centre (y, x)."""
    h, w = before.shape
    out = np.zeros((len(centers), 2))
    for k, (cy, cx) in enumerate(np.asarray(centers, int)):
        y, x = int(np.clip(cy - patch // 2, 0, max(0, h - patch))), int(np.clip(cx - patch // 2, 0, max(0, w - patch)))
        dy, dx = phase_shift(before[y : y + patch, x : x + patch], after[y : y + patch, x : x + patch])
        out[k] = dx, dy
    return out


def rasterise(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, extent: tuple[float, float, float, float], frames: int, h: int, w: int, step: float = 300.0) -> np.ndarray:
    """Counts (frames, H, W) of points (seconds, lat, lon) in an extent (lon1, lon2, lat1, lat2). Points outside, or without a time,
    are left out. Row 0 is the northern one."""
    x1, x2, y1, y2 = extent
    ok = np.isfinite(t) & np.isfinite(lat) & np.isfinite(lon)
    k = np.floor(np.where(ok, t, 0) / step).astype(int)
    ok &= (lat >= y1) & (lat <= y2) & (lon >= x1) & (lon <= x2) & (k >= 0) & (k < frames)
    y, x = np.minimum(((y2 - lat[ok]) / (y2 - y1) * h).astype(int), h - 1), np.minimum(((lon[ok] - x1) / (x2 - x1) * w).astype(int), w - 1)
    out = np.zeros((frames, h, w))
    np.add.at(out, (k[ok], y, x), 1.0)
    return out


def storm_cells(h: int, w: int, frames: int, seed: int, cells: int = 5) -> np.ndarray:
    """A synthetic event (frames, H, W), 0..255: moving blobs that rise, hold and decay, over faint noise."""
    return storms(h, w, frames, [seed], cells)[0]


def storms(h: int, w: int, frames: int, seeds: list[int], cells: int = 5) -> np.ndarray:
    """(K, frames, H, W): the storm_cells() of each seed."""
    y, x = np.mgrid[:h, :w]
    out, drawn = np.empty((len(seeds), frames, h, w)), np.empty((cells, 8, len(seeds)))
    for k, seed in enumerate(seeds):
        rng = np.random.default_rng(int(seed))
        out[k] = rng.normal(4, 2, (frames, h, w))
        for c in range(cells):
            drawn[c, :, k] = rng.uniform(0.2, 0.8) * h, rng.uniform(0.2, 0.8) * w, *rng.normal(0, 0.01, 2) * (h, w), rng.uniform(0.04, 0.12) * min(h, w), rng.uniform(90, 250), rng.uniform(0, 0.3) * frames, rng.uniform(0.2, 0.5) * frames
    for cy, cx, vy, vx, size, peak, start, hold in drawn[..., None, None]:
        for t in range(frames):
            life = np.clip((t - start) / max(1.0, 0.2 * frames), 0, 1) * np.clip(1 - (t - start - hold) / max(1.0, 0.3 * frames), 0, 1)
            out[:, t] += life * peak * np.exp(-((y - cy - vy * t) ** 2 + (x - cx - vx * t) ** 2) / (2 * size * size))
    return np.clip(out, 0, 255)


def terrain(h: int, w: int, seed: int, hills: int = 4) -> np.ndarray:
    """Synthetic terrain of a few Gaussian hills, scaled to 0..1."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    z = sum(rng.uniform(0.3, 1) * np.exp(-((y - rng.uniform(0, h)) ** 2 + (x - rng.uniform(0, w)) ** 2) / (2 * (rng.uniform(0.1, 0.3) * h) ** 2)) for _ in range(hills))
    return minmax(z)
