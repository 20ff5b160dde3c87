"""Segmentation and tracking kernels: k-means regions, compact watershed, temporal segmenters, assignment, scores."""

from __future__ import annotations

import heapq
import math

import numpy as np

from . import raster as R


def label_means(labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, centroids (n, 2) as y, x, sizes, means (n, C)) of labels above 0."""
    flat = labels.ravel()
    ids, inv = np.unique(flat, return_inverse=True)
    n = np.bincount(inv)
    h, w = labels.shape
    y, x = np.divmod(np.arange(h * w), w)
    v = np.asarray(values, float).reshape(h * w, -1)
    cent = np.stack([np.bincount(inv, y) / n, np.bincount(inv, x) / n], 1)
    mean = np.stack([np.bincount(inv, v[:, c]) / n for c in range(v.shape[1])], 1)
    keep = ids > 0
    return ids[keep], cent[keep], n[keep], mean[keep]


def grid_centers(h: int, w: int, n: int) -> np.ndarray:
    """About n centres (y, x) on a regular grid with spacing sqrt(H W / n)."""
    s = np.sqrt(h * w / n)
    gy, gx = (np.linspace(s / 2, k - s / 2, max(1, round(k / s))) for k in (h, w))
    return np.stack(np.meshgrid(gy, gx, indexing="ij"), -1).reshape(-1, 2)


def kmeans_regions(feat: np.ndarray, n: int, kappa: float = 0.1, rounds: int = 10, centers: np.ndarray | None = None, windowed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 1, centres (k, 2) as y, x): k-means in [features / kappa, x / S, y / S] from a grid or given centres, for a fixed
    number of rounds. windowed limits a centre to pixels within 2 S, as published for SLIC; a pixel out of every reach keeps the
    nearest centre overall. Distances are taken for a block of rows at a time."""
    h, w = feat.shape[:2]
    f = np.asarray(feat, float).reshape(h * w, -1) / kappa
    s = np.sqrt(h * w / n)
    y, x = np.divmod(np.arange(h * w), w)
    px = np.column_stack([f, x / s, y / s])
    start = grid_centers(h, w, n) if centers is None else np.asarray(centers, float)
    at = np.clip(start[:, 0].astype(int), 0, h - 1) * w + np.clip(start[:, 1].astype(int), 0, w - 1)
    cent = px[at]
    lab = np.zeros(h * w, int)
    block = max(1, int(4e6 // max(1, len(cent))))
    for _ in range(rounds):
        for i in range(0, h * w, block):
            p = px[i : i + block]
            d = (p * p).sum(1)[:, None] - 2 * p @ cent.T + (cent * cent).sum(1)
            if windowed:
                far = np.abs(p[:, None, -2:] - cent[None, :, -2:]).max(2) > 2
                d = np.where(far, d + 1e9, d)
            lab[i : i + block] = d.argmin(1)
        count = np.bincount(lab, minlength=len(cent))
        sums = np.stack([np.bincount(lab, px[:, c], len(cent)) for c in range(px.shape[1])], 1)
        cent = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], cent)
    return (lab + 1).reshape(h, w).astype(np.int32), np.stack([cent[:, -1] * s, cent[:, -2] * s], 1)


def watershed(height: np.ndarray, markers: np.ndarray, compactness: float = 0.0, mask: np.ndarray | None = None) -> np.ndarray:
    """Flood from the markers in order of height, plus compactness times the distance to the marker; earlier markers win ties.
    Pixels outside the mask stay 0."""
    h, w = height.shape
    mark = np.pad(np.asarray(markers, np.int32) if mask is None else np.where(mask, markers, 0), 1)
    wide = w + 2
    blocked = np.pad(np.zeros((h, w), bool) if mask is None else ~mask, 1, constant_values=True) | (mark > 0)
    # Plain lists over a frame with a rim: the flood takes one pixel at a time and no bounds are tested.
    lab, closed, z = mark.ravel().tolist(), blocked.ravel().tolist(), np.pad(np.asarray(height, float), 1).ravel().tolist()
    seeds = np.flatnonzero(mark.ravel()).tolist()
    heap = [(z[k], age, k, k) for age, k in enumerate(seeds)]
    heapq.heapify(heap)
    age, pop, push = len(heap), heapq.heappop, heapq.heappush
    steps = (-wide, -1, 1, wide)
    while heap:
        _, _, k, seed = pop(heap)
        own = lab[k]
        sy, sx = divmod(seed, wide)
        for d in steps:
            j = k + d
            if not closed[j]:
                closed[j] = True
                lab[j] = own
                age += 1
                cost = z[j]
                if compactness:
                    y, x = divmod(j, wide)
                    cost += compactness * math.hypot(y - sy, x - sx)
                push(heap, (cost, age, j, seed))
    return np.array(lab, np.int32).reshape(h + 2, wide)[1:-1, 1:-1].copy()


def edge_height(fused: np.ndarray, dem: np.ndarray | None = None, weight: float = 0.1) -> np.ndarray:
    """The largest Sobel magnitude over channels and weighted terrain."""
    layers = [R.sobel(fused[..., c]) for c in range(fused.shape[-1])]
    if dem is not None:
        layers.append(R.sobel(dem * weight))
    return np.max(layers, axis=0)


def window_flow(flow: np.ndarray, centers: np.ndarray, win: int = 5) -> np.ndarray:
    """(n, 2) mean flow (dx, dy) in the half-open window around each centre, from a summed-area table."""
    h, w = flow.shape[:2]
    s = np.zeros((h + 1, w + 1, 2))
    s[1:, 1:] = flow.cumsum(0).cumsum(1)
    y, x = np.clip(centers[:, 0].astype(int), 0, h - 1), np.clip(centers[:, 1].astype(int), 0, w - 1)
    y0, y1, x0, x1 = np.maximum(0, y - win), np.minimum(h, y + win), np.maximum(0, x - win), np.minimum(w, x + win)
    return (s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]) / ((y1 - y0) * (x1 - x0))[:, None]


class TemporalSegmenter:
    """Regions that follow the flow: k-means on the first frame, then centroids moved by the flow as markers of a compact
    watershed. Its state is small (labels' centroids and the last frame), so that it can live in a streaming operator."""

    def __init__(self, n: int, dem: np.ndarray | None = None, compactness: float = 0.1, dem_weight: float = 0.1):
        self.n, self.dem, self.compactness, self.dem_weight = n, dem, compactness, dem_weight
        self.last: np.ndarray | None = None
        self.ids = self.centers = None

    def step(self, fused: np.ndarray, flow: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(labels, flow into this frame); the flow is zero on the first frame. Of centroids that meet on one pixel the last id
        stays."""
        h, w = fused.shape[:2]
        if self.last is None:
            flow = np.zeros((h, w, 2))
            extra = [] if self.dem is None else [(self.dem * self.dem_weight)[..., None]]
            labels, _ = kmeans_regions(np.concatenate([fused, *extra], -1), self.n)
        else:
            if flow is None:
                flow = R.lucas_kanade(self.last, fused[..., 0])
            moved = self.centers + window_flow(flow, self.centers)[:, ::-1]
            marks = np.zeros((h, w), np.int32)
            marks[np.clip(moved[:, 0], 0, h - 1).astype(int), np.clip(moved[:, 1], 0, w - 1).astype(int)] = self.ids
            labels = watershed(edge_height(fused, self.dem, self.dem_weight), marks, self.compactness)
        self.ids, self.centers, _, _ = label_means(labels, fused)
        self.last = fused[..., 0].copy()
        return labels, flow


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a one-to-one assignment of least total cost, -1 for rows left over: shortest augmenting paths
    (Jonker and Volgenant)."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.full(cost.shape[0], -1)
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j0, best, used, way = 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = owner[j0]
            slack = c[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < best[1:])
            best[1:][better] = slack[better]
            way[1:][better] = j0
            free = np.where(used[1:], np.inf, best[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            best[1:][~used[1:]] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0] = owner[j1]
            j0 = j1
    col = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            col[owner[j] - 1] = j - 1
    if not flip:
        return col
    out = np.full(m, -1)
    out[col[col >= 0]] = np.flatnonzero(col >= 0)
    return out


def track(old_ids: np.ndarray, old: np.ndarray, new: np.ndarray, flow: np.ndarray, limit: float = 15.0) -> np.ndarray:
    """Ids of the new centroids: those of the old ones, moved by the flow at their pixel, in the best assignment and nearer than
    the limit; others count on from the largest old id, in order."""
    h, w = flow.shape[:2]
    out = np.full(len(new), -1, int)
    if len(old) and len(new):
        at = flow[np.clip(old[:, 0].astype(int), 0, h - 1), np.clip(old[:, 1].astype(int), 0, w - 1)]
        moved = old + at[:, ::-1]
        d = np.hypot(moved[:, None, 0] - new[None, :, 0], moved[:, None, 1] - new[None, :, 1])
        for i, j in enumerate(assign(d)):
            if j >= 0 and d[i, j] < limit:
                out[j] = old_ids[i]
    top = int(np.max(old_ids)) if len(old_ids) else 0
    fresh = np.flatnonzero(out < 0)
    out[fresh] = top + 1 + np.arange(len(fresh))
    return out


def nearest_set(mask: np.ndarray) -> np.ndarray:
    """(H, W) squared distance of every pixel to the nearest one of the mask, infinite without any: along columns by running
    minima, then along rows over all columns."""
    h, w = mask.shape
    y = np.arange(h, dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(mask, y, -np.inf), 0)
    below = np.minimum.accumulate(np.where(mask, y, np.inf)[::-1], 0)[::-1]
    column = np.minimum(y - above, below - y) ** 2
    across = (np.arange(w, dtype=float)[:, None] - np.arange(w)) ** 2
    return np.stack([(across + row).min(1) for row in column])


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Symmetric Hausdorff distance of two masks; 0 if both are empty, infinite if one is."""
    a, b = np.asarray(a, bool), np.asarray(b, bool)
    if not a.any() or not b.any():
        return 0.0 if a.any() == b.any() else float("inf")
    return float(np.sqrt(max(nearest_set(b)[a].max(), nearest_set(a)[b].max())))


def edge_recall(labels: np.ndarray, frame: np.ndarray, threshold: float = 0.1) -> float:
    """The share of a frame's strong edges that lie on the inner side of region borders; 1 if there are none. Edges are those of
    the frame over its own maximum, so that weak frames have theirs too."""
    strong = R.sobel(frame / (frame.max() + 1e-6)) > threshold
    return float((strong & R.boundary(labels) & (labels != 0)).sum() / strong.sum()) if strong.any() else 1.0


def intra_variance(labels: np.ndarray, values: np.ndarray) -> float:
    """Population variance within labels of more than one pixel, averaged over labels and channels."""
    _, _, n, mean = label_means(labels, values)
    _, _, _, square = label_means(labels, np.asarray(values, float) ** 2)
    var = np.maximum(square - mean**2, 0)[n > 1]
    return float(var.mean(0).mean()) if len(var) else 0.0


def sequence_flows(frames: np.ndarray) -> list[np.ndarray]:
    """The flow into each of (T, H, W, C) frames, zero into the first: the same for every number of regions."""
    return [np.zeros((*frames.shape[1:3], 2)), *(R.lucas_kanade(a[..., 0], b[..., 0]) for a, b in zip(frames, frames[1:]))][: len(frames)]


def score_sequence(frames: np.ndarray, n: int, dem: np.ndarray | None = None, flow_align: str = "correct", flows: list[np.ndarray] | None = None) -> dict:
    """Segment (T, H, W, C) frames into about n regions and score them: the metrics of one sweep row. flow_align "legacy" pairs
    frames t and t + 1 with the flow into t, "correct" with the flow between them. flows: sequence_flows(), if already known."""
    seg = TemporalSegmenter(n, dem)
    flows = sequence_flows(frames) if flows is None else flows
    labels = [seg.step(f, flow)[0] for f, flow in zip(frames, flows)]
    fae, bdv, ged, mdv = [], [], [], []
    ids, cent, _, _ = label_means(labels[0], frames[0])
    names, paths = ids.copy(), {int(i): [m] for i, m in zip(ids, label_means(labels[0], frames[0])[3])}
    for t in range(len(frames) - 1):
        flow = flows[t + 1] if flow_align == "correct" else flows[t]
        ids1, cent1, _, mean1 = label_means(labels[t + 1], frames[t + 1])
        common, i, j = np.intersect1d(ids, ids1, return_indices=True)
        if len(common):
            under = label_means(labels[t], flow)[3][i]
            fae.append(float(np.hypot(cent1[j, 1] - cent[i, 1] - under[:, 0], cent1[j, 0] - cent[i, 0] - under[:, 1]).mean()))
        bdv.append(hausdorff(R.warp_back(R.boundary(labels[t]).astype(float), flow) > 0.5, R.boundary(labels[t + 1])))
        union = np.union1d(ids, ids1)
        ged.append((len(union) - len(common)) / max(1, len(union)))
        residual = np.sqrt(((frames[t + 1] - R.warp_back(frames[t], flow)) ** 2).sum(-1))
        _, _, size, m1 = label_means(labels[t + 1], residual)
        m2 = label_means(labels[t + 1], residual**2)[3]
        var, big = np.maximum(m2 - m1**2, 0)[:, 0], size > 1
        mdv.append(float((var[big] * size[big]).sum() / size[big].sum()) if big.any() else 0.0)
        names = track(names, cent, cent1, flow)
        for k, m in zip(names, mean1):
            paths.setdefault(int(k), []).append(m)
        ids, cent = ids1, cent1
    steps = [float(np.linalg.norm(np.diff(np.array(p), axis=0), axis=1).mean()) for p in paths.values() if len(p) > 1]
    recall = [edge_recall(lab, f[..., 0]) for lab, f in zip(labels, frames)]
    isv = [intra_variance(lab, f) for lab, f in zip(labels, frames)]
    mean = lambda v: float(np.mean(v)) if len(v) else 0.0
    return {
        "N": n, "actual_N": len(np.unique(labels[0][labels[0] > 0])), "FAE": mean(fae), "BDV": mean([b for b in bdv if np.isfinite(b)]), "GED": mean(ged), "MDV": mean(mdv), "LFS": mean(steps),
        "intra_sp_var_mean": mean(isv), "intra_sp_var_std": float(np.std(isv)), "boundary_recall_mean": mean(recall), "temporal_br_std": float(np.std(recall)),
    }


def die(centers: np.ndarray, fused: np.ndarray, least: float = 0.05) -> np.ndarray:
    """The centres at which some channel is at least so strong."""
    h, w = fused.shape[:2]
    if not len(centers):
        return np.empty((0, 2))
    peak = fused[np.clip(centers[:, 0].astype(int), 0, h - 1), np.clip(centers[:, 1].astype(int), 0, w - 1)].max(-1)
    return centers[peak >= least]


def be_born(centers: np.ndarray, fused: np.ndarray, residual: np.ndarray, above: float = 0.15, spacing: float = 20.0, least: float = 0.05) -> np.ndarray:
    """centres with one more for each blob of high residual that has signal and lies far enough from all before it, in order of
    the blobs' first pixels."""
    blobs, _ = R.components(residual > above)
    out = [tuple(c) for c in centers]
    for b in range(1, int(blobs.max()) + 1):
        inside = blobs == b
        if fused[inside].max() < least:
            continue
        cy, cx = np.argwhere(inside).mean(0)
        if out and np.hypot(np.array(out)[:, 0] - cy, np.array(out)[:, 1] - cx).min() < spacing:
            continue
        out.append((float(cy), float(cx)))
    return np.array(out, float).reshape(-1, 2)


def adaptive_step(centers: np.ndarray | None, before: np.ndarray | None, fused: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of the adaptive segmenter: centres move by the mean flow of their neighbourhood, die in empty places and are
    born where the moved frame does not explain the new one; a compact watershed from the centres gives the regions."""
    h, w = fused.shape[:2]
    if centers is None:
        labels, centers = kmeans_regions(fused, n)
        return labels, centers
    flow = R.lucas_kanade(before[..., 0], fused[..., 0])
    moved = centers + window_flow(flow, centers)[:, ::-1] if len(centers) else centers
    moved = np.clip(moved, 0, (h - 1, w - 1))
    residual = np.abs(fused - R.warp_back(before, flow)).max(-1)
    centers = be_born(die(moved, fused), fused, residual)
    marks = np.zeros((h, w), np.int32)
    for k, (y, x) in enumerate(centers, 1):
        marks[int(y), int(x)] = k
    return watershed(edge_height(fused), marks, 0.1), centers


def peaks(a: np.ndarray, spacing: int, least: float) -> np.ndarray:
    """(k, 2) local maxima at least so high and so far apart, the highest first."""
    cand = np.argwhere(a >= least)
    cand = cand[np.argsort(-a[tuple(cand.T)], kind="stable")] if len(cand) else cand
    out: list[np.ndarray] = []
    for c in cand:
        if all(max(abs(c - o)) > spacing for o in out):
            y, x = c
            if a[y, x] >= a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max():
                out.append(c)
    return np.array(out, int).reshape(-1, 2)


def threshold_cells(smooth: np.ndarray, level: float, n_max: int, split: bool = False, spacing: int = 5) -> np.ndarray:
    """Cells above a level: holes filled, components of at least H W / n_max pixels, numbered anew; split divides cells with several
    peaks by watershed."""
    mask = R.fill_holes(smooth > level)
    lab, area = R.components(mask)
    big = np.flatnonzero(area >= smooth.size / n_max) + 1
    out = np.zeros_like(lab)
    for k, b in enumerate(big, 1):
        out[lab == b] = k
    if split:
        for b in range(1, int(out.max()) + 1):
            inside = out == b
            top = peaks(np.where(inside, smooth, -np.inf), spacing, level)
            if len(top) > 1:
                marks = np.zeros_like(out)
                marks[tuple(top.T)] = np.arange(1, len(top) + 1)
                parts = watershed(-smooth, marks, 0.0, inside)
                out[inside & (parts > 1)] = parts[inside & (parts > 1)] + out.max() - 1
    return out


def nested_cells(vil: np.ndarray, sigma: float = 1.0, n_max: int = 2000, levels: tuple[float, ...] = (4.4, 20.3, 36.5)) -> dict[str, np.ndarray]:
    """Cells at three levels of one smoothed field; a higher level lies inside a lower one."""
    smooth = R.gaussian(vil, sigma)
    return {name: threshold_cells(smooth, level, n_max) for name, level in zip(("low", "med", "high"), levels)}


def sigma_sweep(vil: np.ndarray, level: float, n_max: int, sigmas: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0)) -> list[tuple[float, int, int]]:
    """(sigma, cells, pixels) of a level for several smoothings."""
    out = []
    for s in sigmas:
        c = threshold_cells(R.gaussian(vil, s), level, n_max)
        out.append((s, int(c.max()), int((c > 0).sum())))
    return out


def best_cells(cells: np.ndarray, regions: np.ndarray) -> tuple[float, float, int]:
    """(mean IoU, area-weighted mean IoU, cells): one-to-one match of cells and regions with the largest total IoU; unmatched
    cells count 0."""
    k = int(cells.max())
    if k == 0:
        return 0.0, 0.0, 0
    cand = np.unique(regions[(cells > 0) & (regions > 0)])
    iou = np.zeros((k, len(cand)))
    area = np.bincount(cells.ravel(), minlength=k + 1)[1:]
    for j, r in enumerate(cand):
        both = np.bincount(cells[regions == r], minlength=k + 1)[1:]
        iou[:, j] = both / (area + (regions == r).sum() - both + 1e-8)
    got = assign(-iou)
    per = np.array([iou[i, j] if j >= 0 else 0.0 for i, j in enumerate(got)])
    return float(per.mean()), float((per * area).sum() / area.sum()), k


def boundary_score(cell: np.ndarray, region: np.ndarray, mask: np.ndarray, tolerance: int = 0, margin: int = 5) -> tuple[float, float, float]:
    """(precision, recall, F1) of region borders against cell borders."""
    if margin <= tolerance:
        raise ValueError("the margin must exceed the tolerance")
    roi = R.dilate(mask, margin)
    p = (region & R.dilate(cell, tolerance)).sum() / ((region & roi).sum() + 1e-8)
    r = (cell & R.dilate(region, tolerance)).sum() / (cell.sum() + 1e-8)
    return float(p), float(r), float(2 * p * r / (p + r + 1e-8))


# Weights of the levels in scheme F.
FIXED_WEIGHTS = {"low": 0.20, "med": 0.30, "high": 0.50}


def level_weights(cells: dict[str, np.ndarray], grad: np.ndarray) -> dict[str, dict[str, float]]:
    """Weights of the active levels by mean border gradient (G), by the inverse of the number of border pixels (P) and by fixed
    shares (F); each scheme sums to one, and is even where it has nothing to go by."""
    borders = {k: R.boundary(c, True) for k, c in cells.items() if c.max() > 0}
    raw = {
        "G": {k: float(grad[b].mean()) if b.any() else 0.0 for k, b in borders.items()},
        "P": {k: 1 / (float(b.sum()) + 1e-8) for k, b in borders.items()},
        "F": {k: FIXED_WEIGHTS[k] for k in borders},
    }
    total = {scheme: sum(w.values()) for scheme, w in raw.items()}
    return {scheme: {k: v / total[scheme] if total[scheme] else 1 / len(borders) for k, v in w.items()} for scheme, w in raw.items()}


def evaluate(vil: np.ndarray, regions: np.ndarray, sigma: float = 1.0, n_max: int = 2000, tolerance: int = 0, margin: int = 5) -> dict:
    """Boundary scores in three stages and per level, IoU per level and composites by the weight schemes."""
    cells = nested_cells(vil, sigma, n_max)
    region = R.boundary(regions)
    out: dict = {"zero_cell": bool(cells["low"].max() == 0), "active_levels": ",".join(k for k, c in cells.items() if c.max() > 0)}
    low = R.boundary(cells["low"], True)
    nested = np.logical_or.reduce([R.boundary(c, True) for c in cells.values()])
    every = np.ones_like(low)
    out["f1_stage0"] = boundary_score(low, region, every, tolerance, margin)[2]
    p, r, f = boundary_score(low, region, cells["low"] > 0, tolerance, margin)
    out |= {"precision_roi": p, "recall": r, "f1_stage1": f, "f1_nested": boundary_score(nested, region, cells["low"] > 0, tolerance, margin)[2]}
    if out["zero_cell"]:
        return {k: 0.0 if isinstance(v, float) else v for k, v in out.items()} | {f"f1_multi_{s}": 0.0 for s in "GPF"}
    per = {}
    for k, c in cells.items():
        miou, weighted, n = best_cells(c, regions)
        per[k] = boundary_score(R.boundary(c, True), region, c > 0, tolerance, margin)[2] if n else 0.0
        out |= {f"f1_{k}": per[k], f"miou_{k}": miou, f"miou_weighted_{k}": weighted, f"n_instances_{k}": n}
    gy, gx = np.gradient(R.gaussian(vil, sigma))
    for scheme, ws in level_weights(cells, np.hypot(gy, gx)).items():
        out[f"f1_multi_{scheme}"] = float(sum(w * per[k] for k, w in ws.items()))
    return out


def distortion_elbow(points: np.ndarray, k_max: int = 6) -> int:
    """Number of clusters at the elbow of the k-means distortion curve of (n, d) points."""
    ks, loss = [], []
    for k in range(1, min(k_max, len(points)) + 1):
        c = points[np.linspace(0, len(points) - 1, k).astype(int)]
        for _ in range(10):
            lab = ((points[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([points[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
        ks.append(k)
        loss.append(float(((points - c[lab]) ** 2).sum()))
    if len(ks) < 3:
        return ks[-1] if ks else 1
    p = np.column_stack([ks, loss]).astype(float)
    p = (p - p.min(0)) / (np.ptp(p, axis=0) + 1e-12)
    d = p[-1] - p[0]
    d /= np.linalg.norm(d) + 1e-12
    v = p - p[0]
    return ks[int(np.linalg.norm(v - np.outer(v @ d, d), axis=1).argmax())]


def split_regions(regions: np.ndarray, frame: np.ndarray, k_max: int = 6) -> tuple[np.ndarray, dict[int, int]]:
    """(fine labels, {fine: parent}): each region divided at its peaks, as many as the distortion elbow asks for."""
    fine, parent, top = np.zeros_like(regions), {}, 0
    for r in np.unique(regions[regions > 0]):
        inside = regions == r
        pts = np.argwhere(inside)
        scale = np.sqrt(len(pts))
        k = distortion_elbow(np.column_stack([pts / scale, frame[inside]]), k_max)
        seeds = peaks(np.where(inside, frame, -np.inf), 1, -1e300)[:k]
        marks = np.zeros_like(regions)
        marks[tuple(seeds.T)] = np.arange(1, len(seeds) + 1)
        part = watershed(-frame, marks, 0.0, inside)
        part[inside & (part == 0)] = 1
        fine[inside] = part[inside] + top
        for i in range(1, int(part.max()) + 1):
            parent[top + i] = int(r)
        top += int(part.max())
    return fine, parent
