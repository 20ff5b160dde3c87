"""Frame operators: NumPy kernels run per event by grouped Arrow functions. The unit of work is one event (or event and region
count), never a frame of a sequence, since regions depend on the frames before."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import expressions as X
from ..kernels import batched, model, raster, segment, solver
from .decision import with_joint

SWEEP_OUT = "event_id string, N int, actual_N int, FAE double, BDV double, GED double, MDV double, LFS double, intra_sp_var_mean double, intra_sp_var_std double, boundary_recall_mean double, temporal_br_std double, runtime_s double, _pixels int"


def synthetic_frames(events: DataFrame, side: int = 32, frames: int = 6) -> DataFrame:
    """Frames (event_id, channel, t, h, w, data) of synthetic storms for (event_id, seed): a radar channel and two infrared ones of half
    the side that follow it. Made where they are needed; nothing is collected."""

    half = len(range(0, side, 2))
    planes = [(name, t, n) for name, n in (("vil", side), ("ir107", half), ("ir069", half)) for t in range(frames)]
    some = max(1, 1_000_000 // max(1, frames * side * side))  # events at a time

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, some):
                b = whole.slice(i, some)
                vil = raster.storms(side, side, frames, b.column("seed").to_pylist())
                k = len(vil)
                small = np.moveaxis(raster.gaussian(np.moveaxis(vil, (2, 3), (0, 1)), 1.0)[::2, ::2], (0, 1), (2, 3))
                values = np.concatenate([v.reshape(k, -1).astype(np.float32) for v in (vil, 250 - 0.4 * small, 250 - 0.5 * small)], 1)
                each = lambda column, kind: pa.array([p[column] for p in planes] * k, kind)  # noqa: E731, B023
                offsets = np.concatenate([[0], np.cumsum([n * n for _, _, n in planes] * k)]).astype(np.int32)
                columns = [b.column("event_id").take(pa.array(np.repeat(np.arange(k), len(planes)))), each(0, pa.string()), each(1, pa.int32()), each(2, pa.int32()), each(2, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["event_id", "channel", "t", "h", "w", "data"])

    return events.select("event_id", "seed").mapInArrow(run, "event_id string, channel string, t int, h int, w int, data array<float>")


CHANNELS = ("vil", "ir107", "ir069")


def stack(pdf: pd.DataFrame, channels: tuple[str, ...] = CHANNELS) -> np.ndarray | None:
    """(T, H, W, C) of one event: channels scaled by their own range over all frames and resized to the first one's grid; a missing
    further channel is zeros, a missing first one gives None."""
    first = pdf[pdf["channel"] == channels[0]].sort_values("t")
    if first.empty:
        return None
    h, w, times = int(first["h"].iloc[0]), int(first["w"].iloc[0]), first["t"].tolist()
    out = np.zeros((len(times), h, w, len(channels)))
    for c, name in enumerate(channels):
        rows = pdf[pdf["channel"] == name].set_index("t")
        if rows.empty:
            continue
        cube = np.stack([raster.resize_cubic(np.asarray(rows.loc[t, "data"], float).reshape(int(rows.loc[t, "h"]), int(rows.loc[t, "w"])), h, w) if t in rows.index else np.zeros((h, w)) for t in times])
        out[..., c] = raster.minmax(cube)
    return out


def stacks(rows: pa.Table, channels: tuple[str, ...] = CHANNELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(rows, cubes (K, T, H, W, C))]: the stack() of every event of a table in which an event's rows lie together, and a row of
    each event. Events with frames of the same channels, times and sizes are made at once; those without the first channel are
    left out."""
    ids = rows.column("event_id").to_pylist()
    event = np.cumsum([k > 0 and a != b for k, (a, b) in enumerate(zip(ids, [None, *ids]))])
    number = {name: c for c, name in enumerate(channels)}
    shape = np.stack([np.array([number.get(v, -1) for v in rows.column("channel").to_pylist()], np.int64), *(rows.column(c).to_numpy().astype(np.int64) for c in ("t", "h", "w"))], 1)
    order = np.lexsort((shape[:, 1], shape[:, 0], event))
    order = order[shape[order, 0] >= 0]
    shape, event = shape[order], event[order]
    data = rows.column("data").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    offsets, values = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
    begin, length = offsets[:-1][order], np.diff(offsets)[order]
    if (length != shape[:, 2] * shape[:, 3]).any():
        raise ValueError("a frame's data does not have h times w values")
    alike: dict[bytes, list[int]] = {}
    first = np.flatnonzero(np.diff(event, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(event))):
        if shape[a, 0] == 0:
            alike.setdefault(shape[a:b].tobytes(), []).append(int(a))
    out = []
    for kind, at in alike.items():
        plan, at = np.frombuffer(kind, np.int64).reshape(-1, 4), np.array(at)
        h, w = (int(v) for v in plan[0, 2:])
        times = plan[plan[:, 0] == 0, 1].tolist()
        if len({(c, t) for c, t, _, _ in plan.tolist()}) < len(plan):
            raise ValueError("an event has two frames of one channel and time")
        cubes = np.zeros((len(at), len(times), h, w, len(channels)))
        for c in range(len(channels)):
            cube = np.zeros((len(times), h, w, len(at)))
            for r, (_, t, hr, wr) in enumerate(plan.tolist()):
                if plan[r, 0] == c and t in times:
                    cube[times.index(t)] = raster.resize_cubic(values[begin[at + r] + np.arange(hr * wr)[:, None]].reshape(hr, wr, -1), h, w)
            lo, hi = cube.min((0, 1, 2)), cube.max((0, 1, 2))
            cubes[..., c] = np.moveaxis(np.where(hi > lo, (cube - lo) / np.where(hi > lo, hi - lo, 1), 0.0), -1, 0)
        out.append((order[at], cubes))
    return out


def whole_events(batches) -> Iterator[pa.Table]:
    """Batches in which an event's rows follow each other as tables in which no event is divided: the last event of a batch waits for the next batch."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("event_id").to_pylist()
        cut = ids.index(ids[-1])
        if cut or kept and kept[0].column("event_id")[0].as_py() != ids[-1]:
            yield pa.Table.from_batches([*kept, b.slice(0, cut)])
            kept = []
        kept.append(b.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def map_stacks(frames: DataFrame, run, ddl: str) -> DataFrame:
    """A row for each dict that run(event ids, numbers of regions, cubes) gives, the cubes being those of stacks(): as grouping by
    event_id, but for as many events at a time as a batch holds. frames: of pending_counts()."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def rows_of(batches):
        for table in whole_events(batches):
            ids, counts = table.column("event_id"), table.column("_n")
            for rows, cubes in stacks(table):
                by_counts: dict[tuple, list[int]] = {}
                for k, n in enumerate(counts.take(pa.array(rows)).to_pylist()):
                    by_counts.setdefault(tuple(n), []).append(k)
                for n_of, at in by_counts.items():
                    got = run(ids.take(pa.array(rows[at])).to_pylist(), n_of, cubes[at])
                    for pdf in got:
                        yield pa.RecordBatch.from_pandas(pdf[names], schema=schema, preserve_index=False)

    # A window brings an event's rows together like groupBy: it uses the partitions of a join before it, and skewed ones stay whole.
    frames = frames.withColumn("_k", F.row_number().over(Window.partitionBy("event_id").orderBy("t")))
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return frames.mapInArrow(rows_of, ddl)


def pending_counts(frames: DataFrame, counts: list[int], done: DataFrame | None) -> DataFrame:
    """frames with ``_n``, the numbers of regions that each event still needs: all, or those that ``done`` (event_id, N) lacks.
    Finished events lose their frames before the shuffle."""
    every = F.array(*[F.lit(int(n)) for n in counts])
    if done is None:
        return frames.withColumn("_n", every)
    made = done.groupBy("event_id").agg(F.collect_set("N").alias("_made"))  # at most as many as there are counts
    left = frames.join(made, "event_id", "left").withColumn("_n", F.array_except(every, F.coalesce("_made", F.array().cast("array<int>"))))
    return left.where(F.size("_n") > 0).drop("_made")


def sweep_regions(frames: DataFrame, counts: list[int], flow_align: str = "correct", done: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """The sweep table: every event segmented into each number of regions and scored. Events run in parallel; a task stacks the
    frames of one event and takes their flows once, for all numbers. An event without the radar channel gives no rows. done:
    finished (event_id, N), which are left out; classes: event_id, lifecycle_class. J_imex is null for fewer than three numbers."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cube, rows = stack(pdf), []
        if cube is not None and len(cube):
            began = time.perf_counter()
            flows = segment.sequence_flows(cube)
            shared = (time.perf_counter() - began) / len(pdf["_n"].iloc[0])
            for n in pdf["_n"].iloc[0]:
                began = time.perf_counter()
                row = segment.score_sequence(cube, int(n), flow_align=flow_align, flows=flows)
                rows.append({"event_id": key[0]} | row | {"N": int(n), "runtime_s": time.perf_counter() - began + shared, "_pixels": cube.shape[1] * cube.shape[2]})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SWEEP_OUT.split(", ")])

    got = pending_counts(frames, counts, done).groupBy("event_id").applyInPandas(run, SWEEP_OUT)
    edges = X.super_edges(F.col("actual_N"))
    got = got.withColumn("E_super_est", edges).withColumn("VRAM_est_MB", X.edge_memory_mb(edges)).withColumn("avg_sp_area", F.col("_pixels") / F.col("actual_N")).drop("_pixels")
    kind = None if classes is None else "lifecycle_class"
    if classes is not None:
        got = got.join(classes, "event_id", "left")
    return with_joint(got, ["event_id"], kind) if len(counts) >= 3 else got.withColumn("J_imex", F.lit(None).cast("double"))


def sweep_counts(frames: DataFrame, counts: list[int], done: DataFrame | None = None) -> DataFrame:
    """event_id, N and actual_N of sweep_regions() without its scores. These follow from the first frame's regions, scaled by all
    frames, so that no flow is taken and no later frame is segmented; for many events at a time."""

    def run(ids, counts, cubes):
        for n in counts:
            labels = np.sort(batched.kmeans_regions(cubes[:, 0], n).reshape(len(ids), -1), 1)
            yield pd.DataFrame({"event_id": ids, "N": n, "actual_N": 1 + (np.diff(labels) > 0).sum(1)})

    return map_stacks(pending_counts(frames, counts, done), run, "event_id string, N int, actual_N int")


def frame_components(frames: DataFrame, channel: str = "vil", noise: float = 20.0) -> DataFrame:
    """(event_id, t, n_cells, max_area, active, mass) of each frame, row by row."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for e, t, h, w, d in zip(pdf["event_id"], pdf["t"], pdf["h"], pdf["w"], pdf["data"]):
                a = np.asarray(d, float).reshape(h, w)
                _, area = raster.components(a > noise)
                rows.append((e, t, len(area), int(area.max()) if len(area) else 0, float((a > noise).mean()), float(a[a > noise].sum())))
            yield pd.DataFrame(rows, columns=["event_id", "t", "n_cells", "max_area", "active", "mass"])

    return frames.where(F.col("channel") == channel).select("event_id", "t", "h", "w", "data").mapInPandas(run, "event_id string, t int, n_cells int, max_area int, active double, mass double")


def lightning_channel(frames: DataFrame, most: float, sigma: float) -> DataFrame:
    """(event_id, t, total, most) of frames of flash counts, clipped and smoothed, row by row."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for e, t, h, w, d in zip(pdf["event_id"], pdf["t"], pdf["h"], pdf["w"], pdf["data"]):
                a = raster.gaussian(np.clip(np.asarray(d, float).reshape(h, w), 0, most), sigma)
                rows.append((e, t, float(a.sum()), float(a.max())))
            yield pd.DataFrame(rows, columns=["event_id", "t", "total", "most"])

    return frames.select("event_id", "t", "h", "w", "data").mapInPandas(run, "event_id string, t int, total double, most double")


def segment_events(frames: DataFrame, n: int, method: str = "temporal") -> DataFrame:
    """(event_id, t, label array<int>, h, w): the label maps of each event's frames by the temporal or the adaptive segmenter."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cube = stack(pdf)
        rows = []
        if cube is not None:
            seg, centers, before = segment.TemporalSegmenter(n), None, None
            for t, f in enumerate(cube):
                if method == "adaptive":
                    labels, centers = segment.adaptive_step(centers, before, f, n)
                    before = f
                else:
                    labels, _ = seg.step(f)
                rows.append((key[0], t, labels.ravel().astype(np.int32), f.shape[0], f.shape[1]))
        return pd.DataFrame(rows, columns=["event_id", "t", "label", "h", "w"])

    return frames.groupBy("event_id").applyInPandas(run, "event_id string, t int, label array<int>, h int, w int")


def evaluate_cells(frames: DataFrame, counts: list[int]) -> DataFrame:
    """Boundary scores of regions against nested cells on each event's first frame, for each number of regions."""
    ddl = "event_id string, N_requested int, N_actual int, zero_cell boolean, active_levels string, f1_stage0 double, f1_stage1 double, f1_nested double, precision_roi double, recall double, f1_multi_G double, f1_multi_P double, f1_multi_F double"
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cube = stack(pdf)
        rows = []
        raw = pdf[(pdf["channel"] == "vil")].sort_values("t")
        if cube is not None:
            phys = np.clip(np.asarray(raw["data"].iloc[0], float), 0, 255).reshape(cube.shape[1:3]) / 255 * 70
            for n in counts:
                lab, _ = segment.kmeans_regions(cube[0], n)
                rows.append({"event_id": key[0], "N_requested": n, "N_actual": len(np.unique(lab))} | segment.evaluate(phys, lab, margin=2))
        return pd.DataFrame(rows, columns=names)

    return frames.groupBy("event_id").applyInPandas(run, ddl)


def region_graph(cube: np.ndarray, n: int, scale: float = 1.5) -> dict:
    """The graph of one frame: states and environment of its regions, adjacency in both directions and kernel weights."""
    labels, _ = segment.kmeans_regions(cube[0], n)
    ids, cent, _, mean = segment.label_means(labels, cube[0])
    row = np.zeros(int(labels.max()) + 1, int)
    row[ids] = np.arange(len(ids))
    pairs = np.concatenate([np.stack([row[labels[:, :-1]].ravel(), row[labels[:, 1:]].ravel()], 1), np.stack([row[labels[:-1]].ravel(), row[labels[1:]].ravel()], 1)])
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
    src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    length = np.hypot(*(cent[src] - cent[dst]).T)
    width = scale * np.sqrt(labels.size / n)
    env = np.column_stack([mean[:, 0], cent / labels.shape, np.ones(len(ids))])
    return {"h": mean[:, :3], "env": env, "src": src, "dst": dst, "w": np.exp(-(length**2) / (2 * width**2)), "n": len(ids), "length": length, "spacing": np.sqrt(labels.size / n)}


SOLVER_OUT = (
    "event_id string, N int, N_actual int, E int, seed int, D double, sigma_init double, spectral_radius double, lambda_max_topo double, lambda_max_weighted double, nfe_diffusion int, nfe_reaction int, "
    "nfe_imex_total int, rejected_diff int, rejected_rxn int, imex_converged boolean, nfe_dopri5 int, rejected_dopri5 int, dopri5_converged boolean, nfe_ratio double, solution_l2_error double"
)


def _problem(cube: np.ndarray, n: int) -> tuple[dict, float, dict]:
    """(graph, D, the columns that describe it) of an event's first frame."""
    g = region_graph(cube, n)
    topo, weighted = (solver.lambda_max(g["n"], g["src"], g["dst"], w) for w in (np.ones(len(g["src"])), g["w"]))
    k = float(np.bincount(g["dst"], g["w"], g["n"]).max()) if len(g["src"]) else 1.0
    d = solver.calibrate_diffusion(solver.stability_radius(), k)
    return g, d, {"N": n, "N_actual": g["n"], "E": len(g["src"]), "D": d, "lambda_max_topo": topo, "lambda_max_weighted": weighted}


def _solver_rows(frames: DataFrame, counts: list[int], seeds: list[int], sigma: float, done: DataFrame | None, ddl: str, row_of) -> DataFrame:
    """A row of row_of(graph, D, seed) for each event, number of regions and seed: an event's frames are stacked once and its graph
    is made once for each number. done: finished (event_id, N), which are left out."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cube, rows = stack(pdf), []
        for n in pdf["_n"].iloc[0] if cube is not None else ():
            g, d, about = _problem(cube, int(n))
            for seed in seeds:
                rhs, jac = solver.reaction(g["env"], solver.make_weights(sigma, int(seed), 3, g["env"].shape[1]))
                explicit = solver.diffusion(g["src"], g["dst"], g["w"], g["n"], d)
                rows.append({"event_id": key[0], "seed": int(seed), "sigma_init": sigma, "spectral_radius": solver.spectral_norm(jac(g["h"]))} | about | row_of(g["h"], explicit, rhs, jac))
        return pd.DataFrame(rows, columns=names)

    return pending_counts(frames, counts, done).groupBy("event_id").applyInPandas(run, ddl)


def solver_benchmark(frames: DataFrame, counts: list[int], seeds: list[int], sigma: float = 1.0, steps: int = 3, done: DataFrame | None = None) -> DataFrame:
    """Split against unsplit solver for each event, number of regions and seed."""
    return _solver_rows(frames, counts, seeds, sigma, done, SOLVER_OUT, lambda h, explicit, rhs, jac: solver.compare(h, explicit, rhs, jac, steps=steps))


ACCURACY_OUT = (
    "event_id string, N int, N_actual int, E int, seed int, D double, sigma_init double, spectral_radius double, lambda_max_topo double, lambda_max_weighted double, nfe_ref int, nfe_train int, "
    "nfe_ratio_train_over_ref double, ref_converged boolean, train_converged boolean, eps_int double"
)


def accuracy_rows(frames: DataFrame, counts: list[int], seeds: list[int], sigma: float = 1.0, steps: int = 3, done: DataFrame | None = None) -> DataFrame:
    """The split solver at a loose tolerance against itself at a tight one, for each event, number of regions and seed. The events
    of a batch are integrated side by side, each with its own steps."""

    def run(ids, counts, cubes):
        for n in counts:
            g = batched.region_graphs(cubes[:, 0], batched.kmeans_regions(cubes[:, 0], n), n)
            degree = np.where(g.edges > 0, np.maximum.reduceat(g.w.sum(0), g.start), 1.0)
            d = solver.calibrate_diffusion(solver.stability_radius(), degree)
            about = {"event_id": ids, "N": n, "N_actual": g.sizes, "E": g.edges, "D": d, "sigma_init": sigma, "lambda_max_topo": batched.lambda_max(g, (g.w > 0).astype(float)), "lambda_max_weighted": batched.lambda_max(g, g.w)}
            for seed in seeds:
                weights = solver.make_weights(sigma, int(seed), 3, g.env.shape[1])
                stretch = np.split(np.linalg.norm(solver.reaction(g.env, weights)[1](g.h.T), 2, axis=(1, 2)), g.start[1:])
                got = batched.accuracy(batched.Reacting.of(g, d, weights), g.h, steps=steps)
                yield pd.DataFrame(about | {"seed": int(seed), "spectral_radius": [float(np.median(v)) for v in stretch]} | got)

    return map_stacks(pending_counts(frames, counts, done), run, ACCURACY_OUT)


TRIAGE_OUT = "event_id string, N int, N_actual int, E int, seed int, D double, sigma_init double, spectral_radius double, lambda_max_topo double, lambda_max_weighted double, dominant_real double, converged boolean, accepted int, rejected int, verdict string"


def triage_rows(frames: DataFrame, counts: list[int], seeds: list[int], sigma: float = 1.0, dt: float = 300.0) -> DataFrame:
    """One unsplit step of each event with its trace, and why it went badly if it did: divergence, stiffness or unclear."""

    def row_of(h, explicit, rhs, jac):
        _, tr = solver.unsplit(h, explicit, rhs, dt=dt, steps=1)
        return {"dominant_real": solver.dominant_real(jac(h)), "converged": tr.converged, "accepted": tr.accepted, "rejected": tr.rejected, "verdict": solver.verdict(tr, dt / 10)}

    return _solver_rows(frames, counts, seeds, sigma, None, TRIAGE_OUT, row_of)


def forecast_events(frames: DataFrame, n: int, lead: float, seed: int = 0) -> DataFrame:
    """(event_id, regions, loss): the transport model's forecast of the frame ``lead`` frames on, from the first two."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cube = stack(pdf)
        if cube is None or len(cube) <= lead:
            return pd.DataFrame(columns=["event_id", "regions", "loss"])
        labels, _ = segment.kmeans_regions(cube[0], n)
        flow = raster.lucas_kanade(cube[0][..., 0], cube[1][..., 0])
        code = model.encode(cube[0], labels, flow)
        _, h = model.forecast(model.init_model(seed), code, raster.terrain(*cube.shape[1:3], seed=1), lead)
        pred = model.decode(h, code["route"], flow, lead)
        return pd.DataFrame([(key[0], len(h), model.balanced_mse(pred[..., 0], cube[int(lead)][..., 0]))], columns=["event_id", "regions", "loss"])

    return frames.groupBy("event_id").applyInPandas(run, "event_id string, regions int, loss double")
