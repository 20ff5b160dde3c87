"""The temporal segmenter as a stateful streaming operator: frames arrive in micro-batches, the state of an event is its centroids
and last frame."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels.segment import TemporalSegmenter

OUTPUT = "event_id string, t int, n_regions int, label_sum bigint"


def _pack(seg: TemporalSegmenter, t: int) -> bytes:
    out = io.BytesIO()
    np.savez(out, last=seg.last, ids=seg.ids, centers=seg.centers, t=t)
    return out.getvalue()


def segment_stream(frames: DataFrame, n: int, idle_ms: int | None = None) -> DataFrame:
    """frames: event_id, t, h, w, data (values 0..1). Frames of an event must come in order of t over the batches; within a batch they
    are sorted. A frame not later than the last one seen, which may be a repeat, is not segmented but reported with nulls. The state of
    an event without frames for ``idle_ms`` milliseconds is freed; a frame that comes still later starts anew. A query that ends
    with its input (availableNow) must leave that out, since a state that waits for its time keeps it running."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, seen = TemporalSegmenter(n), -1
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            z = np.load(io.BytesIO(state.get[0]))
            seg.last, seg.ids, seg.centers, seen = z["last"], z["ids"], z["centers"], int(z["t"])
        rows = []
        got = pd.concat(list(pdfs))
        for t, h, w, data in sorted(zip(got["t"], got["h"], got["w"], got["data"]), key=lambda r: r[0]):
            if t <= seen:
                rows.append((key[0], int(t), None, None))
                continue
            labels, _ = seg.step(np.asarray(data, float).reshape(h, w, 1))
            seen = int(t)
            rows.append((key[0], seen, len(np.unique(labels)), int(labels.sum())))
        if seen >= 0:
            state.update((_pack(seg, seen),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["event_id", "t", "n_regions", "label_sum"]).astype({"n_regions": "Int32", "label_sum": "Int64"})

    return frames.groupBy("event_id").applyInPandasWithState(step, OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def segment_batch(frames: DataFrame, n: int) -> DataFrame:
    """The same over a table."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seg, rows = TemporalSegmenter(n), []
        for t, h, w, data in sorted(zip(pdf["t"], pdf["h"], pdf["w"], pdf["data"]), key=lambda r: r[0]):
            labels, _ = seg.step(np.asarray(data, float).reshape(h, w, 1))
            rows.append((key[0], int(t), len(np.unique(labels)), int(labels.sum())))
        return pd.DataFrame(rows, columns=["event_id", "t", "n_regions", "label_sum"])

    return frames.groupBy("event_id").applyInPandas(run, OUTPUT)
