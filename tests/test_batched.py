"""The kernels of many events against those of one, and the operators that use them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.kernels import batched, raster, segment, solver
from squallframe.operators import imagery as I
from squallframe.plans import imagery_queries

WEIGHTS = solver.make_weights(1.0, 0)


def first_frames(events, side=16):
    return np.stack([np.moveaxis([raster.minmax(v) for v in raster.storm_cells(side, side, 3, k)], 0, -1) for k in range(events)])


def problems(frames, n):
    g = batched.region_graphs(frames, batched.kmeans_regions(frames, n), n)
    d = solver.calibrate_diffusion(solver.stability_radius(), np.where(g.edges > 0, np.maximum.reduceat(g.w.sum(0), g.start), 1.0))
    return g, d, batched.Reacting.of(g, d, WEIGHTS)


def alone(frame, n):
    g, d, about = I._problem(frame[None], n)
    rhs, jac = solver.reaction(g["env"], WEIGHTS)
    return g, about, solver.accuracy(g["h"], solver.diffusion(g["src"], g["dst"], g["w"], g["n"], d), rhs, jac, steps=1)


@pytest.mark.parametrize("n", [1, 8])
def test_many_events_equal_single_ones(n):
    f = first_frames(6)
    f[2] = 0  # an event without any signal
    g, d, p = problems(f, n)
    topo, weighted, got = batched.lambda_max(g, (g.w > 0).astype(float)), batched.lambda_max(g, g.w), batched.accuracy(p, g.h, steps=1)
    for k, frame in enumerate(f):
        one, about, row = alone(frame, n)
        own = g.owner == k
        assert np.array_equal(one["h"].T, g.h[:, own]) and np.array_equal(one["env"], g.env[own]) and g.edges[k] == about["E"]
        assert np.allclose([d[k], topo[k], weighted[k]], [about["D"], about["lambda_max_topo"], about["lambda_max_weighted"]], rtol=1e-9)
        assert all(got[c][k] == row[c] for c in row if c != "eps_int") and np.isclose(got["eps_int"][k], row["eps_int"], rtol=1e-6, atol=1e-14)


def test_states_that_are_not_finite_end_their_event_alone():
    g, _, p = problems(first_frames(3), 8)
    h = g.h.copy()
    h[0, g.start[1]] = np.inf
    got, row = batched.strang(p, h, steps=2)
    clean, whole = batched.strang(p, g.h, steps=2)
    assert row["imex_converged"].tolist() == [True, False, True] and whole["imex_converged"].all()
    other = g.owner != 1
    assert np.array_equal(got[:, other], clean[:, other]) and (row["nfe_imex_total"] == whole["nfe_imex_total"])[[0, 2]].all()


def test_regions_of_large_frames_and_of_many():
    f = first_frames(5, 24)
    want = np.stack([segment.kmeans_regions(v, 20)[0] for v in f])
    assert np.array_equal(batched.kmeans_regions(f, 20), want)
    block, batched.BLOCK = batched.BLOCK, 1
    try:
        assert np.array_equal(batched.kmeans_regions(f, 20), want)
    finally:
        batched.BLOCK = block


def odd_frames(spark):
    """Twelve events: E1 lacks the radar, E2 an infrared frame, E3 a channel; E4 has another channel too, E5 larger frames."""
    small = I.synthetic_frames(spark.createDataFrame([(f"E{k}", k) for k in range(12) if k != 5], "event_id string, seed int"), 16, 3)
    large = I.synthetic_frames(spark.createDataFrame([("E5", 5)], "event_id string, seed int"), 20, 4)
    drop = "event_id = 'E1' and channel = 'vil' or event_id = 'E2' and channel = 'ir107' and t = 1 or event_id = 'E3' and channel = 'ir069'"
    return small.unionByName(large).where(f"not ({drop})").unionByName(small.where("event_id = 'E4' and channel = 'vil'").withColumn("channel", F.lit("lght")))


def test_stacks_equal_stack(spark):
    pdf = odd_frames(spark).orderBy("event_id", F.rand(1)).toPandas()
    import pyarrow as pa

    got = {pdf["event_id"][int(r)]: c for rows, cubes in I.stacks(pa.Table.from_pandas(pdf)) for r, c in zip(rows, cubes)}
    want = {e: c for e, g in pdf.groupby("event_id") if (c := I.stack(g)) is not None}
    assert set(got) == set(want) and len(want) == 11 and all(np.array_equal(got[e], want[e]) for e in want)
    twice = pa.Table.from_pandas(pdf[pdf["event_id"] == "E6"].iloc[[0, 0]].assign(channel="vil"))
    with pytest.raises(ValueError):
        I.stacks(twice)


def test_accuracy_rows_of_odd_events(spark):
    """An event divided by Arrow's batches, or with frames of its own kind, has the row that its own frames give; done counts stay out."""
    f = odd_frames(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        done = spark.createDataFrame([("E7", 4), ("E8", 4), ("E8", 8)], "event_id string, N int")
        got = {(r.event_id, r.N): r for r in I.accuracy_rows(f, [4, 8], [0], steps=1, done=done).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {(f"E{k}", n) for k in range(12) for n in (4, 8)} - {("E1", 4), ("E1", 8), ("E7", 4), ("E8", 4), ("E8", 8)}
    for e, pdf in f.toPandas().groupby("event_id"):
        for n in (4, 8):
            if (e, n) in got:
                _, about, row = alone(I.stack(pdf)[0], n)
                want = about | row
                assert all(np.isclose(got[e, n][c], v, rtol=1e-6, atol=1e-14) for c, v in want.items())


def test_counts_are_those_of_the_sweep(spark):
    f = odd_frames(spark)
    done = spark.createDataFrame([("E7", 6), ("E8", 6), ("E8", 12)], "event_id string, N int")
    got = sorted(map(tuple, I.sweep_counts(f, [6, 12], done).collect()))
    assert got == sorted(map(tuple, I.sweep_regions(f, [6, 12], done=done).select("event_id", "N", "actual_N").collect())) and len(got) == 19


def test_resumed_sweep_makes_the_frames_once(spark, data):
    """Making frames takes most of the time; before, they were made again to find the finished events."""
    got = imagery_queries.x05_resumed_sweep(spark, data)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 2 and "FlatMapGroups" not in plan  # frames, and the counts


def test_many_events_cost_less_than_one_each():
    """100 events took 10 times as long as 10; a batch of them takes less than these 10 alone."""
    f = first_frames(100)
    began = time.process_time()
    for frame in f[:10]:
        alone(frame, 8)
    each = time.process_time() - began
    began = time.process_time()
    g, _, p = problems(f, 8)
    batched.accuracy(p, g.h, steps=1)
    assert time.process_time() - began < each
