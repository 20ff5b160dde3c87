import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.functions import cleaning as K
from squallframe.functions import distributions as T
from squallframe.functions import expressions as X
from squallframe.kernels import raster, segment
from squallframe.operators import decision as D
from squallframe.operators import imagery as I
from squallframe.operators import pixels as P
from squallframe.operators import relational as R
from squallframe.operators import stats as S
from squallframe.sources import catalog as C
from squallframe.sources import hdf5 as H
from squallframe.session import work_dir
from squallframe.streaming import flashes, segmenter


def test_t_quantiles_against_printed_tables():
    for df, want in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert abs(T.t_quantile(0.975, df) - want) < 6e-4
    far = sum(c / 250**k for k, c in enumerate(T.t_expansion(0.975)))
    assert abs(far - T.t_quantile(0.975, 250)) < 1e-9
    assert abs(T.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(T.normal_upper(1.96) - 0.025) < 1e-4


def test_correlation_and_rank_tests(spark, monkeypatch):
    rows = [(float(i), float(i * i), "a" if i % 2 else "b") for i in range(12)] + [(None, 1.0, "a"), (float("nan"), 2.0, "b")]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    c = S.correlations(df, "x", "y").first()
    assert c.n == 12 and math.isclose(c.spearman, 1.0) and c.spearman_p < 1e-9 and math.isclose(c.pearson, np.corrcoef(np.arange(12), np.arange(12) ** 2)[0, 1])
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    exact = S.mann_whitney_less(small, "g", "v", "a", "b").first()
    assert exact.u == 0 and math.isclose(exact.p, 1 / 20)  # one of the orders of three and three
    monkeypatch.setattr(S, "EXACT_SMALLER", 0)
    m = S.mann_whitney_less(small, "g", "v", "a", "b").first()
    assert m.u == 0 and abs(m.p - T.normal_upper(4 / math.sqrt(9 / 12 * 7))) < 1e-12
    assert S.mann_whitney_less(df.limit(0), "g", "x", "a", "b").first().p is None


@pytest.mark.parametrize("raw,plain", [("S1", "S1"), (" s1_sweep ", "S1"), ("s1\t", "S1"), ("a/b/S1_n_sweep.csv", "S1"), ("", ""), ("  ", ""), (None, None)])
def test_plain_id(spark, raw, plain):
    assert spark.createDataFrame([(raw,)], "i string").select(K.plain_id(F.col("i"))).first()[0] == plain


def test_letters_key(spark):
    got = [r[0] for r in spark.createDataFrame([(" Rapid-Growth ",), ("RAPIDGROWTH",), ("--",), (None,)], "c string").select(K.letters_key(F.col("c"))).collect()]
    assert got == ["rapidgrowth", "rapidgrowth", None, None]


def test_elbow_by_hand_and_small_groups(spark):
    ns, ys = [1, 2, 3, 4, 5], [10.0, 4.0, 2.0, 1.5, 1.0]
    df = spark.createDataFrame([("g", n, y) for n, y in zip(ns, ys)] + [("two", 1, 1.0), ("two", 2, 0.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("flat", 3, 1.0)], "c string, N int, v double")
    got = {r.c: r.e for r in D.elbows(df, ["c"], "N", {"e": F.col("v")}).collect()}
    assert got == {"g": 2, "two": 1, "flat": 3}  # the guard of 1e-12 makes the end of a flat curve its farthest point


def test_recommendation_skips_small_classes_and_breaks_ties_early(spark, data):
    from squallframe.plans.sweep_queries import d05_recommend

    for r in d05_recommend(spark, data).collect():
        assert r.recommended_N <= max(r.lfs_ceiling_N, r.recommended_N) and r.binding_constraint


def test_phases(spark):
    up, down = [float(i) for i in range(6)], [float(6 - i) for i in range(6)]
    rows = [("gd", t, v) for t, v in enumerate(up + down)] + [("g", t, v) for t, v in enumerate(up)] + [("short", 0, 1.0), ("short", 1, 0.0), ("p", 0, 2.0), ("p", 1, 2.0), ("p", 2, 2.0), ("p", 3, 2.0)]
    got = {r.k: (r.n_phases, r.phase_sequence) for r in D.phases(spark.createDataFrame(rows, "k string, t int, y double"), ["k"], "t", "y").collect()}
    assert got == {"gd": (2, "G→D"), "g": (1, "G"), "short": (1, "D"), "p": (1, "P")}


def test_plateau_rules(spark):
    rows = [("a", n, j) for n, j in ((1, 0.1), (2, 0.96), (3, 1.0), (4, 0.97), (5, 0.2))] + [("neg", n, -1.0 * n) for n in (1, 2, 3)] + [("one", n, j) for n, j in ((1, 0.1), (2, 1.0), (3, 0.2))]
    got = {r.k: (r.plateau_width, r.n_star) for r in S.plateau(spark.createDataFrame(rows, "k string, N int, j double"), ["k"], "N", "j").collect()}
    assert got == {"a": (2.0, 2.0), "neg": (None, 1.0), "one": (2.0, 2.0)}


def test_keep_last_and_first_with_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 5, "d"), (None, 6, "e")], "k int, o int, v string")
    assert sorted((r.k or 0, r.v) for r in R.keep_last(df, ["k"], ["o", "v"]).collect()) == [(0, "e"), (1, "b")]
    assert sorted((r.k or 0, r.v) for r in R.latest_by_key(df, ["k"], ["o"], ["v"]).collect()) == [(0, "e"), (1, "b")]


def test_round_robin_needs_no_single_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r.k, r.chunk) for r in R.round_robin(df, ["k"], 7).collect())
    assert got == [(k, k % 7) for k in range(1000)]
    assert R.round_robin(df.limit(0), ["k"], 7).count() == 0


def test_resolve_paths(spark):
    c = spark.createDataFrame([("vil/2019/a.h5",), ("vil/2019/b.h5",), ("vil/2019/c.h5",), ("vil/2019/d.h5",), (None,)], "file_name string")
    f = spark.createDataFrame([("/r/vil/2019/a.h5", 1), ("/r/2019/vil/b.h5", 1), ("/x/c.h5", 1)], "path string, length bigint")
    assert {r.file_name: r.path for r in C.resolve_paths(c, f).collect()} == {"vil/2019/a.h5": "/r/vil/2019/a.h5", "vil/2019/b.h5": "/r/2019/vil/b.h5", "vil/2019/c.h5": "/x/c.h5", "vil/2019/d.h5": None, None: None}
    assert "/a/2019" in C.root_candidates("/a/b")


def test_listing_tolerant_columns_and_calibration(spark):
    at = work_dir(spark, "listing")
    C.write_ids(spark.createDataFrame([("a",), ("b",)], "id string"), f"{at}/ids")
    assert C.list_files(spark, at, "*.txt").where("length > 0").count() >= 1
    df = spark.createDataFrame([(5, 0.25)], "n int, J double")
    got = C.tolerant_sweep(df, {"N": ("N", "n_sp"), "J_imex": ("J_imex", "J"), "FAE": ("FAE",)}).first()
    assert (got.N, got.J_imex, got.FAE) == (5, 0.25, None)
    bad = spark.createDataFrame([(1.0, 2.0)], "c_sigma double, rtol double")
    C.write_calibration(bad, f"{at}/cal")
    with pytest.raises(Exception, match="calibration lacks"):
        C.read_calibration(spark, f"{at}/cal").collect()


def test_pixel_sql_agrees_with_kernels(spark):
    r = np.random.default_rng(5)
    lab, v = r.integers(0, 4, (9, 11)), r.random((9, 11))
    px = spark.createDataFrame([(0, y, x, int(lab[y, x]), float(v[y, x])) for y in range(9) for x in range(11)], "t int, y int, x int, label int, v double")
    ids, cent, n, mean = segment.label_means(lab, v)
    got = {s.label: (s.cy, s.cx, s.n_px, s.v_mean) for s in P.label_stats(px, ["t"], ["v"]).collect()}
    for k, c, m, a in zip(ids, cent, n, mean):
        assert np.allclose(got[int(k)], (*c, m, *a))
    assert math.isclose(P.intra_variance(px, ["t"], ["v"]).first().isv, segment.intra_variance(lab, v))
    assert {(e.y, e.x) for e in P.boundary(px, ["t"]).where("edge").collect()} == set(map(tuple, np.argwhere(raster.boundary(lab)).tolist()))
    near = P.dilate(px.withColumn("on", F.col("v") > 0.9), ["t"], "on", 2, "near")
    assert {(e.y, e.x) for e in near.where("near").collect()} == set(map(tuple, np.argwhere(raster.dilate(v > 0.9, 2)).tolist()))


def test_frames_to_pixels_and_components(spark):
    e = spark.createDataFrame([("S1", 1), ("S2", 2)], "event_id string, seed int")
    f = I.synthetic_frames(e, 16, 3)
    assert f.count() == 2 * 3 * 3 and P.explode_frames(f.where("channel = 'vil'")).count() == 2 * 3 * 256
    c = I.frame_components(f).collect()
    assert len(c) == 6 and all(0 <= x.active <= 1 for x in c)
    assert I.segment_events(f.where("channel <> 'vil'"), 4).count() == 0


def test_streams_equal_batches(spark, data):
    at = work_dir(spark, "stream")
    raw = spark.read.parquet(f"{data}/flashes.parquet")
    raw.repartition(3).write.parquet(f"{at}/flashes")
    done = flashes.run_to_end(flashes.frame_counts(flashes.read_flashes(spark, f"{at}/flashes")), "t", "update", ("id", "start"))
    batch = raw.where("event_id is not null and t_off is not null and not isnan(t_off)").groupBy(K.plain_id(F.col("event_id")).alias("id"), X.frame_index(F.round(F.col("t_off") * 1e6) / 1e6).alias("frame")).count()
    assert done.agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0] and done.count() == batch.count()
    e = spark.createDataFrame([("S1", 1), ("S2", 2)], "event_id string, seed int")
    f = I.synthetic_frames(e, 16, 4).where("channel = 'vil'").select("event_id", "t", "h", "w", F.transform("data", lambda v: v.cast("double") / 255).alias("data"))
    for k in (0, 1):  # two files, so that the state is carried over
        f.where(F.floor(F.col("t") / 2) == k).coalesce(1).write.mode("append").parquet(f"{at}/frames")
    stream = spark.readStream.schema("event_id string, t int, h int, w int, data array<double>").parquet(f"{at}/frames")
    got = flashes.run_to_end(segmenter.segment_stream(stream, 5), "s", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, segmenter.segment_batch(f, 5).collect()))


def test_hdf5_layouts_without_the_library():
    cube = np.zeros((2, 4, 5, 3))
    f = {"id": np.array([b"S1", b"S2"]), "vil": cube}
    assert [k for k, _ in H.cubes(f, "vil", "index", {"S2"})] == ["S2"]
    assert [k for k, _ in H.cubes({"S1": {"vil": cube[0]}}, "vil", "group", None)] == ["S1"]
    assert [k for k, _ in H.cubes({"S9": cube[0]}, "vil", "first", {"S1"})] == []
    assert H.frames_first(cube[0]).shape == (3, 4, 5) and H.frames_first(np.zeros((3, 9, 9))).shape == (3, 9, 9)


def test_small_helpers(spark):
    assert R.parse_overrides(["A=S1", " B = S2 "]) == {"A": "S1", "B": "S2"} and R.parse_overrides(None) == {}
    with pytest.raises(ValueError):
        R.parse_overrides(["A"])
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "a array<double>").select(S.head_tail_ratio(F.col("a")))
    assert [None if r[0] is None else round(r[0], 6) for r in df.collect()] == [4.0, None]
    c = spark.createDataFrame([("e", 1, 10), ("e", 2, None)], "e string, k int, parent_id int")
    p = spark.createDataFrame([("e", 10, 0.5)], "e string, id int, v double")
    assert sorted((r.k, r.parent_v) for r in R.with_parents(c, p, ["e"], ["v"]).collect()) == [(1, 0.5), (2, None)]


def test_environment_cache(spark):
    from squallframe.operators import environment as E

    tiles = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 2, 2, [5.0, 5.0, 5.0, 5.0])], "tile int, tlon1 double, tlon2 double, tlat1 double, tlat2 double, th int, tw int, values array<double>")
    events = spark.createDataFrame([("a", 1.0, 4.0, 1.0, 4.0), ("b", 1.0, 4.0, 1.0, 4.0), ("c", 50.0, 54.0, 1.0, 4.0)], "id string, lon1 double, lon2 double, lat1 double, lat2 double")
    asked = []

    def fetch(e):
        asked.append(e.count())
        return E.regrid(e, tiles, 3, 3)

    ext, cache = E.unique_extents(events), f"{work_dir(spark, 'env')}/cache"
    first = {r.cache_key: r.source for r in E.read_through(spark, cache, ext, fetch).collect()}
    again = {r.cache_key: r.source for r in E.read_through(spark, cache, ext, fetch).collect()}
    assert sorted(first.values()) == ["tiles", "zero"] and again == first and asked == [2, 1]
    got = {r.id: list(r.data) for r in E.for_events(events, E.regrid(ext, tiles, 3, 3)).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == [0.0] * 9
