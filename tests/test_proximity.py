import math

import numpy as np
import pytest

from squallframe.operators import proximity as P


def places(spark, rows):
    return spark.createDataFrame(rows, "id string, lat double, lon double")


def brute(rows, km):
    out = set()
    for i, (a, la, lo) in enumerate(rows):
        for b, lb, mo in rows[i + 1 :]:
            h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(mo - lo) / 2) ** 2
            if 2 * P.EARTH_KM * math.asin(min(1, math.sqrt(h))) <= km:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("km", [1.0, 60.0])
def test_pairs_against_brute_force(spark, km):
    r = np.random.default_rng(1)
    rows = [(f"a{i:03d}", float(np.clip(40 + r.normal(0, 0.02), -90, 90)), float(r.normal(0, 0.02) % 360)) for i in range(120)]
    rows += [(f"p{i}", 89.9 + 0.1 * r.random(), float(360 * r.random())) for i in range(40)]
    rows += [(f"s{i}", -90.0, float(10 * i)) for i in range(3)] + [(f"n{i}", 90.0, float(100 * i)) for i in range(2)]
    rows += [("same1", 10.0, 20.0), ("same2", 10.0, 20.0), ("same3", 10.0, 20.0)]
    got = {tuple(x) for x in P.neighbour_pairs(places(spark, rows), "id", km).collect()}
    assert got == brute(rows, km)


def test_each_pair_once_and_empty(spark):
    rows = [("b", 0.0, 359.9999), ("a", 0.0, 0.0001), ("c", 0.004, 0.0)]
    got = sorted(map(tuple, P.neighbour_pairs(places(spark, rows), "id", 1.0).collect()))
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
    assert P.neighbour_pairs(places(spark, []), "id", 1.0).count() == 0


def test_box_places(spark):
    nan = float("nan")
    rows = [
        ("plain", -100.0, -90.0, 30.0, 40.0), ("turned", 270.0, 260.0, 40.0, 30.0), ("date line", 178.0, -178.0, 10.0, 12.0), ("mixed", 265.0, -94.0, 1.0, 3.0),
        ("flat", 1.0, 2.0, 5.0, 5.0), ("thin", 1.0, 1.0, 5.0, 6.0), ("gone", None, 2.0, 5.0, 6.0), ("nan", 1.0, nan, 5.0, 6.0), ("far", 1.0, 2.0, 5.0, 91.0), ("off", -999.0, 2.0, 5.0, 6.0),
        (None, 1.0, 2.0, 5.0, 6.0), ("plain", -100.0, -90.0, 30.0, 40.0), ("plain", None, -90.0, 30.0, 40.0),
    ]
    df = spark.createDataFrame(rows, "id string, llcrnrlon double, urcrnrlon double, llcrnrlat double, urcrnrlat double")
    got = {r["id"]: (r["lat"], r["lon"]) for r in P.box_places(df).collect()}
    assert got == {"plain": (35.0, 265.0), "turned": (35.0, 265.0), "date line": (11.0, 180.0), "mixed": (2.0, 265.5)}


def inside(ring, y, x):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_regions_with_hole_edge_and_date_line(spark):
    star = [(0.0, 0.0), (10.0, 0.0), (4.0, 4.0), (10.0, 9.0), (0.0, 9.0), (3.0, 5.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 2.0), (1.0, 2.0)]
    line = [(175.0, -5.0), (-175.0, -5.0), (-175.0, 5.0), (175.0, 5.0)]
    rings = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in r]) for k, r in (("star", star), ("star", hole), ("line", line), ("bad", [(0.0, 0.0)]))], "region_id string, ring array<struct<lon:double,lat:double>>")
    r = np.random.default_rng(0)
    pts = [(i, float(r.uniform(-1, 10)), float(r.uniform(-1, 11))) for i in range(400)] + [(1000, 0.0, 180.0), (1001, 0.0, -179.0), (1002, 0.0, 5.0), (1003, 1.5, 2.0), (1004, 1.0, 2.0), (1005, 5.0, 179.0), (1006, None, 2.0), (1007, 4.9, 174.9)]
    got = {(x["region_id"], x["point_id"]) for x in P.points_in_regions(spark.createDataFrame(pts, "point_id bigint, lat double, lon double"), P.region_edges(rings), 0.7, 1.3).collect()}
    want = {("star", i) for i, y, x in pts[:400] if inside(star, y, x) != inside(hole, y, x)}
    assert {g for g in got if g[1] < 1000} == want
    assert {g for g in got if g[1] >= 1000} == {("line", 1000), ("line", 1001), ("star", 1002), ("star", 1004), ("line", 1005)}


def test_plan_has_no_cartesian_product(spark):
    df = P.neighbour_pairs(places(spark, [("a", 1.0, 2.0)]), "id", 1.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
