"""Queries over a label raster, a graph and vectors; the raster is built from lineitem's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import graphs as G
from ..operators import pixels as P
from ..operators import relational as R
from ..session import table
from .sweep_queries import _r, _rounded

SIDE = 32


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (t, y, x, label, v, flow) of two frames, one for each line status; the second one's labels are shifted."""
    li = table(spark, sf_dir, "lineitem").where("l_linestatus is not null")
    px = li.groupBy(F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("t"), (F.col("l_partkey") % SIDE).cast("int").alias("y"), (F.col("l_suppkey") % SIDE).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v"), F.avg("l_discount").alias("u"))
    moved = F.col("x") + 2 * F.col("t")
    return px.withColumn("label", (F.lit(1) + F.floor(F.col("y") / 8) * 4 + F.floor(F.least(moved, F.lit(SIDE - 1)) / 8)).cast("int")).withColumn("label", F.when((F.col("t") == 1) & (F.col("y") >= 24), 0).otherwise(F.col("label")))


RASTER_SQL = f"""px0 as (select case when l_linestatus = 'F' then 0 else 1 end as t, cast(l_partkey % {SIDE} as int) as y, cast(l_suppkey % {SIDE} as int) as x, avg(l_quantity) as v, avg(l_discount) as u
  from lineitem where l_linestatus is not null group by 1, 2, 3),
px as (select *, case when t = 1 and y >= 24 then 0 else cast(1 + floor(y / 8.0) * 4 + floor(least(x + 2 * t, {SIDE - 1}) / 8.0) as int) end as label from px0)"""

_T = ["t"]


def _pair(spark, sf_dir):
    px = raster(spark, sf_dir)
    return px.where("t = 0").drop("t").withColumn("e", F.lit(0)), px.where("t = 1").drop("t").withColumn("e", F.lit(0))


def a21_label_stats(spark, sf_dir):
    return _rounded(P.label_stats(raster(spark, sf_dir), _T, ["v"]))


def a23_intra_variance(spark, sf_dir):
    return _rounded(P.intra_variance(raster(spark, sf_dir), _T, ["v", "u"]))


def a24_weighted_variance(spark, sf_dir):
    return _rounded(P.weighted_variance(raster(spark, sf_dir), _T, "v"))


def a25_pooled(spark, sf_dir):
    s = P.label_stats(raster(spark, sf_dir), _T, ["v"])
    return _rounded(s.groupBy("t").agg(F.avg("v_mean").alias("mean"), F.stddev_pop("v_mean").alias("std"), F.max("v_mean").alias("most"), F.count(F.lit(1)).alias("labels")))


def j12_adjacency(spark, sf_dir):
    return P.adjacency(raster(spark, sf_dir), _T)


def j14_best_overlap(spark, sf_dir):
    return _rounded(P.best_overlap(*_pair(spark, sf_dir), ["e"]).drop("e"))


def j15_overlaps(spark, sf_dir):
    return _rounded(P.overlaps(*_pair(spark, sf_dir), ["e"]).drop("e"))


def m03_turnover(spark, sf_dir):
    return _rounded(P.turnover(*_pair(spark, sf_dir), ["e"]).drop("e"))


def m01_flow_error(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    flow = a.select("e", "y", "x", (F.col("u") * 10).alias("fy"), (F.col("v") / 20).alias("fx"))
    return _rounded(P.flow_error(a, b, flow, ["e"]).drop("e"))


def m07_boundary_jaccard(spark, sf_dir):
    return _rounded(P.boundary_jaccard(*_pair(spark, sf_dir), ["e"]).drop("e"))


def r12_gradient(spark, sf_dir):
    return _rounded(P.gradient(raster(spark, sf_dir), _T, "v"))


def r14_dilation(spark, sf_dir):
    px = raster(spark, sf_dir).withColumn("on", F.col("v") > 32)
    return P.dilate(px, _T, "on", 2, "near").groupBy("t").agg(F.sum(F.col("on").cast("int")).alias("n_on"), F.sum(F.col("near").cast("int")).alias("n_near"))


def r15_boundary(spark, sf_dir):
    return P.boundary(raster(spark, sf_dir), _T, positive=True).where("edge").select("t", "y", "x")


def m10_boundary_f1(spark, sf_dir):
    px = P.boundary(raster(spark, sf_dir).withColumn("cell", F.col("v") > 30), _T).withColumnRenamed("edge", "region_edge")
    own = P.boundary(px.select("t", "y", "x", F.col("cell").cast("int").alias("label")), _T, positive=True).select("t", "y", "x", F.col("edge").alias("cell_edge"))
    return _rounded(P.boundary_f1(px.join(own, ["t", "y", "x"]), _T, "cell_edge", "region_edge", "cell", 0, 2))


def r29_match_classes(spark, sf_dir):
    px = raster(spark, sf_dir)
    flags = px.select("t", "y", "x", (F.col("v") > 30).alias("ref"), (F.col("u") > 0.05).alias("found"))
    flags = P.dilate(P.dilate(P.dilate(flags, _T, "ref", 1, "near_ref"), _T, "found", 1, "near_found"), _T, "ref", 2, "roi")
    return P.match_classes(flags, "ref", "found", "near_ref", "near_found", "roi").groupBy("t", "match").agg(F.count(F.lit(1)).alias("n"))


def s23_coarsen(spark, sf_dir):
    return _rounded(P.coarsen(raster(spark, sf_dir), _T, "v", 3))


def s24_coarsen_mode(spark, sf_dir):
    return P.coarsen(raster(spark, sf_dir), _T, "label", 3, "mode")


def r09_coast(spark, sf_dir):
    land = raster(spark, sf_dir).select("t", "y", "x", F.when(F.col("v") > 25, 1).otherwise(0).alias("land"))
    return P.coast_code(land, _T)


def w11_window_mean(spark, sf_dir):
    from ..operators.stats import window_mean_2d

    return _rounded(window_mean_2d(raster(spark, sf_dir).where("t = 0"), "y", "x", "v", 5))


def _graph(spark, sf_dir):
    px = raster(spark, sf_dir)
    return P.adjacency(px, _T).drop("border"), P.label_stats(px, _T, ["v", "u"])


def g02_rbf(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(G.rbf_weights(e, n, _T, "label", F.lit(9.0)))


def g10_diffusion(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(G.diffusion(G.rbf_weights(e, n, _T, "label", F.lit(9.0)), n, _T, "label", "v_mean", 0.5))


def g12_headroom(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(G.headroom(G.rbf_weights(e, n, _T, "label", F.lit(9.0)), _T, 0.01, 3.0))


def g07_feature_distance(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(G.feature_distance(e, n, _T, "label", ["v_mean", "u_mean"]))


def g09_segments(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(G.line_segments(e, n, _T, "label"))


def g11_attention(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    w = R.both_ways(G.rbf_weights(e, n, _T, "label", F.lit(9.0)), "src", "dst")
    return _rounded(G.attention(w, _T, "w").select("t", "src", "dst", "alpha"))


def j10_radius_graph(spark, sf_dir):
    return _rounded(G.radius_graph(_graph(spark, sf_dir)[1], _T, "label", 12.5))


def j10_fallback_graph(spark, sf_dir):
    """A radius at which no two regions are near: two nearest neighbours instead."""
    return _rounded(G.connected_graph(_graph(spark, sf_dir)[1], _T, "label", 0.5, 2))


def g05_superset_graph(spark, sf_dir):
    """Pairs of regions that come within a radius in any frame."""
    nodes = _graph(spark, sf_dir)[1].withColumn("g", F.lit(0))
    return G.superset_graph(nodes, ["g"], "label", "t", 12.5).drop("g")


def u04_edges_of_all_frames(spark, sf_dir):
    """Touching regions of any frame."""
    return G.union_over_frames(_graph(spark, sf_dir)[0].withColumn("g", F.lit(0)), ["g"], "t").drop("g")


def w10_nearest(spark, sf_dir):
    return _rounded(G.nearest(_graph(spark, sf_dir)[1], _T, "label", 3))


def _flow(spark, sf_dir):
    return raster(spark, sf_dir).select("t", "y", "x", (F.col("u") * 10).alias("fy"), (F.col("v") / 20).alias("fx"))


def a33_label_flow(spark, sf_dir):
    return _rounded(P.label_flow(raster(spark, sf_dir), _flow(spark, sf_dir), _T))


def c18_advected(spark, sf_dir):
    px = raster(spark, sf_dir)
    return _rounded(P.advect(P.label_stats(px, _T, []).select("t", "label", "cy", "cx"), P.label_flow(px, _flow(spark, sf_dir), _T), _T, SIDE, SIDE))


def j17_values_at_nodes(spark, sf_dir):
    px = raster(spark, sf_dir)
    return _rounded(P.at_nodes(P.label_stats(px, _T, []).select("t", "label", "cy", "cx"), px, _T, ["v"], SIDE, SIDE).select("t", "label", "v"))


def f22_norms(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "embeddings").select("vec_id", X.l2_norm(F.col("embedding")).alias("norm")), 4)


def f17_minmax(spark, sf_dir):
    v = X.minmax(F.transform("embedding", lambda e: e.cast("double")))
    return _rounded(table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(v, F.lit(0.0), lambda s, e: s + e).alias("total"), F.array_max(v).alias("most"), F.array_min(v).alias("least")), 4)


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "acfgjmrsuw" and k[1:3].isdigit()}

_STATS = "st as (select t, label, avg(y) as cy, avg(x) as cx, count(*) as n_px, avg(v) as v_mean, var_pop(v) as v_var, avg(u) as u_mean, var_pop(u) as u_var from px where label > 0 group by t, label)"
_NB = "nb as (select a.t, a.y, a.x, a.label as a, b.label as b from px a join px b on a.t = b.t and ((b.y = a.y and b.x = a.x + 1) or (b.x = a.x and b.y = a.y + 1)))"
_ADJ = "adj as (select t, least(a, b) as src, greatest(a, b) as dst, count(*) as border from nb where a > 0 and b > 0 and a <> b group by 1, 2, 3)"
_AB = "pa as (select y, x, label as la from px where t = 0 and label > 0), pb as (select y, x, label as lb from px where t = 1 and label > 0)"
_OV = f"""{_AB}, bo as (select la, lb, count(*) as "both" from pa join pb using (y, x) group by 1, 2), na as (select la, count(*) as na from pa group by 1), nbb as (select lb, count(*) as nb from pb group by 1),
ov as (select *, "both" / (na + nb - "both" + 1e-8) as iou from bo join na using (la) join nbb using (lb))"""
_RBF = "w as (select adj.t, src, dst, exp(-(power(s.cy - d.cy, 2) + power(s.cx - d.cx, 2)) / 162.0) as w, s.v_mean as vs, d.v_mean as vd from adj join st s on s.t = adj.t and s.label = src join st d on d.t = adj.t and d.label = dst)"
_BW = "bw as (select t, src, dst, w, vs, vd from w union all select t, dst, src, w, vd, vs from w)"
_G = f"with {RASTER_SQL}, {_STATS}, {_NB}, {_ADJ}, {_RBF}, {_BW}"
_NEAR4 = "(abs(a.y - b.y) + abs(a.x - b.x) = 1)"


def _edge(src: str, out: str) -> str:
    return f"{out} as (select a.t, a.y, a.x, a.label, exists (select 1 from {src} b where b.t = a.t and {_NEAR4} and b.label <> a.label) as edge from {src} a)"


def _dil(flag: str, r: int) -> str:
    return f"exists (select 1 from f b where b.t = f.t and b.{flag} and (b.y - f.y) * (b.y - f.y) + (b.x - f.x) * (b.x - f.x) <= {r * r})"


SQL = {
    "a21_label_stats": f"with {RASTER_SQL}, {_STATS} select t, label, {_r('cy')} as cy, {_r('cx')} as cx, n_px, {_r('v_mean')} as v_mean, {_r('v_var')} as v_var from st",
    "a23_intra_variance": f"with {RASTER_SQL}, {_STATS} select t, {_r('(avg(v_var) + avg(u_var)) / 2')} as isv from st where n_px > 1 group by t",
    "a24_weighted_variance": f"with {RASTER_SQL}, {_STATS} select t, {_r('sum(v_var * n_px) / sum(n_px)')} as mdv from st where n_px > 1 group by t",
    "a25_pooled": f"with {RASTER_SQL}, {_STATS} select t, {_r('avg(v_mean)')} as mean, {_r('stddev_pop(v_mean)')} as std, {_r('max(v_mean)')} as most, count(*) as labels from st group by t",
    "j12_adjacency": f"with {RASTER_SQL}, {_NB}, {_ADJ} select * from adj",
    "j14_best_overlap": f"with {RASTER_SQL}, {_OV} select la, lb, {_r('iou')} as iou from (select *, row_number() over (partition by la order by \"both\" desc, lb) as k from ov) where k = 1",
    "j15_overlaps": f"with {RASTER_SQL}, {_OV} select la, lb, \"both\", na, nb, {_r('iou')} as iou from ov",
    "m03_turnover": f"with {RASTER_SQL}, {_AB}, a as (select distinct la as l from pa), b as (select distinct lb as l from pb) select {_r('count(*) filter (where a.l is null or b.l is null) / count(*)')} as ged from a full join b on a.l = b.l",
    "m01_flow_error": f"""with {RASTER_SQL}, {_STATS}, fl as (select label, avg(u * 10) as fy, avg(v / 20) as fx from px where t = 0 and label > 0 group by 1)
select {_r('avg(sqrt(power(b.cy - a.cy - fy, 2) + power(b.cx - a.cx - fx, 2)))')} as fae from st a join st b on b.label = a.label and a.t = 0 and b.t = 1 join fl on fl.label = a.label""",
    "m07_boundary_jaccard": f"""with {RASTER_SQL}, {_edge('px', 'e')} select {_r('count(*) filter (where a.edge and b.edge) / count(*) filter (where a.edge or b.edge)')} as bji from e a join e b on a.t = 0 and b.t = 1 and a.y = b.y and a.x = b.x""",
    "r12_gradient": f"""with {RASTER_SQL}, d as (select t, y, x, v, lag(v) over r as l, lead(v) over r as n, lag(v) over c as o, lead(v) over c as p from px window r as (partition by t, y order by x), c as (partition by t, x order by y)),
g as (select *, case when l is null and n is null then 0 when l is null then n - v when n is null then v - l else (n - l) / 2 end as gx, case when o is null and p is null then 0 when o is null then p - v when p is null then v - o else (p - o) / 2 end as gy from d)
select t, y, x, {_r('sqrt(gx * gx + gy * gy)')} as grad from g""",
    "r14_dilation": f"with {RASTER_SQL}, f as (select t, y, x, v > 32 as \"on\" from px) select t, cast(sum(\"on\"::int) as bigint) as n_on, cast(sum(({_dil(chr(34) + 'on' + chr(34), 2)})::int) as bigint) as n_near from f group by t",
    "r15_boundary": f"with {RASTER_SQL}, {_edge('px', 'e')} select t, y, x from e where edge and label > 0",
    "m10_boundary_f1": f"""with {RASTER_SQL}, {_edge('px', 'e')}, c as (select t, y, x, cast(v > 30 as int) as label from px), {_edge('c', 'ce')},
f as (select e.t, e.y, e.x, e.edge as s, ce.edge and ce.label = 1 as c, ce.label = 1 as cell from e join ce using (t, y, x)),
g as (select t, sum((s and c)::int) as nb, sum((s and {_dil('cell', 2)})::int) as sr, sum(c::int) as nc from f group by t),
h as (select t, nb / (sr + 1e-8) as p, nb / (nc + 1e-8) as r from g) select t, {_r('p')} as precision, {_r('r')} as recall, {_r('2 * p * r / (p + r + 1e-8)')} as f1 from h""",
    "r29_match_classes": f"""with {RASTER_SQL}, f as (select t, y, x, v > 30 as ref, u > 0.05 as found from px),
g as (select t, ref, found, {_dil('ref', 1)} as nr, {_dil('found', 1)} as nf, {_dil('ref', 2)} as roi from f)
select t, case when found and nr then 'TP' when found and roi then 'FP_in' when found then 'FP_out' when ref and not nf then 'FN' else 'none' end as "match", count(*) as n from g group by 1, 2""",
    "s23_coarsen": f"with {RASTER_SQL} select t, cast(floor(y / 3.0) as int) as y, cast(floor(x / 3.0) as int) as x, {_r('avg(v)')} as v from px group by 1, 2, 3",
    "s24_coarsen_mode": f"""with {RASTER_SQL}, c as (select t, cast(floor(y / 3.0) as int) as y, cast(floor(x / 3.0) as int) as x, label, count(*) as n from px group by 1, 2, 3, 4)
select t, y, x, label from (select *, row_number() over (partition by t, y, x order by n desc, label) as k from c) where k = 1""",
    "r09_coast": f"""with {RASTER_SQL}, l as (select t, y, x, case when v > 25 then 1 else 0 end as land from px),
c as (select *, land = 1 and exists (select 1 from l b where b.t = a.t and {_NEAR4} and b.land = 0) as coast from l a)
select t, y, x, cast(land = 1 and not coast as int) as bit1, cast(coast as int) as bit0 from c""",
    "w11_window_mean": f"with {RASTER_SQL} select a.y, a.x, {_r('avg(b.v)')} as mean from px a join px b on a.t = 0 and b.t = 0 and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by 1, 2",
    "g02_rbf": f"{_G} select t, src, dst, {_r('w')} as w from w",
    "g10_diffusion": f"{_G}, f as (select t, dst as label, 0.5 * sum(w * (vs - vd)) as flux from bw group by 1, 2) select st.t, st.label, {_r('coalesce(flux, 0)')} as flux from st left join f using (t, label)",
    "g12_headroom": f"""{_G}, k as (select t, max(s) as k from (select t, src, sum(w) as s from bw group by 1, 2) group by t)
select t, {_r('k')} as k_max, {_r('3.0 / (0.01 * k)')} as dt_stable, {_r('3.0 / (0.01 * k) / 150')} as headroom, case when 3.0 / (0.01 * k) / 150 < 1 then 'sub-steps' when 3.0 / (0.01 * k) / 150 < 2 then 'marginal' else 'stable' end as verdict from k""",
    "g07_feature_distance": f"{_G} select adj.t, src, dst, {_r('sqrt(power(s.v_mean - d.v_mean, 2) + power(s.u_mean - d.u_mean, 2))')} as w from adj join st s on s.t = adj.t and s.label = src join st d on d.t = adj.t and d.label = dst",
    "g09_segments": f"{_G} select adj.t, src, dst, {_r('s.cx')} as x0, {_r('s.cy')} as y0, {_r('d.cx')} as x1, {_r('d.cy')} as y1 from adj join st s on s.t = adj.t and s.label = src join st d on d.t = adj.t and d.label = dst",
    "g11_attention": f"{_G} select t, src, dst, {_r('exp(w) / sum(exp(w)) over (partition by t, dst)')} as alpha from bw",
    "j10_radius_graph": f"{_G}, d as (select a.t, a.label as src, b.label as dst, sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) as d from st a join st b on a.t = b.t and a.label < b.label) select t, src, dst, {_r('d')} as d from d where d > 0 and d < 12.5",
    "w10_nearest": f"""{_G}, d as (select a.t, a.label as src, b.label as dst, sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) as d from st a join st b on a.t = b.t and a.label <> b.label),
r as (select *, cast(row_number() over (partition by t, src order by d, dst) as int) as rank from d) select t, src, dst, {_r('d')} as d, rank from r where rank <= 3""",
    "j10_fallback_graph": f"""{_G}, d as (select a.t, a.label as src, b.label as dst, sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) as d from st a join st b on a.t = b.t and a.label <> b.label),
r as (select *, row_number() over (partition by t, src order by d, dst) as rank from d) select distinct t, least(src, dst) as src, greatest(src, dst) as dst, {_r('d')} as d from r where rank <= 2""",
    "g05_superset_graph": f"{_G}, d as (select a.t, a.label as src, b.label as dst, sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) as d from st a join st b on a.t = b.t and a.label < b.label) select src, dst, count(distinct t) as n_frames from d where d > 0 and d < 12.5 group by 1, 2",
    "u04_edges_of_all_frames": f"with {RASTER_SQL}, {_NB}, {_ADJ} select least(src, dst) as src, greatest(src, dst) as dst, count(distinct t) as n_frames from adj group by 1, 2",
    "a33_label_flow": f"with {RASTER_SQL} select t, label, {_r('avg(u * 10)')} as fy, {_r('avg(v / 20)')} as fx, count(*) as n_px from px where label > 0 group by 1, 2",
    "c18_advected": f"""with {RASTER_SQL} select t, label, {_r('least(greatest(avg(y) + avg(u * 10), 0), 31)')} as cy, {_r('least(greatest(avg(x) + avg(v / 20), 0), 31)')} as cx from px where label > 0 group by 1, 2""",
    "j17_values_at_nodes": f"with {RASTER_SQL}, {_STATS} select st.t, st.label, {_r('px.v')} as v from st left join px on px.t = st.t and px.y = floor(cy) and px.x = floor(cx)",
    "f22_norms": f"select vec_id, {_r('sqrt(list_sum(list_transform(embedding, lambda e: e::double * e::double)))', 4)} as norm from embeddings",
    "f17_minmax": f"""with m as (select vec_id, list_transform(embedding, lambda e: e::double) as v, list_min(embedding)::double as lo, list_max(embedding)::double as hi from embeddings)
select vec_id, {_r('list_sum(list_transform(v, lambda e: (e - lo) / (hi - lo)))', 4)} as total, {_r('1.0::double', 4)} as most, {_r('0.0::double', 4)} as least from m""",
}
