"""Graph operators over node and edge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .relational import both_ways


def with_ends(edges: DataFrame, nodes: DataFrame, by: list[str], node: str, values: list[str]) -> DataFrame:
    """edges (by, src, dst) with the values of both ends, as {value}_s and {value}_d."""
    end = lambda side: nodes.select(*by, F.col(node).alias("src" if side == "s" else "dst"), *[F.col(v).alias(f"{v}_{side}") for v in values])
    return edges.join(end("s"), [*by, "src"]).join(end("d"), [*by, "dst"])


def rbf_weights(edges: DataFrame, nodes: DataFrame, by: list[str], node: str, sigma: Column) -> DataFrame:
    """edges with w = exp(-d^2 / (2 sigma^2)) of the distance between their ends' (cy, cx)."""
    e = with_ends(edges, nodes, by, node, ["cy", "cx"])
    d2 = F.pow(F.col("cy_s") - F.col("cy_d"), F.lit(2)) + F.pow(F.col("cx_s") - F.col("cx_d"), F.lit(2))
    return e.withColumn("w", F.exp(-d2 / (2 * sigma * sigma))).drop("cy_s", "cy_d", "cx_s", "cx_d")


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, degree, strength) of undirected edges given once."""
    return both_ways(edges, "src", "dst").groupBy(*by, "src").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def diffusion(edges: DataFrame, nodes: DataFrame, by: list[str], node: str, value: str, d: float) -> DataFrame:
    """(by, node, flux): d times the weighted sum of neighbours' excess; the fluxes of a graph sum to zero. edges are undirected
    and given once; nodes without edges have flux 0."""
    e = with_ends(both_ways(edges, "src", "dst"), nodes, by, node, [value])
    f = e.groupBy(*by, F.col("dst").alias(node)).agg((d * F.sum(F.col("w") * (F.col(f"{value}_s") - F.col(f"{value}_d")))).alias("flux"))
    return nodes.select(*by, node).join(f, [*by, node], "left").withColumn("flux", F.coalesce("flux", F.lit(0.0)))


def radius_graph(nodes: DataFrame, by: list[str], node: str, radius: float) -> DataFrame:
    """(by, src, dst, d): pairs at distance 0 < d < radius, src < dst. Nodes are binned by radius; each is compared with its own
    and the eight bins around it."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = nodes.select(*by, F.col(node).alias("src"), F.col("cy").alias("ay"), F.col("cx").alias("ax"), cell("cy").alias("_r"), cell("cx").alias("_c"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = nodes.select(*by, F.col(node).alias("dst"), F.col("cy").alias("by_"), F.col("cx").alias("bx_"), cell("cy").alias("_r0"), cell("cx").alias("_c0")).withColumn("m", around)
    b = b.withColumn("_r", F.col("_r0") + F.col("m.i")).withColumn("_c", F.col("_c0") + F.col("m.j")).drop("m", "_r0", "_c0")
    d = F.hypot(F.col("ay") - F.col("by_"), F.col("ax") - F.col("bx_"))
    return a.join(b, [*by, "_r", "_c"]).where(F.col("src") < F.col("dst")).withColumn("d", d).where((F.col("d") > 0) & (F.col("d") < radius)).select(*by, "src", "dst", "d")


def nearest(nodes: DataFrame, by: list[str], node: str, k: int) -> DataFrame:
    """(by, src, dst, d, rank): the k nearest other nodes of each node within its group, lower name first on a tie. Nodes are
    binned by cells that hold about k of them on the average, and each is compared with its own cell and the eight around it;
    it is done if its k-th distance lies within a cell's width or these cells hold its whole group. The others try again with
    cells twice as wide."""
    span = F.greatest(F.max("cy") - F.min("cy"), F.max("cx") - F.min("cx"))
    width = F.greatest(span / F.greatest(F.sqrt(F.count(F.lit(1)) / F.lit(float(max(1, k)))), F.lit(1.0)), F.lit(1e-9))
    groups = nodes.groupBy(*by).agg(F.min("cy").alias("_y0"), F.min("cx").alias("_x0"), span.alias("_span"), width.alias("_width"))
    base = settle(nodes.select(*by, F.col(node).alias("_id"), "cy", "cx").join(groups, by), "nearest")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left, done, scale = base, None, 1.0
    while not left.isEmpty():
        size = F.col("_width") * scale
        row, column = F.floor((F.col("cy") - F.col("_y0")) / size), F.floor((F.col("cx") - F.col("_x0")) / size)
        a = left.select(*by, F.col("_id").alias("src"), F.col("cy").alias("ay"), F.col("cx").alias("ax"), size.alias("_size"), F.col("_span"), row.alias("_r0"), column.alias("_c0")).withColumn("m", around)
        a = a.withColumn("_r", F.col("_r0") + F.col("m.i")).withColumn("_c", F.col("_c0") + F.col("m.j")).drop("m", "_r0", "_c0")
        b = base.select(*by, F.col("_id").alias("dst"), F.col("cy").alias("by_"), F.col("cx").alias("bx_"), row.alias("_r"), column.alias("_c"))
        p = a.join(b, [*by, "_r", "_c"]).where("src <> dst").withColumn("d", F.hypot(F.col("ay") - F.col("by_"), F.col("ax") - F.col("bx_")))
        p = p.withColumn("rank", F.row_number().over(W.partitionBy(*by, "src").orderBy("d", "dst"))).where(F.col("rank") <= k)
        p = settle(p.select(*by, "src", "dst", "d", "rank", ((F.col("rank") == k) & (F.col("d") <= F.col("_size"))).alias("_near")), "nearest-some")
        good = left.where(F.col("_span") <= size).select(*by, F.col("_id").alias("src")).unionByName(p.where("_near").select(*by, "src")).distinct()
        found = p.join(good, [*by, "src"]).select(*by, "src", "dst", "d", "rank")
        done = found if done is None else done.unionByName(found)
        left = settle(left.join(good.withColumnRenamed("src", "_id"), [*by, "_id"], "left_anti"), "nearest-left")
        scale *= 2
    if done is None:
        return base.select(*by, F.col("_id").alias("src"), F.col("_id").alias("dst"), F.col("cy").alias("d"), F.lit(1).alias("rank")).limit(0)
    return done


def connected_graph(nodes: DataFrame, by: list[str], node: str, radius: float, k: int) -> DataFrame:
    """(by, src, dst, d): radius_graph(), and for groups in which it has no edge the k nearest nodes, each pair once."""
    near = settle(radius_graph(nodes, by, node, radius), "radius-graph")
    bare = nodes.join(near.select(*by).distinct(), by, "left_anti")
    more = nearest(bare, by, node, k).select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d").distinct()
    return near.unionByName(more)


def union_over_frames(edges: DataFrame, by: list[str], frame: str) -> DataFrame:
    """(by, src, dst, n_frames): undirected edges that any frame has, each once, with the number of frames that have it."""
    e = edges.select(*by, frame, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.groupBy(*by, "src", "dst").agg(F.countDistinct(frame).alias("n_frames"))


def superset_graph(nodes: DataFrame, by: list[str], node: str, frame: str, radius: float) -> DataFrame:
    """(by, src, dst, n_frames): pairs of nodes that come nearer than the radius in any frame."""
    return union_over_frames(radius_graph(nodes, [*by, frame], node, radius), by, frame)


def feature_distance(edges: DataFrame, nodes: DataFrame, by: list[str], node: str, features: list[str]) -> DataFrame:
    """Region adjacency weights: Euclidean distance of the ends' features."""
    e = with_ends(edges, nodes, by, node, features)
    d2 = sum((F.pow(F.col(f"{f}_s") - F.col(f"{f}_d"), F.lit(2)) for f in features), F.lit(0.0))
    return e.withColumn("w", F.sqrt(d2)).select(*by, "src", "dst", "w")


def line_segments(edges: DataFrame, nodes: DataFrame, by: list[str], node: str) -> DataFrame:
    e = with_ends(edges, nodes, by, node, ["cy", "cx"])
    return e.select(*by, "src", "dst", F.col("cx_s").alias("x0"), F.col("cy_s").alias("y0"), F.col("cx_d").alias("x1"), F.col("cy_d").alias("y1"))


def attention(edges: DataFrame, by: list[str], score: str) -> DataFrame:
    """edges with alpha: softmax of the score over each receiver's incoming edges."""
    w = W.partitionBy(*by, "dst")
    e = edges.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("alpha", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def headroom(edges: DataFrame, by: list[str], d: float, r_stab: float, dt: float = 300.0) -> DataFrame:
    """(by, k_max, dt_stable, headroom, verdict) of explicit diffusion at half a macro step."""
    k = degrees(edges, by).groupBy(*by).agg(F.max("strength").alias("k_max"))
    k = k.withColumn("dt_stable", r_stab / (d * F.col("k_max"))).withColumn("headroom", F.col("dt_stable") / (dt / 2))
    return k.withColumn("verdict", F.when(F.col("headroom") < 1, "sub-steps").when(F.col("headroom") < 2, "marginal").otherwise("stable"))
