"""Raster operators as SQL over pixel rows: label statistics, neighbours, overlaps, boundaries, scores.

Pixel rows are (by..., y, x, label, v...); ``by`` names the frame or event. Neighbour joins are equi-joins on shifted
coordinates, so that frames stay apart and partition by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def explode_frames(frames: DataFrame) -> DataFrame:
    """(event_id, channel, t, y, x, v) from frames with row-major arrays."""
    p = frames.select("event_id", "channel", "t", "w", F.posexplode("data").alias("i", "v"))
    return p.select("event_id", "channel", "t", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


def label_stats(px: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Centroid, size and mean, population variance of each value, for labels above 0."""
    aggs = [F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("n_px")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.var_pop(v).alias(f"{v}_var")]
    return px.where("label > 0").groupBy(*by, "label").agg(*aggs)


def intra_variance(px: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, isv): variance within labels of more than one pixel, averaged over labels and then over values."""
    g = label_stats(px, by, values).where("n_px > 1").groupBy(*by).agg(*[F.avg(f"{v}_var").alias(v) for v in values])
    return g.select(*by, (sum((F.col(v) for v in values), F.lit(0.0)) / len(values)).alias("isv"))


def weighted_variance(px: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mdv): variance within labels of more than one pixel, weighted by their size."""
    g = label_stats(px, by, [value]).where("n_px > 1")
    return g.groupBy(*by).agg((F.sum(F.col(f"{value}_var") * F.col("n_px")) / F.sum("n_px")).alias("mdv"))


def neighbours(px: DataFrame, by: list[str], value: str, steps: tuple[tuple[int, int], ...] = ((0, 1), (1, 0))) -> DataFrame:
    """(by, y, x, a, b): the value of each pixel and of its neighbour, for each step; one join for all steps."""
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    here = px.select(*by, "y", "x", F.col(value).alias("a")).withColumn("m", moves)
    here = here.withColumn("_y", F.col("y") + F.col("m.dy")).withColumn("_x", F.col("x") + F.col("m.dx"))
    there = px.select(*by, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("b"))
    return here.join(there, [*by, "_y", "_x"]).select(*by, "y", "x", "a", "b")


def adjacency(px: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, border): pairs of touching labels above 0, src < dst, with the number of touching pixel pairs."""
    n = neighbours(px, by, "label").where("a > 0 and b > 0 and a <> b")
    return n.groupBy(*by, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).alias("border"))


def boundary(px: DataFrame, by: list[str], positive: bool = False) -> DataFrame:
    """px with ``edge``: whether any of the four neighbours has another label; the frame's rim is no neighbour. With positive only
    labels above 0 are edges."""
    n = neighbours(px, by, "label", ((0, 1), (1, 0), (0, -1), (-1, 0))).where("a <> b").select(*by, "y", "x").distinct().withColumn("_e", F.lit(True))
    got = px.join(n, [*by, "y", "x"], "left").withColumn("edge", F.coalesce("_e", F.lit(False))).drop("_e")
    return got.withColumn("edge", F.col("edge") & (F.col("label") > 0)) if positive else got


def gradient(px: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, y, x, grad): magnitude of central differences, one-sided at the rim."""
    row, col = W.partitionBy(*by, "y").orderBy("x"), W.partitionBy(*by, "x").orderBy("y")

    def diff(w: W) -> Column:
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)

    g = px.withColumn("_gx", diff(row)).withColumn("_gy", diff(col))
    return g.select(*by, "y", "x", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).alias("grad"))


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def dilate(px: DataFrame, by: list[str], flag: str, radius: int, alias: str) -> DataFrame:
    """px with ``alias``: whether a flagged pixel lies within the radius. Only flagged pixels are spread."""
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk(radius)]))
    on = px.where(flag).select(*by, "y", "x").withColumn("m", moves)
    hit = on.select(*by, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).distinct().withColumn("_d", F.lit(True))
    return px.join(hit, [*by, "y", "x"], "left").withColumn(alias, F.coalesce("_d", F.lit(False))).drop("_d")


def overlaps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, la, lb, both, na, nb, iou): all pairs of labels above 0 that share pixels."""
    pa = a.where("label > 0").select(*by, "y", "x", F.col("label").alias("la"))
    pb = b.where("label > 0").select(*by, "y", "x", F.col("label").alias("lb"))
    both = pa.join(pb, [*by, "y", "x"]).groupBy(*by, "la", "lb").agg(F.count(F.lit(1)).alias("both"))
    na, nb = pa.groupBy(*by, "la").agg(F.count(F.lit(1)).alias("na")), pb.groupBy(*by, "lb").agg(F.count(F.lit(1)).alias("nb"))
    return both.join(na, [*by, "la"]).join(nb, [*by, "lb"]).withColumn("iou", F.col("both") / (F.col("na") + F.col("nb") - F.col("both") + 1e-8))


def best_overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, la, lb, iou): for each label of a the label of b with most of its pixels, the smaller one on a tie."""
    o = overlaps(a, b, by)
    return o.groupBy(*by, "la").agg(F.max_by(F.struct("lb", "iou"), F.struct(F.col("both"), -F.col("lb"))).alias("m")).select(*by, "la", F.col("m.lb").alias("lb"), F.col("m.iou").alias("iou"))


def turnover(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, ged): labels that appear or vanish from a to b, as a share of all."""
    la = a.where("label > 0").select(*by, "label").distinct().withColumn("_a", F.lit(1))
    lb = b.where("label > 0").select(*by, "label").distinct().withColumn("_b", F.lit(1))
    j = la.join(lb, [*by, "label"], "full_outer")
    return j.groupBy(*by).agg((F.sum(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias("ged"))


def flow_error(a: DataFrame, b: DataFrame, flow: DataFrame, by: list[str]) -> DataFrame:
    """(by, fae): mean length of (centroid motion - mean flow under the label) over labels common to both frames."""
    ca, cb = label_stats(a, by, []), label_stats(b, by, []).select(*by, "label", F.col("cy").alias("cy1"), F.col("cx").alias("cx1"))
    m = a.where("label > 0").join(flow, [*by, "y", "x"]).groupBy(*by, "label").agg(F.avg("fy").alias("fy"), F.avg("fx").alias("fx"))
    j = ca.join(cb, [*by, "label"]).join(m, [*by, "label"])
    return j.groupBy(*by).agg(F.avg(F.hypot(F.col("cy1") - F.col("cy") - F.col("fy"), F.col("cx1") - F.col("cx") - F.col("fx"))).alias("fae"))


def label_flow(px: DataFrame, flow: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, fy, fx, n_px): mean flow of each label's pixels."""
    j = px.where("label > 0").select(*by, "y", "x", "label").join(flow.select(*by, "y", "x", "fy", "fx"), [*by, "y", "x"])
    return j.groupBy(*by, "label").agg(F.avg("fy").alias("fy"), F.avg("fx").alias("fx"), F.count(F.lit(1)).alias("n_px"))


def at_nodes(nodes: DataFrame, px: DataFrame, by: list[str], values: list[str], h: int, w: int) -> DataFrame:
    """nodes (by, cy, cx, ...) with the values of the pixel that each centre lies in, clipped to the raster."""
    n = nodes.withColumn("y", F.least(F.greatest(F.floor("cy"), F.lit(0)), F.lit(h - 1)).cast("int")).withColumn("x", F.least(F.greatest(F.floor("cx"), F.lit(0)), F.lit(w - 1)).cast("int"))
    return n.join(px.select(*by, "y", "x", *values), [*by, "y", "x"], "left").drop("y", "x")


def advect(nodes: DataFrame, flow: DataFrame, by: list[str], h: int, w: int) -> DataFrame:
    """nodes (by, label, cy, cx) moved by the mean flow (by, label, fy, fx) of their label, clipped to the raster; without flow they stay."""
    m = nodes.join(flow.select(*by, "label", "fy", "fx"), [*by, "label"], "left")
    to = lambda c, d, n: F.least(F.greatest(F.col(c) + F.coalesce(F.col(d), F.lit(0.0)), F.lit(0.0)), F.lit(float(n - 1)))
    return m.withColumn("cy", to("cy", "fy", h)).withColumn("cx", to("cx", "fx", w)).drop("fy", "fx")


def boundary_jaccard(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, bji): common share of two boundaries, 1 if both are empty."""
    ea, eb = boundary(a, by).select(*by, "y", "x", F.col("edge").alias("ea")), boundary(b, by).select(*by, "y", "x", F.col("edge").alias("eb"))
    j = ea.join(eb, [*by, "y", "x"])
    both, some = F.sum((F.col("ea") & F.col("eb")).cast("int")), F.sum((F.col("ea") | F.col("eb")).cast("int"))
    return j.groupBy(*by).agg(F.when(some == 0, 1.0).otherwise(both / some).alias("bji"))


def boundary_f1(px: DataFrame, by: list[str], cell_edge: str, region_edge: str, cell: str, tolerance: int = 0, margin: int = 5) -> DataFrame:
    """(by, precision, recall, f1): boundary match with a tolerance; precision counts only region boundaries within the margin of a
    cell in its denominator."""
    if margin <= tolerance:
        raise ValueError("the margin must exceed the tolerance")
    p = dilate(dilate(dilate(px, by, cell_edge, tolerance, "_near_cell"), by, region_edge, tolerance, "_near_region"), by, cell, margin, "_roi")
    n = lambda c: F.sum(c.cast("double"))
    s, c = F.col(region_edge), F.col(cell_edge)
    g = p.groupBy(*by).agg((n(s & F.col("_near_cell")) / (n(s & F.col("_roi")) + 1e-8)).alias("precision"), (n(c & F.col("_near_region")) / (n(c) + 1e-8)).alias("recall"))
    return g.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))


def match_classes(px: DataFrame, ref: str, found: str, near_ref: str, near_found: str, roi: str) -> DataFrame:
    """px with ``match``: TP, FP in the region of interest, FP outside, FN, or none."""
    c = F.col
    kind = F.when(c(found) & c(near_ref), "TP").when(c(found) & c(roi), "FP_in").when(c(found), "FP_out").when(c(ref) & ~c(near_found), "FN").otherwise("none")
    return px.withColumn("match", kind)


def coarsen(px: DataFrame, by: list[str], value: str, size: int, how: str = "mean") -> DataFrame:
    """(by, y, x, value): squares of size x size as their mean, or as the most frequent value (the smallest on a tie)."""
    cell = px.select(*by, F.floor(F.col("y") / size).cast("int").alias("y"), F.floor(F.col("x") / size).cast("int").alias("x"), value)
    if how == "mean":
        return cell.groupBy(*by, "y", "x").agg(F.avg(value).alias(value))
    n = cell.groupBy(*by, "y", "x", value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by, "y", "x").agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(value))


def coast_code(land: DataFrame, by: list[str]) -> DataFrame:
    """land (by, y, x, land 0/1) with two bits: ocean 00, land 10, coast 01, which is land that touches ocean."""
    wet = neighbours(land, by, "land", ((0, 1), (1, 0), (0, -1), (-1, 0))).where("a = 1 and b = 0").select(*by, "y", "x").distinct().withColumn("_c", F.lit(True))
    got = land.join(wet, [*by, "y", "x"], "left")
    coast = F.coalesce("_c", F.lit(False))
    return got.select(*by, "y", "x", F.when((F.col("land") == 1) & ~coast, 1).otherwise(0).alias("bit1"), F.when(coast, 1).otherwise(0).alias("bit0"))
