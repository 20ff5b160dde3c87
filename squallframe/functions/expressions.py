"""Scalar functions as Column expressions (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ID_SUFFIXES

# Side of a frame in pixels, largest speed in pixels a frame, forecast frames, floats of an edge.
FRAME_SIDE, V_MAX, FORECAST_FRAMES, EDGE_FLOATS = 384, 9, 12, 6
# Outer weight of the stiffness penalty by lifecycle class, and for any other.
CLASS_ALPHA = {"RAPID_GROWTH": 1.40, "GROWTH_DECAY": 1.20, "EPISODIC": 0.95, "PLATEAU": 0.65, "RAPID_DECAY": 0.65, "STEADY": 0.55, "QUIESCENT": 0.35}
OTHER_ALPHA = 0.70


def path_parts(path: Column) -> Column:
    """Parts of a path; backslashes count as slashes."""
    return F.split(F.translate(path, "\\", "/"), "/")


def base_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def bare_id(path: Column) -> Column:
    """The event id in a sweep file's name: base name without ending and known suffix."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.regexp_replace(stem, f"({'|'.join(ID_SUFFIXES)})$", "")


def swapped_path(path: Column) -> Column:
    """The other layout of a catalogue path: a/b/f as b/a/f; other depths stay."""
    p = path_parts(path)
    return F.when(F.size(p) == 3, F.concat_ws("/", p[1], p[0], p[2])).otherwise(path)


def run_tag(n: Column) -> Column:
    return F.format_string("N%04d", n)


def extent_key(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Name of an extent's cache entry: four decimals each, rounded half up, m for minus."""

    def part(c: Column) -> Column:
        k = F.floor(c * 10000 + 0.5)
        return F.concat(F.when(k < 0, F.lit("m")).otherwise(F.lit("")), F.floor(F.abs(k) / 10000).cast("string"), F.lit("."), F.lpad((F.abs(k) % 10000).cast("string"), 4, "0"))

    return F.concat_ws("_", *[part(c) for c in (lon1, lat1, lon2, lat2)])


def frame_index(seconds: Column, step: float = 300.0) -> Column:
    return F.floor(seconds / step).cast("int")


def sigmoid(x: Column, slope: float, middle: float) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * (x - middle)))


def silu(x: Column) -> Column:
    return x / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def super_edges(n: Column, side: int = FRAME_SIDE, v_max: float = V_MAX, steps: int = FORECAST_FRAMES) -> Column:
    """Edges to allocate for n regions: n times the regions within reach, n - 1 at most, truncated."""
    reach = math.pi * (v_max * steps) ** 2
    around = F.lit(reach) / (F.lit(float(side * side)) / F.greatest(n, F.lit(1)))
    return (n * F.least(around, (n - 1).cast("double"))).cast("bigint")


def edge_memory_mb(edges: Column, batch: int = 32, floats: int = EDGE_FLOATS) -> Column:
    return edges * (batch * floats * 4) / 1e6


def rbf_width(n: Column, h: int, w: int, scale: float) -> Column:
    return scale * F.sqrt(F.lit(float(h * w)) / n)


def class_alpha(c: Column) -> Column:
    out = F.lit(OTHER_ALPHA)
    for name, value in CLASS_ALPHA.items():
        out = F.when(c == name, F.lit(value)).otherwise(out)
    return out


def settled(c: Column, digits: int) -> Column:
    """Rounded half up by way of twelve decimals: means of a few short decimals are often exact ties, which the order in which
    doubles were summed must not decide. Null beyond 26 digits before the point."""
    return F.round(c.try_cast("decimal(38,12)"), digits).cast("double")


def vil_physical(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) / 255.0 * 70.0


def region_hint(active: Column, cells: Column, least: int = 500, most: int = 2500) -> Column:
    """A first guess at a region count: grows with active fraction and number of cells, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(least) + (active * 1000).cast("int") + cells * 50)).cast("int")


def slope_sign(s: Column, flat: float = 1e-6) -> Column:
    return F.when(F.abs(s) < flat, 0).otherwise(F.signum(s)).cast("int")


def binding(voted: Column, lfs: Column, vram: Column) -> Column:
    """Which limits hold the voted number down."""
    texts = F.concat_ws(" + ", F.when(voted > lfs, F.lit("LFS-stiffness")), F.when(voted > vram, F.lit("VRAM")))
    return F.when(texts == "", F.lit("none (quality-dominated)")).otherwise(texts)


def minmax(a: Column) -> Column:
    """An array scaled to 0..1; a flat one becomes zeros."""
    lo, hi = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda v: F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0))


def zscores(a: Column) -> Column:
    """Array scaled by population deviation, guarded by 1e-9."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    return F.transform(a, lambda v: (v - mean) / (F.sqrt(var) + 1e-9))


def fixed_scaling(a: Column, most: float = 255.0) -> Column:
    """An array over a fixed maximum."""
    return F.transform(a, lambda v: v / most)


def own_scaling(a: Column) -> Column:
    """An array over its own maximum, guarded by 1e-6."""
    return F.transform(a, lambda v: v / (F.array_max(a) + 1e-6))


# What a solver ends with, by code.
SOLVER_RESULTS = ("successful", "max_steps_reached", "dt_min_reached", "nonlinear_divergence")


def solver_result(code: Column) -> Column:
    """The name of a solver's result; other codes are unknown, with their number."""
    names = F.array(*[F.lit(n) for n in SOLVER_RESULTS])
    return F.when(code.between(0, len(SOLVER_RESULTS) - 1), F.get(names, code)).otherwise(F.concat(F.lit("unknown("), code.cast("string"), F.lit(")")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v))


def lambert_xy(lon: Column, lat: Column, lon0: float = -98.0, lat0: float = 38.0, sp1: float = 30.0, sp2: float = 60.0, radius: float = 6_370_000.0) -> tuple[Column, Column]:
    """Lambert conformal conic coordinates in metres on a sphere (Snyder 1987, equations 15-1 to 15-5)."""
    r = math.radians
    t = lambda phi: math.tan(math.pi / 4 + phi / 2)
    n = math.log(math.cos(r(sp1)) / math.cos(r(sp2))) / math.log(t(r(sp2)) / t(r(sp1)))
    f = math.cos(r(sp1)) * t(r(sp1)) ** n / n
    rho0 = radius * f / t(r(lat0)) ** n
    rho = radius * f / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)
