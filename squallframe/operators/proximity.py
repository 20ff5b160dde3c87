"""Points in regions and points near points, by crossing parity over latitude strips.

A region is a set of rings in the longitude-latitude plane. Its edges are binned into latitude strips, and within a strip
into longitude cells that the region covers there; points are binned alike, so that strip and cell are an equi-join key and
no pair is looked at whose bins differ. For each (region, point) the edges that a ray to the east crosses are counted: an odd
number means inside. A point on an edge is found explicitly and is inside, whatever the parity. Since all edges of a region
that matter for a point share the point's strip and cell, the count needs no second shuffle.

Neighbours within a distance are the points inside the smallest box around each point's circle (a cap around a pole covers all
longitudes), by the same operator, followed by the exact great-circle distance. Equal places are one point throughout and
only the last step names their members.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle

EARTH_KM = 6371.0


def box_places(rows: DataFrame, key: str = "id", lon: tuple[str, str] = ("llcrnrlon", "urcrnrlon"), lat: tuple[str, str] = ("llcrnrlat", "urcrnrlat")) -> DataFrame:
    """(key, lat, lon) of the middle of each key's box, for keys that have a usable one.

    Usable: four corners present (NaN counts as missing), latitudes in -90..90, longitudes in -360..360, and neither pair
    equal. Corners may be in any order and either longitude convention; the middle lies on the shorter arc, modulo 360. Of
    several usable rows of a key the least place counts, so that repeated rows and noise in the last digit change nothing.
    Null keys have no place."""
    x1, x2, y1, y2 = (F.col(f"`{c}`").cast("double") for c in (*lon, *lat))
    ok = y1.between(-90, 90) & y2.between(-90, 90) & x1.between(-360, 360) & x2.between(-360, 360) & (y1 != y2) & (x1 != x2)
    turn = F.pmod(x2 - x1 + 540.0, F.lit(360.0)) - 180.0
    mid = F.pmod(x1 + turn / 2, F.lit(360.0))
    # Nine decimals are a tenth of a millimetre: they only join what differs in rounding noise.
    place = F.struct(F.round((y1 + y2) / 2, 9).alias("lat"), F.pmod(F.round(mid, 9), F.lit(360.0)).alias("lon"))
    got = rows.where(ok & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.min(place).alias("_p"))
    return got.select(key, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))


def _strip(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height)


def _cells(strip: Column, height: float, width: float) -> Column:
    """How many longitude cells a strip has: fewer near the poles, so that a cell keeps its width on the ground."""
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians((strip + 0.5) * height - 90.0)) * 360.0 / width)).cast("bigint")


def region_edges(rings: DataFrame) -> DataFrame:
    """(region_id, x0, xmin, xmax, x1, y1, x2, y2) from rings (region_id, ring array<struct<lon,lat>>); a region may have
    several rings, holes included. Longitudes are unrolled around the first vertex, so a ring may cross the date line; a region
    must be narrower than 180 degrees, or come as edges. Rings of fewer than three vertices or with nulls are left out."""
    good = rings.where((F.size("ring") >= 3) & ~F.exists("ring", lambda v: v["lon"].isNull() | v["lat"].isNull()))
    base = good.select("region_id", F.col("ring")[0]["lon"].alias("x0"), "ring")
    near = lambda x: F.col("x0") + F.pmod(x - F.col("x0") + 540.0, F.lit(360.0)) - 180.0
    flat = base.select("region_id", "x0", F.transform("ring", lambda v: F.struct(near(v["lon"]).alias("x"), v["lat"].cast("double").alias("y"))).alias("r"))
    pairs = F.arrays_zip(F.col("r").alias("a"), F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1)).alias("b"))
    edge = flat.select("region_id", "x0", F.array_min(F.transform("r", lambda v: v["x"])).alias("xmin"), F.array_max(F.transform("r", lambda v: v["x"])).alias("xmax"), F.explode(pairs).alias("e"))
    return edge.select("region_id", "x0", "xmin", "xmax", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def box_edges(boxes: DataFrame) -> DataFrame:
    """Edges of boxes (region_id, x0, xmin, xmax, ymin, ymax), which may be up to 360 degrees wide."""
    a, b, c, d = "xmin", "ymin", "xmax", "ymax"
    sides = F.array(*[F.struct(F.col(p).alias("x1"), F.col(q).alias("y1"), F.col(r).alias("x2"), F.col(s).alias("y2")) for p, q, r, s in ((a, b, a, d), (c, b, c, d), (a, b, c, b), (a, d, c, d))])
    return boxes.select("region_id", "x0", "xmin", "xmax", F.explode(sides).alias("e")).select("region_id", "x0", "xmin", "xmax", "e.*")


def points_in_regions(points: DataFrame, edges: DataFrame, height: float, width: float, keep: Column | None = None) -> DataFrame:
    """(region_id, point_id, lat, lon, on_edge) of the points inside or on the edge of each region.

    points: point_id, lat, lon (any convention); null or NaN coordinates are in no region. height, width: degrees of a strip and,
    at the equator, of a cell. keep: further condition on region_id and point_id, applied inside the join."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-720, 720)
    p = points.where(ok).select("point_id", F.col("lat").cast("double").alias("lat"), F.pmod(F.col("lon").cast("double"), F.lit(360.0)).alias("lon")).withColumn("_strip", _strip(F.col("lat"), height))
    p = p.withColumn("_cell", F.least(F.floor(F.col("lon") / 360.0 * _cells(F.col("_strip"), height, width)), _cells(F.col("_strip"), height, width) - 1))

    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.where(F.col("y1").isNotNull()).withColumn("_strip", F.explode(F.sequence(_strip(lo, height), _strip(hi, height))))
    e = e.withColumn("_n", _cells(F.col("_strip"), height, width))
    first, last = F.floor(F.col("xmin") / 360.0 * F.col("_n")), F.floor(F.col("xmax") / 360.0 * F.col("_n"))
    every = last - first + 1 >= F.col("_n")
    span = F.when(every, F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).otherwise(F.transform(F.sequence(first, F.when(every, first).otherwise(last)), lambda i: F.pmod(i, F.col("_n"))))
    e = e.withColumn("_cell", F.explode(span)).drop("_n")

    x = F.col("lon") + 360.0 * F.round((F.col("x0") - F.col("lon")) / 360.0)
    y = F.col("lat")
    apart = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    crosses = apart & (x < at)
    # A point at half a turn from x0 may stand at either end of a region that goes all round.
    along = lambda v: ((v - F.col("x1")) * (F.col("y2") - F.col("y1")) == (y - F.col("y1")) * (F.col("x2") - F.col("x1"))) & v.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    touches = y.between(lo, hi) & (along(x) | along(x + 360.0) | along(x - 360.0))
    joined = p.join(e if keep is None else e, ["_strip", "_cell"])
    if keep is not None:
        joined = joined.where(keep)
    hit = joined.select("_strip", "_cell", "region_id", "point_id", "lat", "lon", F.when(crosses, 1).otherwise(0).alias("_c"), touches.alias("_t")).where("_c = 1 or _t")
    counted = hit.groupBy("_strip", "_cell", "region_id", "point_id", "lat", "lon").agg(F.sum("_c").alias("_c"), F.max("_t").alias("on_edge"))
    return counted.where("_c % 2 = 1 or on_edge").select("region_id", "point_id", "lat", "lon", "on_edge")


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b)))


def neighbours(places: DataFrame, key: str, km: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (place_a, place_b, km) of different places at most km apart, each once; members (place, key) name
    the keys of every place. A place is called by its least key. places: key, lat, lon, one row a key."""
    own = places.select(F.col(key).alias("_key"), "lat", "lon")
    spots = own.groupBy("lat", "lon").agg(F.min("_key").alias("point_id"))
    members = own.join(spots, ["lat", "lon"]).select(F.col("point_id").alias("place"), F.col("_key").alias(key))
    r = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    lat, lon = F.col("lat"), F.col("lon")
    capped = F.abs(lat) + r >= 90.0
    half = F.when(capped, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(r))) / F.cos(F.radians(lat))))) * (1 + 1e-9) + 1e-9)
    boxes = spots.select(
        F.struct(F.col("point_id").alias("id"), lat.alias("lat"), lon.alias("lon")).alias("region_id"), lon.alias("x0"), (lon - half).alias("xmin"), (lon + half).alias("xmax"),
        F.when(lat - r <= -90.0, -90.0).otherwise(lat - r).alias("ymin"), F.when(lat + r >= 90.0, 90.0).otherwise(lat + r).alias("ymax"),
    )
    size = max(2.2 * r, 1e-4)
    inside = points_in_regions(spots, box_edges(boxes), size, size, F.col("region_id.id") < F.col("point_id"))
    far = great_circle_km(F.col("region_id.lat"), F.col("region_id.lon"), lat, lon)
    pairs = inside.withColumn("km", far).where(F.col("km") <= km).select(F.col("region_id.id").alias("place_a"), F.col("point_id").alias("place_b"), "km")
    return pairs, members


def _dealt(members: DataFrame, hot: DataFrame, place: str, key: str) -> DataFrame:
    """members with ``_salt``: those of a hot place dealt over its salts, 0 for others."""
    return members.join(hot.withColumnRenamed("place", place), place, "left").withColumn("_salt", F.pmod(F.hash(key), F.coalesce("_salts", F.lit(1)))).drop("_salts")


def _spread(rows: DataFrame, hot: DataFrame, place: str) -> DataFrame:
    """rows with ``_salt``: once for each salt of their place."""
    return rows.join(hot.withColumnRenamed("place", place), place, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def neighbour_pairs(places: DataFrame, key: str, km: float, hot_keys: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different keys at most km apart, those at one place included. A place of more than
    hot_keys keys is dealt over as many tasks as it has such portions."""
    pairs, members = neighbours(places, key, km)
    members = settle(members, "places-members")
    n = members.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_keys)
    hot = broadcast_if_small(n.select("place", F.ceil(F.col("n") / hot_keys).cast("int").alias("_salts")), 100_000)
    a, b = members.select(F.col("place").alias("place_a"), F.col(key).alias("ka")), members.select(F.col("place").alias("place_b"), F.col(key).alias("kb"))
    half = _spread(pairs.select("place_a", "place_b"), hot, "place_a").join(_dealt(a, hot, "place_a", "ka"), ["place_a", "_salt"]).select("place_b", "ka")
    apart = _spread(half, hot, "place_b").join(_dealt(b, hot, "place_b", "kb"), ["place_b", "_salt"]).select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b"))
    one = _spread(a.withColumnRenamed("place_a", "place"), hot, "place").join(_dealt(b.withColumnRenamed("place_b", "place"), hot, "place", "kb"), ["place", "_salt"])
    return apart.unionByName(one.where(F.col("ka") < F.col("kb")).select(F.col("ka").alias("id_a"), F.col("kb").alias("id_b")))
