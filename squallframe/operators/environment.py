"""Static environment of events: elevation, convective energy and land type, regridded from tiles to an event's frame, with a cache
keyed by extent so that events of one extent are fetched once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..kernels import raster
from ..session import settle
from .relational import anti, bbox_overlap, keep_first

GRID = "cache_key string, h int, w int, data array<double>, source string"


def unique_extents(events: DataFrame) -> DataFrame:
    """(cache_key, lon1, lon2, lat1, lat2): each extent of (id, lon1, lon2, lat1, lat2) once."""
    key = X.extent_key(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return keep_first(events.withColumn("cache_key", key), ["cache_key"], [F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")]).select("cache_key", "lon1", "lon2", "lat1", "lat2")


def regrid(extents: DataFrame, tiles: DataFrame, h: int, w: int, nearest: bool = False, buffer: float = 0.1) -> DataFrame:
    """A grid (GRID) for each extent from the tiles that overlap it, row 0 in the north.

    tiles: tile, tlon1, tlon2, tlat1, tlat2, th, tw, values array<double> (row 0 in the north), points at cell centres. Values are
    interpolated linearly, or taken from the nearest point for categories, which must not be averaged; tiles later by name win where
    they overlap. An extent without any tile gets zeros and the source "zero", so that the fallback shows."""
    wide = extents.withColumns({"lon1": F.col("lon1") - buffer, "lon2": F.col("lon2") + buffer, "lat1": F.col("lat1") - buffer, "lat2": F.col("lat2") + buffer})
    hit = bbox_overlap(wide, tiles)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.iloc[0]
        y = np.linspace(e.lat2 - buffer, e.lat1 + buffer, h)[:, None] + np.zeros((1, w))
        x = np.linspace(e.lon1 + buffer, e.lon2 - buffer, w)[None, :] + np.zeros((h, 1))
        out, seen = np.zeros((h, w)), np.zeros((h, w), bool)
        for t in pdf.sort_values("tile").itertuples():
            v = np.asarray(t.values_, float).reshape(t.th, t.tw)[::-1]
            gy = t.tlat1 + (np.arange(t.th) + 0.5) * (t.tlat2 - t.tlat1) / t.th
            gx = t.tlon1 + (np.arange(t.tw) + 0.5) * (t.tlon2 - t.tlon1) / t.tw
            cy, cx = np.clip(y, gy[0], gy[-1]), np.clip(x, gx[0], gx[-1])
            inside = (y >= t.tlat1) & (y <= t.tlat2) & (x >= t.tlon1) & (x <= t.tlon2)
            got = (raster.grid_nearest if nearest else raster.grid_linear)(gy, gx, v, cy, cx)
            out, seen = np.where(inside, got, out), seen | inside
        return pd.DataFrame([(key[0], h, w, out.ravel(), "tiles" if seen.any() else "zero")], columns=["cache_key", "h", "w", "data", "source"])

    made = hit.withColumnRenamed("values", "values_").groupBy("cache_key").applyInPandas(run, GRID)
    zeros = F.array_repeat(F.lit(0.0), h * w)
    bare = anti(extents.select("cache_key"), hit.select("cache_key"), ["cache_key"]).select("cache_key", F.lit(h).alias("h"), F.lit(w).alias("w"), zeros.alias("data"), F.lit("zero").alias("source"))
    return made.unionByName(bare)


def read_through(spark: SparkSession, cache: str, extents: DataFrame, fetch) -> DataFrame:
    """Grids of all extents: those in the cache are read, the others made by fetch(extents) and added. Fallback grids are not kept, so
    that they are tried again."""
    try:
        missing = anti(extents, spark.read.schema(GRID).parquet(cache), ["cache_key"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = extents
    new = settle(fetch(missing), "grids")
    new.where("source <> 'zero'").write.mode("append").parquet(cache)
    kept = spark.read.schema(GRID).parquet(cache).join(extents.select("cache_key"), "cache_key", "left_semi")
    return kept.unionByName(new.where("source = 'zero'"))


def for_events(events: DataFrame, grids: DataFrame) -> DataFrame:
    """(id, h, w, data scaled to 0..1, source): the grid of each event's extent."""
    key = X.extent_key(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return events.withColumn("cache_key", key).join(grids, "cache_key").select("id", "h", "w", X.minmax(F.col("data")).alias("data"), "source")


def month_of(time: Column) -> Column:
    """Calendar month; July where the time is missing."""
    return F.coalesce(F.month(time), F.lit(7))


def monthly_climatology(values: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(month, y, x, value): means by month and cell of (time, y, x, value); months in ``done`` are left out, so that a build goes on
    where it stopped."""
    v = values.withColumn("month", F.month("time")).where("month is not null")
    return (v if done is None else anti(v, done, ["month"])).groupBy("month", "y", "x").agg(F.avg("value").alias("value"))


def cape_level(v: Column, top: float = 5000.0) -> Column:
    """Convective energy scaled and clipped to 0..1."""
    return F.least(F.greatest(v / top, F.lit(0.0)), F.lit(1.0))


def cape_for_events(events: DataFrame, climatology: DataFrame, lon0: float, lat0: float, step: float) -> DataFrame:
    """(id, y, x, cape): the cells of a regular grid (origin lon0, lat0 in the south-west) in each event's extent, for its month."""
    e = events.withColumn("month", month_of(F.col("time_utc")))
    span = lambda lo, hi, o: F.sequence(F.floor((F.col(lo) - o) / step).cast("int"), F.floor((F.col(hi) - o) / step).cast("int"))
    cells = e.withColumn("y", F.explode(span("lat1", "lat2", lat0))).withColumn("x", F.explode(span("lon1", "lon2", lon0)))
    got = cells.join(climatology, ["month", "y", "x"], "left")
    return got.select("id", "y", "x", cape_level(F.coalesce("value", F.lit(0.0))).alias("cape"))
