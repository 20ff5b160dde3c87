"""Streaming counts of flashes in five-minute frames of event time, with late data bounded by a watermark."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import plain_id
from ..schemas import FLASHES_SCHEMA
from ..session import local_path, work_dir

#: All flash offsets count from this instant; the frames of an event are what matters, not the day.
ORIGIN = "2000-01-01 00:00:00"


def read_flashes(spark: SparkSession, path: str, schema: str = FLASHES_SCHEMA) -> DataFrame:
    """A stream of flash files with their event time. path: a folder of Parquet files, or one file."""
    reader = spark.readStream.schema(schema)
    if not os.path.isdir(local_path(path)):
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    rows = reader.parquet(path)
    at = F.timestamp_micros((F.unix_micros(F.lit(ORIGIN).cast("timestamp")) + F.round(F.col("t_off") * 1e6)).cast("bigint"))
    good = F.col("event_id").isNotNull() & F.col("t_off").isNotNull() & ~F.isnan("t_off")
    return rows.where(good).select(plain_id(F.col("event_id")).alias("id"), at.alias("at"), "energy")


def frame_counts(stream: DataFrame, late: str = "1 day", frame: str = "5 minutes") -> DataFrame:
    """(id, start, n): flashes of each event and frame. Works on batches alike."""
    w = F.window("at", frame)
    return stream.withWatermark("at", late).groupBy("id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("id", F.col("w.start").alias("start"), "n")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process all that is there and return the sink as a table. Each batch writes its rows, in update mode only the changed ones,
    into a folder of its own, which a batch repeated after a failure overwrites. Of the rows with one ``keys`` the last
    batch's counts (update mode); without keys all rows do."""
    spark = stream.sparkSession
    root = work_dir(spark, f"stream-{name}")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        rows = spark.read.parquet(f"{root}/out")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)  # no input, no batch
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    return rows.select(*stream.columns)
