"""Sources and sinks of the catalogue layer: CSV, append, JSON records, id lists, file listings, shell scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators.relational import keep_last
from ..schemas import CATALOG_SCHEMA, SWEEP_FIELDS

# Fields of a calibration record; the two maps are keyed by candidate and by class.
CALIBRATION_SCHEMA = (
    "c_sigma double, lambda_max_topo_ref double, c_sigma_sweep map<string,double>, r_stab_tsit5 double, k_max_at_N_star double, D double, "
    "N_star int, class_sigma_init map<string,double>, rtol double, atol double, calibration_event_id string"
)
# Fields that a calibration record must have, and defaults of those that it may lack.
CALIBRATION_REQUIRED = ("c_sigma", "D", "class_sigma_init")
CALIBRATION_DEFAULTS = {"rtol": 1e-3, "atol": 1e-6}


def read_catalog_csv(spark: SparkSession, path: str, schema: str = CATALOG_SCHEMA) -> DataFrame:
    """A catalogue with an explicit schema; nothing is inferred. Empty values are null."""
    return spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append sink; Parquet files need no header that only the first batch writes."""
    df.write.mode("append").parquet(path)


def write_calibration(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration records; a record without a required field is an error, optional fields get their defaults."""
    raw = spark.read.text(path).select(F.from_json("value", CALIBRATION_SCHEMA).alias("r")).select("r.*")
    checked = raw
    for name in CALIBRATION_REQUIRED:
        ok = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"calibration lacks {name}"))).otherwise(F.col(name))
        checked = checked.withColumn(name, ok)
    return checked.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in CALIBRATION_DEFAULTS.items()})


def write_ids(df: DataFrame, path: str, key: str = "id") -> None:
    df.select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of all files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select("path", X.base_name(F.col("path")).alias("name"), "length")


def root_candidates(root: str) -> list[str]:
    """Folders in which a catalogue's files may lie, the nearest first."""
    up = root.rstrip("/").rpartition("/")[0] or root
    return list(dict.fromkeys([root, up, *(f"{r}/{d}" for r in (root, up) for d in ("2019", "2018", "data"))]))


def resolve_paths(catalog: DataFrame, files: DataFrame, column: str = "file_name") -> DataFrame:
    """catalog with ``path``: the listed file of the catalogue's name, in either folder layout, else of its base name alone; null if
    there is none."""
    named = files.select("path", X.path_parts(F.col("path")).alias("_p"))
    keyed = named.select("path", F.concat_ws("/", F.slice("_p", F.greatest(F.size("_p") - 2, F.lit(1)), 3)).alias("_k"), F.element_at("_p", -1).alias("_b"))
    tails = keyed.groupBy("_k").agg(F.min("path").alias("_exact"))
    bases = keyed.groupBy("_b").agg(F.min("path").alias("_base"))
    c = catalog.withColumn("_k", F.col(column)).withColumn("_s", X.swapped_path(F.col(column))).withColumn("_b", X.base_name(F.col(column)))
    c = c.join(tails, "_k", "left").join(tails.select(F.col("_k").alias("_s"), F.col("_exact").alias("_swap")), "_s", "left").join(bases, "_b", "left")
    return c.withColumn("path", F.coalesce("_exact", "_swap", "_base")).drop("_k", "_s", "_b", "_exact", "_swap", "_base")


def tolerant_sweep(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each wanted column from the first of its candidates that the frame has; null where it has none."""
    low = {c.lower(): c for c in df.columns}
    kinds = dict(SWEEP_FIELDS)
    pick = lambda cs: next((low[c.lower()] for c in cs if c.lower() in low), None)
    return df.select(*[(F.col(f"`{pick(cs)}`") if pick(cs) else F.lit(None)).cast(kinds.get(n, "double")).alias(n) for n, cs in names.items()])


def copy_script(catalog: DataFrame, bucket: str, target: str, column: str = "file_name") -> DataFrame:
    """(line, position): one mkdir line for each folder, where it is first needed, and one copy line for each file."""
    c = catalog.select(F.col(column).alias("f"), "position")
    folder = F.concat(F.lit(f"{target}/"), F.regexp_replace("f", "/[^/]*$", ""))
    dirs = c.groupBy(folder.alias("d")).agg((F.min("position") * 2).alias("position")).select(F.concat(F.lit("mkdir -p "), "d").alias("line"), "position")
    return dirs.unionByName(c.select(F.concat(F.lit(f"cp {bucket}/"), "f", F.lit(f" {target}/"), "f").alias("line"), (F.col("position") * 2 + 1).alias("position")))


def resume_script(catalog: DataFrame, present: DataFrame, bucket: str, target: str, column: str = "file_name") -> DataFrame:
    """copy_script() for the files that are missing or empty. present: name, length."""
    have = present.where("length > 0").select(F.col("name").alias(column)).distinct()
    return copy_script(catalog.join(have, column, "left_anti"), bucket, target, column)


def merge_results(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Result files as one table, the row of the last file for each key."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_file", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*keys, "_file")]
    return keep_last(every, keys, ["_file", *rest]).drop("_file")
