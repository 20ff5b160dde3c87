"""Session helpers: builder for local runs, shared work folders, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "squallframe", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench use; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each context; they need no installation of it. The archive lies in the shared
    folder where that is a file system, else with the driver, which serves it."""
    sc = spark.sparkContext
    if getattr(sc, "_squallframe_shipped", False):
        return
    here = Path(__file__).resolve().parent
    root = shared_root(spark)
    folder = Path(local_path(work_dir(spark, "package")) if is_local(root) else tempfile.mkdtemp(prefix="squallframe-zip-"))
    at = folder / "squallframe_pkg.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(str(at))
    sc._squallframe_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one of this machine where it is unset
    (as in local tests; a cluster must set it)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(sc, "_squallframe_root", None)
        if at is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="squallframe-")
            atexit.register(shutil.rmtree, local_path(at), ignore_errors=True)
            sc._squallframe_root = at
            sc.setCheckpointDir(at)
    return at.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below shared_root(); the caller writes it once."""
    root = shared_root(spark)
    at = f"{root}/squallframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if is_local(at):
        os.makedirs(local_path(at), exist_ok=True)
    return at


def clear_work(spark: SparkSession) -> None:
    """Remove all that work_dir() gave this application, when none of its results is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/squallframe/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_local(uri: str) -> bool:
    return uri.startswith(("file:", "/"))


def local_path(uri: str) -> str:
    return uri[5:].replace("///", "/", 1).replace("//", "/", 1) if uri.startswith("file:") else uri


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a written table in the shared folder: survives lost executors, unlike localCheckpoint."""
    at = f"{work_dir(df.sparkSession, name)}/t"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """broadcast() hint if df has at most max_rows rows, else df as it is (a shuffle join then).

    The check reads at most max_rows + 1 rows; nothing is dropped."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
