"""Many small files into few well-sized ones, each distinct record once.

Plan of the operator (every step is distributed; the driver only sees counts):

1. Items. A file is one item, or several if it has more than ``chunk_lines`` lines, so that no item is unbounded.
2. Records get a 128-bit key (two independent 64-bit hashes over the normalised fields and their null mask). The first
   line of each record is found by a grouped minimum, which combines on the map side: a record that holds a third of all
   lines shrinks to one row per map task before the shuffle. Lines that add nothing become narrow marker rows.
3. Longest-first scheduling. Items are spread over shards by the hash that also partitions the lines; each shard owns a
   fixed set of output groups and gives its items, longest first, to the least loaded of them (a heap).
4. Lines and markers are shuffled once, by item, joined with their group there and sorted inside the partition. Each
   group is then streamed through pyarrow into one file; memory is bounded by one row group.
5. Each attempt writes under its own name; only the files reported by successful tasks enter the manifest. The manifest is
   verified (line counts, an order-free checksum of all records read back from the files, and that these are all different)
   and then published by one atomic rename.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import nan_to_null, plain_id
from ..schemas import SWEEP_FIELDS
from ..session import settle, work_dir

#: Bytes of small-file text that go into one output group.
TARGET_BYTES = 128 << 20
#: Lines of one file that form one schedulable item.
CHUNK_LINES = 250_000
#: A record with more than this part of all lines, and at least so many, is hot.
HOT, HOT_LEAST = 10_000, 1_000
#: At most about so many items are scheduled by one task.
SHARD_ITEMS = 100_000
#: And at most so many output groups are written by one task.
SHARD_GROUPS = 4
#: A file of unknown size counts as so many bytes a line.
DEFAULT_LINE_BYTES = 160


def schedule(sizes: list[int], groups: int) -> list[int]:
    """Longest-first: the group of each item, items taken by falling size (ties by position), each to the least loaded group
    (ties to the lowest number)."""
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (load + sizes[i], g))
    return out


def record_columns(fields: tuple[tuple[str, str], ...] = SWEEP_FIELDS, id_field: str | None = "event_id") -> list[Column]:
    """The fields in the form in which records are compared and stored: NaN is null, the id is plain."""
    out = []
    for name, kind in fields:
        c = F.col(f"`{name}`").cast(kind)
        if kind in ("double", "float"):
            c = nan_to_null(c)
        elif name == id_field:
            c = plain_id(c)
        out.append(c.alias(name))
    return out


def record_keys(names: list[str]) -> list[Column]:
    """Two 64-bit hashes. Spark's hash skips nulls, so the null mask is hashed too: (null, x) differs from (x, null)."""
    cols = [F.col(f"`{n}`") for n in names]
    mask = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(17), mask, *cols).alias("_k1"), F.xxhash64(*cols, mask, F.lit(71)).alias("_k2")]


def redundant_lines(keyed: DataFrame, total: int) -> DataFrame:
    """(file_id, line_no, _k1) of lines whose record stands in an earlier line, order being (file_id, line_no). total: the number
    of lines. Records with more than a HOT-th of them are fewer than HOT, so their first lines are broadcast; no other record
    brings more than that share to one task."""
    slim = keyed.select("_k1", "_k2", "file_id", "line_no")
    first = settle(slim.groupBy("_k1", "_k2").agg(F.min(F.struct("file_id", "line_no")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "compact-first")
    hot = first.where(F.col("_n") > max(total // HOT, HOT_LEAST)).drop("_n")
    later = F.struct("file_id", "line_no") > F.col("_first")
    if hot.isEmpty():
        got = slim.join(first.drop("_n"), ["_k1", "_k2"])
    else:
        got = slim.join(F.broadcast(hot), ["_k1", "_k2"])
        rest = slim.join(F.broadcast(hot.drop("_first")), ["_k1", "_k2"], "left_anti")
        got = got.unionByName(rest.join(first.where(F.col("_n") <= max(total // HOT, HOT_LEAST)).drop("_n"), ["_k1", "_k2"]))
    return got.where(later).select("file_id", "line_no", "_k1")


_REPORT = "kind string, grp int, path string, n_rows bigint, n_bytes bigint, checksum bigint, file_id bigint, line_no int"
_REPORT_ARROW = pa.schema([("kind", pa.string()), ("grp", pa.int32()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("checksum", pa.int64()), ("file_id", pa.int64()), ("line_no", pa.int32())])


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


class _GroupFile:
    """One output group on its way into one file; rows are buffered up to a row group."""

    def __init__(self, fs: pafs.FileSystem, base: str, grp: int, row_group: int):
        self.fs, self.base, self.grp, self.row_group = fs, base, grp, row_group
        self.path, self.rows, self.sum, self.writer, self.buffer, self.held = f"group-{grp:06d}-{uuid.uuid4().hex[:8]}.parquet", 0, 0, None, [], 0

    def add(self, rows: pa.Table, keys: np.ndarray) -> None:
        self.rows += rows.num_rows
        self.sum += int(keys.view(np.uint64).sum(dtype=np.uint64))
        self.buffer.append(rows)
        self.held += rows.num_rows
        if self.held >= self.row_group:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            rows = pa.concat_tables(self.buffer)
            if self.writer is None:
                self.fs.create_dir(self.base, recursive=True)
                self.writer = pq.ParquetWriter(f"{self.base}/{self.path}", rows.schema, filesystem=self.fs, compression="zstd")
            self.writer.write_table(rows, row_group_size=rows.num_rows)
            self.buffer, self.held = [], 0

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.writer.close()
        size = self.fs.get_file_info(f"{self.base}/{self.path}").size
        return pa.RecordBatch.from_pylist([{"kind": "file", "grp": self.grp, "path": self.path, "n_rows": self.rows, "n_bytes": size, "checksum": _signed(self.sum), "file_id": None, "line_no": None}], schema=_REPORT_ARROW)


def _streamer(folder: str, fields: list[str], row_group: int):
    """mapInArrow function: partitions arrive sorted by (_group, file_id, line_no, _k1, _kind); a marker (_kind 0) comes just
    before the line (_kind 1) that it withholds. A line that repeats the one before it is a twin of it and withheld as well."""
    keep = ["file_id", "line_no", *fields, "loaded_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        file: _GroupFile | None = None
        last = None  # (file_id, line_no, _k1, _kind) of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, fid, line, key, grp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_kind", "file_id", "line_no", "_k1", "_group"))
            same = np.zeros(len(kind), bool)
            same[1:] = (fid[1:] == fid[:-1]) & (line[1:] == line[:-1]) & (key[1:] == key[:-1])
            before = np.roll(kind, 1)
            if last is not None:
                same[0], before[0] = (int(fid[0]), int(line[0]), int(key[0])) == last[:3], last[3]
            last = (int(fid[-1]), int(line[-1]), int(key[-1]), int(kind[-1]))
            line_rows = kind == 1
            for what, at in (("held", np.flatnonzero(line_rows & same & (before == 0))), ("twin", np.flatnonzero(line_rows & same & (before == 1)))):
                if len(at):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([what] * n), pa.array(grp[at], pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(key[at], pa.int64()), pa.array(fid[at], pa.int64()), pa.array(line[at], pa.int32())], schema=_REPORT_ARROW)
            good = np.flatnonzero(line_rows & ~same)
            tab = pa.Table.from_batches([batch]).select(keep)
            for part in np.split(good, np.flatnonzero(np.diff(grp[good])) + 1) if len(good) else []:
                if file is not None and file.grp != grp[part[0]]:
                    yield file.close()
                    file = None
                if file is None:
                    file = _GroupFile(fs, base, int(grp[part[0]]), row_group)
                file.add(tab.take(pa.array(part)), key[part])
        if file is not None:
            yield file.close()

    return run


def compact(
    rows: DataFrame,
    files: DataFrame,
    out: str,
    fields: tuple[tuple[str, str], ...] = SWEEP_FIELDS,
    id_field: str | None = "event_id",
    target_bytes: int = TARGET_BYTES,
    chunk_lines: int = CHUNK_LINES,
    row_group: int = 100_000,
) -> tuple[DataFrame, dict]:
    """Write the distinct records of ``rows`` into well-sized Parquet files under ``out``; return the redundant lines and the
    manifest's head.

    rows: file_id, line_no, the ``fields``, and optionally loaded_at; further columns are ignored. files: file_id, n_bytes.
    Records are equal if all fields are, with NaN as null and ids in plain spelling; the first line by (file_id, line_no)
    stays. Rows with a null file_id or line_no sort first and are kept like any other. A file absent from ``files`` or with a
    null or non-positive size counts DEFAULT_LINE_BYTES a line. No rows give no files and an empty, published manifest.
    Two rows with the same (file_id, line_no) are one line given twice if equal; if they differ both stay.
    """
    spark = rows.sparkSession
    names = [n for n, _ in fields]
    loaded = F.col("loaded_at") if "loaded_at" in rows.columns else F.lit(None).cast("timestamp")
    base = rows.select(F.coalesce(F.col("file_id"), F.lit(-1)).cast("bigint").alias("file_id"), F.coalesce(F.col("line_no"), F.lit(-1)).cast("int").alias("line_no"), *record_columns(fields, id_field), loaded.alias("loaded_at"))
    keyed = base.select("*", *record_keys(names))
    chunk = F.floor(F.col("line_no") / chunk_lines).cast("int").alias("_chunk")

    lines = base.groupBy("file_id", chunk).agg(F.count(F.lit(1)).alias("_lines"))
    known = files.groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(F.max(F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("_bytes"))
    whole = lines.groupBy("file_id").agg(F.sum("_lines").alias("_all"))
    size = F.ceil(F.coalesce(F.col("_bytes") * F.col("_lines") / F.col("_all"), F.col("_lines") * DEFAULT_LINE_BYTES)).cast("bigint")
    items = settle(lines.join(whole, "file_id").join(known, "file_id", "left").select("file_id", "_chunk", "_lines", size.alias("_size")), "compact-items")
    total, all_rows, n_items = items.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.sum("_lines"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-int(total) // target_bytes))
    shards = max(1, min(groups, max(-(-n_items // SHARD_ITEMS), -(-groups // SHARD_GROUPS))))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["file_id", "_chunk"])
        own = range(int(pdf["_shard"].iloc[0]), groups, shards)
        at = schedule(pdf["_size"].tolist(), len(own))
        return pd.DataFrame({"file_id": pdf["file_id"], "_chunk": pdf["_chunk"], "_group": [own[g] for g in at]})

    shard = F.pmod(F.hash("file_id", "_chunk"), F.lit(shards))  # as repartition() places rows by these columns
    planned = items.withColumn("_shard", shard).groupBy("_shard").applyInPandas(plan, "file_id bigint, _chunk int, _group int")

    marks = redundant_lines(keyed, int(all_rows))
    none = [F.lit(None).cast(t).alias(n) for n, t in (*fields, ("loaded_at", "timestamp"))]
    lined = keyed.select("file_id", "line_no", chunk, F.lit(1).alias("_kind"), "_k1", *names, "loaded_at")
    both = lined.unionByName(marks.select("file_id", "line_no", chunk, F.lit(0).alias("_kind"), "_k1", *none))
    # With a projection above the exchange, the join brings the plan to the lines' partitions; it would move both sides to
    # the session's default number of partitions otherwise.
    homed = both.repartition(shards, "file_id", "_chunk").withColumn("_home", F.spark_partition_id())
    placed = homed.join(planned.hint("shuffle_hash"), ["file_id", "_chunk"])
    done = placed.sortWithinPartitions("_group", "file_id", "line_no", "_k1", "_kind").mapInArrow(_streamer(f"{out}/data", names, row_group), _REPORT)
    report_at = f"report-{uuid.uuid4().hex[:8]}"
    done.write.parquet(f"{out}/{report_at}")
    report = spark.read.parquet(f"{out}/{report_at}")

    by = {r["kind"]: r for r in report.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"), F.sum("n_bytes").alias("bytes"), F.sum(F.col("checksum").cast("decimal(38,0)")).alias("sum")).collect()}
    made = by.get("file")
    held = sum(by[k]["n"] for k in ("held", "twin") if k in by)
    head = {"files": made["n"] if made else 0, "rows": int(made["rows"]) if made else 0, "bytes": int(made["bytes"]) if made else 0, "groups": groups, "redundant": held, "checksum": int(made["sum"]) % (1 << 64) if made else 0, "report": report_at}
    if head["rows"] + held != all_rows:
        raise RuntimeError(f"compaction lost or doubled lines: {head['rows']} written and {held} redundant of {all_rows}")
    if made:
        again = _read_files(spark, out, report).select(*record_keys(names)).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
        n, different, checksum = again.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("_k1").cast("decimal(38,0)") * F.col("n"))).first()
        if n != head["rows"] or int(checksum) % (1 << 64) != head["checksum"]:
            raise RuntimeError("the written files do not hold the records that were streamed into them")
        if different != n:
            raise RuntimeError(f"{n - different} records were written more than once")
    _publish(out, head)
    return report.where("kind = 'held'").select("file_id", "line_no"), head


def _read_files(spark: SparkSession, out: str, report: DataFrame) -> DataFrame:
    return spark.read.parquet(*[f"{out}/data/{r.path}" for r in report.where("kind = 'file'").select("path").toLocalIterator()])


def _publish(out: str, head: dict) -> None:
    """Write the manifest beside its place, then rename it: readers see the old or the new one, never a part."""
    fs, base = pafs.FileSystem.from_uri(out)
    tmp = f"{base}/.manifest-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(tmp) as f:
        f.write(json.dumps(head, sort_keys=True).encode())
    fs.move(tmp, f"{base}/manifest.json")


def read_compacted(spark: SparkSession, out: str) -> DataFrame | None:
    """The published table: only files that the manifest's report names are read; None if it has no file."""
    fs, base = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        head = json.loads(f.read())
    return _read_files(spark, out, spark.read.parquet(f"{out}/{head['report']}")) if head["files"] else None


def compaction_dir(spark: SparkSession) -> str:
    return work_dir(spark, "compact")
