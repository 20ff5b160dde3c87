"""Texts of drifting schema into one table, with a report of every change.

Each header is reduced to a fingerprint of its names; a version is a fingerprint together with the migration steps that its
file needs: rename a column, default a field that is absent, cast a field whose values no longer fit, drop a column of no base
field. The steps come from the values, not from a list of known names: a column carries an absent field if it holds that
field's values of the same file and lines in a reference table. Versions are kept in a table to which new ones are appended, so
a version keeps its number whatever files arrive later. Every file is then routed through its version's chain.
"""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import ID_SUFFIXES
from ..schemas import SWEEP_FIELDS
from ..session import broadcast_if_small, settle

# Texts of a missing value, in lower case.
MISSING = frozenset(("", "nan", "na", "n/a", "null", "none"))

_INT = re.compile(r"[+-]?[0-9]+")
_NUM = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_ANY = re.compile(r"[+\-−]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:\s*(?:[eE]|[x×*]\s*10\s*\^?)\s*[+\-−]?[0-9]+)?")
_GROUPS = re.compile(r"[+-]?[0-9]{1,3}(?:([ ',_\u00a0\u202f])[0-9]{3})(?:\1[0-9]{3})*")
_HEX = re.compile(r"[+-]?0[xX][0-9a-fA-F]+")
_SUFFIX = re.compile(rf"(?i)({'|'.join(ID_SUFFIXES)})$")


def missing(v: str) -> bool:
    return v.strip().lower() in MISSING


def fits(v: str, kind: str) -> bool:
    """Whether a text is a value of the type; missing values fit any type and everything is a string."""
    v = v.strip()
    if kind == "string" or v.lower() in MISSING:
        return True
    return bool((_INT if kind in ("int", "bigint") else _NUM).fullmatch(v))


def readings(v: str) -> list[float]:
    """The numbers that a text may stand for, the most likely first; none if it has none."""
    v = v.strip().replace("−", "-")
    out: list[float] = []
    if _NUM.fullmatch(v):
        return [float(v)]
    if _HEX.search(v):
        out.append(float(int(_HEX.search(v)[0], 16)))
    for m in _ANY.finditer(v):
        s = re.sub(r"\s*[x×*]\s*10\s*\^?\s*", "e", m[0].replace(" ", ""))
        for t in dict.fromkeys((s.replace(",", "."), s.replace(",", ""))):
            try:
                out.append(float(t))
            except ValueError:
                pass
    if re.search(r"[0-9][ '_,][0-9]{3}\b", v):
        t = re.search(r"[+-]?[0-9][0-9 '_,.]*", v)[0]
        for s in (re.sub(r"[ '_,]", "", t), re.sub(r"[ '_.]", "", t).replace(",", ".")):
            try:
                out.append(float(s.rstrip(".")))
            except ValueError:
                pass
    if "%" in v:
        out += [x / 100 for x in out]
    return out


def parse(body: str | None) -> tuple[list[str], list[list[str]]]:
    """(names, rows) of a text: byte-order mark, remarks and blank lines left out; any of , ; tab | as separator; every row as
    long as the header (short rows are filled with empty values, what is beyond the header is left out)."""
    lines = [s for s in re.split(r"\r\n|\n|\r", (body or "").lstrip("﻿")) if s.strip() and not s.lstrip().startswith("#")]
    if not lines:
        return [], []
    bare = re.sub(r'"[^"]*"', "", lines[0])
    sep = max(",;\t|", key=bare.count)
    rows = list(csv.reader((s.lstrip(" ") for s in lines), delimiter=sep, skipinitialspace=True))
    names = [n.strip().strip("﻿").strip() for n in rows[0]]
    wide = len(names)
    return names, [(r + [""] * wide)[:wide] for r in rows[1:]]


def fingerprint(names: list[str]) -> str:
    """Of the set of names: order, letter case and outer blanks don't count."""
    return hashlib.md5("\x1f".join(sorted(n.strip().lower() for n in names)).encode()).hexdigest()


def _same_text(field: str, have: str, want: str) -> bool:
    if field == "event_id":
        plain = lambda s: _SUFFIX.sub("", s.strip()).upper()
        return plain(have) == plain(want)
    letters = lambda s: re.sub(r"[\W_]", "", s).lower()
    return letters(have) == letters(want)


def carries(field: str, kind: str, have: list[str], want: list) -> int:
    """How a column relates to a field's reference values: 2 if all of them agree and some are present, 1 if both are missing
    throughout, 0 otherwise."""
    if len(have) != len(want):
        return 0
    some = False
    for h, w in zip(have, want):
        gone = w is None or w != w or (kind == "string" and missing(str(w)))
        if missing(h) or gone:
            if missing(h) != gone:
                return 0
            continue
        if kind == "string":
            good = _same_text(field, h, str(w))
        else:
            good = any(abs(x - w) <= 1e-9 * max(1e-3, abs(w)) for x in readings(h))
        if not good:
            return 0
        some = True
    return 2 if some else 1


def match(absent: list[tuple[str, str]], others: dict[str, list[str]], want: dict[str, list]) -> dict[str, str]:
    """{field: column} for the absent fields that a column carries; where several would do, real values go before missing ones,
    then the likest name, then the first column."""
    found = []
    for f, (field, kind) in enumerate(absent):
        for c, (name, have) in enumerate(others.items()):
            if how := carries(field, kind, have, want[field]):
                like = SequenceMatcher(None, field.lower(), name).ratio()
                found.append((-how, -like, c, f, field, name))
    out: dict[str, str] = {}
    for *_, field, name in sorted(found):
        if field not in out and name not in out.values():
            out[field] = name
    return out


_PARSED = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("print", T.StringType()), T.StructField("absent", T.ArrayType(T.StringType())),
    T.StructField("retyped", T.ArrayType(T.StringType())), T.StructField("others", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
])
_PLAN = "file_id bigint, print string, renamed array<struct<field:string,name:string>>, removed array<string>, retyped array<string>, added array<string>"


def _arrow(ddl_or_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_or_schema if isinstance(ddl_or_schema, T.StructType) else T._parse_datatype_string(ddl_or_schema))


def _reader(fields: tuple[tuple[str, str], ...], schema: pa.Schema):
    low = {n.lower(): n for n, _ in fields}
    kinds = dict(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, rows = parse(body)
                keys = [n.lower() for n in names]
                have = set(keys)
                absent = [n for n, _ in fields if n.lower() not in have]
                cols = list(zip(*rows)) if rows else [()] * len(keys)
                bad, others = [], {}
                for k, col in zip(keys, cols):
                    if k in low:
                        if low[k] not in bad and not all(fits(v, kinds[low[k]]) for v in col):
                            bad.append(low[k])
                    elif k not in others and (k or not all(missing(v) for v in col)):
                        others[k] = list(col)
                out.append({"file_id": file_id, "print": fingerprint(names), "absent": absent, "retyped": bad, "others": list(others), "values": list(others.values()) if absent and others else None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _planner(fields: tuple[tuple[str, str], ...], schema: pa.Schema):
    kinds = dict(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                got: dict[str, str] = {}
                bad = list(r["retyped"])
                if r["values"] is not None:
                    lines = sorted(r["lines"] or [], key=lambda x: x["line_no"])
                    others = dict(zip(r["others"], r["values"]))
                    want = {f: [x[f] for x in lines] for f in r["absent"]}
                    got = match([(f, kinds[f]) for f in r["absent"]], others, want)
                    bad += [f for f, n in got.items() if not all(fits(v, kinds[f]) for v in others[n])]
                out.append({"file_id": r["file_id"], "print": r["print"], "renamed": [{"field": f, "name": n} for f, n in got.items()], "removed": [f for f in r["absent"] if f not in got], "retyped": bad, "added": [n for n in r["others"] if n not in got.values()]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def plan_migrations(raw: DataFrame, reference: DataFrame, fields: tuple[tuple[str, str], ...] = SWEEP_FIELDS, max_broadcast: int = 1_000_000) -> DataFrame:
    """One row per text: its fingerprint and its steps. raw: file_id, body; reference: file_id, line_no and the fields; further
    columns are ignored. A null or empty body has no column, so all fields are removed. A text of several rows in raw is
    planned as often. Only files that lack a field and have another column are compared with the reference, whose other rows
    never leave the scan."""
    read = _reader(fields, _arrow(_PARSED))
    parsed = settle(raw.select(F.col("file_id").cast("bigint").alias("file_id"), "body").mapInArrow(read, _PARSED), "drift-parsed")
    names = [n for n, _ in fields]
    asked = parsed.where("values is not null")
    wanted = broadcast_if_small(asked.select("file_id").distinct(), max_broadcast)
    lines = reference.select(F.col("file_id").cast("bigint").alias("file_id"), "line_no", *names).join(wanted, "file_id", "left_semi")
    # A file's lines are as many as the rows of its text, which is a single value here already.
    held = lines.groupBy("file_id").agg(F.collect_list(F.struct("line_no", *names)).alias("lines"))
    plan = _planner(fields, _arrow(_PLAN))
    hard = asked.join(held, "file_id", "left").mapInArrow(plan, _PLAN)
    none = F.array().cast("array<struct<field:string,name:string>>")
    easy = parsed.where("values is null").select("file_id", "print", none.alias("renamed"), F.col("absent").alias("removed"), "retyped", F.col("others").alias("added"))
    return easy.unionByName(hard)


def change_report(plans: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind, column_name), a row for each change."""
    step = lambda c, kind: F.transform(c, lambda x: F.struct(x.alias("field_name"), F.lit(kind).alias("change_kind"), F.lit(None).cast("string").alias("column_name")))
    renamed = F.transform("renamed", lambda x: F.struct(x["field"].alias("field_name"), F.lit("renamed").alias("change_kind"), x["name"].alias("column_name")))
    every = F.concat(renamed, step("removed", "removed"), step("added", "added"), step("retyped", "retyped"))
    return plans.select("file_id", F.explode(every).alias("c")).select("file_id", "c.*")


def _chain() -> F.Column:
    """A plan's migration chain in the order in which it is applied, as JSON."""
    return F.to_json(F.struct(F.sort_array("renamed").alias("rename"), F.sort_array("removed").alias("default"), F.sort_array("retyped").alias("cast"), F.sort_array("added").alias("drop")))


def keep_versions(plans: DataFrame, at: str) -> DataFrame:
    """(print, steps, version): the versions in the table at ``at``, to which those of these plans that it lacks are appended first.
    Numbers count up from 1 for each fingerprint; new chains are numbered by their text. One writer at a time."""
    spark = plans.sparkSession
    schema = "print string, steps string, version int"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(schema).parquet(at) if there else spark.createDataFrame([], schema)
    used = plans.select("print", _chain().alias("steps")).distinct()
    last = known.groupBy("print").agg(F.max("version").alias("_last"))
    number = F.row_number().over(W.partitionBy("print").orderBy("steps")) + F.coalesce("_last", F.lit(0))
    fresh = settle(used.join(known, ["print", "steps"], "left_anti").join(last, "print", "left").select("print", "steps", number.cast("int").alias("version")), "drift-versions")
    fresh.write.mode("append").parquet(at)
    return spark.read.schema(schema).parquet(at)


def version_registry(plans: DataFrame, versions: DataFrame) -> DataFrame:
    """(print, steps, version, n_files): the kept versions with the number of these files that have them."""
    used = plans.groupBy("print", _chain().alias("steps")).agg(F.count(F.lit(1)).alias("n_files"))
    return versions.join(used, ["print", "steps"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def migrate(raw: DataFrame, plans: DataFrame, versions: DataFrame, fields: tuple[tuple[str, str], ...] = SWEEP_FIELDS, max_broadcast: int = 100_000) -> DataFrame:
    """(file_id, line_no, version, fields): every text routed through the chain of its version: columns renamed, absent fields
    null, values that do not fit cast by cast_column(), other columns dropped. A file without a plan has an empty chain and a
    null version."""
    kinds = dict(fields)
    ddl = ", ".join(["file_id bigint", "line_no int", "version int", *(f"`{n}` {t}" for n, t in fields)])
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, body, version, steps in zip(*(batch.column(i).to_pylist() for i in range(4))):
                names, rows = parse(body)
                if not rows:
                    continue
                chain = json.loads(steps or "{}")
                cols: dict[str, tuple] = {}
                for k, c in zip((n.lower() for n in names), zip(*rows)):
                    cols.setdefault(k, c)
                for r in chain.get("rename", ()):
                    cols[r["field"].lower()] = cols.pop(r["name"])
                for n in (*chain.get("default", ()), *chain.get("drop", ())):
                    cols.pop(n.lower(), None)
                cast = set(chain.get("cast", ())) if steps else set(kinds)
                n = len(rows)
                data = [pa.array([file_id] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([version] * n, pa.int32())]
                for f, t in fields:
                    c = cols.get(f.lower())
                    value = cast_column if f in cast else plain_column
                    data.append(pa.nulls(n, schema.field(f).type) if c is None else pa.array(value(c, kinds[f]), schema.field(f).type))
                yield pa.RecordBatch.from_arrays(data, schema=schema)

    left = raw.select(F.col("file_id").cast("bigint").alias("file_id"), "body")
    routed = plans.select("file_id", "print", _chain().alias("steps")).join(broadcast_if_small(versions, max_broadcast), ["print", "steps"], "left")
    return left.join(routed, "file_id", "left").select("file_id", "body", "version", "steps").mapInArrow(run, ddl)


def _bounded(x: int, kind: str) -> int | None:
    return x if -(1 << (31 if kind == "int" else 63)) <= x < 1 << (31 if kind == "int" else 63) else None


def plain_column(values: Iterable[str], kind: str) -> list:
    """Values that fit their type; missing ones and whole numbers beyond the type are null."""
    if kind == "string":
        return [None if missing(v) else v.strip() for v in values]
    if kind == "double":
        return [None if missing(v) else float(v) for v in values]
    return [None if missing(v) else _bounded(int(v), kind) for v in values]


def cast_column(values: Iterable[str], kind: str) -> list:
    """Values of any notation. A whole number may have its digits in groups of three; else its first whole reading counts. In a
    column of doubles a comma parts groups of three only if all of its values allow that and one has two such groups; else it
    is the decimal sign. What has no reading is null."""
    if kind == "string":
        return plain_column(values, kind)
    values = list(values)
    if kind == "double":
        commas = [v.strip() for v in values if "," in v]
        grouped = all(_GROUPS.fullmatch(v) for v in commas) and any(v.count(",") > 1 for v in commas)
        return [None if missing(v) else next(iter(readings(v.replace(",", "") if grouped else v)), None) for v in values]
    out = []
    for v in values:
        s = v.strip().replace("−", "-")
        if missing(s):
            out.append(None)
        elif _INT.fullmatch(s):
            out.append(_bounded(int(s), kind))
        elif _GROUPS.fullmatch(s):
            out.append(_bounded(int(re.sub(r"[^0-9+-]", "", s)), kind))
        else:
            out.append(next((x for r in readings(s) if r == int(r) and (x := _bounded(int(r), kind)) is not None), None))
    return out
