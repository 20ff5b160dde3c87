"""Queries of the data-layout problems p1 to p3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, drift, proximity
from ..schemas import SWEEP_FIELDS
from ..session import settle, table, work_dir

#: Kilometres within which two events count as neighbours.
NEAR_KM = 1.0

# Rings of coarse study regions, (longitude, latitude) per vertex; "basin" has a hole.
STUDY_REGIONS: tuple[tuple[str, tuple[tuple[float, float], ...]], ...] = (
    ("basin", ((-104.0, 33.0), (-88.0, 33.0), (-86.0, 41.0), (-95.0, 45.5), (-104.0, 41.0))),
    ("basin", ((-98.0, 36.0), (-94.0, 36.0), (-94.0, 39.0), (-98.0, 39.0))),
    ("coast", ((-98.0, 25.0), (-80.0, 24.5), (-75.0, 35.0), (-70.0, 41.5), (-77.0, 38.5), (-82.0, 31.0), (-90.0, 30.0), (-97.0, 29.0))),
    ("islands", ((172.0, 50.0), (-164.0, 50.0), (-160.0, 57.0), (172.0, 57.0))),
    ("lakes", ((-93.0, 41.0), (-76.0, 41.0), (-75.0, 48.0), (-84.0, 44.0), (-93.0, 49.0))),
    ("range", ((-120.0, 34.0), (-105.0, 34.0), (-105.0, 49.0), (-112.0, 41.0), (-121.0, 49.0))),
)


def _record_sql(alias: str = "") -> str:
    out = []
    for n, t in SWEEP_FIELDS:
        if t == "double":
            out.append(f"case when isnan({n}) then null else {n} end as {n}")
        elif n == "event_id":
            out.append(r"upper(regexp_replace(trim(regexp_replace(event_id, '\s', ' ', 'g')), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i')) as event_id")
        else:
            out.append(n)
    return ", ".join(out)


def _compact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    out = compaction.compaction_dir(spark)
    held, _ = compaction.compact(table(spark, sf_dir, "sweep"), table(spark, sf_dir, "sweep_files"), out)
    return held, out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the sweep files that add nothing, as the compaction withheld them."""
    return _compact(spark, sf_dir)[0]


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct records, read back from the compacted files."""
    names = [n for n, _ in SWEEP_FIELDS]
    got = compaction.read_compacted(spark, _compact(spark, sf_dir)[1])
    if got is None:
        got = table(spark, sf_dir, "sweep").limit(0)
    return got.select("file_id", "line_no", *names)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different events whose places are at most NEAR_KM apart."""
    places = proximity.box_places(table(spark, sf_dir, "storm_catalog"))
    return proximity.neighbour_pairs(settle(places, "places"), "id", NEAR_KM)


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different places at most NEAR_KM apart, with the number of events at each: the pairs of p2_found without those
    that membership expands to."""
    places = proximity.box_places(table(spark, sf_dir, "storm_catalog"))
    pairs, members = proximity.neighbours(settle(places, "places"), "id", NEAR_KM)
    n = members.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    a, b = (n.select(F.col("place").alias(f"place_{k}"), F.col("n").alias(f"events_{k}")) for k in "ab")
    return pairs.join(a, "place_a").join(b, "place_b").select("place_a", "place_b", "events_a", "events_b")


def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per study region (a point on an edge is inside)."""
    places = proximity.box_places(table(spark, sf_dir, "storm_catalog")).withColumnRenamed("id", "point_id")
    rows = [(name, [{"lon": x, "lat": y} for x, y in ring]) for name, ring in STUDY_REGIONS]
    rings = spark.createDataFrame(rows, "region_id string, ring array<struct<lon:double,lat:double>>")
    inside = proximity.points_in_regions(places, proximity.region_edges(rings), height=1.0, width=2.0)
    return inside.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_events"))


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "sweep_raw")
    return raw, settle(drift.plan_migrations(raw, table(spark, sf_dir, "sweep")), "drift-plans")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file against the base schema."""
    return drift.change_report(_plans(spark, sf_dir)[1]).select("file_id", "field_name", "change_kind")


def _versions(spark: SparkSession, plans: DataFrame) -> DataFrame:
    return drift.keep_versions(plans, f"{work_dir(spark, 'drift-registry')}/t")


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in the base schema, each through the chain of its version."""
    raw, plans = _plans(spark, sf_dir)
    return drift.migrate(raw, plans, _versions(spark, plans)).drop("version")


def p3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema versions and their migration chains."""
    plans = _plans(spark, sf_dir)[1]
    return drift.version_registry(plans, _versions(spark, plans))


_PLACES_SQL = """
places as (
  select id, min(lat) as lat, min(lon) as lon from (
    select id, (llcrnrlat + urcrnrlat) / 2 as lat,
           ((llcrnrlon + ((((urcrnrlon - llcrnrlon + 540) % 360) + 360) % 360 - 180) / 2) % 360 + 360) % 360 as lon
    from storm_catalog
    where llcrnrlat between -90 and 90 and urcrnrlat between -90 and 90 and llcrnrlon between -360 and 360
      and urcrnrlon between -360 and 360 and llcrnrlat <> urcrnrlat and llcrnrlon <> urcrnrlon and id is not null)
  group by id)"""


def _region_sql() -> str:
    edges = []
    for name, ring in STUDY_REGIONS:
        x0 = ring[0][0]
        xs = [x0 + (x - x0 + 540) % 360 - 180 for x, _ in ring]
        for i, (_, y) in enumerate(ring):
            k = (i + 1) % len(ring)
            edges.append(f"('{name}', {x0}, {xs[i]}, {y}, {xs[k]}, {ring[k][1]})")
    return f"""with {_PLACES_SQL.strip()},
edges(region_id, x0, x1, y1, x2, y2) as (values {", ".join(edges)}),
hits as (
  select region_id, id, count(*) as n from (
    select region_id, id, x1, y1, x2, y2, lat as y, lon + 360 * round((x0 - lon) / 360) as x from edges, places)
  where (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (case when y2 = y1 then 1 else y2 - y1 end)
  group by region_id, id)
select region_id, count(*) as n_events from hits where n % 2 = 1 group by region_id"""


def _drift_sql() -> str:
    """The cells of every text, and which column carries which field of the same lines in sweep."""
    fields = ", ".join(f"('{n}', '{t}')" for n, t in SWEEP_FIELDS)
    values = ", ".join(f"cast({n} as varchar)" for n, _ in SWEEP_FIELDS)
    names = ", ".join(f"'{n}'" for n, _ in SWEEP_FIELDS)
    return rf"""fields(field, kind) as (values {fields}),
texts as (select file_id, list_filter(string_split_regex(ltrim(body, chr(65279)), '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9)) <> '' and left(ltrim(x, ' ' || chr(9)), 1) <> '#') as l from sweep_raw),
heads as (select file_id, l, regexp_replace(l[1], '"[^"]*"', '', 'g') as h from texts where len(l) > 0),
seps as (select file_id, l, case when n1 >= n2 and n1 >= n3 and n1 >= n4 then ',' when n2 >= n3 and n2 >= n4 then ';' when n3 >= n4 then chr(9) else '|' end as sep from (
  select *, len(h) - len(replace(h, ',', '')) as n1, len(h) - len(replace(h, ';', '')) as n2, len(h) - len(replace(h, chr(9), '')) as n3, len(h) - len(replace(h, '|', '')) as n4 from heads)),
lines as (select file_id, sep, unnest(l) as line, generate_subscripts(l, 1) - 1 as line_no from seps),
cells as (select file_id, line_no, string_split(list_aggregate(list_transform(string_split(line, '"'), lambda x, i: case when i % 2 = 1 then replace(x, sep, chr(31)) else x end), 'string_agg', ''), chr(31)) as c from lines),
names as (select file_id, unnest(c) as name, generate_subscripts(c, 1) as k from cells where line_no = 0),
cols as (select file_id, lower(trim(name, ' ' || chr(9) || chr(65279))) as name, min(k) as k from names group by all),
vals as (select cols.file_id, cols.name, line_no, trim(coalesce(c[k], ''), ' ' || chr(9)) as v from cols join cells on cells.file_id = cols.file_id and line_no > 0),
marked as (select *, lower(v) in ('', 'nan', 'na', 'n/a', 'null', 'none') as gone from vals),
base as (select c.file_id, f.field, c.name from cols c join fields f on lower(f.field) = c.name),
absent as (select t.file_id, f.field, f.kind from texts t, fields f where not exists (from base b where b.file_id = t.file_id and b.field = f.field)),
others as (select c.file_id, c.name from cols c where not exists (from fields f where lower(f.field) = c.name) and (c.name <> '' or exists (from marked m where m.file_id = c.file_id and m.name = c.name and not gone))),
ref as (select file_id, line_no, unnest([{names}]) as field, unnest([{values}]) as w from sweep where file_id in (select file_id from sweep_raw)),
asked as (select a.file_id, a.field, a.kind, o.name from absent a join others o using (file_id)),
reads as (select *, regexp_extract(replace(v, ',', '.'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') as r1, regexp_extract(replace(v, ',', ''), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') as r2, regexp_extract(v, '0[xX][0-9a-fA-F]+') as r3 from marked),
agree as (select a.file_id, a.field, a.name, count(*) as n, count(r.w) as n_ref, bool_or(not m.gone) as present,
  bool_and(case when m.gone or r.w is null or lower(r.w) in ('nan', '') or a.kind = 'string' and lower(trim(r.w)) in ('na', 'n/a', 'null', 'none') then m.gone = (r.w is null or lower(r.w) in ('nan', '') or a.kind = 'string' and lower(trim(r.w)) in ('na', 'n/a', 'null', 'none'))
    when a.field = 'event_id' then upper(regexp_replace(trim(m.v), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i')) = upper(regexp_replace(trim(r.w), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i'))
    when a.kind = 'string' then lower(regexp_replace(m.v, '[\W_]', '', 'g')) = lower(regexp_replace(r.w, '[\W_]', '', 'g'))
    else coalesce(abs(try_cast(m.r1 as double) - cast(r.w as double)) <= 1e-9 * greatest(1e-3, abs(cast(r.w as double))), false)
      or coalesce(abs(try_cast(m.r2 as double) - cast(r.w as double)) <= 1e-9 * greatest(1e-3, abs(cast(r.w as double))), false)
      or coalesce(abs(try_cast(m.r3 as bigint) - cast(r.w as double)) < 0.5, false) end) as ok
  from asked a join reads m on m.file_id = a.file_id and m.name = a.name left join ref r on r.file_id = a.file_id and r.line_no = m.line_no and r.field = a.field group by all),
carried as (select file_id, field, arg_max(name, case when present then 1 else 0 end) as name from agree where ok group by all),
source as (select file_id, field, name from base union all select file_id, field, name from carried)"""


def _drift_table_sql() -> str:
    pick = lambda n, t: f"max(case when s.field = '{n}' then 1 end)"
    kept = ", ".join(f"{pick(n, t)} as has_{i}" for i, (n, t) in enumerate(SWEEP_FIELDS))
    value = lambda n, t: f"case when lower(trim({n})) in ('', 'nan', 'na', 'n/a', 'null', 'none') then null else trim({n}) end" if t == "string" else f"case when isnan({n}) then null else {n} end" if t == "double" else n
    out = ", ".join(f"case when has_{i} = 1 then {value(n, t)} end as {n}" for i, (n, t) in enumerate(SWEEP_FIELDS))
    return f"""with {_drift_sql()}, has as (select t.file_id, {kept} from texts t left join source s using (file_id) group by t.file_id)
select file_id, line_no, {out} from sweep join has using (file_id)"""


_FIELD_LIST = ", ".join(n for n, _ in SWEEP_FIELDS)

QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_regions": p2_regions, "p3_found": p3_found, "p3_table": p3_table, "p3_versions": p3_versions}

SQL = {
    "p1_found": f"""with r as (select file_id, line_no, {_record_sql()} from sweep),
n as (select file_id, line_no, row_number() over (partition by {_FIELD_LIST} order by file_id, line_no) as k from r)
select file_id, line_no from n where k > 1""",
    "p1_records": f"""with r as (select file_id, line_no, {_record_sql()} from sweep),
n as (select *, row_number() over (partition by {_FIELD_LIST} order by file_id, line_no) as k from r)
select file_id, line_no, {_FIELD_LIST} from n where k = 1""",
    "p2_found": f"""with {_PLACES_SQL.strip()}
select a.id as id_a, b.id as id_b from places a join places b on a.id < b.id and abs(a.lat - b.lat) <= 0.01
where 2 * 6371 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 1.0""",
    "p2_neighbours": f"""with {_PLACES_SQL.strip()}, spots as (select min(id) as place, any_value(lat) as lat, any_value(lon) as lon, count(*) as n from places group by round(lat, 9), round(lon, 9) % 360)
select a.place as place_a, b.place as place_b, a.n as events_a, b.n as events_b from spots a join spots b on a.place < b.place and abs(a.lat - b.lat) <= 0.01
where 2 * 6371 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 1.0""",
    "p2_regions": _region_sql(),
    "p3_table": _drift_table_sql(),
    "p3_found": rf"""with {_drift_sql()}
select file_id, field as field_name, 'renamed' as change_kind from carried
union all select a.file_id, a.field, 'removed' from absent a where not exists (from carried c where c.file_id = a.file_id and c.field = a.field)
union all select o.file_id, o.name, 'added' from others o where not exists (from carried c where c.file_id = o.file_id and c.name = o.name)
union all select distinct m.file_id, s.field, 'retyped' from marked m join source s on s.file_id = m.file_id and s.name = m.name join fields f on f.field = s.field
where not gone and kind <> 'string' and not regexp_full_match(v, case when kind in ('int', 'bigint') then '[+-]?[0-9]+' else '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?' end)""",
}
