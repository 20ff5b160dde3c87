"""Queries over the storm catalogue, the flashes and the events stream: scans, joins, sets, trends, scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.cleaning import clean_doubles, plain_id
from ..operators import decision as D
from ..operators import relational as R
from ..operators import stats as S
from ..sources import catalog as C
from ..session import table, work_dir
from .sweep_queries import EVENTS_SQL, RUNS_SQL, _r, _rounded, latest_events, runs

CHANNELS = ("vil", "ir069", "ir107", "lght")
GRID = [100, 200, 300]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storm catalogue with NaN as null and repeated rows of one (id, channel) once: the one listed first."""
    rows = clean_doubles(table(spark, sf_dir, "storm_catalog")).where("id is not null and img_type is not null")
    return R.keep_first(rows, ["id", "img_type"], [F.col(c).asc_nulls_last() for c in ("listed_at", "file_name", "time_utc", "pct_missing", "llcrnrlon", "urcrnrlon", "llcrnrlat", "urcrnrlat")])


_NULLED = ", ".join(f"case when isnan({c}) then null else {c} end as {c}" for c in ("pct_missing", "llcrnrlon", "urcrnrlon", "llcrnrlat", "urcrnrlat"))
CAT_SQL = f"""cat0 as (select * replace ({_NULLED}) from storm_catalog where id is not null and img_type is not null),
cat as (select * exclude (k) from (select *, row_number() over (partition by id, img_type order by listed_at nulls last, file_name nulls last, time_utc nulls last, pct_missing nulls last, llcrnrlon nulls last, urcrnrlon nulls last, llcrnrlat nulls last, urcrnrlat nulls last) as k from cat0) where k = 1)"""


def s01_catalog_csv(spark, sf_dir):
    at = f"{work_dir(spark, 'csv')}/catalog"
    cols = ["id", "img_type", "file_name", "time_utc", "pct_missing", "llcrnrlon", "urcrnrlon", "llcrnrlat", "urcrnrlat"]
    C.write_csv(catalog(spark, sf_dir).select(*cols), at)
    return C.read_catalog_csv(spark, at).withColumn("time_utc", F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss"))


def s02_path_layouts(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", "img_type", X.swapped_path(F.col("file_name")).alias("other_layout"), X.base_name(F.col("file_name")).alias("base"))


def s03_resolved(spark, sf_dir):
    """Catalogue names resolved against a listing that has every third file in the other layout."""
    c = catalog(spark, sf_dir).where("file_name is not null")
    n = F.pmod(F.conv(F.substring(F.md5("file_name"), 1, 4), 16, 10).cast("int"), F.lit(3))
    files = c.select("file_name", n.alias("n")).distinct().select(F.concat(F.lit("/data/"), F.when(F.col("n") == 0, X.swapped_path(F.col("file_name"))).when(F.col("n") == 1, F.col("file_name")).otherwise(F.lit("none/x.h5"))).alias("path"))
    return C.resolve_paths(c.select("id", "img_type", "file_name"), files).select("id", "img_type", "path")


def s13_complete_events(spark, sf_dir):
    return R.complete_files(runs(spark, sf_dir), "event_id", "N", "intra_sp_var_mean", GRID, 5)


def s14_bare_ids(spark, sf_dir):
    return table(spark, sf_dir, "sweep_files").groupBy(X.bare_id(F.col("file_name")).alias("bare_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def s17_append(spark, sf_dir):
    at = f"{work_dir(spark, 'append')}/t"
    r = runs(spark, sf_dir).select("event_id", "N", "runtime_s")
    for part in (r.where("N < 500"), r.where("N >= 500")):
        C.append_rows(part, at)
    return spark.read.parquet(at)


def s18_calibration(spark, sf_dir):
    """A calibration record for each class, written as JSON and read back with defaults."""
    at = f"{work_dir(spark, 'json')}/calibration"
    g = runs(spark, sf_dir).where("lifecycle_class is not null").groupBy("lifecycle_class").agg(F.round(F.avg("J_imex"), 3).alias("s"), F.max("N").alias("N_star"), F.max("event_id").alias("calibration_event_id"))
    C.write_calibration(g.select(F.lit(1.5).alias("c_sigma"), F.lit(0.01).alias("D"), "N_star", F.create_map("lifecycle_class", "s").alias("class_sigma_init"), "calibration_event_id"), at)
    got = C.read_calibration(spark, at)
    return got.select(F.map_keys("class_sigma_init")[0].alias("lifecycle_class"), "N_star", "calibration_event_id", "c_sigma", "D", "rtol", "atol")


def s20_id_list(spark, sf_dir):
    at = f"{work_dir(spark, 'ids')}/list"
    C.write_ids(latest_events(spark, sf_dir).where("lifecycle_class = 'episodic'"), at)
    return C.read_ids(spark, at)


def _extents(spark, sf_dir):
    """One usable extent for each event, west and south corner first."""
    c = catalog(spark, sf_dir).where("llcrnrlon between -180 and 180 and urcrnrlon between -180 and 180 and llcrnrlat between -90 and 90 and urcrnrlat between -90 and 90 and llcrnrlon < urcrnrlon and llcrnrlat < urcrnrlat")
    c = R.keep_first(c, ["id"], [F.col("img_type")])
    return c.select("id", F.col("llcrnrlon").alias("lon1"), F.col("urcrnrlon").alias("lon2"), F.col("llcrnrlat").alias("lat1"), F.col("urcrnrlat").alias("lat2"))


_EXT = f"""{CAT_SQL}, ext as (select id, llcrnrlon as lon1, urcrnrlon as lon2, llcrnrlat as lat1, urcrnrlat as lat2 from (select *, row_number() over (partition by id order by img_type) as k from cat
  where llcrnrlon between -180 and 180 and urcrnrlon between -180 and 180 and llcrnrlat between -90 and 90 and urcrnrlat between -90 and 90 and llcrnrlon < urcrnrlon and llcrnrlat < urcrnrlat) where k = 1)"""


def j18_tile_overlap(spark, sf_dir):
    """Tiles of one degree that each extent touches."""
    tiles = spark.range(360 * 180).select(F.col("id").alias("tile"), (F.col("id") % 360 - 180.0).alias("tlon1"), (F.col("id") % 360 - 179.0).alias("tlon2"), (F.floor(F.col("id") / 360) - 90.0).alias("tlat1"), (F.floor(F.col("id") / 360) - 89.0).alias("tlat2"))
    hit = R.bbox_overlap(_extents(spark, sf_dir), tiles)
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("n_tiles"), F.min("tile").alias("first_tile"))


def s29_extent_keys(spark, sf_dir):
    return _extents(spark, sf_dir).select("id", X.extent_key(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("cache_key"))


def s32_unique_extents(spark, sf_dir):
    """Each event with the number of events that share its extent: one fetch serves them all."""
    e = _extents(spark, sf_dir)
    key = X.extent_key(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    e = e.withColumn("cache_key", key)
    return R.lookup(e.select("id", "cache_key"), e.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_events")), ["cache_key"]).select("id", "n_events")


def s34_monthly(spark, sf_dir):
    """Monthly climatology of missing pixels by channel; months done before (here the odd ones) are left out."""
    c = catalog(spark, sf_dir).where("time_utc is not null").withColumn("month", F.month("time_utc"))
    done = spark.range(1, 13, 2).select(F.col("id").cast("int").alias("month"))
    return _rounded(R.anti(c, done, ["month"]).groupBy("month", "img_type").agg(F.avg("pct_missing").alias("mean_missing"), F.count(F.lit(1)).alias("n")))


def s45_copy_script(spark, sf_dir):
    c = catalog(spark, sf_dir).where("file_name is not null and pct_missing = 0").groupBy("file_name").agg(F.min("listed_at").alias("at"))
    c = R.round_robin(c.select("file_name"), ["file_name"], 1 << 30).withColumnRenamed("chunk", "position")
    return C.copy_script(c, "store", "local").select("line", "position")


def s46_resume_script(spark, sf_dir):
    f = table(spark, sf_dir, "sweep_files")
    present = f.where("n_rows is not null").select(F.col("file_name").alias("name"), F.when(F.col("n_rows") > 3, F.col("n_bytes")).otherwise(0).alias("length"))
    return C.resume_script(f.select("file_name", F.col("file_id").alias("position")), present, "store", "local").select("line", "position")


def s47_merge(spark, sf_dir):
    """Three result files as one, the last one's row for each key."""
    r = clean_doubles(table(spark, sf_dir, "sweep")).where("event_id is not null and N is not null")
    parts = [r.where(F.col("file_id") % 3 == k).groupBy("event_id", "N").agg(F.max("runtime_s").alias("runtime_s")) for k in range(3)]
    return _rounded(C.merge_results(parts, ["event_id", "N"]))


def s51_index(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", "img_type", "file_name")


def s53_without_extent(spark, sf_dir):
    return R.anti(catalog(spark, sf_dir).select("id").distinct(), _extents(spark, sf_dir), ["id"])


def s54_months(spark, sf_dir):
    return catalog(spark, sf_dir).groupBy("id").agg(F.coalesce(F.month(F.min("time_utc")), F.lit(7)).alias("month"))


def q04_complete_vil(spark, sf_dir):
    return catalog(spark, sf_dir).where((F.col("img_type") == "vil") & (F.col("pct_missing") == 0.0)).select("id", "file_name")


def q03_infrared(spark, sf_dir):
    return catalog(spark, sf_dir).where(F.col("img_type").isin("ir069", "ir107")).groupBy("img_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_events"))


def q12_dropna(spark, sf_dir):
    return R.drop_missing(table(spark, sf_dir, "sweep").select("file_id", "line_no", "FAE", "J_imex"), ["FAE", "J_imex"]).select("file_id", "line_no")


def q06_flashes_in_box(spark, sf_dir):
    """Flashes inside the box of their own event, each distinct one once."""
    f = clean_doubles(table(spark, sf_dir, "flashes")).withColumn("id", plain_id(F.col("event_id"))).select("id", "t_off", "lat", "lon", "energy").distinct()
    j = f.join(_extents(spark, sf_dir), "id")
    return j.where("lon between lon1 and lon2 and lat between lat1 and lat2").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("energy"), 6).alias("most"))


def f08_flash_frames(spark, sf_dir):
    """Flashes for each event and five-minute frame."""
    f = clean_doubles(table(spark, sf_dir, "flashes")).where("t_off is not null and event_id is not null")
    return f.groupBy(plain_id(F.col("event_id")).alias("id"), X.frame_index(F.col("t_off")).alias("frame")).agg(F.count(F.lit(1)).alias("n"))


def f25_lambert(spark, sf_dir):
    e = _extents(spark, sf_dir)
    x, y = X.lambert_xy(F.col("lon1"), F.col("lat1"))
    return e.select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def j01_semi(spark, sf_dir):
    return R.semi(catalog(spark, sf_dir).select("id", "img_type"), latest_events(spark, sf_dir).where("lifecycle_class = 'steady'"), ["id"])


def j02_left(spark, sf_dir):
    v = catalog(spark, sf_dir).where("img_type = 'vil'").select("id", "file_name")
    return v.join(latest_events(spark, sf_dir).select("id", "lifecycle_class"), "id", "left")


def j04_resume(spark, sf_dir):
    """Runs of the wanted grid that no event has yet: an anti-join against what is done."""
    r = runs(spark, sf_dir)
    want = r.select("event_id").distinct().withColumn("N", F.explode(F.array(*[F.lit(n) for n in GRID])))
    return R.anti(want, r, ["event_id", "N"])


def j05_pending(spark, sf_dir):
    return R.incomplete(runs(spark, sf_dir), ["event_id"], "N", GRID).select("event_id", F.array_join("missing", ",").alias("missing"))


def j06_all_channels(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return R.in_all([c.where(F.col("img_type") == t).select("id") for t in CHANNELS])


def j08_division(spark, sf_dir):
    return R.owns_all(catalog(spark, sf_dir), ["id"], "img_type", ["vil", "ir107"])


def j20_key_sets(spark, sf_dir):
    """How the ids of catalogue and classification relate: a full outer join on their sets."""
    a = catalog(spark, sf_dir).select("id").distinct().withColumn("a", F.lit(1))
    b = latest_events(spark, sf_dir).select("id").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "classified only").when(F.col("b").isNull(), "catalogue only").otherwise("both")
    return a.join(b, "id", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def j21_mapped(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("lifecycle_class").agg(F.max(X.class_alpha(F.col("lifecycle_class"))).alias("alpha"), F.count(F.lit(1)).alias("n"))


def u01_union(spark, sf_dir):
    f, e = table(spark, sf_dir, "flashes").select(F.col("event_id").alias("id"), "energy"), table(spark, sf_dir, "event_catalogue").select("id", "peak_mass")
    return R.union_all([clean_doubles(f), clean_doubles(e)]).groupBy(plain_id(F.col("id")).alias("id")).agg(F.count("energy").alias("n_flashes"), F.count("peak_mass").alias("n_masses"))


def u03_pairs(spark, sf_dir):
    """Distinct unordered pairs of nations whose customers ordered on one day at one priority."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.to_date("o_orderdate").alias("d"), "o_orderpriority").distinct()
    a, b = o.withColumnRenamed("c_nationkey", "src"), o.withColumnRenamed("c_nationkey", "dst")
    return R.unordered_pairs(a.join(b, ["d", "o_orderpriority"]).where("src <> dst"), "src", "dst")


def u06_first_seen(spark, sf_dir):
    """Folders of the sweep files in the order in which they are first met."""
    f = table(spark, sf_dir, "sweep_files").select(X.path_parts(F.col("file_name"))[1].alias("folder"), "file_id")
    return f.groupBy("folder").agg(F.min("file_id").alias("first_id"))


def _mass(spark, sf_dir):
    """(user_id, t, mass): value above a noise level summed by hour, hours numbered in order."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(F.when(F.col("value") > 20, F.col("value")).otherwise(0.0)).alias("mass"))
    return e.withColumn("t", F.row_number().over(W.partitionBy("user_id").orderBy("hour")) - 1).select("user_id", "t", "mass")


_MASS = """h as (select user_id, date_trunc('hour', ts) as hour, sum(case when value > 20 then value else 0.0 end) as mass from events where user_id is not null and ts is not null group by 1, 2),
m as (select user_id, row_number() over (partition by user_id order by hour) - 1 as t, mass from h)"""


def a08_trends(spark, sf_dir):
    t = S.trend(_mass(spark, sf_dir), ["user_id"], "t", "mass")
    return _rounded(t.select("user_id", "slope", "intercept", "r_squared", "peak", "peak_at", "trough", "mean", "n"), 5)


def a13_active_share(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 20).cast("int")).alias("active"), F.sum(F.when(F.col("value") > 20, F.col("value")).otherwise(0)).alias("mass")), 4)


def d09_phases(spark, sf_dir):
    return D.phases(_mass(spark, sf_dir), ["user_id"], "t", "mass")


def w14_run_lengths(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null and ts is not null")
    return S.run_lengths(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", F.md5("sequence").alias("sequence_md5"), "n_runs")


def f24_json(spark, sf_dir):
    """A JSON column's keys, counted, and its first value parsed."""
    e = table(spark, sf_dir, "events").where("props is not null")
    k = e.select(F.explode(F.json_object_keys("props")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "adfjqsuw" and k[1:3].isdigit()}

_SWAP = "case when len(string_split(file_name, '/')) = 3 then string_split(file_name, '/')[2] || '/' || string_split(file_name, '/')[1] || '/' || string_split(file_name, '/')[3] else file_name end"
_PART = "case when floor({0} * 10000 + 0.5) < 0 then 'm' else '' end || (abs(floor({0} * 10000 + 0.5))::bigint // 10000) || '.' || lpad((abs(floor({0} * 10000 + 0.5))::bigint % 10000)::varchar, 4, '0')"
_KEY = "(" + " || '_' || ".join(_PART.format(c) for c in ("lon1", "lat1", "lon2", "lat2")) + ")"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(file_name, '^.*/', ''), '\.[^.]*$', ''), '(_n_sweep|_sweep|_metrics|_result|_out)$', '')"
_PID = r"upper(regexp_replace(regexp_replace({}, '\s', '', 'g'), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i'))"
_EV = EVENTS_SQL

SQL = {
    "s01_catalog_csv": f"with {CAT_SQL} select id, img_type, file_name, strftime(time_utc at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as time_utc, pct_missing, llcrnrlon, urcrnrlon, llcrnrlat, urcrnrlat from cat",
    "s02_path_layouts": f"with {CAT_SQL} select id, img_type, {_SWAP} as other_layout, regexp_replace(file_name, '^.*/', '') as base from cat",
    "s03_resolved": f"""with {CAT_SQL}, c as (select id, img_type, file_name, {_SWAP} as sw, ('0x' || substr(md5(file_name), 1, 4))::int % 3 as n from cat where file_name is not null)
select id, img_type, case when n = 0 then '/data/' || sw when n = 1 then '/data/' || file_name end as path from c""",
    "s13_complete_events": f"with {RUNS_SQL} select event_id, count(intra_sp_var_mean) as valid from runs group by event_id having count(distinct case when N in (100, 200, 300) then N end) = 3 and count(intra_sp_var_mean) >= 5",
    "s14_bare_ids": f"select {_BARE} as bare_id, count(*) as n_files, sum(n_bytes) as n_bytes from sweep_files group by 1",
    "s17_append": f"with {RUNS_SQL} select event_id, N, runtime_s from runs",
    "s18_calibration": f"with {RUNS_SQL} select lifecycle_class, max(N) as N_star, max(event_id) as calibration_event_id, 1.5::double as c_sigma, 0.01::double as D, 1e-3::double as rtol, 1e-6::double as atol from runs where lifecycle_class is not null group by 1",
    "s20_id_list": f"with {_EV} select id from ev where lifecycle_class = 'episodic'",
    "j18_tile_overlap": f"""with {_EXT}, tiles as (select i as tile, i % 360 - 180.0 as x, floor(i / 360.0) - 90.0 as y from range({360 * 180}) r(i))
select id, count(*) as n_tiles, min(tile) as first_tile from ext join tiles on lon1 <= x + 1 and x <= lon2 and lat1 <= y + 1 and y <= lat2 group by id""",
    "s29_extent_keys": f"with {_EXT} select id, {_KEY} as cache_key from ext",
    "s32_unique_extents": f"with {_EXT} select id, count(*) over (partition by {_KEY}) as n_events from ext",
    "s34_monthly": f"with {CAT_SQL} select cast(month(time_utc) as int) as month, img_type, {_r('avg(pct_missing)')} as mean_missing, count(*) as n from cat where time_utc is not null and month(time_utc) % 2 = 0 group by 1, 2",
    "s45_copy_script": f"""with {CAT_SQL}, f as (select file_name as f, cast(row_number() over (order by file_name) - 1 as int) as p from (select distinct file_name from cat where file_name is not null and pct_missing = 0))
select 'mkdir -p local/' || regexp_replace(f, '/[^/]*$', '') as line, min(p) * 2 as position from f group by 1 union all select 'cp store/' || f || ' local/' || f, p * 2 + 1 from f""",
    "s46_resume_script": """with f as (select file_name as f, file_id as p from sweep_files where n_rows is null or n_rows <= 3 or n_bytes <= 0)
select 'mkdir -p local/' || regexp_replace(f, '/[^/]*$', '') as line, min(p) * 2 as position from f group by 1 union all select 'cp store/' || f || ' local/' || f, p * 2 + 1 from f""",
    "s47_merge": f"""with r as (select event_id, N, file_id % 3 as k, max(case when isnan(runtime_s) then null else runtime_s end) as v from sweep where event_id is not null and N is not null group by 1, 2, 3)
select event_id, N, {_r('v')} as runtime_s from (select *, row_number() over (partition by event_id, N order by k desc) as q from r) where q = 1""",
    "s51_index": f"with {CAT_SQL} select id, img_type, file_name from cat",
    "s53_without_extent": f"with {_EXT} select distinct id from cat where id not in (select id from ext)",
    "s54_months": f"with {CAT_SQL} select id, cast(coalesce(month(min(time_utc)), 7) as int) as month from cat group by id",
    "q04_complete_vil": f"with {CAT_SQL} select id, file_name from cat where img_type = 'vil' and pct_missing = 0",
    "q03_infrared": f"with {CAT_SQL} select img_type, count(*) as n, count(distinct id) as n_events from cat where img_type in ('ir069', 'ir107') group by 1",
    "q12_dropna": "select file_id, line_no from sweep where FAE is not null and not isnan(FAE) and J_imex is not null and not isnan(J_imex)",
    "q06_flashes_in_box": f"""with {_EXT}, f as (select distinct {_PID.format('event_id')} as id, case when isnan(t_off) then null else t_off end as t_off, case when isnan(lat) then null else lat end as lat,
  case when isnan(lon) then null else lon end as lon, case when isnan(energy) then null else energy end as energy from flashes)
select id, count(*) as n, round(max(energy), 6) as most from f join ext using (id) where lon between lon1 and lon2 and lat between lat1 and lat2 group by id""",
    "f08_flash_frames": f"select {_PID.format('event_id')} as id, cast(floor(t_off / 300) as int) as frame, count(*) as n from flashes where t_off is not null and not isnan(t_off) and event_id is not null group by 1, 2",
    "f25_lambert": f"""with {_EXT}, k as (select ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)) as n),
f as (select n, cos(radians(30)) * power(tan(pi() / 4 + radians(30) / 2), n) / n as f from k),
g as (select id, n, 6370000 * f / power(tan(pi() / 4 + radians(38) / 2), n) as r0, 6370000 * f / power(tan(pi() / 4 + radians(lat1) / 2), n) as r, n * radians(lon1 + 98) as th from ext, f)
select id, round(r * sin(th), 2) as x, round(r0 - r * cos(th), 2) as y from g""",
    "j01_semi": f"with {CAT_SQL}, {_EV} select id, img_type from cat where id in (select id from ev where lifecycle_class = 'steady')",
    "j02_left": f"with {CAT_SQL}, {_EV} select cat.id, file_name, lifecycle_class from cat left join ev using (id) where img_type = 'vil'",
    "j04_resume": f"with {RUNS_SQL}, w as (select distinct event_id, gn from runs, (values (100), (200), (300)) g(gn)) select event_id, gn as N from w where not exists (select 1 from runs r where r.event_id = w.event_id and r.N = w.gn)",
    "j05_pending": f"with {RUNS_SQL}, w as (select distinct event_id, gn from runs, (values (100), (200), (300)) g(gn)) select event_id, string_agg(gn::varchar, ',' order by gn) as missing from w where not exists (select 1 from runs r where r.event_id = w.event_id and r.N = w.gn) group by 1",
    "j06_all_channels": f"with {CAT_SQL} select id from cat where img_type in ('vil', 'ir069', 'ir107', 'lght') group by id having count(distinct img_type) = 4",
    "j08_division": f"with {CAT_SQL} select id from cat where img_type in ('vil', 'ir107') group by id having count(distinct img_type) = 2",
    "j20_key_sets": f"with {CAT_SQL}, {_EV}, a as (select distinct id from cat), b as (select distinct id from ev) select case when a.id is null then 'classified only' when b.id is null then 'catalogue only' else 'both' end as side, count(*) as n from a full join b on a.id = b.id group by 1",
    "j21_mapped": f"with {RUNS_SQL} select lifecycle_class, max(case lifecycle_class {' '.join(f'''when '{k}' then {v}::double''' for k, v in X.CLASS_ALPHA.items())} else 0.70::double end) as alpha, count(*) as n from runs group by 1",
    "u01_union": f"""with u as (select event_id as id, case when isnan(energy) then null else energy end as e, null as p from flashes union all select id, null, case when isnan(peak_mass) then null else peak_mass end from event_catalogue)
select {_PID.format('id')} as id, count(e) as n_flashes, count(p) as n_masses from u group by 1""",
    "u03_pairs": """with o as (select distinct c_nationkey as n, o_orderdate::date as d, o_orderpriority as p from orders join customer on o_custkey = c_custkey)
select distinct least(a.n, b.n) as src, greatest(a.n, b.n) as dst from o a join o b using (d, p) where a.n <> b.n""",
    "u06_first_seen": "select string_split(file_name, '/')[2] as folder, min(file_id) as first_id from sweep_files group by 1",
    "a08_trends": f"""with {_MASS} select user_id, {_r('regr_slope(mass, t)', 5)} as slope, {_r('regr_intercept(mass, t)', 5)} as intercept, {_r('regr_r2(mass, t)', 5)} as r_squared, {_r('max(mass)', 5)} as peak,
  (select cast(min(t) as int) from m b where b.user_id = m.user_id and b.mass = max(m.mass)) as peak_at, {_r('min(mass)', 5)} as trough, {_r('avg(mass)', 5)} as mean, count(mass) as n from m group by user_id""",
    "a13_active_share": f"select event_type, {_r('avg((value > 20)::int)', 4)} as active, {_r('sum(case when value > 20 then value else 0 end)', 4)} as mass from events group by 1",
    "d09_phases": f"""with {_MASS}, c as (select *, count(*) over (partition by user_id) as k from m), hh as (select user_id, k, t, mass, k < 4 or t < floor(k / 2) as l from c),
s as (select user_id, max(k) as k, coalesce(regr_slope(mass, t) filter (where l), 0) as a, coalesce(regr_slope(mass, t) filter (where not l), 0) as b from hh group by 1),
p as (select user_id, k, case when abs(a) < 1e-6 then 'P' when a > 0 then 'G' else 'D' end as a, case when abs(b) < 1e-6 then 'P' when b > 0 then 'G' else 'D' end as b from s)
select user_id, case when k < 4 or a = b then 1 else 2 end as n_phases, case when k < 4 or a = b then a else a || '→' || b end as phase_sequence from p""",
    "w14_run_lengths": """with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events where user_id is not null and event_type is not null and ts is not null)
select user_id, md5(string_agg(event_type, '→' order by ts, event_id)) as sequence_md5, count(*) as n_runs from e where p is null or p <> event_type group by 1""",
    "f24_json": "select k as key, count(*) as n from (select unnest(json_keys(props)) as k from events where props is not null) group by 1",
}
