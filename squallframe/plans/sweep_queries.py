"""Queries over the sweep table and the event catalogue: aggregates, decisions, trends, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.cleaning import clean_doubles, letters_key, plain_id
from ..functions.distributions import t_critical_sql
from ..operators import decision as D
from ..operators import relational as R
from ..operators import stats as S
from ..schemas import SWEEP_FIELDS
from ..session import settle, table
from ..sources.catalog import merge_results, tolerant_sweep

_NAMES = [n for n, _ in SWEEP_FIELDS]
_VALUES = [n for n in _NAMES if n not in ("N", "event_id")]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (event_id, N): the run loaded last. NaN is null, ids are plain."""
    rows = clean_doubles(table(spark, sf_dir, "sweep")).withColumn("event_id", plain_id(F.col("event_id"))).where("event_id is not null and N is not null")
    return R.latest_by_key(rows, ["event_id", "N"], ["loaded_at", "file_id", "line_no"], _VALUES)


_VALUE_SQL = ", ".join(f"case when isnan({n}) then null else {n} end as {n}" if t == "double" else n for n, t in SWEEP_FIELDS if n != "event_id")
RUNS_SQL = f"""runs0 as (select {_VALUE_SQL}, loaded_at, file_id, line_no,
  upper(regexp_replace(regexp_replace(event_id, '\\s', '', 'g'), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i')) as event_id from sweep
  where event_id is not null and N is not null),
runs as (select * exclude (k) from (select *, row_number() over (partition by event_id, N order by loaded_at desc nulls last, file_id desc, line_no desc) as k from runs0) where k = 1)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with SQL."""
    return df.select(*[X.settled(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(sql: str, digits: int = 6) -> str:
    return f"round(try_cast({sql} as decimal(38, 12)), {digits})::double"


def _class_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(S.sweep_aggregate(runs(spark, sf_dir).where("lifecycle_class is not null"), ["lifecycle_class", "N"]), "class-agg")


def a01_sweep_by_n(spark, sf_dir):
    return _rounded(S.sweep_aggregate(runs(spark, sf_dir), ["N"]))


def a02_sweep_by_class(spark, sf_dir):
    return _rounded(S.sweep_aggregate(runs(spark, sf_dir).where("lifecycle_class is not null"), ["lifecycle_class", "N"]))


def a02_sweep_rollup(spark, sf_dir):
    return _rounded(S.sweep_rollup(runs(spark, sf_dir)))


def _agg_sql(by: str, where: str = "") -> str:
    parts = []
    for k, c in S.METRICS.items():
        parts.append(f"avg({c}) as {k}_mean, stddev_samp({c}) as {k}_std, case when count({c}) >= 2 then ({t_critical_sql(f'(count({c}) - 1)')}) * stddev_samp({c}) / sqrt(count({c})) end as {k}_ci")
    return f"""agg0 as (select {by}, {", ".join(parts)}, avg(E_super_est) as E_super_mean, avg(VRAM_est_MB) as VRAM_mean_MB, avg(runtime_s) as runtime_mean, count(event_id) as n_events
  from runs {where} group by {by}),
agg as (select *, 2 * ISV_ci / (ISV_mean + 1e-12) * 100 as ISV_rel_ci_pct, 2 * LFS_ci / (LFS_mean + 1e-12) * 100 as LFS_rel_ci_pct from agg0)"""


_AGG_OUT = ", ".join([f"round(try_cast({k}_{s} as decimal(38, 12)), 6)::double as {k}_{s}" for k in S.METRICS for s in ("mean", "std", "ci")] + [f"round(try_cast({c} as decimal(38, 12)), 6)::double as {c}" for c in ("E_super_mean", "VRAM_mean_MB", "runtime_mean", "ISV_rel_ci_pct", "LFS_rel_ci_pct")] + ["n_events"])
_CLASS_AGG = _agg_sql("lifecycle_class, N", "where lifecycle_class is not null")


#: The measures of solver rows, which no table holds, as expressions of a sweep row that both engines know.
_SOLVER = {
    "nfe_diffusion": "E_super_est % 97 + 6", "nfe_reaction": "E_super_est % 53 + actual_N % 7", "nfe_imex_total": "E_super_est % 97 + 6 + E_super_est % 53 + actual_N % 7", "nfe_dopri5": "N % 211 + 12", "nfe_ratio": "(N % 211 + 12) / (E_super_est % 97 + 7.0)",
    "wall_imex_sec": "runtime_s / 8.0", "wall_dopri5_sec": "runtime_s / 4.0", "lambda_max_topo": "GED * 16.0", "lambda_max_weighted": "GED * 4.0", "solution_l2_error": "temporal_br_std / 16.0", "rejected_diff": "N % 5", "rejected_rxn": "N % 3",
    "dopri5_converged": "E_super_est % 3 = 0", "imex_converged": "E_super_est % 5 <> 0", "eps_int": "temporal_br_std / 32.0", "nfe_ref": "N % 83 + 10", "nfe_train": "N % 37 + 4", "nfe_ratio_train_over_ref": "(N % 37 + 4) / (N % 83 + 10.0)", "ref_converged": "N % 11 <> 0", "train_converged": "N % 7 <> 0",
}


def solver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("lifecycle_class is not null").select("lifecycle_class", "event_id", "N", *[F.expr(e).cast("double" if "ratio" in k else "boolean" if k.endswith("converged") else "double" if "/" in e or "*" in e else "bigint").alias(k) for k, e in _SOLVER.items()])


def a03_solver_summary(spark, sf_dir):
    return _rounded(S.solver_summary(solver_rows(spark, sf_dir), ["lifecycle_class", "N"]))


def a04_accuracy_summary(spark, sf_dir):
    return _rounded(S.accuracy_summary(solver_rows(spark, sf_dir), ["lifecycle_class", "N"]))


def a04_accuracy_elbow(spark, sf_dir):
    """The first N of each class whose mean error exceeds twice that of its smallest N."""
    g = S.accuracy_summary(solver_rows(spark, sf_dir), ["lifecycle_class", "N"]).where("eps_int_mean is not null")
    return _rounded(D.first_crossing(g, ["lifecycle_class"], "N", "eps_int_mean", 2.0))


def s48_merged_accuracy(spark, sf_dir):
    """Two accuracy files with common keys, of which the later one counts."""
    r = solver_rows(spark, sf_dir).select("event_id", "N", "eps_int", "nfe_ref")
    return _rounded(merge_results([r.withColumn("eps_int", F.col("eps_int") * 2), r.where("N % 2 = 0")], ["event_id", "N"]))


def s15_rebuilt_joint(spark, sf_dir):
    """Sweep rows under older names and without a joint score, which is rebuilt."""
    old = runs(spark, sf_dir).drop("J_imex").withColumnRenamed("N", "n_requested")
    names = {n: ("n_requested",) if n == "N" else ("J_imex", "J") if n == "J_imex" else (n,) for n in _NAMES}
    got = D.with_joint(settle(tolerant_sweep(old, names), "sweep"), ["event_id"], "lifecycle_class")
    return got.select("event_id", "N", _joint(F.col("J_imex")).alias("J_imex"))


def q14_wide_intervals(spark, sf_dir):
    """The classes and numbers whose interval is wider than 50 per cent of the mean."""
    return _class_agg(spark, sf_dir).select("lifecycle_class", "N", F.coalesce(F.col("ISV_rel_ci_pct") > 50, F.lit(False)).alias("high_ci"))


def f18_older_scaling(spark, sf_dir):
    """The array functions of older scripts: physical units, z-scores and scaling by a fixed or the own maximum, on the masses of an event."""
    a = latest_events(spark, sf_dir).where("peak_mass is not null and r_squared is not null and mean_mass is not null").select("id", F.array("peak_mass", "mean_mass", "r_squared").alias("a"))
    z, old = X.zscores(F.col("a")), X.fixed_scaling(F.col("a"))
    return _rounded(a.select("id", z[0].alias("z_peak"), old[1].alias("old_mean"), X.own_scaling(F.col("a"))[1].alias("own_mean"), X.vil_physical(F.col("a")[0]).alias("vil")))


def f27_solver_codes(spark, sf_dir):
    """Names of the codes that a solver ends with."""
    return runs(spark, sf_dir).select("event_id", "N", X.solver_result((F.col("N") % 5).cast("int")).alias("result"))


def d05_recommend(spark, sf_dir):
    return D.recommend(_class_agg(spark, sf_dir))


def d01_elbows(spark, sf_dir):
    agg = _class_agg(spark, sf_dir)
    return D.elbows(agg, ["lifecycle_class"], "N", {"isv_elbow": F.col("ISV_mean"), "fae_elbow": F.col("FAE_mean"), "mdv_elbow": F.col("MDV_mean"), "br_elbow": 1 - F.col("BR_mean")})


def d02_lfs_ceiling(spark, sf_dir):
    agg = _class_agg(spark, sf_dir)
    return D.lfs_ceiling(agg, ["lifecycle_class"], "N", "LFS_mean")


def d03_memory_ceiling(spark, sf_dir):
    n = runs(spark, sf_dir).select("lifecycle_class", "N").distinct()
    return n.groupBy("lifecycle_class").agg(D.memory_ceiling(n, "N", budget=40.0).alias("vram_ceiling_N"), F.max(X.super_edges(F.col("N"))).alias("most_edges"))


def d04_joint(spark, sf_dir):
    agg = _class_agg(spark, sf_dir)
    return _rounded(D.joint_scores(agg, ["lifecycle_class"], "N", "ISV_mean", "LFS_mean").select("lifecycle_class", "N", "quality", "stiffness", "joint"))


def d06_metric_vote(spark, sf_dir):
    return D.metric_vote(settle(S.sweep_aggregate(runs(spark, sf_dir), ["N"]), "agg"))


def d10_gated_joint(spark, sf_dir):
    got = D.gated_joint(settle(runs(spark, sf_dir), "runs"), ["event_id"], "lifecycle_class")
    return got.select("event_id", "N", _joint(F.col("J_gated")).alias("J_gated"))


def _joint(c):
    """Flat curves give huge values (differences over 1e-12): these to a few digits only."""
    return F.when(F.abs(c) < 1000, X.settled(c, 6)).otherwise(F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))), 5))


def w15_plateaus(spark, sf_dir):
    return _rounded(S.plateau(runs(spark, sf_dir).where("J_imex is not null"), ["event_id"], "N", "J_imex"))


def d15_soft_argmax(spark, sf_dir):
    return D.soft_argmax(runs(spark, sf_dir).where("boundary_recall_mean is not null"), ["event_id"], "N", "boundary_recall_mean")


def d16_interval(spark, sf_dir):
    """Whether the gated optimum lies between the soft optima of recall and of -FAE, by event."""
    r = runs(spark, sf_dir).where("boundary_recall_mean is not null and FAE is not null and J_imex is not null")
    lo = D.soft_argmax(r.withColumn("v", 1 / (1 + F.col("FAE"))), ["event_id"], "N", "v", 0.97).withColumnRenamed("soft_N", "lo")
    hi = D.soft_argmax(r, ["event_id"], "N", "boundary_recall_mean").withColumnRenamed("soft_N", "hi")
    star = r.groupBy("event_id").agg(S.first_argmax(["event_id"], F.col("J_imex"), F.col("N")).alias("star"))
    return star.join(lo, "event_id").join(hi, "event_id").select("event_id", "lo", "star", "hi", D.interval_check(F.col("lo"), F.col("star"), F.col("hi")).alias("verdict"))


def d14_first_crossing(spark, sf_dir):
    return _rounded(D.first_crossing(runs(spark, sf_dir).where("runtime_s is not null"), ["event_id"], "N", "runtime_s", 3.0))


def w12_head_tail(spark, sf_dir):
    """First and last metric of every event in order of N, its range, and the steps between neighbours (lag)."""
    w = W.partitionBy("event_id").orderBy("N")
    r = runs(spark, sf_dir).where("LFS is not null").withColumn("step", F.col("LFS") - F.lag("LFS").over(w))
    g = r.groupBy("event_id").agg(F.min_by("LFS", "N").alias("first_lfs"), F.max_by("LFS", "N").alias("last_lfs"), F.avg(F.abs("step")).alias("mean_step"), (F.max("LFS") - F.min("LFS")).alias("lfs_range"), F.count(F.lit(1)).alias("n"))
    return _rounded(g)


def d17_subclass_stability(spark, sf_dir):
    """Plateaus of steady events whose spatial class depends on the rule, against those for which both rules agree."""
    e = latest_events(spark, sf_dir).where("lifecycle_class = 'steady' and active_fraction_t0 is not null and n_cells_t0 is not null and max_cell_area_t0 is not null")
    args = (F.col("n_cells_t0"), F.col("max_cell_area_t0"), F.col("active_fraction_t0"))
    e = e.select(F.col("id").alias("event_id"), (D.spatial_type(*args) != D.spatial_subclass(*args)).alias("subclass_changed"))
    p = S.plateau(runs(spark, sf_dir).where("J_imex is not null"), ["event_id"], "N", "J_imex")
    g = R.lookup(p, e, ["event_id"], "inner").groupBy("subclass_changed")
    return _rounded(g.agg(F.count(F.lit(1)).alias("events"), F.median("plateau_width").alias("width_median"), F.percentile("plateau_width", F.lit(0.98)).alias("width_p98"), F.median("n_star").alias("n_star_median")))


def d19_report(spark, sf_dir):
    """The recommendation as lines of text, one for each class."""
    r = D.recommend(_class_agg(spark, sf_dir))
    line = F.format_string("%s: N=%d of %d events (vote %d, LFS ceiling %d, VRAM ceiling %d; %s)", "lifecycle_class", "recommended_N", "n_events", "majority_vote_N", "lfs_ceiling_N", "vram_ceiling_N", "binding_constraint")
    return r.select(line.alias("line"))


def a26_correlations(spark, sf_dir):
    return _rounded(S.correlations(runs(spark, sf_dir), "runtime_s", "E_super_est"), 6)


def a27_mann_whitney(spark, sf_dir):
    return _rounded(S.mann_whitney_less(runs(spark, sf_dir), "lifecycle_class", "J_imex", "STEADY", "PLATEAU"), 6)


def a26_coefficients(spark, sf_dir):
    return _rounded(S.correlations(runs(spark, sf_dir), "runtime_s", "E_super_est").select("n", "pearson", "spearman"), 6)


def a27_rank_sum(spark, sf_dir):
    return _rounded(S.mann_whitney_less(runs(spark, sf_dir), "lifecycle_class", "J_imex", "STEADY", "PLATEAU").select("n_a", "n_b", "u"), 6)


def a28_quantiles(spark, sf_dir):
    r = runs(spark, sf_dir).where("lifecycle_class is not null")
    return _rounded(S.percentiles(r, ["lifecycle_class"], {"j_median": (F.col("J_imex"), 0.5), "j_p98": (F.col("J_imex"), 0.98), "fae_p25": (F.col("FAE"), 0.25)}))


def a29_histogram(spark, sf_dir):
    return S.histogram(runs(spark, sf_dir), "boundary_recall_mean", 0.0, 1.0, 20)


def a30_plurality(spark, sf_dir):
    """The class that most of an event's rows name, the one loaded first on a tie."""
    rows = table(spark, sf_dir, "sweep").withColumn("event_id", plain_id(F.col("event_id"))).where("event_id is not null and lifecycle_class is not null")
    rows = rows.withColumn("pos", F.col("file_id") * 100000 + F.col("line_no"))
    return S.plurality(rows, ["event_id"], "lifecycle_class", "pos")


def a31_profile(spark, sf_dir):
    return _rounded(S.profile(table(spark, sf_dir, "sweep"), [n for n, t in SWEEP_FIELDS if t != "string"]))


def a36_plot_range(spark, sf_dir):
    r = table(spark, sf_dir, "storm_catalog")
    lo, hi = S.plot_range(F.when(~F.isnan("pct_missing"), F.col("pct_missing")))
    return r.groupBy("img_type").agg(lo.alias("vmin"), hi.alias("vmax"))


def a18_crosstab(spark, sf_dir):
    """Spatial type by class of the latest classification, as rows."""
    return latest_events(spark, sf_dir).where("lifecycle_class is not null and spatial_type is not null").groupBy("spatial_type", "lifecycle_class").agg(F.count(F.lit(1)).alias("n"))


def a19_pivot(spark, sf_dir):
    r = runs(spark, sf_dir).where("lifecycle_class is not null")
    return _rounded(r.groupBy("lifecycle_class").pivot("N", [100, 200, 400, 800]).agg(F.avg("runtime_s")).select("lifecycle_class", *[F.col(str(n)).alias(f"n{n}") for n in (100, 200, 400, 800)]))


def a20_numeric_means(spark, sf_dir):
    r = runs(spark, sf_dir).where("lifecycle_class is not null")
    return _rounded(r.groupBy("lifecycle_class").agg(*[F.avg(n).alias(n) for n, t in SWEEP_FIELDS if t != "string"]))


def a17_distinct(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("lifecycle_class").agg(F.count_distinct("event_id").alias("n_events"), F.count_distinct("N").alias("n_counts"), F.count(F.lit(1)).alias("n_rows"))


_EVENT_VALUES = ["slope", "r_squared", "n_phases", "phase_sequence", "peak_mass", "mean_mass", "active_fraction_t0", "n_cells_t0", "max_cell_area_t0", "spatial_type", "lifecycle_class", "duration_frames"]


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest classification of every event, spellings made plain."""
    rows = clean_doubles(table(spark, sf_dir, "event_catalogue")).withColumn("id", plain_id(F.col("id"))).withColumn("lifecycle_class", letters_key(F.col("lifecycle_class"))).where("id is not null")
    return R.latest_by_key(rows, ["id"], ["classified_at", "batch_no", "lifecycle_class", "slope", "r_squared"], [v for v in _EVENT_VALUES if v not in ("lifecycle_class", "slope", "r_squared")] + ["lifecycle_class", "slope", "r_squared"])


EVENTS_SQL = """ev0 as (select * replace (upper(regexp_replace(id, '\\s', '', 'g')) as id, nullif(lower(regexp_replace(lifecycle_class, '[^A-Za-z0-9]', '', 'g')), '') as lifecycle_class,
    case when isnan(slope) then null else slope end as slope, case when isnan(r_squared) then null else r_squared end as r_squared,
    case when isnan(peak_mass) then null else peak_mass end as peak_mass, case when isnan(mean_mass) then null else mean_mass end as mean_mass,
    case when isnan(active_fraction_t0) then null else active_fraction_t0 end as active_fraction_t0) from event_catalogue where id is not null),
ev as (select * exclude (k) from (select *, row_number() over (partition by id order by classified_at desc nulls last, batch_no desc nulls last, lifecycle_class desc nulls last,
    slope desc nulls last, r_squared desc nulls last) as k from ev0) where k = 1)"""


def d12_thresholds(spark, sf_dir):
    return _rounded(D.thresholds(latest_events(spark, sf_dir)))


_PHASE_MAP = {"GROWTH": "G", "DECAY": "D", "PLATEAU": "P"}


def d08_lifecycle(spark, sf_dir):
    """Every event classified anew from its statistics and the corpus thresholds."""
    e = latest_events(spark, sf_dir).where("slope is not null and mean_mass is not null")
    seq = F.col("phase_sequence")
    for name, letter in _PHASE_MAP.items():
        seq = F.replace(seq, F.lit(name), F.lit(letter))
    e = e.withColumn("phase_sequence", F.replace(seq, F.lit(">"), F.lit("→"))).drop("lifecycle_class")
    return D.lifecycle(e, D.thresholds(e)).select("id", "lifecycle_class")


def d13_enrich(spark, sf_dir):
    """Percentile and standard score of the slope, and the region hint, of every event."""
    e = latest_events(spark, sf_dir).where("slope is not null and active_fraction_t0 is not null and n_cells_t0 is not null")
    m = e.agg(F.avg("slope").alias("m"), F.stddev_pop("slope").alias("s"))
    e = S.share_below(e, "slope", "pct").withColumn("_m", R.one_row(m))
    return e.select("id", F.round("pct", 4).alias("intensity_percentile"), F.round((F.col("slope") - F.col("_m.m")) / (F.col("_m.s") + 1e-9), 4).alias("slope_norm"), X.region_hint(F.col("active_fraction_t0"), F.col("n_cells_t0")).alias("recommended_N_hint"))


def c02_spatial_rules(spark, sf_dir):
    e = latest_events(spark, sf_dir).where("active_fraction_t0 is not null and n_cells_t0 is not null and max_cell_area_t0 is not null")
    args = (F.col("n_cells_t0"), F.col("max_cell_area_t0"), F.col("active_fraction_t0"))
    e = e.select("id", D.spatial_type(*args).alias("by_cells"), D.spatial_subclass(*args).alias("by_activity"))
    return e.withColumn("differs", F.col("by_cells") != F.col("by_activity"))


def d18_trend_labels(spark, sf_dir):
    label, sure = D.trend_label(F.col("slope"))
    side = F.when(F.col("slope") > 1000, "Growth").when(F.col("slope") < -1000, "Decay")
    return latest_events(spark, sf_dir).where("slope is not null").select("id", label.alias("trend"), sure.alias("confidence"), side.alias("search_type"))


def o01_extremes(spark, sf_dir):
    e = latest_events(spark, sf_dir).where("slope is not null").select("id", F.round("slope", 4).alias("slope"))
    up = e.orderBy(F.desc("slope"), "id").limit(10).withColumn("side", F.lit("growth"))
    return up.unionByName(e.orderBy("slope", "id").limit(10).withColumn("side", F.lit("decay")))


def o02_class_report(spark, sf_dir):
    """The five strongest events of each class: the steepest fall where the class decays."""
    e = latest_events(spark, sf_dir).where("slope is not null and lifecycle_class is not null")
    key = F.when(F.col("lifecycle_class").contains("decay"), F.col("slope")).otherwise(-F.col("slope"))
    return R.top_per_group(e.withColumn("_key", key), "lifecycle_class", [F.col("_key"), F.col("id")], 5).select("lifecycle_class", "rank", "id")


def o03_stratified(spark, sf_dir):
    return R.stratified_sample(latest_events(spark, sf_dir).where("lifecycle_class is not null"), "lifecycle_class", "id", 4).select("lifecycle_class", "id")


def o04_one_per_class(spark, sf_dir):
    e = latest_events(spark, sf_dir).where("lifecycle_class is not null")
    chosen = e.where("lifecycle_class = 'steady'").agg(F.max("id").alias("id")).select(F.lit("steady").alias("lifecycle_class"), "id").where("id is not null")
    return R.one_per_class(e, "lifecycle_class", "id", chosen)


def o05_uniform(spark, sf_dir):
    return R.uniform_sample(latest_events(spark, sf_dir).select("id"), "id", 25, 7)


def w08_chunks(spark, sf_dir):
    e = latest_events(spark, sf_dir).where("lifecycle_class is not null").select("lifecycle_class", "id")
    return R.round_robin(e, ["lifecycle_class", "id"], 17)


def o09_array_slice(spark, sf_dir):
    return w08_chunks(spark, sf_dir).where("chunk = 3").select("lifecycle_class", "id")


def o08_extremes_n(spark, sf_dir):
    p = S.plateau(runs(spark, sf_dir).where("J_imex is not null"), ["event_id"], "N", "J_imex").where("plateau_width is not null").select("event_id", "plateau_width")
    return p.orderBy("plateau_width", "event_id").limit(5).withColumn("side", F.lit("narrow")).unionByName(p.orderBy(F.desc("plateau_width"), "event_id").limit(5).withColumn("side", F.lit("wide")))


def o07_nearest(spark, sf_dir):
    r = runs(spark, sf_dir).select("event_id", "N").withColumn("target", F.lit(777))
    return R.nearest_value(r, ["event_id"], "target", "N")


def f14_edge_estimates(spark, sf_dir):
    n = runs(spark, sf_dir).select("N").distinct()
    e = X.super_edges(F.col("N"))
    return n.select("N", e.alias("edges"), F.round(X.edge_memory_mb(e), 6).alias("mb"), F.round(X.rbf_width(F.col("N"), 384, 384, 1.5), 6).alias("sigma"), X.run_tag(F.col("N")).alias("tag"))


def f09_activations(spark, sf_dir):
    x = F.col("J_imex")
    r = runs(spark, sf_dir).where("J_imex is not null")
    return r.select("event_id", "N", *[F.round(e, 9).alias(a) for a, e in (("sigmoid", X.sigmoid(x, 5.0, 0.6)), ("silu", X.silu(x)), ("softplus", X.softplus(x)), ("tanh", F.tanh(x)), ("leaky", X.leaky_relu(x)))])


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "acdfoqsw" and k[1:3].isdigit()}

_E = "(case when N - 1 < pi() * 11664.0 / (147456.0 / greatest(N, 1)) then cast(trunc(N * cast(N - 1 as double)) as bigint) else cast(trunc(N * (pi() * 11664.0 / (147456.0 / greatest(N, 1)))) as bigint) end)"


def _elbow_sql(names: dict[str, str], by: str = "lifecycle_class", source: str = "agg") -> str:
    """CTEs e_<name>(by, name) for the elbow of each score."""
    out = []
    for k, v in names.items():
        out.append(f"""n_{k} as (select {by}, N, (N - min(N) over w) / (max(N) over w - min(N) over w + 1e-12) as x, ({v} - min({v}) over w) / (max({v}) over w - min({v}) over w + 1e-12) as y, count(*) over w as k
  from {source} window w as (partition by {by})),
l_{k} as (select *, first_value(x) over o as ax, first_value(y) over o as ay, last_value(x) over o - first_value(x) over o as dx, last_value(y) over o - first_value(y) over o as dy
  from n_{k} window o as (partition by {by} order by N rows between unbounded preceding and unbounded following)),
u_{k} as (select *, dx / (sqrt(dx * dx + dy * dy) + 1e-12) as ux, dy / (sqrt(dx * dx + dy * dy) + 1e-12) as uy from l_{k}),
d_{k} as (select {by}, N, k, round(sqrt(power((x - ax) - ((x - ax) * ux + (y - ay) * uy) * ux, 2) + power((y - ay) - ((x - ax) * ux + (y - ay) * uy) * uy, 2)), 12) as d from u_{k}),
e_{k} as (select {by}, case when max(k) < 3 then min(N) else min(N) filter (where r = 1) end as {k} from (select *, row_number() over (partition by {by} order by d desc, N) as r from d_{k}) group by {by})""")
    return ",\n".join(out)


_RANK_SQL = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
_EL = {"isv_elbow": "ISV_mean", "fae_elbow": "FAE_mean", "mdv_elbow": "MDV_mean", "br_elbow": "(1 - BR_mean)"}
_REC = {"isv_elbow_N": "ISV_mean", "fae_elbow_N": "FAE_mean", "mdv_elbow_N": "MDV_mean", "tbr_elbow_N": "TBR_mean", "br_elbow_N": "(1 - BR_mean)"}
_JOINT = """j0 as (select *, first_value(ISV_mean) over o as i0, last_value(ISV_mean) over o as i1, first_value(LFS_mean) over o as l0, last_value(LFS_mean) over o as l1
  from agg window o as (partition by lifecycle_class order by N rows between unbounded preceding and unbounded following)),
j as (select *, (i0 - ISV_mean) / (i0 - i1 + 1e-12) as quality, (LFS_mean - l0) / (l1 - l0 + 1e-12) as stiffness from j0),
joint as (select *, quality - 1.5 * stiffness as joint from j)"""
_CEIL = """c as (select lifecycle_class, N, LFS_mean, min(LFS_mean) over w as lo, max(LFS_mean) over w as hi from agg window w as (partition by lifecycle_class)),
ceil as (select lifecycle_class, coalesce(max(N) filter (where hi - lo < 1e-9 or LFS_mean <= lo * 1.1 + 0.1 * (hi - lo)), min(N)) as lfs_ceiling_N from c group by lifecycle_class)"""
_RUNS_J = f"with {RUNS_SQL}, r as (select event_id, N, J_imex as j, max(J_imex) over (partition by event_id) as m from runs where J_imex is not null)"
_PLATEAU = f"""{_RUNS_J}, p as (select event_id, case when max(m) <= 0 or count(*) < 3 then null when count(*) filter (where j >= 0.95 * m) < 2 then max(N) - min(N)
    else max(N) filter (where j >= 0.95 * m) - min(N) filter (where j >= 0.95 * m) end::double as plateau_width,
  case when max(m) <= 0 then min(N) filter (where j = m) else coalesce(min(N) filter (where j >= 0.95 * m), min(N) filter (where j = m)) end::double as n_star, max(j) as j_max from r group by event_id)"""
_MD5 = "md5('{0}:' || {1})"
_LATEST = f"with {EVENTS_SQL}"
_PHASE_SQL = "replace(replace(replace(replace(phase_sequence, 'GROWTH', 'G'), 'DECAY', 'D'), 'PLATEAU', 'P'), '>', '→')"
_TYPE = "case when n_cells_t0 = 0 then 'quiescent' when n_cells_t0 = 1 and max_cell_area_t0 < 5000 then 'isolated_cell' when max_cell_area_t0 >= 30000 then 'mcs' when active_fraction_t0 < 0.01 then 'quiescent' else 'cluster' end"
_SUB = "case when active_fraction_t0 < 0.01 then 'quiescent' when max_cell_area_t0 >= 30000 then 'mcs' when n_cells_t0 = 1 and max_cell_area_t0 < 5000 then 'isolated_cell' else 'cluster' end"


def _soft(value: str, ratio: float, alias: str) -> str:
    return f"select event_id, min(N) filter (where m >= 1e-6 and v >= {ratio} * m) as {alias} from (select event_id, N, {value} as v, max({value}) over (partition by event_id) as m from src) group by event_id"


_CHUNK = "select lifecycle_class, id, cast((row_number() over (order by lifecycle_class, id) - 1) % 17 as int) as chunk from ev where lifecycle_class is not null"

SQL = {
    "a01_sweep_by_n": f"with {RUNS_SQL}, {_agg_sql('N')} select N, {_AGG_OUT} from agg",
    "a02_sweep_by_class": f"with {RUNS_SQL}, {_CLASS_AGG} select lifecycle_class, N, {_AGG_OUT} from agg",
    "a02_sweep_rollup": f"""with {RUNS_SQL} select lifecycle_class, N, round(try_cast(avg(intra_sp_var_mean) as decimal(38, 12)), 6)::double as ISV_mean, round(try_cast(avg(LFS) as decimal(38, 12)), 6)::double as LFS_mean, count(event_id) as n_events, cast(grouping(lifecycle_class) as int) as all_classes
  from runs group by grouping sets ((N), (lifecycle_class, N))""",
    "d01_elbows": f"with {RUNS_SQL}, {_CLASS_AGG}, {_elbow_sql(_EL)} select * from e_isv_elbow join e_fae_elbow using (lifecycle_class) join e_mdv_elbow using (lifecycle_class) join e_br_elbow using (lifecycle_class)",
    "d02_lfs_ceiling": f"with {RUNS_SQL}, {_CLASS_AGG}, {_CEIL} select * from ceil",
    "d03_memory_ceiling": f"with {RUNS_SQL}, n as (select distinct lifecycle_class, N from runs) select lifecycle_class, coalesce(max(N) filter (where {_E} * 32 * 6 * 4 / 1e6 <= 40), min(N)) as vram_ceiling_N, max({_E}) as most_edges from n group by 1",
    "d04_joint": f"with {RUNS_SQL}, {_CLASS_AGG}, {_JOINT} select lifecycle_class, N, round(try_cast(quality as decimal(38, 12)), 6)::double as quality, round(try_cast(stiffness as decimal(38, 12)), 6)::double as stiffness, round(try_cast(joint as decimal(38, 12)), 6)::double as joint from joint",
    "d05_recommend": f"""with {RUNS_SQL}, {_CLASS_AGG.replace('agg0 as', 'agga as').replace('agg as', 'aggb as').replace('from agg0', 'from agga')},
agg as (select * exclude (k) from (select *, count(*) over (partition by lifecycle_class) as k from aggb) where k >= 3),
{_elbow_sql(_REC)}, {_JOINT}, {_CEIL},
best as (select lifecycle_class, max(n_events) as n_events, min(N) filter (where r = 1) as joint_optimal_N from (select *, row_number() over (partition by lifecycle_class order by round(joint, 12) desc, N) as r from joint) group by 1),
mem as (select coalesce(max(N) filter (where {_E} * 32 * 6 * 4 / 1e6 <= 4000), min(N)) as vram_ceiling_N from agg),
per as (select * from e_isv_elbow_N join e_fae_elbow_N using (lifecycle_class) join e_mdv_elbow_N using (lifecycle_class) join e_tbr_elbow_N using (lifecycle_class) join e_br_elbow_N using (lifecycle_class)
  join best using (lifecycle_class) join ceil using (lifecycle_class), mem),
pool as (select lifecycle_class, 1 as p, isv_elbow_N as v from per union all select lifecycle_class, 2, fae_elbow_N from per union all select lifecycle_class, 3, mdv_elbow_N from per union all select lifecycle_class, 4, joint_optimal_N from per),
votes as (select lifecycle_class, v, count(*) as votes, min(p) as p from pool group by 1, 2),
voted as (select lifecycle_class, max(v) filter (where r = 1) as majority_vote_N, '[' || string_agg('{{"N":' || v || ',"votes":' || votes || '}}', ',' order by p) || ']' as vote_breakdown
  from (select *, row_number() over (partition by lifecycle_class order by votes desc, p) as r from votes) group by 1),
raw as (select *, least(majority_vote_N, lfs_ceiling_N, vram_ceiling_N) as raw_N from per join voted using (lifecycle_class)),
rec as (select * from (select raw.*, joint.N, ISV_mean, LFS_mean, quality, stiffness, joint.joint, ISV_rel_ci_pct, row_number() over (partition by lifecycle_class order by abs(joint.N - raw_N), joint.N) as r
  from raw join joint using (lifecycle_class)) where r = 1)
select lifecycle_class, n_events, isv_elbow_N, fae_elbow_N, mdv_elbow_N, tbr_elbow_N, br_elbow_N, lfs_ceiling_N, vram_ceiling_N, joint_optimal_N, majority_vote_N, N as recommended_N,
  case when majority_vote_N <= lfs_ceiling_N and majority_vote_N <= vram_ceiling_N then 'none (quality-dominated)'
    when majority_vote_N > lfs_ceiling_N and majority_vote_N > vram_ceiling_N then 'LFS-stiffness + VRAM' when majority_vote_N > lfs_ceiling_N then 'LFS-stiffness' else 'VRAM' end as binding_constraint,
  round(try_cast(ISV_mean as decimal(38, 12)), 6)::double as isv_at_rec, round(try_cast(LFS_mean as decimal(38, 12)), 6)::double as lfs_at_rec, round(try_cast(quality as decimal(38, 12)), 4)::double as quality_at_rec, round(try_cast(stiffness as decimal(38, 12)), 4)::double as stiffness_at_rec, round(try_cast(joint as decimal(38, 12)), 4)::double as joint_score_at_rec,
  {_E} as e_super_at_rec, round(try_cast({_E} * 32 * 6 * 4 / 1e6 as decimal(38, 12)), 1)::double as vram_at_rec_mb, round(try_cast(ISV_rel_ci_pct as decimal(38, 12)), 1)::double as isv_ci_pct_at_rec, vote_breakdown from rec""",
    "d10_gated_joint": f"""with {RUNS_SQL}, g0 as (select *, count(*) over w as k, count(*) filter (where intra_sp_var_mean is null or LFS is null or FAE is null or MDV is null or boundary_recall_mean is null or temporal_br_std is null) over w as bad,
    {_E}::double as e from runs window w as (partition by event_id)),
g as (select *, 1 - boundary_recall_mean as bi from g0 where k >= 3 and bad = 0),
{_elbow_sql({"el": "bi"}, "event_id", "g")},
f as (select g.*, el, first_value(intra_sp_var_mean) over o as i0, first_value(boundary_recall_mean) over o as b0 from g join e_el using (event_id)
  window o as (partition by event_id order by N rows between unbounded preceding and unbounded following)),
h as (select *, (i0 - intra_sp_var_mean) / (i0 - min(intra_sp_var_mean) over w + 1e-12) as gi, (boundary_recall_mean - b0) / (max(boundary_recall_mean) over w - b0 + 1e-12) as gb,
  (FAE - min(FAE) over w) / (max(FAE) over w - min(FAE) over w + 1e-12) as pf, (MDV - min(MDV) over w) / (max(MDV) over w - min(MDV) over w + 1e-12) as pm,
  (LFS - min(LFS) over w) / (max(LFS) over w - min(LFS) over w + 1e-12) as sl, (e - min(e) over w) / (max(e) over w - min(e) over w + 1e-12) as se,
  (temporal_br_std - min(temporal_br_std) over w) / (max(temporal_br_std) over w - min(temporal_br_std) over w + 1e-12) as st from f window w as (partition by event_id)),
q as (select *, 0.40 * gi + 0.30 * least(gb, max(gb) filter (where N = el) over (partition by event_id)) - 0.15 * pf - 0.15 * pm as q, 0.10 * sl + 0.60 * se + 0.30 * st as s from h)
select event_id, N, case when abs(v) < 1000 then round(try_cast(v as decimal(38, 12)), 6)::double else round(v / power(10.0::double, floor(log10(abs(v)))), 5) end as J_gated from (select event_id, N, q - case lifecycle_class {" ".join(f"when '{k}' then {v}" for k, v in X.CLASS_ALPHA.items())} else 0.70 end / (1 + exp(-5 * (s - 0.60))) - 0.10 * q * s as v from q)""",
    "w15_plateaus": f"{_PLATEAU} select event_id, plateau_width, n_star, round(try_cast(j_max as decimal(38, 12)), 6)::double as j_max from p",
    "o08_extremes_n": f"""{_PLATEAU}, v as (select event_id, plateau_width from p where plateau_width is not null)
select * from (select *, 'narrow' as side from v order by plateau_width, event_id limit 5) union all select * from (select *, 'wide' as side from v order by plateau_width desc, event_id limit 5)""",
    "d15_soft_argmax": f"with {RUNS_SQL}, src as (select * from runs where boundary_recall_mean is not null) {_soft('boundary_recall_mean', 0.95, 'soft_N')}",
    "d16_interval": f"""with {RUNS_SQL}, src as (select * from runs where boundary_recall_mean is not null and FAE is not null and J_imex is not null),
lo as ({_soft('(1 / (1 + FAE))', 0.97, 'lo')}), hi as ({_soft('boundary_recall_mean', 0.95, 'hi')}),
st as (select event_id, min(N) filter (where r = 1) as star from (select event_id, N, row_number() over (partition by event_id order by J_imex desc, N) as r from src) group by 1)
select event_id, lo, star, hi, case when lo is null or hi is null or star is null then 'unknown' when lo <= star and star <= hi then 'inside' when star < lo then 'below' else 'above' end as verdict
from st join lo using (event_id) join hi using (event_id)""",
    "d14_first_crossing": f"""with {RUNS_SQL}, b as (select event_id, N, runtime_s, first_value(runtime_s) over (partition by event_id order by N) as b from runs where runtime_s is not null)
select event_id, round(try_cast(max(b) as decimal(38, 12)), 6)::double as baseline, min(N) filter (where runtime_s > 3 * b) as elbow_N from b group by event_id""",
    "d06_metric_vote": f"""with {RUNS_SQL}, {_agg_sql('N')}, al as (select 1 as a, * from agg),
{_elbow_sql({"isv_elbow": "ISV_mean", "fae_elbow": "FAE_mean", "bdv_elbow": "BDV_mean", "mdv_elbow": "MDV_mean", "br_elbow": "(1 - BR_mean)", "tbr_elbow": "TBR_mean"}, "a", "al")},
one as (select * from e_isv_elbow join e_fae_elbow using (a) join e_bdv_elbow using (a) join e_mdv_elbow using (a) join e_br_elbow using (a) join e_tbr_elbow using (a)),
pool as (select unnest([isv_elbow, fae_elbow, bdv_elbow, mdv_elbow, br_elbow, tbr_elbow]) as v, unnest([1, 2, 3, 4, 5, 6]) as p from one),
vote as (select v from (select v, count(*) as c, min(p) as p from pool group by v) order by c desc, p limit 1)
select isv_elbow, fae_elbow, bdv_elbow, mdv_elbow, br_elbow, tbr_elbow, v as voted_N from one, vote""",
    "w12_head_tail": f"""with {RUNS_SQL}, s as (select event_id, N, LFS, LFS - lag(LFS) over (partition by event_id order by N) as step from runs where LFS is not null)
select event_id, round(try_cast(arg_min(LFS, N) as decimal(38, 12)), 6)::double as first_lfs, round(try_cast(arg_max(LFS, N) as decimal(38, 12)), 6)::double as last_lfs, round(try_cast(avg(abs(step)) as decimal(38, 12)), 6)::double as mean_step, round(try_cast(max(LFS) - min(LFS) as decimal(38, 12)), 6)::double as lfs_range, count(*) as n from s group by event_id""",
    "a28_quantiles": f"with {RUNS_SQL} select lifecycle_class, round(try_cast(median(J_imex) as decimal(38, 12)), 6)::double as j_median, round(try_cast(quantile_cont(J_imex, 0.98) as decimal(38, 12)), 6)::double as j_p98, round(try_cast(quantile_cont(FAE, 0.25) as decimal(38, 12)), 6)::double as fae_p25 from runs where lifecycle_class is not null group by 1",
    "a29_histogram": f"with {RUNS_SQL} select case when boundary_recall_mean = 1 then 20 else cast(floor(boundary_recall_mean * 20) + 1 as int) end as bin, count(*) as n from runs where boundary_recall_mean between 0 and 1 group by 1",
    "a30_plurality": """with r as (select upper(regexp_replace(regexp_replace(event_id, '\\s', '', 'g'), '(_n_sweep|_sweep|_metrics|_result|_out)$', '', 'i')) as event_id, lifecycle_class, file_id * 100000 + line_no as p
  from sweep where event_id is not null and lifecycle_class is not null),
c as (select event_id, lifecycle_class, row_number() over (partition by event_id order by count(*) desc, min(p)) as k from r group by 1, 2) select event_id, lifecycle_class from c where k = 1""",
    "a31_profile": " union all ".join(f"select '{n}' as \"column\", round(try_cast(min(x) as decimal(38, 12)), 6)::double as min, round(try_cast(max(x) as decimal(38, 12)), 6)::double as max, round(try_cast(avg(x) as decimal(38, 12)), 6)::double as mean, round(try_cast(stddev_pop(x) as decimal(38, 12)), 6)::double as std, round(try_cast(avg((x = 0)::int) * 100 as decimal(38, 12)), 6)::double as zero_pct from (select case when isnan({n}::double) then null else {n}::double end as x from sweep)" for n, t in SWEEP_FIELDS if t != "string"),
    "a36_plot_range": "select img_type, coalesce(min(x), 0.0) as vmin, coalesce(max(x), 1.0) as vmax from (select img_type, case when isnan(pct_missing) then null else nullif(pct_missing, 0) end as x from storm_catalog) group by 1",
    "a18_crosstab": f"{_LATEST} select spatial_type, lifecycle_class, count(*) as n from ev where lifecycle_class is not null and spatial_type is not null group by 1, 2",
    "a19_pivot": f"with {RUNS_SQL} select lifecycle_class, {', '.join(f'round(try_cast(avg(runtime_s) filter (where N = {n}) as decimal(38, 12)), 6)::double as n{n}' for n in (100, 200, 400, 800))} from runs where lifecycle_class is not null group by 1",
    "a20_numeric_means": f"with {RUNS_SQL} select lifecycle_class, {', '.join(f'round(try_cast(avg({n}) as decimal(38, 12)), 6)::double as {n}' for n, t in SWEEP_FIELDS if t != 'string')} from runs where lifecycle_class is not null group by 1",
    "a17_distinct": f"with {RUNS_SQL} select lifecycle_class, count(distinct event_id) as n_events, count(distinct N) as n_counts, count(*) as n_rows from runs group by 1",
    "a26_coefficients": f"""with {RUNS_SQL}, g as (select runtime_s as x, E_super_est::double as y from runs where runtime_s is not null and E_super_est is not null),
r as (select x, y, {_RANK_SQL.format('x')} as rx, {_RANK_SQL.format('y')} as ry from g)
select count(*) as n, {_r('corr(x, y)')} as pearson, {_r('corr(rx, ry)')} as spearman from r""",
    "a27_rank_sum": f"""with {RUNS_SQL}, g as (select lifecycle_class as c, J_imex as v from runs where lifecycle_class in ('STEADY', 'PLATEAU') and J_imex is not null),
r as (select c, {_RANK_SQL.format('v')} as r from g), k as (select count(*) filter (where c = 'STEADY') as na, count(*) as n, sum(r) filter (where c = 'STEADY') as s from r)
select cast(na as int) as n_a, cast(n - na as int) as n_b, {_r('s - na * (na + 1) / 2')} as u from k""",
    "d12_thresholds": f"{_LATEST} select round(try_cast(quantile_cont(slope, 0.85) as decimal(38, 12)), 6)::double as growth, round(try_cast(quantile_cont(slope, 0.15) as decimal(38, 12)), 6)::double as decay, round(try_cast(quantile_cont(abs(slope), 0.25) as decimal(38, 12)), 6)::double as stable, round(try_cast(quantile_cont(mean_mass, 0.75) as decimal(38, 12)), 6)::double as high_mass, round(try_cast(quantile_cont(mean_mass, 0.10) as decimal(38, 12)), 6)::double as noise_mass from ev",
    "d08_lifecycle": f"""{_LATEST}, e as (select *, {_PHASE_SQL} as ph from ev where slope is not null and mean_mass is not null),
t as (select quantile_cont(slope, 0.85) as g, quantile_cont(slope, 0.15) as d, quantile_cont(abs(slope), 0.25) as s, quantile_cont(mean_mass, 0.75) as h, quantile_cont(mean_mass, 0.10) as q from e)
select id, case when mean_mass < q or active_fraction_t0 < 0.005 then 'QUIESCENT' when n_phases >= 3 and (contains(ph, 'G→D→G') or contains(ph, 'D→G→D')) then 'EPISODIC'
  when n_phases = 2 and ph in ('G→D', 'G→P→D') then 'GROWTH_DECAY' when mean_mass > h and abs(slope) < s then 'PLATEAU' when abs(slope) < s and r_squared > 0.6 then 'STEADY'
  when slope > g then 'RAPID_GROWTH' when slope < d then 'RAPID_DECAY' when n_phases >= 2 then 'EPISODIC' else 'STEADY' end as lifecycle_class from e, t""",
    "d13_enrich": f"""{_LATEST}, e as (select * from ev where slope is not null and active_fraction_t0 is not null and n_cells_t0 is not null), m as (select avg(slope) as m, stddev_pop(slope) as s from e)
select id, round((rank() over (order by slope) - 1) / (count(*) over ()) * 100, 4) as intensity_percentile, round((slope - m) / (s + 1e-9), 4) as slope_norm,
  greatest(500, least(2500, 500 + cast(trunc(active_fraction_t0 * 1000) as int) + n_cells_t0 * 50)) as "recommended_N_hint" from e, m""",
    "c02_spatial_rules": f"{_LATEST} select id, {_TYPE} as by_cells, {_SUB} as by_activity, ({_TYPE}) <> ({_SUB}) as differs from ev where active_fraction_t0 is not null and n_cells_t0 is not null and max_cell_area_t0 is not null",
    "d18_trend_labels": f"""{_LATEST} select id, case when slope > 500 then 'GROWTH' when slope < -500 then 'DECAY' else 'STEADY' end as trend,
  case when abs(slope) <= 500 then 'N/A' when abs(slope) > 1000 then 'High' else 'Moderate' end as confidence, case when slope > 1000 then 'Growth' when slope < -1000 then 'Decay' end as search_type from ev where slope is not null""",
    "o01_extremes": f"""{_LATEST}, e as (select id, round(slope, 4) as slope from ev where slope is not null)
select * from (select id, slope, 'growth' as side from e order by slope desc, id limit 10) union all select * from (select id, slope, 'decay' as side from e order by slope, id limit 10)""",
    "o02_class_report": f"""{_LATEST} select * from (select lifecycle_class, row_number() over (partition by lifecycle_class order by case when contains(lifecycle_class, 'decay') then slope else -slope end, id) as rank, id
  from ev where slope is not null and lifecycle_class is not null) where rank <= 5""",
    "o03_stratified": f"{_LATEST} select lifecycle_class, id from (select lifecycle_class, id, row_number() over (partition by lifecycle_class order by {_MD5.format(42, 'id')}, id) as k from ev where lifecycle_class is not null) where k <= 4",
    "o04_one_per_class": f"""{_LATEST} select lifecycle_class, id from (select lifecycle_class, id, row_number() over (partition by lifecycle_class order by {_MD5.format(42, 'id')}, id) as k from ev where lifecycle_class <> 'steady') where k = 1
union all select 'steady', max(id) from ev where lifecycle_class = 'steady' having max(id) is not null""",
    "o05_uniform": f"{_LATEST} select id from ev order by {_MD5.format(7, 'id')}, id limit 25",
    "w08_chunks": f"{_LATEST} {_CHUNK}",
    "o09_array_slice": f"{_LATEST} select lifecycle_class, id from ({_CHUNK}) where chunk = 3",
    "o07_nearest": f"with {RUNS_SQL} select event_id, N from (select event_id, N, row_number() over (partition by event_id order by abs(N - 777), N) as k from runs) where k = 1",
    "f14_edge_estimates": f"with {RUNS_SQL}, n as (select distinct N from runs) select N, {_E} as edges, round({_E} * 768 / 1e6, 6) as mb, round(1.5 * sqrt(147456.0::double / N), 6) as sigma, 'N' || lpad(N::varchar, cast(greatest(4, length(N::varchar)) as int), '0') as tag from n",
    "f09_activations": f"""with {RUNS_SQL} select event_id, N, round(1 / (1 + exp(-5 * (J_imex - 0.6))), 9) as sigmoid, round(J_imex / (1 + exp(-J_imex)), 9) as silu, round(ln(1 + exp(J_imex)), 9) as softplus,
  round((exp(2 * J_imex) - 1) / (exp(2 * J_imex) + 1), 9) as tanh, round(case when J_imex >= 0 then J_imex else 0.2 * J_imex end, 9) as leaky from runs where J_imex is not null""",
}
SQL["d17_subclass_stability"] = f"""{_PLATEAU}, {EVENTS_SQL}, e as (select id, ({_TYPE}) <> ({_SUB}) as subclass_changed from ev
  where lifecycle_class = 'steady' and active_fraction_t0 is not null and n_cells_t0 is not null and max_cell_area_t0 is not null)
select subclass_changed, count(*) as events, {_r('median(plateau_width)')} as width_median, {_r('quantile_cont(plateau_width, 0.98)')} as width_p98, {_r('median(n_star)')} as n_star_median from p join e on e.id = p.event_id group by 1"""
SQL["d19_report"] = f"""select printf('%s: N=%d of %d events (vote %d, LFS ceiling %d, VRAM ceiling %d; %s)', lifecycle_class, recommended_N, n_events, majority_vote_N, lfs_ceiling_N, vram_ceiling_N, binding_constraint) as line
from ({SQL["d05_recommend"]})"""

_SOLVER_SQL = f"{RUNS_SQL}, sr as (select lifecycle_class, event_id, N, {', '.join(f'{e} as {k}' for k, e in _SOLVER.items())} from runs where lifecycle_class is not null)"
_MEAN = lambda k, c: f"{_r(f'avg({c})')} as {k}_mean"
_FRAC = lambda k: f"avg(cast({k} as int))"
_ACC = f"""{_SOLVER_SQL}, ac as (select lifecycle_class, N, avg(eps_int) as m from sr group by 1, 2 having avg(eps_int) is not null), first as (select *, first_value(m) over (partition by lifecycle_class order by N) as b from ac)"""
SQL |= {
    "a03_solver_summary": f"""with {_SOLVER_SQL} select lifecycle_class, N, {", ".join(f"{_MEAN(k, c)}, {_r(f'stddev_samp({c})')} as {k}_std" for k, c in S.SOLVER_SPREAD.items())}, {", ".join(_MEAN(k, c) for k, c in S.SOLVER_MEANS.items())},
  {", ".join(f"{_r(_FRAC(f'{k}_converged'))} as {k}_converged_frac" for k in ("dopri5", "imex"))}, count(nfe_imex_total) as n_trials, {", ".join(f"{_r(f'avg(nfe_{k}) / nullif(avg(nfe_imex_total), 0)')} as {k}_fraction" for k in ("reaction", "diffusion"))}
  from sr group by lifecycle_class, N""",
    "a04_accuracy_summary": f"""with {_SOLVER_SQL} select lifecycle_class, N, count(*) as n_samples, {_MEAN('eps_int', 'eps_int')}, {_r('stddev_samp(eps_int)')} as eps_int_std, {_MEAN('nfe_ref', 'nfe_ref')}, {_MEAN('nfe_train', 'nfe_train')}, {_MEAN('nfe_ratio', 'nfe_ratio_train_over_ref')},
  {_r(_FRAC('ref_converged'))} as frac_ref_converged, {_r(_FRAC('train_converged'))} as frac_train_converged from sr group by lifecycle_class, N""",
    "a04_accuracy_elbow": f"with {_ACC} select lifecycle_class, {_r('max(b)')} as baseline, min(N) filter (where m > 2 * b) as elbow_N from first group by lifecycle_class",
    "s48_merged_accuracy": f"with {_SOLVER_SQL} select event_id, N, {_r('eps_int * case when N % 2 = 0 then 1 else 2 end')} as eps_int, nfe_ref from sr",
    "s15_rebuilt_joint": f"with {RUNS_SQL} select r.event_id, r.N, g.J_gated as J_imex from runs r left join ({SQL['d10_gated_joint']}) g using (event_id, N)",
    "q14_wide_intervals": f"with {RUNS_SQL}, {_CLASS_AGG} select lifecycle_class, N, coalesce(ISV_rel_ci_pct > 50, false) as high_ci from agg",
    "f18_older_scaling": f"""{_LATEST}, m as (select id, peak_mass as p, mean_mass as q, r_squared as t, (peak_mass + mean_mass + r_squared) / 3 as mu from ev where peak_mass is not null and r_squared is not null and mean_mass is not null)
select id, {_r('(p - mu) / (sqrt(((p - mu) ** 2 + (q - mu) ** 2 + (t - mu) ** 2) / 3) + 1e-9)')} as z_peak, {_r('q / 255.0')} as old_mean, {_r('q / (greatest(p, q, t) + 1e-6)')} as own_mean, {_r('least(greatest(p, 0), 255) / 255.0 * 70.0')} as vil from m""",
    "f27_solver_codes": f"with {RUNS_SQL} select event_id, N, case N % 5 when 0 then 'successful' when 1 then 'max_steps_reached' when 2 then 'dt_min_reached' when 3 then 'nonlinear_divergence' else 'unknown(4)' end as result from runs",
}
