"""Decisions over sweeps: elbows, ceilings, joint scores, votes, recommendations; thresholds and lifecycle classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from .relational import one_row
from .stats import WHOLE, first_argmax, percentiles

ALPHA, LFS_TOL, BATCH, BUDGET_MB = 1.5, 0.10, 32, 4000.0


def _groups(by: list[str], n: str) -> tuple[W, W]:
    """(unordered, ordered whole) windows over each group."""
    return W.partitionBy(*by), W.partitionBy(*by).orderBy(n).rowsBetween(*WHOLE)


def elbows(agg: DataFrame, by: list[str], n: str, scores: dict[str, Column]) -> DataFrame:
    """(by, one column of N for each score): the point farthest from the chord, the first on a tie; the first N of a group with
    fewer than three points. Ranges and ends of all scores come from one aggregate, which is joined back."""
    cols = agg.select(*by, n, *[e.cast("double").alias(f"_v_{k}") for k, e in scores.items()])
    ends = [F.min(n).alias("_n0"), F.max(n).alias("_n1"), F.count(F.lit(1)).alias("_k")]
    for k in scores:
        v = f"_v_{k}"
        ends += [F.min(v).alias(f"_lo_{k}"), F.max(v).alias(f"_hi_{k}"), F.min_by(v, n).alias(f"_a_{k}"), F.max_by(v, n).alias(f"_b_{k}")]
    g = cols.join(cols.groupBy(*by).agg(*ends), by)
    span = F.col("_n1") - F.col("_n0") + 1e-12
    x, dx = (F.col(n) - F.col("_n0")) / span, (F.col("_n1") - F.col("_n0")) / span
    marks = []
    for k in scores:
        size = F.col(f"_hi_{k}") - F.col(f"_lo_{k}") + 1e-12
        y, dy = (F.col(f"_v_{k}") - F.col(f"_a_{k}")) / size, (F.col(f"_b_{k}") - F.col(f"_a_{k}")) / size
        norm = F.sqrt(dx * dx + dy * dy) + 1e-12
        along = (x * dx + y * dy) / norm
        marks.append(F.round(F.sqrt(F.pow(x - along * dx / norm, F.lit(2)) + F.pow(y - along * dy / norm, F.lit(2))), 12).alias(f"_d_{k}"))
    dist = g.select(*by, n, "_k", *marks)
    return dist.groupBy(*by).agg(*[F.when(F.max("_k") < 3, F.min(n)).otherwise(first_argmax(by, F.col(f"_d_{k}"), F.col(n))).alias(k) for k in scores])


def lfs_ceiling(agg: DataFrame, by: list[str], n: str, lfs: str, tol: float = LFS_TOL) -> DataFrame:
    """(by, lfs_ceiling_N): the largest N whose score is within tolerance of the minimum; the last N of a flat curve."""
    every, _ = _groups(by, n)
    lo, hi = F.min(lfs).over(every), F.max(lfs).over(every)
    ok = (hi - lo < 1e-9) | (F.col(lfs) <= lo * (1 + tol) + tol * (hi - lo))
    return agg.withColumn("_ok", ok).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_ok"), F.col(n))), F.min(n)).alias("lfs_ceiling_N"))


def memory_ceiling(agg: DataFrame, n: str, batch: int = BATCH, budget: float = BUDGET_MB) -> Column:
    """The largest N whose edges fit the budget, else the smallest, as an aggregate."""
    fits = X.edge_memory_mb(X.super_edges(F.col(n)), batch) <= budget
    return F.coalesce(F.max(F.when(fits, F.col(n))), F.min(n))


def joint_scores(agg: DataFrame, by: list[str], n: str, isv: str, lfs: str, alpha: float = ALPHA) -> DataFrame:
    """agg with quality, stiffness and joint = quality - alpha * stiffness, both relative to the first and last N."""
    _, ordered = _groups(by, n)
    first, last = (lambda c: F.first(c).over(ordered)), (lambda c: F.last(c).over(ordered))
    q = (first(isv) - F.col(isv)) / (first(isv) - last(isv) + 1e-12)
    s = (F.col(lfs) - first(lfs)) / (last(lfs) - first(lfs) + 1e-12)
    return agg.withColumn("quality", q).withColumn("stiffness", s).withColumn("joint", F.col("quality") - alpha * F.col("stiffness"))


def recommend(agg: DataFrame, alpha: float = ALPHA, tol: float = LFS_TOL, batch: int = BATCH, budget: float = BUDGET_MB) -> DataFrame:
    """The recommended N of each class. agg: sweep_aggregate() by class and N; classes with fewer than three N are left out.

    Elbows of variance, flow error and residual vote together with the joint optimum (the earliest of these four wins a tie);
    the vote is held down by the stiffness and memory ceilings and moved to the nearest N of the class, the lower on a tie."""
    by, n = ["lifecycle_class"], "N"
    agg = agg.where("lifecycle_class is not null and N is not null").withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(*by))).where("_k >= 3").drop("_k")
    scored = joint_scores(agg, by, n, "ISV_mean", "LFS_mean", alpha)
    marks = elbows(agg, by, n, {"isv_elbow_N": F.col("ISV_mean"), "fae_elbow_N": F.col("FAE_mean"), "mdv_elbow_N": F.col("MDV_mean"), "tbr_elbow_N": F.col("TBR_mean"), "br_elbow_N": 1 - F.col("BR_mean")})
    best = scored.groupBy(*by).agg(first_argmax(by, F.round("joint", 12), F.col(n)).alias("joint_optimal_N"), F.max("n_events").alias("n_events"))
    memory = agg.select(n).distinct().agg(memory_ceiling(agg, n, batch, budget).alias("vram_ceiling_N"))
    per = marks.join(best, by).join(lfs_ceiling(agg, by, n, "LFS_mean", tol), by).withColumn("vram_ceiling_N", one_row(memory)["vram_ceiling_N"])
    pool = F.array("isv_elbow_N", "fae_elbow_N", "mdv_elbow_N", "joint_optimal_N")
    votes = F.transform(pool, lambda v: F.size(F.filter(pool, lambda w: w == v)))
    voted = F.element_at(pool, F.array_position(votes, F.array_max(votes)).cast("int"))
    per = per.withColumn("majority_vote_N", voted).withColumn("_raw", F.least("majority_vote_N", "lfs_ceiling_N", "vram_ceiling_N"))
    per = per.withColumn("vote_breakdown", F.to_json(F.transform(F.array_distinct(pool), lambda v: F.struct(v.alias("N"), F.size(F.filter(pool, lambda w: w == v)).alias("votes")))))
    per = per.withColumn("binding_constraint", X.binding(F.col("majority_vote_N"), F.col("lfs_ceiling_N"), F.col("vram_ceiling_N")))
    at = scored.join(per.select(*by, "_raw"), by).groupBy(*by).agg(F.min_by(F.struct(n, "ISV_mean", "LFS_mean", "quality", "stiffness", "joint", "ISV_rel_ci_pct"), F.struct(F.abs(F.col(n) - F.col("_raw")), F.col(n))).alias("r"))
    out = per.join(at, by)
    e = X.super_edges(F.col("r.N"))
    return out.select(
        "lifecycle_class", "n_events", "isv_elbow_N", "fae_elbow_N", "mdv_elbow_N", "tbr_elbow_N", "br_elbow_N", "lfs_ceiling_N", "vram_ceiling_N", "joint_optimal_N", "majority_vote_N",
        F.col("r.N").alias("recommended_N"), "binding_constraint", X.settled(F.col("r.ISV_mean"), 6).alias("isv_at_rec"), X.settled(F.col("r.LFS_mean"), 6).alias("lfs_at_rec"), X.settled(F.col("r.quality"), 4).alias("quality_at_rec"),
        X.settled(F.col("r.stiffness"), 4).alias("stiffness_at_rec"), X.settled(F.col("r.joint"), 4).alias("joint_score_at_rec"), e.alias("e_super_at_rec"), X.settled(X.edge_memory_mb(e, batch), 1).alias("vram_at_rec_mb"),
        X.settled(F.col("r.ISV_rel_ci_pct"), 1).alias("isv_ci_pct_at_rec"), "vote_breakdown",
    )


def gated_joint(sweep: DataFrame, by: list[str], class_column: str | None) -> DataFrame:
    """sweep with J_gated: four quality terms, three stiffness terms, a sigmoid penalty by class and an interaction, within each
    group. Groups with fewer than three N or a missing metric get none of their rows. Ranges and ends come from one aggregate, the
    quality at the elbow of recall from a second; both are joined back, so that no window is sorted."""
    n = "N"
    isv, br = "intra_sp_var_mean", "boundary_recall_mean"
    need = [isv, "LFS", "FAE", "MDV", br, "temporal_br_std"]
    base = sweep.withColumn("_e", X.super_edges(F.col(n)).cast("double"))
    bad = F.max(sum((F.col(c).isNull().cast("int") for c in need), F.lit(0)))
    spans = [f(c).alias(f"_{f.__name__}_{c}") for c in (*need, "_e", n) for f in (F.min, F.max)]
    ends = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), bad.alias("_bad"), *spans, F.min_by(isv, n).alias("_isv0"), F.min_by(br, n).alias("_br0"), F.max_by(br, n).alias("_br1"))
    g = base.join(ends.where("_bad = 0 and _k >= 3"), by)
    lo, hi = (lambda c: F.col(f"_min_{c}")), (lambda c: F.col(f"_max_{c}"))
    level = lambda c: (F.col(c) - lo(c)) / (hi(c) - lo(c) + 1e-12)
    g = g.withColumn("_gain", (F.col(br) - F.col("_br0")) / (hi(br) - F.col("_br0") + 1e-12))
    # The elbow of 1 - recall: distance from the chord between the first and last N, both axes scaled to 0..1.
    width, height = hi(n) - lo(n) + 1e-12, hi(br) - lo(br) + 1e-12
    x, y = (F.col(n) - lo(n)) / width, (F.col("_br0") - F.col(br)) / height
    dx, dy = (hi(n) - lo(n)) / width, (F.col("_br0") - F.col("_br1")) / height
    norm = F.sqrt(dx * dx + dy * dy) + 1e-12
    along = (x * dx + y * dy) / norm
    away = F.round(F.sqrt(F.pow(x - along * dx / norm, F.lit(2)) + F.pow(y - along * dy / norm, F.lit(2))), 12)
    cap = g.groupBy(*by).agg(F.max_by("_gain", F.struct(away, -F.col(n))).alias("_cap"))
    g = g.join(cap, by)
    q = 0.40 * (F.col("_isv0") - F.col(isv)) / (F.col("_isv0") - lo(isv) + 1e-12) + 0.30 * F.least("_gain", "_cap") - 0.15 * level("FAE") - 0.15 * level("MDV")
    s = 0.10 * level("LFS") + 0.60 * level("_e") + 0.30 * level("temporal_br_std")
    alpha = X.class_alpha(F.col(class_column)) if class_column else F.lit(X.OTHER_ALPHA)
    g = g.withColumn("_q", q).withColumn("_s", s)
    return g.select(*sweep.columns, (F.col("_q") - alpha * X.sigmoid(F.col("_s"), 5.0, 0.60) - 0.10 * F.col("_q") * F.col("_s")).alias("J_gated"))


def with_joint(sweep: DataFrame, by: list[str], class_column: str | None) -> DataFrame:
    """sweep with J_imex: its own where it has one, else the gated joint score, null for groups that have none. by and N tell the
    rows apart."""
    own = F.col("J_imex") if "J_imex" in sweep.columns else F.lit(None).cast("double")
    base = sweep.withColumn("_own", own).drop("J_imex")
    got = gated_joint(base, by, class_column).select(*by, "N", "J_gated")
    return base.join(got, [*by, "N"], "left").withColumn("J_imex", F.coalesce("_own", "J_gated")).drop("_own", "J_gated")


def thresholds(stats: DataFrame, slope: str = "slope", mass: str = "mean_mass") -> DataFrame:
    """One row of exact, linearly interpolated percentiles that the classes are told apart by."""
    v, m = F.col(slope), F.col(mass)
    return percentiles(stats, [], {"growth": (v, 0.85), "decay": (v, 0.15), "stable": (F.abs(v), 0.25), "high_mass": (m, 0.75), "noise_mass": (m, 0.10)})


def phases(series: DataFrame, by: list[str], t: str, y: str) -> DataFrame:
    """(by, n_phases, phase_sequence): the slope signs of both halves of each series, split at its middle; a series of fewer
    than four frames is one phase. t need not be contiguous: frames count by their order."""
    w = W.partitionBy(*by)
    rows = series.withColumn("_i", F.row_number().over(w.orderBy(t)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    left = (F.col("_n") < 4) | (F.col("_i") < F.floor(F.col("_n") / 2))
    x, v = F.col("_i").cast("double"), F.col(y).cast("double")
    g = rows.groupBy(*by).agg(F.max("_n").alias("_n"), F.regr_slope(F.when(left, v), F.when(left, x)).alias("_a"), F.regr_slope(F.when(~left, v), F.when(~left, x)).alias("_b"))
    name = lambda c: F.when(c > 0, "G").when(c < 0, "D").otherwise("P")
    a, b = name(X.slope_sign(F.coalesce("_a", F.lit(0.0)))), name(X.slope_sign(F.coalesce("_b", F.lit(0.0))))
    one = (F.col("_n") < 4) | (a == b)
    return g.select(*by, F.when(one, 1).otherwise(2).alias("n_phases"), F.when(one, a).otherwise(F.concat_ws("→", a, b)).alias("phase_sequence"))


def lifecycle(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with lifecycle_class: the first rule that holds. stats: slope, r_squared, n_phases, phase_sequence, mean_mass,
    active_fraction_t0. limits: thresholds(), one row."""
    c = F.col
    seq = c("phase_sequence")
    rule = (
        F.when((c("mean_mass") < c("noise_mass")) | (c("active_fraction_t0") < 0.005), "QUIESCENT")
        .when((c("n_phases") >= 3) & (seq.contains("G→D→G") | seq.contains("D→G→D")), "EPISODIC")
        .when((c("n_phases") == 2) & seq.isin("G→D", "G→P→D"), "GROWTH_DECAY")
        .when((c("mean_mass") > c("high_mass")) & (F.abs("slope") < c("stable")), "PLATEAU")
        .when((F.abs("slope") < c("stable")) & (c("r_squared") > 0.6), "STEADY")
        .when(c("slope") > c("growth"), "RAPID_GROWTH")
        .when(c("slope") < c("decay"), "RAPID_DECAY")
        .when(c("n_phases") >= 2, "EPISODIC")
        .otherwise("STEADY")
    )
    return stats.withColumn("_limits", one_row(limits)).select("*", *[F.col("_limits")[k].alias(k) for k in limits.columns]).withColumn("lifecycle_class", rule).drop("_limits", *limits.columns)


def spatial_type(cells: Column, area: Column, active: Column) -> Column:
    """By cells first; a frame without any is quiescent."""
    return F.when(cells == 0, "quiescent").when((cells == 1) & (area < 5000), "isolated_cell").when(area >= 30000, "mcs").when(active < 0.01, "quiescent").otherwise("cluster")


def spatial_subclass(cells: Column, area: Column, active: Column) -> Column:
    """By activity first."""
    return F.when(active < 0.01, "quiescent").when(area >= 30000, "mcs").when((cells == 1) & (area < 5000), "isolated_cell").otherwise("cluster")


def trend_label(slope: Column, limit: float = 500.0) -> tuple[Column, Column]:
    """(label, confidence) of a mass trend."""
    label = F.when(slope > limit, "GROWTH").when(slope < -limit, "DECAY").otherwise("STEADY")
    return label, F.when(label == "STEADY", "N/A").when(F.abs(slope) > 2 * limit, "High").otherwise("Moderate")


def first_crossing(df: DataFrame, by: list[str], n: str, value: str, factor: float) -> DataFrame:
    """(by, baseline, elbow_N): the first N whose value exceeds factor times that of the smallest N; null if none does."""
    base = df.withColumn("baseline", F.min_by(value, n).over(W.partitionBy(*by)))
    return base.groupBy(*by).agg(F.first("baseline").alias("baseline"), F.min(F.when(F.col(value) > factor * F.col("baseline"), F.col(n))).alias("elbow_N"))


def soft_argmax(df: DataFrame, by: list[str], n: str, value: str, ratio: float = 0.95) -> DataFrame:
    """(by, soft_N): the smallest N whose value is at least ratio times the maximum; null if the maximum is below 1e-6."""
    top = df.withColumn("_m", F.max(value).over(W.partitionBy(*by)))
    return top.groupBy(*by).agg(F.min(F.when((F.col("_m") >= 1e-6) & (F.col(value) >= ratio * F.col("_m")), F.col(n))).alias("soft_N"))


def interval_check(lower: Column, star: Column, upper: Column) -> Column:
    return F.when(lower.isNull() | upper.isNull() | star.isNull(), "unknown").when((lower <= star) & (star <= upper), "inside").when(star < lower, "below").otherwise("above")


def metric_vote(agg: DataFrame, n: str = "N") -> DataFrame:
    """One row: the elbow of each of six metrics over all events and their plurality, ties to the earliest metric."""
    one = agg.withColumn("_all", F.lit(1))
    names = {"isv_elbow": F.col("ISV_mean"), "fae_elbow": F.col("FAE_mean"), "bdv_elbow": F.col("BDV_mean"), "mdv_elbow": F.col("MDV_mean"), "br_elbow": 1 - F.col("BR_mean"), "tbr_elbow": F.col("TBR_mean")}
    e = elbows(one, ["_all"], n, names)
    pool = F.array(*names)
    votes = F.transform(pool, lambda v: F.size(F.filter(pool, lambda w: w == v)))
    return e.select(*names, F.element_at(pool, F.array_position(votes, F.array_max(votes)).cast("int")).alias("voted_N"))
