"""Aggregations and windows: trends, confidence intervals, ranks, plateaus, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import normal_upper, t_critical, t_table, t_two_sided
from .relational import one_row, running_before

WHOLE = (W.unboundedPreceding, W.unboundedFollowing)


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """(by, a column for each wanted): exact, linearly interpolated percentiles of the values that are not null; null for a group
    without any. Different values are counted before the shuffle and ordered by range partitions, so that no task ever
    holds all values of a column or group. by must not be null."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_c"), v.cast("double").alias("_v")) for k, (v, _) in wanted.items()])).alias("_e")
    counts = df.select(*by, each).select(*by, "_e.*").where("_v is not null").groupBy(*by, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_before(counts, [*by, "_c", "_v"], "_n", "_at")
    ends = placed.groupBy(*by, "_c").agg(F.min("_at").alias("_first"), F.sum("_n").alias("_all"))
    share = F.element_at(F.create_map(*[x for k, (_, q) in wanted.items() for x in (F.lit(k), F.lit(float(q)))]), F.col("_c"))
    near = placed.join(ends, [*by, "_c"]).withColumn("_at", F.col("_at") - F.col("_first")).withColumn("_r", share * (F.col("_all") - 1))
    holds = lambda r: F.max(F.when((F.col("_at") <= r) & (r < F.col("_at") + F.col("_n")), F.col("_v")))
    got = near.groupBy(*by, "_c").agg(holds(F.floor("_r")).alias("_lo"), holds(F.ceil("_r")).alias("_hi"), F.max(F.col("_r") - F.floor("_r")).alias("_f"))
    value = got.withColumn("_v", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    return value.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == k, F.col("_v"))).alias(k) for k in wanted])


def with_ci(agg: DataFrame, names: list[str], level: float = 0.95) -> DataFrame:
    """agg with {name}_ci, half the width of the mean's t confidence interval, from {name}_std and {name}_n, which is dropped;
    null for fewer than two values."""
    out = agg.withColumn("_t", t_table(agg.sparkSession, level).scalar())
    half = lambda k: F.when(F.col(f"{k}_n") >= 2, t_critical(F.col(f"{k}_n") - 1, level) * F.col(f"{k}_std") / F.sqrt(F.col(f"{k}_n").cast("double")))
    return out.withColumns({f"{k}_ci": half(k) for k in names}).drop("_t", *[f"{k}_n" for k in names])


def relative_width(half: Column, mean: Column) -> Column:
    return 2 * half / (mean + 1e-12) * 100


# Short names of the sweep metrics.
METRICS = {"ISV": "intra_sp_var_mean", "FAE": "FAE", "BDV": "BDV", "MDV": "MDV", "LFS": "LFS", "BR": "boundary_recall_mean", "TBR": "temporal_br_std"}


def sweep_aggregate(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and confidence interval of the sweep metrics for each group: one shuffle of partial sums."""
    aggs = []
    for short, name in METRICS.items():
        aggs += [F.avg(name).alias(f"{short}_mean"), F.stddev_samp(name).alias(f"{short}_std"), F.count(name).alias(f"{short}_n")]
    aggs += [F.avg("E_super_est").alias("E_super_mean"), F.avg("VRAM_est_MB").alias("VRAM_mean_MB"), F.avg("runtime_s").alias("runtime_mean"), F.count("event_id").alias("n_events")]
    out = with_ci(sweep.groupBy(*by).agg(*aggs), list(METRICS))
    return out.withColumn("ISV_rel_ci_pct", relative_width(F.col("ISV_ci"), F.col("ISV_mean"))).withColumn("LFS_rel_ci_pct", relative_width(F.col("LFS_ci"), F.col("LFS_mean")))


# Short names of the solver benchmark's measures; the first group has a mean and a deviation, the second a mean.
SOLVER_SPREAD = {"nfe_diffusion": "nfe_diffusion", "nfe_reaction": "nfe_reaction", "nfe_imex_total": "nfe_imex_total", "nfe_dopri5": "nfe_dopri5", "nfe_ratio": "nfe_ratio", "wall_imex": "wall_imex_sec", "wall_dopri5": "wall_dopri5_sec", "lambda_max_topo": "lambda_max_topo", "lambda_max_w": "lambda_max_weighted"}
SOLVER_MEANS = {"l2_error": "solution_l2_error", "rejected_diff": "rejected_diff", "rejected_rxn": "rejected_rxn"}


def solver_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means and deviations of the solver benchmark for each group, the shares of runs that converged, and the shares of the mean
    evaluations that go to reaction and diffusion (null if there are none)."""
    aggs = [f(c).alias(f"{k}_{s}") for k, c in SOLVER_SPREAD.items() for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    aggs += [F.avg(c).alias(f"{k}_mean") for k, c in SOLVER_MEANS.items()] + [F.avg(F.col(f"{k}_converged").cast("int")).alias(f"{k}_converged_frac") for k in ("dopri5", "imex")]
    out = rows.groupBy(*by).agg(*aggs, F.count("nfe_imex_total").alias("n_trials"))
    share = lambda k: F.try_divide(f"nfe_{k}_mean", "nfe_imex_total_mean")
    return out.withColumn("reaction_fraction", share("reaction")).withColumn("diffusion_fraction", share("diffusion"))


def accuracy_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """The integration error and the cost of the accuracy rows for each group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("eps_int").alias("eps_int_mean"), F.stddev_samp("eps_int").alias("eps_int_std"), F.avg("nfe_ref").alias("nfe_ref_mean"), F.avg("nfe_train").alias("nfe_train_mean"),
        F.avg("nfe_ratio_train_over_ref").alias("nfe_ratio_mean"), F.avg(F.col("ref_converged").cast("int")).alias("frac_ref_converged"), F.avg(F.col("train_converged").cast("int")).alias("frac_train_converged"),
    )


def sweep_rollup(sweep: DataFrame) -> DataFrame:
    """Both groupings, by N and by (class, N), in one pass: grouping sets."""
    return sweep.groupingSets([[F.col("N")], [F.col("lifecycle_class"), F.col("N")]], F.col("lifecycle_class"), F.col("N")).agg(
        F.avg("intra_sp_var_mean").alias("ISV_mean"), F.avg("LFS").alias("LFS_mean"), F.count("event_id").alias("n_events"), F.grouping("lifecycle_class").cast("int").alias("all_classes")
    )


def trend(rows: DataFrame, by: list[str], t: str, y: str) -> DataFrame:
    """Least-squares line and summary of each series: one pass, no sort. Ties of the maximum go to the first t."""
    return rows.groupBy(*by).agg(
        F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), F.regr_r2(y, t).alias("r_squared"),
        F.max(y).alias("peak"), F.min_by(t, F.struct(-F.col(y), F.col(t))).alias("peak_at"), F.min(y).alias("trough"), F.avg(y).alias("mean"), F.count(y).alias("n"),
    )


def first_argmax(by: list[str], value: Column, index: Column) -> Column:
    """Index of the largest value as an aggregate; the smallest index on a tie."""
    return F.max_by(index, F.struct(value, -index))


def average_rank(value: Column, by: list[Column] | None = None) -> Column:
    """Rank with ties averaged, as a window expression."""
    over = W.partitionBy(*(by or []))
    return F.rank().over(over.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*(by or []), value)) - 1) / 2.0


def share_below(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Percent of strictly smaller values; values must not be null. Equal values are counted first and ranked as one row."""
    ranked = running_before(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), [value], "_n", "_before")
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return df.join(ranked.drop("_n"), value).withColumn(alias, F.col("_before") / one_row(total)["n"] * 100).drop("_before")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson and Spearman coefficients with two-sided p-values. Rows with a missing value are left out."""
    good = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def ranks(c: str) -> DataFrame:
        n = running_before(good.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [c], "_n", "_before")
        return n.select(c, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(f"r{c}"))

    both = good.join(ranks("x"), "x").join(ranks("y"), "y")
    r = both.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n")).first()
    p = lambda c: None if c is None or r.n < 3 else (0.0 if abs(c) >= 1 else t_two_sided(c * math.sqrt((r.n - 2) / (1 - c * c)), r.n - 2))
    return df.sparkSession.createDataFrame([(r.n, r.pearson, p(r.pearson), r.spearman, p(r.spearman))], "n bigint, pearson double, pearson_p double, spearman double, spearman_p double")


#: U has its exact distribution if the smaller group has at most so many values, there are at most so many pairs, and no ties.
EXACT_SMALLER, EXACT_PAIRS = 8, 100_000


def rank_sum_ways(n1: int, n2: int) -> list[int]:
    """In how many ways n1 and n2 values can be ordered for U = 0, 1, ... n1 n2: the coefficients of the Gaussian binomial."""
    m = min(n1, n2)
    ways = [1] + [0] * (n1 * n2)
    for k in range(1, m + 1):
        up = max(n1, n2) + k
        for u in range(n1 * n2, up - 1, -1):
            ways[u] -= ways[u - up]
        for u in range(k, n1 * n2 + 1):
            ways[u] += ways[u - k]
    return ways


def mann_whitney_less(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row: U of group a against b and the one-sided p-value that a tends to be smaller (exact for small groups without
    ties, else by normal approximation with tie and continuity correction)."""
    good = df.where(F.col(group).isin([a, b]) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    counts = good.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("g") == a, 1).otherwise(0)).alias("na"))
    ranked = running_before(counts, ["v"], "n", "before")
    r = ranked.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0).agg(F.sum(F.col("rank") * F.col("na")).alias("rank_sum"), F.sum("na").alias("na"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")).first()
    n1, n2 = int(r.na or 0), int((r.n or 0) - (r.na or 0))
    u = (r.rank_sum or 0.0) - n1 * (n1 + 1) / 2
    n = n1 + n2
    if n1 and n2 and min(n1, n2) <= EXACT_SMALLER and n1 * n2 <= EXACT_PAIRS and not r.ties:
        ways = rank_sum_ways(n1, n2)
        p = sum(ways[: int(u) + 1]) / sum(ways)
        return df.sparkSession.createDataFrame([(n1, n2, float(u), p)], "n_a int, n_b int, u double, p double")
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (r.ties or 0) / (n * (n - 1)))) if n1 and n2 and n > 1 else 0.0
    p = normal_upper(-(u - n1 * n2 / 2 + 0.5) / sigma) if sigma else None
    return df.sparkSession.createDataFrame([(n1, n2, float(u), p)], "n_a int, n_b int, u double, p double")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last one holds its upper edge."""
    at = F.when(F.col(value) == hi, bins).otherwise(F.floor((F.col(value) - lo) / (hi - lo) * bins) + 1).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def plurality(df: DataFrame, by: list[str], choice: str, position: str) -> DataFrame:
    """The most frequent choice of each group; the one that came first on a tie."""
    c = df.groupBy(*by, choice).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_p"))
    return c.groupBy(*by).agg(F.max_by(choice, F.struct(F.col("_n"), -F.col("_p"))).alias(choice))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: min, max, mean, population deviation and percent of zeros; one scan."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), (F.avg((x == 0).cast("double")) * 100).alias("zero_pct")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def plot_range(value: Column) -> tuple[Column, Column]:
    """Smallest and largest value other than zero, else 0 and 1, as aggregates."""
    x = F.when(value != 0, value)
    return F.coalesce(F.min(x), F.lit(0.0)), F.coalesce(F.max(x), F.lit(1.0))


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, sequence, n_runs): each group's values in order with equal neighbours collapsed, joined by arrows."""
    w = W.partitionBy(*by).orderBy(*order)
    turn = df.withColumn("_p", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(value)))
    got = turn.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", value))).alias("_s"))
    return got.select(*by, F.array_join(F.transform("_s", lambda s: s[value].cast("string")), "→").alias("sequence"), F.size("_s").alias("n_runs"))


def plateau(df: DataFrame, by: list[str], n: str, j: str, ratio: float = 0.95) -> DataFrame:
    """(by, plateau_width, n_star, j_max): the span of N at or above ratio times the maximum, and the first such N. Width is null
    where the maximum is not positive or there are fewer than three rows, and the whole span where fewer than two N reach it;
    n_star is then the (first) N of the maximum."""
    top = df.withColumn("_m", F.max(j).over(W.partitionBy(*by)))
    hit = F.when(F.col(j) >= ratio * F.col("_m"), F.col(n))
    got = top.groupBy(*by).agg(F.max(j).alias("j_max"), F.min(hit).alias("_lo"), F.max(hit).alias("_hi"), F.count(hit).alias("_k"), F.min(n).alias("_first"), F.max(n).alias("_last"), F.count(F.lit(1)).alias("_rows"), F.max_by(n, F.struct(F.col(j), -F.col(n))).alias("_arg"))
    width = F.when((F.col("j_max") <= 0) | (F.col("_rows") < 3), None).when(F.col("_k") < 2, F.col("_last") - F.col("_first")).otherwise(F.col("_hi") - F.col("_lo")).cast("double")
    star = F.when(F.col("j_max") <= 0, F.col("_arg")).otherwise(F.coalesce("_lo", "_arg")).cast("double")
    return got.select(*by, width.alias("plateau_width"), star.alias("n_star"), "j_max")


def window_mean_2d(cells: DataFrame, y: str, x: str, v: str, size: int) -> DataFrame:
    """(y, x, mean): mean of the cells present in the size x size window around each cell, clipped at the border. Sums are spread along
    rows and then along columns, so that a cell is copied 2 x size times, not size x size."""
    half = size // 2
    step = lambda c: F.explode(F.sequence(F.col(c) - half, F.col(c) + half))
    rows = cells.select(F.col(y).alias("_y"), step(x).alias("_x"), F.col(v).alias("_v")).groupBy("_y", "_x").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    both = rows.select(step("_y").alias(y), F.col("_x").alias(x), "_s", "_n").groupBy(y, x).agg((F.sum("_s") / F.sum("_n")).alias("mean"))
    return cells.select(y, x).join(both, [y, x])


def head_tail_ratio(series: Column, share: float = 0.1) -> Column:
    """Mean of an ordered array's last entries over the mean of its first ones; a tenth of it each, one entry at least. Null for an empty
    array."""
    n = F.size(series)
    k = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / k
    return F.when(n > 0, mean(F.slice(series, n - k + 1, k)) / (mean(F.slice(series, F.lit(1), k)) + 1e-12))
