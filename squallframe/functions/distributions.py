"""Student's t and the normal distribution, for confidence intervals and tests on the driver; and as Column expressions."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Degrees of freedom up to which quantiles come from a table; beyond, from the expansion in 1/df.
TABLE = 200


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache
def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_upper(mid) < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache
def t_quantile(p: float, df: int) -> float:
    """The p-quantile (p > 0.5) of Student's t."""
    lo, hi = 0.0, 1e5
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def t_expansion(p: float) -> tuple[float, ...]:
    """Coefficients of 1, 1/df, ... of the quantile for many degrees of freedom (Abramowitz and Stegun 26.7.5)."""
    z = normal_quantile(p)
    return (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)


def t_table(spark: SparkSession, level: float = 0.95) -> DataFrame:
    """One row with the array _t of two-sided critical values for 1, 2, ..., TABLE degrees of freedom."""
    return spark.createDataFrame([([t_quantile(0.5 + level / 2, k) for k in range(1, TABLE + 1)],)], "_t array<double>")


def t_critical(df: Column, level: float = 0.95) -> Column:
    """Two-sided critical value, given the column _t of t_table(); null below one degree of freedom."""
    p = 0.5 + level / 2
    far = sum((F.lit(c) / F.pow(df.cast("double"), F.lit(float(k))) for k, c in enumerate(t_expansion(p)[1:], 1)), F.lit(t_expansion(p)[0]))
    return F.when(df < 1, None).when(df <= TABLE, F.element_at("_t", F.greatest(F.lit(1), F.least(df.cast("int"), F.lit(TABLE))))).otherwise(far)


def t_critical_sql(df: str, level: float = 0.95) -> str:
    """The same as SQL."""
    p = 0.5 + level / 2
    table = ", ".join(repr(t_quantile(p, k)) for k in range(1, TABLE + 1))
    far = " + ".join(f"{c!r} / power({df}, {k})" for k, c in enumerate(t_expansion(p)))
    return f"case when {df} < 1 then null when {df} <= {TABLE} then ([{table}])[{df}] else {far} end"
