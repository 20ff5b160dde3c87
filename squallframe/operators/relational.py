"""Catalogue operators: filters, joins, set operations, duplicates, sampling, resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import clean_doubles, nan_to_null
from ..session import broadcast_if_small, settle

#: Rows up to which a dimension is broadcast.
SMALL = 200_000


def one_row(df: DataFrame) -> Column:
    """The only row of df as a struct: a scalar subquery, computed once and used as a value, in place of a cross join."""
    return df.select(F.struct(*df.columns)).scalar()


def first_column(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """The first candidate that the frame has."""
    return next((c for c in candidates if c in df.columns), None)


def ordered_columns(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Known columns in their order, further ones after them."""
    known = [c for c in order if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows with all of the columns: NaN and null are missing."""
    return clean_doubles(df).dropna(subset=subset)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by a total order; null keys are a key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by the order columns; nulls there count as earliest."""
    return keep_first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keep_last for keys that may be hot: a grouped maximum, combined on the map side, instead of a window."""
    top = F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*values).alias("_v"))).alias("_t")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_t._v.{v}").alias(v) for v in values])


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(broadcast_if_small(keys.select(*on).distinct(), SMALL), on, "left_semi")


def anti(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(broadcast_if_small(done.select(*on).distinct(), SMALL), on, "left_anti")


def lookup(df: DataFrame, dimension: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a dimension, broadcast while it is small."""
    return df.join(broadcast_if_small(dimension, SMALL), on, how)


def owns_all(df: DataFrame, key: list[str], value: str, required: list[str]) -> DataFrame:
    """Relational division: keys that have every required value."""
    need = F.array(*[F.lit(v) for v in required])
    hit = df.where(F.col(value).isin(required)).groupBy(*key).agg(F.collect_set(value).alias("_s"))  # at most len(required)
    return hit.where(F.size(F.array_except(need, F.col("_s"))) == 0).select(*key)


def in_all(parts: list[DataFrame]) -> DataFrame:
    """Rows common to all frames."""
    return reduce(lambda a, b: a.intersect(b), parts)


def incomplete(df: DataFrame, key: list[str], value: str, required: list[int]) -> DataFrame:
    """(key, missing array): keys that lack some required value."""
    need = F.array(*[F.lit(v) for v in required])
    have = df.groupBy(*key).agg(F.collect_set(F.when(F.col(value).isin(required), F.col(value))).alias("_s"))
    return have.select(*key, F.array_sort(F.array_except(need, F.col("_s"))).alias("missing")).where(F.size("missing") > 0)


def complete_files(df: DataFrame, file: str, n: str, metric: str, required: list[int], least: int) -> DataFrame:
    """Files that hold every required N and at least so many rows with the metric."""
    have = df.groupBy(file).agg(F.collect_set(F.when(F.col(n).isin(required), F.col(n))).alias("_s"), F.count(nan_to_null(F.col(metric))).alias("valid"))
    return have.where((F.size("_s") == len(set(required))) & (F.col("valid") >= least)).select(file, "valid")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unordered_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs, smaller member first."""
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)).distinct()


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order of keys that SQL can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n keys of each stratum in hash order (all of a smaller one)."""
    w = W.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def one_per_class(df: DataFrame, stratum: str, key: str, overrides: DataFrame, seed: int = 42) -> DataFrame:
    """(stratum, key): one key of each stratum, an override where there is one."""
    rest = stratified_sample(df.select(stratum, key).distinct(), stratum, key, 1, seed).join(F.broadcast(overrides.select(stratum)), stratum, "left_anti")
    return rest.unionByName(overrides.select(stratum, key))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def running_before(df: DataFrame, order: list[str], weight: str, alias: str) -> DataFrame:
    """df with the sum of weight over all rows that come strictly before in the total order given; rows must differ in it.

    A window without a partition would bring all rows into one task. Here rows are range-partitioned, each partition is summed
    on its own, and the totals of the partitions before it (a row for each partition) are added."""
    ranged = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum(weight).alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(weight).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_in", inside).join(F.broadcast(totals.select("_part", before.alias("_b"))), "_part")
    return placed.withColumn(alias, F.col("_in") + F.col("_b")).drop("_in", "_b", "_part")


def round_robin(df: DataFrame, order: list[str], chunks: int) -> DataFrame:
    """df with ``chunk``: rows dealt out in sorted order, (position - 1) modulo chunks. Rows that are equal in the order take
    neighbouring positions, whichever way."""
    one = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    at = running_before(one, order, "_n", "_at").drop("_n")
    copy = F.row_number().over(W.partitionBy(*order).orderBy(F.lit(1))) - 1
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}")) for c in order]
    j = df.withColumn("_copy", copy).alias("d").join(at.alias("a"), same)
    return j.select("d.*", F.pmod(F.col("a._at") + F.col("d._copy"), F.lit(chunks)).cast("int").alias("chunk")).drop("_copy")


def top_per_group(df: DataFrame, group: str, by: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*by))).where(F.col("rank") <= k)


def bbox_overlap(extents: DataFrame, tiles: DataFrame, cell: float = 5.0) -> DataFrame:
    """Extent x tile pairs that overlap (touching edges too): both sides are binned into cells so that the join has a key.
    extents: key columns and lon1 <= lon2, lat1 <= lat2; tiles: tile and tlon1, tlon2, tlat1, tlat2."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    e = extents.withColumn("_cx", F.explode(span("lon1", "lon2"))).withColumn("_cy", F.explode(span("lat1", "lat2")))
    t = tiles.withColumn("_cx", F.explode(span("tlon1", "tlon2"))).withColumn("_cy", F.explode(span("tlat1", "tlat2")))
    hit = (F.col("lon1") <= F.col("tlon2")) & (F.col("tlon1") <= F.col("lon2")) & (F.col("lat1") <= F.col("tlat2")) & (F.col("tlat1") <= F.col("lat2"))
    # A pair is reported in the cell of its overlap's lower corner only.
    own = (F.floor(F.greatest("lon1", "tlon1") / cell) == F.col("_cx")) & (F.floor(F.greatest("lat1", "tlat1") / cell) == F.col("_cy"))
    return e.join(t, ["_cx", "_cy"]).where(hit & own).drop("_cx", "_cy")


def nearest_value(df: DataFrame, key: list[str], target: str, value: str) -> DataFrame:
    """The value nearest to the target in each group; the smaller one on a tie."""
    return df.groupBy(*key).agg(F.min(F.struct(F.abs(F.col(value) - F.col(target)), F.col(value))).alias("_m")).select(*key, F.col(f"_m.{value}").alias(value))


def with_parents(children: DataFrame, parents: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """children (by, parent_id, ...) with the parent's values as parent_{value}; children without a parent keep nulls."""
    p = parents.select(*by, F.col("id").alias("parent_id"), *[F.col(v).alias(f"parent_{v}") for v in values])
    return children.join(p, [*by, "parent_id"], "left")


def parse_overrides(pairs: list[str] | None) -> dict[str, str]:
    """{class: event} of texts "class=event"; others are errors."""
    out = {}
    for pair in pairs or []:
        name, sep, event = pair.partition("=")
        if not sep or not name.strip() or not event.strip():
            raise ValueError(f"not class=event: {pair!r}")
        out[name.strip()] = event.strip()
    return out
