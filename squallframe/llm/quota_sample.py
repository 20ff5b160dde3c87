"""A sample with given shares of each category: acceptance probabilities, then exact counts, then a report of deficits.

Each (request, category) needs a quota of keys. Its acceptance probability is the ratio of the quota, raised slightly, to the
keys observed; every key is accepted or not on its own, by a hash. Too many are accepted almost always: the surplus is cut
exactly, lowest hashes first. The cut needs no sort of a category: accepted keys are counted by hash prefix, the prefix at
which the quota is reached is found from these few counts, and only that prefix's keys are ranked. Where fewer were accepted
than quota and category allow, that category is accepted whole and cut like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle
from .stable_sample import DIGITS, salted_hash

#: Hexadecimal digits of a hash prefix: 16**3 counts for each request and category.
PREFIX = 3
#: Standard deviations by which the expected number of accepted keys exceeds the quota.
SLACK = 5.0


def latest_category(rows: DataFrame, key: Column, category: Column, at: str, tie: str | None = None) -> DataFrame:
    """(key, category): each key once, with the category of its latest row by ``at``; a null there is no category, whatever
    earlier rows say. Rows without a time are the earliest. Equal times: the higher ``tie``, then the higher name. Null and
    empty keys are left out."""
    named = rows.select(key.alias("key"), category.alias("category"), F.col(at).alias("_at"), (F.col(tie) if tie else F.lit(0)).alias("_tie")).where("key is not null and key <> ''")
    return named.groupBy("key").agg(F.max(F.struct("_at", "_tie", "category")).alias("m")).select("key", F.col("m.category").alias("category"))


def quotas(targets: DataFrame, request: str, category: Column, size: str, share: str, least: str) -> DataFrame:
    """The targets with their category key and quota: the larger of the minimum and the share of the sample size, rounded half
    up. Null sizes, shares and minima count as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    asked = z(size) * F.when(~F.isnan(z(share)), z(share)).otherwise(0) + 0.5
    want = F.floor(F.least(F.greatest(asked, F.lit(0.0)), F.lit(9e18))).cast("bigint")
    made = {"category", "quota", "available", "sampled", "deficit"} - {request, size, share, least}
    kept = targets.withColumn("_category", category).drop(*made)
    return kept.withColumnRenamed("_category", "category").withColumn("quota", F.greatest(want, z(least).cast("bigint"), F.lit(0).cast("bigint")))


def availability(latest: DataFrame, asked: DataFrame) -> DataFrame:
    """The targets with ``available``, the number of keys of their category (0 if there are none)."""
    seen = latest.where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    return asked.join(seen, "category", "left").withColumn("available", F.coalesce("available", F.lit(0)))


def quota_sample(latest: DataFrame, asked: DataFrame, request: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: request, key, category. report: the targets with quota, available, sampled and deficit.

    latest: key, category (latest_category). asked: request, category, quota (quotas). Of several targets with one request and
    category the largest quota counts. Each category is filled to its quota or, if that is more than it has, whole."""
    latest = settle(latest.where("category is not null"), "quota-latest")
    known = settle(availability(latest, asked), "quota-targets")
    need = known.where("category is not null").groupBy(F.col(request).alias("_request"), "category").agg(F.max("quota").alias("quota"), F.max("available").alias("available"))
    sure = F.col("quota") + SLACK * F.sqrt("quota") + SLACK * SLACK
    share = F.when(F.col("available") > 0, sure / F.col("available")).otherwise(1.0)
    edge = F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex((share * 16**DIGITS).cast("bigint"))), DIGITS, "0"))
    need = settle(need.where("quota > 0").withColumn("_edge", edge), "quota-need")

    def accepted(rule: DataFrame) -> DataFrame:
        every = latest.join(broadcast_if_small(rule, 100_000), "category")
        drawn = every.withColumn("_h", salted_hash(F.concat_ws(":", F.col("_request").cast("string"), "key"), salt)).where(F.col("_h") < F.col("_edge"))
        return drawn.select("_request", "category", "key", "quota", "_h", F.substring("_h", 1, PREFIX).alias("_prefix"))

    count = lambda d: d.groupBy("_request", "category", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    counted = settle(count(accepted(need)), "quota-counts")
    got = counted.groupBy("_request", "category").agg(F.sum("_n").alias("_got"))
    checked = need.join(got, ["_request", "category"], "left")
    short = F.coalesce("_got", F.lit(0)) < F.least("quota", "available")
    if not checked.where(short).isEmpty():
        need = settle(checked.withColumn("_edge", F.when(short, F.lit("g")).otherwise(F.col("_edge"))).drop("_got"), "quota-need")
        counted = settle(count(accepted(need)), "quota-counts")
    before = F.sum("_n").over(W.partitionBy("_request", "category").orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1))
    room = counted.join(need.select("_request", "category", "quota"), ["_request", "category"]).withColumn("_room", F.col("quota") - F.coalesce(before, F.lit(0)))
    room = room.where("_room > 0").select("_request", "category", "_prefix", "_n", "_room")
    drawn = accepted(need).join(broadcast_if_small(room, 500_000), ["_request", "category", "_prefix"])
    whole = drawn.where("_n <= _room").select(F.col("_request").alias(request), "key", "category")
    rank = F.row_number().over(W.partitionBy("_request", "category", "_prefix").orderBy("_h", "key"))
    partly = drawn.where("_n > _room").withColumn("_rank", rank).where("_rank <= _room").select(F.col("_request").alias(request), "key", "category")
    sample = settle(whole.unionByName(partly), "quota-sample")
    made = sample.groupBy(F.col(request).alias("_request"), "category").agg(F.count(F.lit(1)).alias("sampled"))
    report = known.join(made, (known[request] == made["_request"]) & (known["category"] == made["category"]), "left").drop(made["category"]).drop("_request")
    report = report.withColumn("sampled", F.coalesce("sampled", F.lit(0))).withColumn("deficit", F.greatest(F.col("quota") - F.col("sampled"), F.lit(0)))
    return sample, report
