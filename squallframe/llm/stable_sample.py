"""A sample that stays as data grows: stratified hash thresholds.

A key is in the sample of a stratum if its salted hash lies below the stratum's threshold. Hash and thresholds depend on
nothing but key, salt and rate, so reruns and partitionings agree. A key belongs to every stratum that any of its rows names:
rows that come later can only add strata, so a selected key is never lost. Thresholds are kept in a ledger, a table to which entries
are only ever appended, and the highest counts: raising a rate adds keys, and a lower rate, written later, removes none. An entry
for OTHER holds for every stratum, with or without entries of its own, as that is the rate it had before it got one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stratum of ledger entries that hold for all strata.
OTHER = "*"
#: Hexadecimal digits of the hash that are compared: 60 bits.
DIGITS = 15


def salted_hash(key: Column, salt: str) -> Column:
    """The first 60 bits of md5(salt:key), as hexadecimal digits; texts of equal length compare like the numbers."""
    return F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, DIGITS)


def threshold(rate: float) -> str:
    """The bound below which a share ``rate`` of all hashes lies; "g" is above every hash."""
    if not rate >= 0:
        raise ValueError(f"a rate is a number from 0 to 1, not {rate}")
    return "g" if rate >= 1 else format(int(rate * 16**DIGITS), f"0{DIGITS}x")


def highest_rates(ledger: list[tuple[str | None, float]]) -> dict[str | None, float]:
    """The rate of each stratum and of OTHER: the highest that the ledger ever gave it, and at least the one of OTHER."""
    out: dict[str | None, float] = {OTHER: 0.0}
    for stratum, rate in ledger:
        out[stratum] = max(rate, out.get(stratum, 0.0))
    return {stratum: max(rate, out[OTHER]) for stratum, rate in out.items()}


def keep_rates(spark: SparkSession, at: str, entries: list[tuple[str | None, float]]) -> list[tuple[str | None, float]]:
    """Append to the ledger table at ``at`` the entries that it lacks, and return what it holds: of each stratum the highest rate.
    Nothing is ever removed: an entry that the caller no longer names stays in force. Two callers may append at once; the worst
    is an entry that stands twice. Strata are few by nature; the table is reduced to one row for each before it is read."""
    for _, rate in entries:
        threshold(rate)
    schema = "stratum string, rate double"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def held() -> dict[str | None, float]:
        return {r.stratum: r.rate for r in spark.read.schema(schema).parquet(at).groupBy("stratum").agg(F.max("rate").alias("rate")).collect()}

    before = held() if there else {}
    more = [(s, float(r)) for s, r in dict.fromkeys(entries) if r > before.get(s, -1.0)]
    if more or not there:
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(at)
        before = held()
    return list(before.items())


def stable_sample(rows: DataFrame, key: Column, stratum: Column, ledger: list[tuple[str | None, float]], salt: str) -> DataFrame:
    """(key, stratum, key_hash): each selected key once in each stratum whose threshold it passes.

    The ledger lists (stratum, rate); a stratum that it lacks has the rate of OTHER, and None stands for rows without one. Rows
    with a null or empty key are no members. Repeated rows change nothing. Keys are filtered before the only shuffle, which
    removes repeats of the selected ones and combines on the map side."""
    rates = highest_rates(ledger)
    bound = F.lit(threshold(rates[OTHER]))
    for name, rate in rates.items():
        if name is not None and name != OTHER:
            bound = F.when(F.col("stratum") == name, F.lit(threshold(rate))).otherwise(bound)
    bound = F.when(F.col("stratum").isNull(), F.lit(threshold(rates.get(None, rates[OTHER])))).otherwise(bound)
    named = rows.select(key.alias("key"), stratum.alias("stratum")).where("key is not null and key <> ''")
    return named.withColumn("key_hash", salted_hash(F.col("key"), salt)).where(F.col("key_hash") < bound).select("key", "stratum", "key_hash").distinct()
