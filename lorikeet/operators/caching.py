"""The exact-match answer cache as a keyed table with a time to live, and request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.config import DEFAULTS
from lorikeet.functions import text as tx


def latest_entries(cache: DataFrame, now: Column, ttl_s: int = DEFAULTS.cache_ttl_s) -> DataFrame:
    """K9: the newest entry of each key that has not expired."""
    live = cache.where(F.col("cached_at") > now - F.make_interval(secs=F.lit(ttl_s)))
    return live.groupBy("key").agg(F.max_by(F.struct("answer", "cached_at"), "cached_at").alias("e")).select("key", "e.*")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """K9: the cache with new entries; the newest of a key counts when it is read."""
    return cache.unionByName(entries)


def invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """K9: the cache without the keys."""
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def evict(entries: DataFrame, max_bytes: int, used: str = "used_at", size: str = "bytes") -> DataFrame:
    """The entries that stay in a cache of limited size: the last used, as far as their sizes add up.

    Sizes are summed up per range of the time of use first, then within a range, so no task sorts all entries.
    """
    placed = entries.repartitionByRange(F.col(used).desc()).withColumn("__pid", F.spark_partition_id())
    before = placed.groupBy("__pid").agg(F.sum(size).alias("__s")).select("__pid", (F.sum("__s").over(W.orderBy("__pid")) - F.col("__s")).alias("__before"))
    inside = W.partitionBy("__pid").orderBy(F.col(used).desc(), "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = placed.withColumn("__upto", F.sum(size).over(inside)).join(before, "__pid")
    return upto.where(F.col("__upto") + F.col("__before") <= max_bytes).drop("__pid", "__upto", "__before")


def lookup(requests: DataFrame, entries: DataFrame, available: bool = True) -> DataFrame:
    """Adds ``cached_answer``: by the condensed question's key, otherwise by the original's; null in an outage."""
    if not available:
        return requests.withColumn("cached_answer", F.lit(None).cast("string"))
    a = entries.select(F.col("key").alias("__k1"), F.col("answer").alias("__a1"))
    b = entries.select(F.col("key").alias("__k2"), F.col("answer").alias("__a2"))
    rows = requests.withColumn("__c", tx.cache_key(F.col("role"), F.col("condensed"))).withColumn("__o", tx.cache_key(F.col("role"), F.col("question")))
    return rows.join(a, rows["__c"] == a["__k1"], "left").join(b, F.col("__o") == b["__k2"], "left").withColumn("cached_answer", F.coalesce("__a1", "__a2")).drop("__c", "__o", "__k1", "__k2", "__a1", "__a2")


def hits_over_time(requests: DataFrame, key: str = "key", ts: str = "ts", ttl_s: int = DEFAULTS.cache_ttl_s) -> DataFrame:
    """Adds ``hit``: whether the request before with the same key is at most ``ttl_s`` old (each request refreshes its entry)."""
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(W.partitionBy(key).orderBy(ts)))
    return requests.withColumn("hit", F.coalesce(gap <= ttl_s * 1_000_000, F.lit(False)))


def rate_limited(requests: DataFrame, client: str = "user_id", ts: str = "ts", unit: str = "minute", limit: int = DEFAULTS.rate_per_minute) -> DataFrame:
    """Adds ``allowed``: the first ``limit`` requests of a client in each clock window are."""
    w = W.partitionBy(client, F.date_trunc(unit, F.col(ts))).orderBy(ts)
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)
