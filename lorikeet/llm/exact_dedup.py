"""Exact deduplication by content sort.

Sampled splitters deal the normalised texts to ranges, Spark's external sorter puts equal texts next
to each other, and the window operator compares each row with its neighbour in full. A text that
many rows share would fill one range, so such texts (found by a pre-aggregated count of 64-bit
digests; at most ``4 * partitions`` can exist) carry a salt: their copies spread over ranges and
their group is summed up on the map side before anything moves. No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.llm.common import shuffle_partitions, table


#: Characters of a text that a splitter holds.
HEAD = 32


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty, and all empty texts are equal. Rows with null id lose to any other; of
    rows that repeat both id and text just one is kept; a group with null ids only keeps one of them
    and has a null ``keep_id``. Empty input gives no rows. Other columns are neither read nor returned.
    ``keep``: "smallest" or "largest" id of equal texts stays.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), (normalise(text) if normalise else text).alias("__t"))

    # More than 1 / (4 n) of all rows: so there are fewer than 4 n such digests, whatever the input.
    least = max(32, rows.count() // (4 * n))
    hot = rows.groupBy(F.xxhash64("__t").alias("__h")).count().where(F.col("count") > least).select("__h", F.lit(True).alias("__hot"))
    rows = rows.withColumn("__h", F.xxhash64("__t")).join(F.broadcast(hot), "__h", "left")

    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("__id", F.lit("salt")), F.lit(4 * n))).otherwise(F.lit(0))
    same = W.partitionBy("__head", "__h", "__salt", "__t")
    order = same.orderBy(F.col("__id").asc_nulls_last() if keep == "smallest" else F.col("__id").desc_nulls_last())
    sorted_rows = (
        # Splitters are sampled from the first characters and a digest, not from whole texts, which the
        # driver would have to hold; equal texts still share a range, and are compared in full there.
        rows.withColumn("__salt", salt)
        .withColumn("__head", F.substring("__t", 1, HEAD))
        .repartitionByRange("__head", "__h", "__salt")
        .select(
            "__id",
            "__hot",
            F.sha2("__t", 256).alias("text_sha256"),
            F.row_number().over(order).alias("__rn"),
            F.first("__id").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__keep"),
            F.count(F.lit(1)).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__size"),
        )
    )
    whole = rows.where("__hot").groupBy("__t").agg(best("__id").alias("__all_keep"), F.count(F.lit(1)).alias("__all_size")).select(F.sha2("__t", 256).alias("text_sha256"), "__all_keep", "__all_size", F.lit(True).alias("__hot"))
    out = sorted_rows.join(F.broadcast(whole), ["text_sha256", "__hot"], "left")
    keep_id = F.when(F.col("__all_size").isNotNull(), F.col("__all_keep")).otherwise(F.col("__keep"))
    return out.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("__all_size", "__size").cast("long").alias("group_size"),
        (F.col("__id").eqNullSafe(keep_id) & (F.col("__rn") == 1)).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS rn
  FROM documents)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
