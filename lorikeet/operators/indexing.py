"""Keeping the chunk table up to date: hash diff, application, deletion, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def one_hash(chunks: DataFrame, key: str = "file_name") -> DataFrame:
    """A3: a hash per file; of several the largest."""
    return chunks.groupBy(key).agg(F.max("file_hash").alias("file_hash"))


def hash_diff(current: DataFrame, indexed: DataFrame, key: str = "file_name", force: bool = False) -> DataFrame:
    """Key, ``status`` (new, changed, unchanged, removed) from a full outer join; ``force``: what is there counts as changed."""
    a, b = current.select(key, F.col("file_hash").alias("now")), indexed.select(key, F.col("file_hash").alias("was"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "new").when(F.col("now").isNull(), "removed").when(F.lit(force) | (F.col("now") != F.col("was")), "changed").otherwise("unchanged")
    return both.select(key, status.alias("status"), F.col("now").alias("file_hash"))


def apply_diff(chunks: DataFrame, fresh: DataFrame, diff: DataFrame, key: str = "file_name", purge: bool = False) -> DataFrame:
    """The chunk table without changed (and, to ``purge``, removed) files, and the fresh chunks of new and changed ones."""
    gone = ["changed", "removed"] if purge else ["changed"]
    kept = chunks.join(diff.where(F.col("status").isin(gone)).select(key), key, "left_anti")
    added = fresh.join(diff.where(F.col("status").isin("new", "changed")).select(key), key, "left_semi")
    return kept.unionByName(added, allowMissingColumns=True)


def missing_narratives(texts: DataFrame, indexed: DataFrame, force: bool = False, key: tuple[str, ...] = ("endpoint", "file_name")) -> DataFrame:
    """Texts that aren't indexed, by endpoint and file name."""
    return texts if force else texts.join(indexed.select(*key).distinct(), list(key), "left_anti")


def endpoint_counts(texts: DataFrame, indexed: DataFrame, key: tuple[str, ...] = ("endpoint", "file_name")) -> DataFrame:
    """Total, new and skipped per endpoint."""
    seen = indexed.select(*key).distinct().withColumn("__seen", F.lit(True))
    return texts.join(seen, list(key), "left").groupBy(key[0]).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("__seen").isNull()).alias("new"), F.count_if(F.col("__seen").isNotNull()).alias("skipped"))


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """K4: rows for which the predicate is false or null."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def status_counts(rows: DataFrame, col: str = "status") -> DataFrame:
    """A7, A8."""
    return rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def check_vectors(chunks: DataFrame, dim: int, col: str = "vec") -> DataFrame:
    """K1: the table with a column that fails the query if a vector has another size."""
    return chunks.withColumn(col, F.when(F.col(col).isNull() | (F.size(col) == dim), F.col(col)).otherwise(F.raise_error(F.lit(f"a vector must have {dim} numbers"))))
