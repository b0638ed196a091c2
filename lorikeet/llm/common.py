"""Shared helpers of the training-data operators: inputs, scratch tables, column names, hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: White space that separates words: space and U+0009 to U+000D. Everything else belongs to a word.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"
WORD_SPACE_CHARS = " \t\n\x0b\f\r"
#: A group of at most this many rows is never hot.
LEAST_HOT = 1000
#: Bytes of text that a Python worker takes in hand at a time; a longer text is taken alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where a session on one machine names none, a folder of the warehouse serves, which all share as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_root(spark: SparkSession) -> str:
    """One folder per application, named by its id."""
    return f"{shared_dir(spark)}/lorikeet-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; to be called once results are written.

    The frames that operators return read their scratch tables, so those stay until then.
    """
    _delete(spark, scratch_root(spark))


class Scratch:
    """Tables written to the shared folder to cut lineage; each can be dropped once superseded."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0. Stays inside generated code."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_SPACE))).cast("long")


# ---------------------------------------------------------------- names of columns


def places(docs: DataFrame) -> list[str]:
    """A name by place for each column: c0, c1 and so on."""
    return [f"c{i}" for i in range(len(docs.columns))]


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place, so that no name of an operator's own can clash."""
    return docs.toDF(*places(docs))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and end rows of successive slices of at most ``most`` bytes of text, or of one row; all rows are in one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def with_outputs(docs: DataFrame, text_col: str, names: list[str], kinds: str, run: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``docs`` and columns computed from its texts, a slice at a time; input columns called ``names`` are replaced.

    Batches have a number of rows, whatever their texts' size, so they are cut into ``slices``, and a text
    that is a string already is sent once. ``kinds``: their types, as a DDL string. ``run`` is called once per task and gives the function of batches.
    """
    docs = docs.drop(*names)
    fields = StructType.fromDDL(kinds).fields
    plain, at, width = by_place(docs), docs.columns.index(text_col), len(docs.columns)
    if not isinstance(docs.schema[at].dataType, StringType):
        plain, at = plain.withColumn("t", F.col(f"c{at}").cast("string")), width
    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), *fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = run()
        for b in batches:
            for first, end in slices(b.column(at)):
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *each(part.column(at))], names=schema.names)

    return plain.mapInArrow(mapped, schema).toDF(*docs.columns, *names)


# ---------------------------------------------------------------- hot keys


def hot_limit(spark: SparkSession, total: int) -> int:
    """Rows from which a group is hot; fewer than 4 groups per shuffle partition can be."""
    return max(LEAST_HOT, total // (4 * shuffle_partitions(spark)))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, limit: int, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, which has one row for each of the keys and their number of rows, ``size``.

    The rows of a group with over ``limit`` are dealt, by a hash of ``by``, to as many shares as it has
    limits, and its one row is copied to each; so no task reads a group whole. ``size`` is dropped.
    """
    shares = F.ceil(F.col(size) / F.lit(float(limit))).cast("int")
    hot = F.broadcast(groups.where(F.col(size) > limit).select(*keys, shares.alias("__shares")))  # fewer than all rows / limit
    dealt = rows.join(hot, keys, "left").withColumn("__share", F.when(F.col("__shares").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("__shares")).cast("int"))).drop("__shares")
    copies = groups.withColumn("__share", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > limit, shares - 1).otherwise(F.lit(0))))).drop(size)
    return dealt.join(copies, [*keys, "__share"], how).drop("__share")
