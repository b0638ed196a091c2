"""Sinks: the chunk table, narrative files, append-only rows, caches, objects, responses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.config import DEFAULTS

CHUNKS = "file_name string, section string, chunk_index int, page int, element_type string, text string, file_hash string, extraction_strategy string, source_type string, endpoint string, item_id string, total_chunks int, vec array<float>"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; one that ``replace`` had moved aside when it was interrupted is moved back."""
    fs, at = _fs(spark, path)
    if not fs.exists(at) and fs.exists(aside := _fs(spark, path.rstrip("/") + "__old")[1]):
        fs.rename(aside, at)
    return fs.exists(at)


def ensure_table(spark: SparkSession, path: str, schema: str = CHUNKS) -> DataFrame:
    """The table at ``path``, created empty if it isn't there; columns that it lacks read as null."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """K3, K8."""
    rows.write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str, keys: tuple[str, ...] = ("file_name", "chunk_index")) -> None:
    """K2: rows take the place of those with the same keys."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return append(rows, path)
    there = spark.read.parquet(path)
    old = there.alias("t").join(rows.select(*keys).distinct().alias("n"), on=[F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], how="left_anti")
    replace(old.unionByName(rows, allowMissingColumns=True), path)


def replace(rows: DataFrame, path: str) -> None:
    """K4, K5: writes a table anew beside the old one, moves the old one aside and the new one into its place.

    ``rows`` may read the old one. At every moment one of them is whole; ``exists`` finds it.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    rows.write.mode("overwrite").parquet(f"{path}__new")
    (fs, at), fresh, aside = _fs(spark, path), _fs(spark, f"{path}__new")[1], _fs(spark, f"{path}__old")[1]
    if fs.exists(at):
        fs.delete(aside, True)
        _move(fs, at, aside)
    _move(fs, fresh, at)
    fs.delete(aside, True)


def _move(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"can't move {a} to {b}")


def count(spark: SparkSession, path: str) -> int:
    """K6: rows of a table; 0 if it isn't there."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each row (path, content binary) to a file below ``root`` and returns path and ``error``, null where it was written.

    Tasks write beside the target and move into place, so a repeated attempt does no harm. Paths that lead out of
    ``root`` are errors, as is a row that can't be written; others go on. The write happens as rows are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for b in batches:
            errors = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if not path or path.startswith("/") or ".." in path.split("/"):
                        raise ValueError("path is not safe")
                    at = f"{base.rstrip('/')}/{path}"
                    aside = f"{at}.tmp{uuid.uuid4().hex}"
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(aside) as out:
                        out.write(data or b"")
                    store.move(aside, at)
                    errors.append(None)
                except Exception as e:  # one bad item doesn't stop the rest
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], names=["path", "error"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, error string")


def write_narratives(items: DataFrame, root: str) -> DataFrame:
    """K7: a file ``<endpoint>/<label>.txt`` for each row with a narrative; endpoint, written, skipped and errors, counted.

    A summary is an item labelled ``summary``; Spark's readers skip names that begin with an underscore.
    """
    rows = items.withColumn("path", F.concat("endpoint", F.lit("/"), "label", F.lit(".txt")))
    empty = F.coalesce("narrative", F.lit("")) == ""
    done = write_files(rows.where(~empty).select("path", F.col("narrative").cast("binary").alias("content")), root).withColumn("skipped", F.lit(False))
    done = done.unionByName(rows.where(empty).select("path", F.lit(None).cast("string").alias("error"), F.lit(True).alias("skipped")))
    counts = done.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("endpoint")).agg(F.count_if(F.col("error").isNull() & ~F.col("skipped")).alias("written"), F.count_if("skipped").alias("skipped"), F.count("error").alias("errors"))
    return counts


def extract_pdfs(entries: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Writes the PDFs that ``readers.zip_entries`` found new or to be overwritten; counts by status. A dry run counts only."""
    wanted = entries.where(F.col("status").isin("extracted", "overwritten"))
    rest = entries.where(~F.col("status").isin("extracted", "overwritten")).select("status")
    if dry_run:
        done = wanted.select("status")
    else:
        wrote = write_files(wanted.select(F.col("file_name").alias("path"), "content"), root)
        done = wanted.select("file_name", "status").join(wrote, wanted["file_name"] == wrote["path"]).select(F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status")).alias("status"))
    return done.union(rest).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def append_batches(rows: DataFrame, path: str, size: int = DEFAULTS.append_rows) -> None:
    """Numbered rows (no) in batches of ``size``, as partitions of an append-only table."""
    first = rows.agg(F.min("no")).first()[0] or 0
    rows.withColumn("batch", F.floor((F.col("no") - first) / size)).write.mode("append").partitionBy("batch").parquet(path)


def insert_if_empty(spark: SparkSession, rows: DataFrame, path: str) -> bool:
    """K14."""
    if count(spark, path):
        return False
    append(rows, path)
    return True


def object_url(base: str, key: str = "key"):
    """K11."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.col(key))


def put_objects(objects: DataFrame, root: str, base_url: str) -> DataFrame:
    """Stores objects (key, content); key and URL of those that were written, the others are left out."""
    wrote = write_files(objects.select(F.col("key").alias("path"), "content"), root).where("error is null")
    return wrote.select(F.col("path").alias("key")).withColumn("url", object_url(base_url))


def delete_objects(spark: SparkSession, root: str, keys: list[str]) -> int:
    """Removes objects by key; the number that were there."""
    gone = 0
    for key in keys:
        if key and not key.startswith("/") and ".." not in key.split("/"):
            fs, at = _fs(spark, f"{root.rstrip('/')}/{key}")
            gone += bool(fs.exists(at) and fs.delete(at, False))
    return gone


def image_key(session: str = "session_id", content: str = "content", mime: str = "mime"):
    """Where an image of a session is stored: by its hash, so that it is stored once."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (("image/jpeg", "jpg"), ("image/png", "png"), ("image/webp", "webp")) for x in kv]), F.col(mime)), F.lit("bin"))
    return F.concat(F.lit("images/"), F.col(session), F.lit("/"), F.left(F.sha2(content, 256), F.lit(16)), F.lit("."), kind)


def sse_lines(events: DataFrame) -> DataFrame:
    """Events as lines of a text/event-stream."""
    return events.select("request_id", "seq", F.concat(F.lit("data: "), F.to_json(F.struct(*[c for c in events.columns if c not in ("request_id", "seq")])), F.lit("\n\n")).alias("value"))
