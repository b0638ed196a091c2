"""Line deduplication over a distributed suffix array of lines.

Every line of every document is a symbol (its 128-bit digest); a suffix starts at each line. Prefix
doubling ranks suffixes by their first 1, 2, 4, ... lines: a round takes the pairs (rank, rank of the
suffix that many lines on), counts equal pairs on the map side, range-partitions and sorts the distinct
pairs, and gives each the place where its group begins, by prefix sums over ranges. A suffix alone in
its group repeats nothing and leaves the rounds.

Suffixes that share their first w lines form an interval of the array with longest common prefix w or
more; two overlapping blocks of 2**m lines name it exactly. It is enough to look at intervals where w is
just enough lines for MIN_WORDS words, counted from a run's start or back from its end: together they
cover every line of every maximal repeated run with at least that many words, however long it is.
Within an interval all but the earliest suffix are later copies, and their lines go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lorikeet.llm.common import Scratch, by_place, hot_limit, join_groups, table

MIN_WORDS = 50
NO_ID = (1 << 63) - 1
DOC = ["__id", "__h"]


def line_windows(words: np.ndarray, least: int) -> np.ndarray:
    """(start, lines) of the shortest windows with ``least`` words from each line on, and back from each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least)  # first end with enough words
    on = np.stack([n, end - n], axis=1)[end <= len(words)]
    start = np.searchsorted(total, total[1:] - least, side="right") - 1  # last start with enough words
    back = np.stack([start, n + 1 - start], axis=1)[start >= 0]
    return np.unique(np.concatenate([on, back]), axis=0)


def keyed(plain: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds DOC: the id (null last) and a hash that tells rows with equal ids apart by their texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return plain.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__h", F.xxhash64(text, F.col(id_col).isNull()))


def lines_and_windows(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """Rows of two kinds per document: lines (w is 0; hi and lo are the digest) and windows (w lines from ``line``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, line, w, hi, lo = [], [], [], [], []
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                lines = (text or b"").split(b"\n")
                digests = np.frombuffer(b"".join(hashlib.md5(x, usedforsecurity=False).digest() for x in lines), np.int64).reshape(-1, 2)
                windows = line_windows(np.array([len(x.split()) for x in lines], np.int64), least)
                none = np.zeros(len(windows), np.int64)
                doc.append(np.full(len(lines) + len(windows), i))
                line += [np.arange(len(lines)), windows[:, 0]]
                w += [np.zeros(len(lines), np.int64), windows[:, 1]]
                hi += [digests[:, 0], none]
                lo += [digests[:, 1], none]
            rows = pa.array(np.concatenate(doc)) if doc else pa.array([], pa.int64())
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (line, w, hi, lo)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *cols], names=[*DOC, "line", "w", "hi", "lo"])

    return docs.select(*DOC, F.col(text_col).cast("string")).mapInArrow(run, "__id long, __h long, line long, w long, hi long, lo long")


def group_ranks(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``__id, __h, line, rank`` of rows whose keys are not alone: rank is the number of rows in groups before theirs."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").repartitionByRange(*keys)
    counted = scratch.keep(counted.withColumn("pid", F.spark_partition_id()))
    sums = counted.groupBy("pid").agg(F.sum("n").alias("s"))
    before = sums.select("pid", (F.sum("s").over(W.orderBy("pid")) - F.col("s")).alias("before"))
    ranks = counted.join(F.broadcast(before), "pid")  # a row per partition
    ranks = ranks.select(*keys, "n", (F.col("before") + F.sum("n").over(W.partitionBy("pid").orderBy(*keys)) - F.col("n")).alias("new"))
    limit = hot_limit(rows.sparkSession, sums.agg(F.sum("s")).first()[0] or 0)
    out = scratch.keep(join_groups(rows, ranks, keys, "n", limit, [*DOC, "line"]).select(*DOC, "line", F.col("new").alias("rank")))
    scratch.drop(counted)
    return out


def later_copies(docs: DataFrame, text_col: str, least: int, scratch: Scratch) -> DataFrame:
    """``__id, __h, line, w``: windows that also stand earlier; ``docs`` has DOC."""
    # rows that repeat id and text are one document
    rows = scratch.keep(lines_and_windows(docs, text_col, least).groupBy(*DOC, "line", "w").agg(F.min("hi").alias("hi"), F.min("lo").alias("lo")))
    level = group_ranks(rows.where("w = 0"), ["hi", "lo"], scratch)
    windows = scratch.keep(rows.where("w > 0").join(level.select(*DOC, "line"), [*DOC, "line"], "left_semi").select(*DOC, "line", "w"))
    scratch.drop(rows)
    widest = windows.agg(F.max("w")).first()[0] or 0
    found, k = [], 1
    while k <= widest:
        here = windows.where((F.col("w") >= k) & (F.col("w") < 2 * k))
        named = here.join(level.withColumnRenamed("rank", "r1"), [*DOC, "line"]).withColumn("second", F.col("line") + F.col("w") - k)
        named = scratch.keep(named.join(level.select(*DOC, F.col("line").alias("second"), F.col("rank").alias("r2")), [*DOC, "second"]))
        place = F.struct(*DOC, "line")
        first = scratch.keep(named.groupBy("r1", "r2", "w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        limit = hot_limit(docs.sparkSession, first.agg(F.sum("n")).first()[0] or 0)
        found.append(scratch.keep(join_groups(named, first, ["r1", "r2", "w"], "n", limit, [*DOC, "line"]).where(place > F.col("first")).select(*DOC, "line", "w")))
        scratch.drop(named)
        scratch.drop(first)
        if 2 * k <= widest:
            pairs = level.withColumnRenamed("rank", "r1").join(level.select(*DOC, (F.col("line") - k).alias("line"), F.col("rank").alias("r2")), [*DOC, "line"])
            after = group_ranks(pairs, ["r1", "r2"], scratch)
            scratch.drop(level)
            level = after
        k *= 2
    out = windows.limit(0)
    for x in found:
        out = out.unionByName(x)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines taken out of the text, and ``n_lines``, ``removed``.

    removed: (first line, end) of what was taken out. A run counts if it has at least ``min_words`` words
    (at least 1), in one line or several; the first copy by id, then by line, stays whole. Lines are
    equal if their bytes are. Null text stays null and has one empty line. Rows that repeat id and text
    are one document; of rows that repeat an id with other texts the order is by hash. Rows with null id
    come last; ids are whole numbers. A text whose lines all go becomes empty. Empty input gives no rows.
    Other columns may have any names; input columns called n_lines or removed are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "removed")
    at, last = docs.columns.index(text_col), len(docs.columns)
    plain = by_place(docs)
    own = keyed(plain, f"c{docs.columns.index(id_col)}", f"c{at}")
    spans = later_copies(own, f"c{at}", max(1, min_words), scratch).groupBy(*DOC).agg(F.collect_list(F.struct("line", "w")).alias("__spans"))
    joined = own.join(spans, DOC, "left").select(*plain.columns, "__spans")
    removed = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, gone = [], [], []
            for text, found in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                counts.append(len(lines))
                change = np.zeros(len(lines) + 1, np.int64)
                for s in found or ():
                    change[s["line"]] += 1
                    change[s["line"] + s["w"]] -= 1
                out = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                gone.append([{"first": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                texts.append("\n".join(x for x, o in zip(lines, out.tolist(), strict=True) if not o) if found else text)
            cols = list(b.columns[:last])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(gone, removed)], names=[*(f"c{i}" for i in range(last)), "n_lines", "removed"])

    fields = [StructField(f"c{i}", StringType() if i == at else f.dataType) for i, f in enumerate(docs.schema)]
    done = joined.mapInArrow(run, StructType([*fields, *StructType.fromDDL("n_lines long, removed array<struct<first:long,end:long>>").fields]))
    return done.toDF(*docs.columns, "n_lines", "removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return done.select("doc_id", "n_lines", gone.alias("removed_lines"), F.length(text).cast("long").alias("clean_chars"), F.sha2(text, 256).alias("clean_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, ls, i, len(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (
  SELECT doc_id, ls, i, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
         sum(words) OVER (PARTITION BY doc_id ORDER BY i) - words AS before
  FROM l),
w AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e, any_value(a.ls) AS ls
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i), b.i, any_value(a.ls)
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY b.doc_id, b.i),
f AS (
  SELECT *, row_number() OVER (PARTITION BY ls[s:e] ORDER BY doc_id, s) AS copy FROM w),
g AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE copy > 1),
t AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS removed_lines,
         coalesce(string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS clean
  FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT doc_id, n_lines, removed_lines, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256 FROM t
"""
