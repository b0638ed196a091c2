"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source, documents stand in the order of that key;
the cumulated word count says which of them the source's budget reaches. Because the keys are
uniform, their leading hex digits cut every source into ranges of even size without sampling, so a
source with a third of all rows is spread over many tasks: sums per range are pre-aggregated, their
prefix sums give each range its offset, and only rows of one range meet in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.llm.common import WORD_SPACE, WORD_SPACE_CHARS, Scratch, by_place, table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-17"
ROWS_A_RANGE = 50_000


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (``__null``, ``__src``, ``source_size``): shares by weight, capped.

    A source's target stops at ``max_epochs`` times its size; the excess goes to the others by weight
    until none is above. With sources ordered by cap over weight, those that stop form a prefix, so
    one pass of prefix sums finds the level. There is one row per source, not per document.
    """
    by_name = W.orderBy("__null", "__src")
    by_cap = W.orderBy(F.col("cap") / F.col("w"), "__null", "__src")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = (
        sources.withColumn("w", weight)
        .withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("ws", F.sum("w").over(after))
        .withColumn("stops", F.col("left") * F.col("w") > F.col("cap") * F.col("ws"))
        .withColumn("level", F.col("left").cast("double") / F.col("ws").cast("double"))
        .withColumn("level", F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(everything))
    )
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return ranked.select("__null", "__src", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def sized_rows(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """What the mix needs of each row: ``doc_id``, the source, the size and the hash-random key."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    source = [F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__src")]
    return docs.select("doc_id", *source, word_count(F.col("text")).alias("size"), key.alias("__key"), *more)


def place_rows(rows: DataFrame, ranges: DataFrame, targets: DataFrame, tie: list[str]) -> DataFrame:
    """``rows`` (with ``__range``) and ``source_size, target, taken``; ``ranges`` has the sum of sizes of each."""
    before = W.partitionBy("__null", "__src").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("__null", "__src", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    ranges = ranges.join(targets, ["__null", "__src"])
    inside = W.partitionBy("__null", "__src", "__range").orderBy("__key", F.col("doc_id").asc_nulls_first(), "size", *tie).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["__null", "__src", "__range"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("__offset") - F.col("__before")))
    return placed.withColumn("taken", (epochs * F.col("size") + last).cast("long"))


def range_digits(n: int) -> int:
    """Hex digits of the key that name a range: at least 256 ranges a source, so that small inputs with one large source are spread as well."""
    return max(2, math.ceil(math.log(max(1, n) / ROWS_A_RANGE, 16)))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    ``taken``: words of the document in the mix: its size for each whole epoch of the source, and in
    the last epoch all, none, or, where the budget ends inside it, its first words. Null texts have
    size 0; a null source is a source of its own; rows with equal ids and sizes are interchangeable.
    Empty input gives no rows. Columns besides doc_id, text and source are ignored.
    """
    rows = Scratch(docs.sparkSession, "mix").keep(sized_rows(docs, seed))
    rows = rows.withColumn("__range", F.substring("__key", 1, range_digits(rows.count())))
    ranges = rows.groupBy("__null", "__src", "__range").agg(F.sum("size").alias("__sum"))
    targets = source_targets(ranges.groupBy("__null", "__src").agg(F.sum("__sum").alias("source_size")), weights, max_epochs)
    return place_rows(rows, ranges, targets, []).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per epoch of a document, cut to its first words where the budget ends.

    Whole rows are carried to their ranges, so each of several rows with one doc_id, or equal in all
    columns, has words of its own and the budget is met exactly. Null texts and texts without words are
    never taken. ``n_chars``, where there is one, is that of the text. Empty input gives no rows.
    """
    scratch, names = Scratch(docs.sparkSession, "mixed"), docs.columns
    # columns go by place inside a struct, so names that the mix uses itself may stand in ``docs``
    plain = by_place(docs)
    at = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "text", "source")}
    plain = plain.select(*(c.alias(k) for k, c in at.items()), F.struct(*plain.columns).alias("__row"))
    digits = range_digits(docs.count())
    light = sized_rows(plain, seed).withColumn("__range", F.substring("__key", 1, digits))
    ranges = scratch.keep(light.groupBy("__null", "__src", "__range").agg(F.sum("size").alias("__sum")))
    targets = source_targets(ranges.groupBy("__null", "__src").agg(F.sum("__sum").alias("source_size")), weights, max_epochs)
    hashed = [f"c{i}" for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    rows = sized_rows(plain, seed, F.col("__row"), F.xxhash64(*(F.col("__row")[c] for c in hashed)).alias("__tie")).withColumn("__range", F.substring("__key", 1, digits))
    rows = place_rows(rows, ranges, targets, ["__tie"]).where("taken > 0")
    size, taken, text = F.col("size"), F.col("taken"), F.col("__row")[f"c{names.index('text')}"]
    copies = F.ceil(taken / size).cast("int")
    out = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.when(F.col("__copy") == copies, taken - (copies - 1) * size).otherwise(size)
    # Split keeps the words; joined again by spaces, only in the one row of a source where the budget ends.
    cut = F.array_join(F.slice(F.split(F.btrim(text, F.lit(WORD_SPACE_CHARS)), WORD_SPACE), 1, words.cast("int")), " ")
    final = F.when(words < size, cut).otherwise(text)
    made = {"text": final, "n_chars": F.length(final).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*((made[c] if c in made else F.col("__row")[f"c{i}"]).alias(f"c{i}") for i, c in enumerate(names))).toDF(*names)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s),
p AS (
  SELECT *,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
l AS (
  SELECT min(rest::DOUBLE / ws::DOUBLE) FILTER (WHERE NOT rest * w > cap * ws AND ord = first_open) AS level
  FROM (SELECT *, min(ord) FILTER (WHERE NOT rest * w > cap * ws) OVER () AS first_open
        FROM (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS ord FROM p))),
t AS (
  SELECT source, source_size,
         coalesce(CASE WHEN rest * w > cap * ws THEN cap::DOUBLE ELSE level * w END, 0.0) AS target
  FROM p, l),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id NULLS FIRST, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
