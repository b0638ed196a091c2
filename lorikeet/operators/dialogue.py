"""Conversations: pairing answers with questions, history windows and budgets, session roll-ups, sheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.config import DEFAULTS
from lorikeet.functions import text as tx

#: Ranges of numbered rows per shuffle partition, and rows looked at to bound each.
RANGES = 2
PER_RANGE = 16


def pair_answers(messages: DataFrame, session: str = "session_id", order: str = "created_at", cols: tuple[str, ...] = ("id", "content")) -> DataFrame:
    """Each assistant row with the latest user row strictly before it in its session; the unpaired go.

    One pass over a window instead of a self-join; a range frame leaves out rows with equal times. Rows without
    a session or a time pair with none.
    """
    question = F.when((F.col("role") == "user") & F.col(session).isNotNull() & F.col(order).isNotNull(), F.struct(F.col(order).alias("at"), *cols))
    # rows at one time share a rank, so a frame that ends one rank before has just the earlier ones
    ranked = messages.withColumn("__rank", F.dense_rank().over(W.partitionBy(session).orderBy(order)))
    earlier = W.partitionBy(session).orderBy("__rank").rangeBetween(W.unboundedPreceding, -1)
    paired = ranked.withColumn("__q", F.max(question).over(earlier)).where((F.col("role") == "assistant") & F.col("__q").isNotNull())
    return paired.select(*messages.columns, *[F.col(f"__q.{c}").alias(f"question_{c}") for c in cols])


def new_rows(pairs: DataFrame, existing: DataFrame, key: str = "id", existing_key: str = "source_message_id") -> DataFrame:
    """Pairs whose id is not in the sink; ids are canonical UUIDs, others in the sink don't count."""
    known = existing.select(tx.uuid_or_null(F.col(existing_key)).alias("__k")).where("__k is not null").distinct()
    return pairs.join(known, tx.uuid_or_null(F.col(key)) == F.col("__k"), "left_anti")


def next_number(existing: DataFrame, col: str = "no") -> DataFrame:
    """A5: one row, ``start_no``: the largest number plus one; 1 if there is none."""
    return existing.agg((F.coalesce(F.max(F.expr(f"try_cast(try_cast({col} AS DOUBLE) AS INT)")), F.lit(0)) + 1).alias("start_no"))


def number_rows(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """W8. Numbers are dense over all rows in order: rows are counted per range, then within it.

    A row's range follows from its values and from bounds fixed beforehand. Partition ids would not do: the rows
    are read twice, and an adaptive plan coalesces the partitions of each reading in its own way.
    """
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    # the rows with the least hashes only say where ranges end; every row is counted and numbered
    some = rows.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(PER_RANGE * ranges)
    ends = some.agg(F.sort_array(F.collect_list("k")).alias("ks")).select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("ks", (i * F.size("ks") / ranges).cast("int"))).alias("__ends"))
    # a binary search: how many ends are less than the row's key, one bit at a time
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get("__ends", lo + step - 1) < key, lo + step).otherwise(lo))
    placed = rows.join(F.broadcast(ends)).withColumn("__range", at).drop("__ends")
    sizes = placed.groupBy("__range").count().select("__range", (F.sum("count").over(W.orderBy("__range")) - F.col("count")).alias("__before"))
    inside = W.partitionBy("__range").orderBy(*order)
    return placed.withColumn("__rn", F.row_number().over(inside)).join(F.broadcast(sizes), "__range").withColumn("no", (F.col("__rn") + F.col("__before") + (start - 1)).cast("long")).drop("__range", "__rn", "__before")


SHEET = ("no", "question", "images", "created_at", "source_message_id", "model", "answer", "sources", "labeled_by", "intent_predicted", "labeled_quality", "notes_respond", "labeled_intent", "notes_intent")


def sheet_rows(pairs: DataFrame) -> DataFrame:
    """The 14 columns of a review sheet from numbered pairs with debug, sources and question_images."""
    blank = F.lit("")
    values = {"no": F.col("no"), "question": tx.cell(F.col("question_content")), "images": tx.numbered_lines(F.col("question_images")), "created_at": tx.cell(tx.local_timestamp(F.col("created_at"))), "source_message_id": tx.cell(F.col("id")), "model": tx.cell(F.col("debug.model")), "answer": tx.cell(F.col("content")), "sources": tx.sources_text(F.col("sources")), "intent_predicted": tx.intent_text(F.col("debug.intent"), F.col("debug.intent_confidence"))}
    return pairs.select(*[values.get(c, blank).alias(c) for c in SHEET])


def last_turns(messages: DataFrame, turns: int = DEFAULTS.history_turns, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """The newest ``2 * turns`` messages of each session."""
    w = W.partitionBy(session).orderBy(F.col(order).desc())
    return messages.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 2 * turns).drop("__rn")


def budget_trim(messages: DataFrame, tokens: int = DEFAULTS.history_tokens, session: str = "session_id", order: str = "created_at", text: str = "content") -> DataFrame:
    """Drops the oldest messages until the rest fits the budget; two always stay."""
    w = W.partitionBy(session).orderBy(F.col(order).desc())
    total = F.sum(F.length(F.coalesce(text, F.lit("")))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = messages.withColumn("__sum", total).withColumn("__rn", F.row_number().over(w))
    return kept.where((F.col("__sum") <= DEFAULTS.chars_per_token * tokens) | (F.col("__rn") <= 2)).drop("__sum", "__rn")


def repeat_run(messages: DataFrame, session: str = "session_id", order: str = "created_at", value: Column | None = None) -> DataFrame:
    """Length of the run of equal values at the end of each session."""
    value = tx.light_normalise(F.col("content")) if value is None else value
    newest = W.partitionBy(session).orderBy(F.col(order).desc())
    rows = messages.withColumn("__v", value).withColumn("__last", F.first("__v").over(newest))
    rows = rows.withColumn("__other", F.sum((~F.col("__v").eqNullSafe(F.col("__last"))).cast("int")).over(newest.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(session).agg(F.count_if(F.col("__other") == 0).alias("repeats"))


def session_rollup(messages: DataFrame, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """Latest message and number of answers."""
    return messages.groupBy(session).agg(F.max(order).alias("last_message_at"), F.count_if(F.col("role") == "assistant").alias("message_count"))


def insert_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """K8: the log with new user and assistant messages; an id that is there already stays as it is."""
    fresh = new.where(F.col("role").isin("user", "assistant")).join(messages.select("id"), "id", "left_anti")
    return messages.unionByName(fresh, allowMissingColumns=True)


def touch_sessions(sessions: DataFrame, new: DataFrame, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """K8: sessions (id, last_message_at, message_count) after new messages; only answers count."""
    seen = session_rollup(new, session, order).select(F.col(session).alias("id"), F.col("last_message_at").alias("__at"), F.col("message_count").alias("__n"))
    touched = sessions.join(seen, "id", "left")
    return touched.withColumn("last_message_at", F.greatest("last_message_at", "__at")).withColumn("message_count", F.coalesce("message_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__at", "__n")


def recent_sessions(sessions: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """A user's latest sessions that aren't archived."""
    return sessions.where((F.col("user_username") == user) & ~F.coalesce("is_archived", F.lit(False))).orderBy(F.col("last_message_at").desc_nulls_last(), "id").limit(limit)


def lookup_users(first: DataFrame, second: DataFrame, key: str = "username") -> DataFrame:
    """Users of the first table, and of the second those that the first lacks."""
    return first.unionByName(second.join(first, key, "left_anti"), allowMissingColumns=True)


def delete_cascade(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in ``gone`` (id)."""
    return sessions.join(gone, "id", "left_anti"), messages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti")
