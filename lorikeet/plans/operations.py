"""Queries over sessions, private data, telemetry and progress, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorikeet.functions import text as tx
from lorikeet.operators import caching, dialogue, guard
from lorikeet.plans.catalogue import query
from lorikeet.sources.readers import table
from lorikeet.streaming import jobs


@query("""
WITH e AS (SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'),
o AS (SELECT * FROM e WHERE turn % 3 <> 0), n AS (SELECT * FROM e WHERE turn % 3 = 0),
s AS (SELECT conv_id, max(turn) AS at, count(*) FILTER (WHERE role = 'assistant') AS k FROM o GROUP BY conv_id),
t AS (SELECT conv_id, max(turn) AS at, count(*) FILTER (WHERE role = 'assistant') AS k FROM n GROUP BY conv_id)
SELECT s.conv_id, greatest(s.at, coalesce(t.at, s.at)) AS last_message_at, s.k + coalesce(t.k, 0) AS message_count FROM s LEFT JOIN t USING (conv_id)""")
def session_touch(spark, sf_dir):
    """Every third message is new; the sessions are those of the others."""
    m = table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role")
    old, new = m.where("created_at % 3 <> 0"), m.where("created_at % 3 = 0")
    sessions = dialogue.session_rollup(old).withColumnRenamed("session_id", "id")
    return dialogue.touch_sessions(sessions, new).select(F.col("id").alias("conv_id"), "last_message_at", "message_count")


@query("""
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'get_info_private_unauthenticated' WHEN 1 THEN 'get_info_private_unauthorized' WHEN 2 THEN 'get_info_private_error' WHEN 3 THEN 'get_info_private' END AS mode,
  CASE turn % 5 WHEN 3 THEN CASE conv_id % 3 WHEN 0 THEN concat('Your grade average is **3.', conv_id % 9, '** with **', conv_id, ' credits**.')
    WHEN 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'Your study plan is empty.' ELSE concat('Your study plan:', chr(10), '- C', conv_id, ' (3 credits)', chr(10), '- D (? credits)') END
    ELSE concat('Your data: {"n":', conv_id, '}') END END AS answer
FROM conversations""")
def private_answer(spark, sf_dir):
    """Each case of the private route by turn, each tool's answer by conversation."""
    n, c = F.col("turn") % 5, F.col("conv_id")
    data = F.when(c % 3 == 0, F.concat(F.lit('{"ipk": "3.'), (c % 9).cast("string"), F.lit('", "total_sks": "'), c.cast("string"), F.lit('"}'))).when(c % 3 == 1, F.when(c % 2 == 0, '{"courses": []}').otherwise(F.concat(F.lit('{"courses": [{"name": "C'), c.cast("string"), F.lit('", "sks": "3"}, {"name": "D"}]}')))).otherwise(F.concat(F.lit('{"n":'), c.cast("string"), F.lit("}")))
    tool = F.when(c % 3 == 0, "get_ipk").when(c % 3 == 1, "get_krs").otherwise("get_other")
    mode = guard.private_mode(F.when(n == 0, "").otherwise("t"), F.when(n == 1, 401).when(n == 2, 500).otherwise(200), n == 4)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", mode.alias("mode"), guard.private_text(tool, data).alias("text"))
    return rows.select("conv_id", "turn", "mode", F.when(F.col("mode") == "get_info_private", F.col("text")).alias("answer"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('Earlier:', chr(10), role, ': ', text, chr(10), chr(10), 'OFFICIAL INFORMATION', chr(10), 'ctx ', conv_id, chr(10), chr(10), 'Question: ', text)
  ELSE concat('OFFICIAL INFORMATION', chr(10), 'ctx ', conv_id, chr(10), chr(10), 'Question: short ', turn) END AS prompt FROM conversations""")
def prompts(spark, sf_dir):
    """With a history the original question is asked, without one the condensed."""
    history = F.when(F.col("turn") % 2 == 0, F.array(F.struct("role", F.col("text").alias("content"))))
    context, condensed = F.concat(F.lit("ctx "), F.col("conv_id").cast("string")), F.concat(F.lit("short "), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.prompt(history, context, F.col("text"), condensed).alias("prompt"))


@query("""
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type ELSE 'base' END AS model, 'base' AS mode, CASE WHEN user_id % 3 = 0 THEN event_id::VARCHAR END AS seconds FROM events""")
def telemetry_overlay(spark, sf_dir):
    """A base map, over which a third of the events lay their own keys."""
    base = F.create_map(F.lit("model"), F.lit("base"), F.lit("mode"), F.lit("base"))
    own = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("model"), F.col("event_type"), F.lit("seconds"), F.col("event_id").cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", tx.overlay(base, own).alias("m"))
    return rows.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("model", "mode", "seconds")])


@query("""
WITH b AS (SELECT event_id, event_id * 37 AS s, event_id * 97 % 1000003 AS done, 1000003 AS total FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm ', s % 60, 's') WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s, 's') END AS spent,
  concat('[', repeat('#', (done * 30) // total), repeat('.', 30 - (done * 30) // total), '] ', printf('%.1f', done * 100 / total), '%') AS bar,
  round(CASE WHEN s > 0 THEN done / s ELSE 0 END, 6) AS per_second FROM b""")
def progress_text(spark, sf_dir):
    """A job's state at each event."""
    s, done = F.col("event_id") * 37, F.col("event_id") * 97 % 1_000_003
    return table(spark, sf_dir, "events").select("event_id", tx.duration_text(s).alias("spent"), tx.progress_bar(done, F.lit(1_000_003)).alias("bar"), F.round(tx.throughput(done, s), 6).alias("per_second"))


@query("""
WITH e AS (SELECT event_type, date_trunc('minute', ts) AS start, value FROM events)
SELECT event_type, start, count(*) AS requests, count(*) FILTER (WHERE value > 100) AS slow, round(max(value), 4) AS longest FROM e GROUP BY ALL""")
def request_metrics(spark, sf_dir):
    """The events' values as milliseconds of requests."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), "ts", F.col("value").alias("ms"))
    m = jobs.request_metrics(e, slow_ms=100.0)
    return m.select(F.col("path").alias("event_type"), F.col("start").cast("timestamp_ntz").alias("start"), "requests", "slow", F.round("longest", 4).alias("longest"))


@query("""
WITH k AS (SELECT event_type || ':' || user_id AS key, max(event_id) AS last, count(*) * 100 AS bytes FROM events GROUP BY ALL),
s AS (SELECT *, sum(bytes) OVER (ORDER BY last DESC) AS upto FROM k)
SELECT key, last FROM s WHERE upto <= 20000""")
def cache_evicted(spark, sf_dir):
    """What stays of entries of 100 bytes a use in a cache of 20,000 bytes: the last used."""
    e = table(spark, sf_dir, "events").groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")).agg(F.max("event_id").alias("last"), (F.count(F.lit(1)) * 100).alias("bytes"))
    return caching.evict(e, 20_000, used="last").select("key", "last")
