"""Streams: event windows, rate limits, answers as deltas, polling sync with a sink-side anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.functions import text as tx

#: Folders, by a hash of the key, of a table that a stream is synced to.
SYNC_PARTS = 64


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream; times are zoned, as watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # the file source reads folders; a single file is reached by its name in its folder
    folder, name = (path, "*.parquet") if _is_folder(spark, path) else (sf_dir, "events.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """R11."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def request_windows(events: DataFrame, client: str = "user_id", limit: int = 10, unit: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests per client and window, and how many are over the limit."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", unit), client).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rejected", F.greatest(F.col("n") - limit, F.lit(0)))


def request_metrics(requests: DataFrame, path: str = "path", ms: str = "ms", unit: str = "minute", slow_ms: float = 1000.0) -> DataFrame:
    """Requests, slow ones and the longest, per path and clock window; a stream's times need a watermark."""
    start = F.window("ts", f"1 {unit}")["start"] if requests.isStreaming else F.date_trunc(unit, "ts")
    if requests.isStreaming:
        requests = requests.withWatermark("ts", "10 minutes")
    return requests.groupBy(path, start.alias("start")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col(ms) > slow_ms).alias("slow"), F.max(ms).alias("longest"))


def request_log(requests: DataFrame) -> DataFrame:
    """Requests (request_id, ts, path, status, ms) as JSON lines with their correlation id."""
    level = F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warning").otherwise("info")
    return requests.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), level.alias("level"), F.lit("request").alias("event"), "request_id", "path", "status", F.round("ms", 1).alias("duration_ms"))).alias("value"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into a table beside its checkpoint, and returns that.

    A micro-batch has a folder of its own, which a repeated attempt writes again; in ``complete`` mode the last one counts.
    """
    spark, root = stream.sparkSession, f"{checkpoint}-{name}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={n}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not q.lastProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(root)
    last = rows.agg(F.max("batch")).first()[0]
    return (rows.where(F.col("batch") == last) if mode == "complete" else rows).drop("batch")


def answer_deltas(answers: DataFrame) -> DataFrame:
    """request_id, seq, type, delta, answer: the words of each answer and then its meta event."""
    words = answers.select("request_id", F.posexplode(tx.words_of(F.col("answer"))).alias("seq", "delta")).select("request_id", "seq", F.lit("token").alias("type"), tx.redact_token(F.col("delta")).alias("delta"), F.lit(None).cast("string").alias("answer"))
    meta = answers.select("request_id", F.size(tx.words_of(F.col("answer"))).alias("seq"), F.lit("meta").alias("type"), F.lit(None).cast("string").alias("delta"), F.col("answer"))
    return words.unionByName(meta)


def final_answers(events: DataFrame) -> DataFrame:
    """The meta event's answer, or, if it is empty or missing, the deltas in order."""
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "delta")))), lambda x: x["delta"]), "")
    return events.groupBy("request_id").agg(F.coalesce(F.nullif(F.max(F.when(F.col("type") == "meta", F.col("answer"))), F.lit("")), deltas).alias("answer"))


def sync(stream: DataFrame, sink_path: str, checkpoint: str, key: str = "id", seconds: int | None = None, start_from=None):
    """Appends rows whose key the sink lacks, per micro-batch; failures end the query, which resumes from its checkpoint."""
    from lorikeet.sources import sinks

    def write(batch: DataFrame, _: int) -> None:
        copies = W.partitionBy(key).orderBy(F.xxhash64(*batch.columns))
        rows = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(SYNC_PARTS)).cast("int")).withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy")
        if sinks.exists(batch.sparkSession, sink_path):
            # just the folders that the batch's keys fall in are read
            parts = [r["part"] for r in rows.select("part").distinct().collect()]  # SYNC_PARTS at most
            there = batch.sparkSession.read.parquet(sink_path).where(F.col("part").isin(parts)).select(key)
            rows = rows.join(there, key, "left_anti")
        rows.write.mode("append").partitionBy("part").parquet(sink_path)

    if start_from is not None:
        stream = stream.where(F.col("created_at") >= F.lit(start_from))
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def keywords_per_batch(stream: DataFrame, load, apply, checkpoint: str):
    """Reloads configuration for each micro-batch; the last good one stays if loading fails, and the first must succeed."""
    held = [load()]

    def run(batch: DataFrame, n: int) -> None:
        try:
            held[0] = load()
        except Exception as e:  # stale configuration is better than none
            print(f"keywords not reloaded in batch {n}: {e}")
        apply(batch, held[0])

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
