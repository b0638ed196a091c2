"""Scans: tables, PDF and ZIP directories, JSON envelopes, narrative texts, HTML pages, objects, event streams."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorikeet.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, file_hash and content of the PDFs right in the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(file_name(F.col("path")).alias("file_name"), F.sha2("content", 256).alias("file_hash"), "content")


def listed(files: DataFrame, name: str = "file_name") -> DataFrame:
    """A listing in order of its names."""
    return files.orderBy(name)


def extraction_strategy(pages: DataFrame) -> DataFrame:
    """Per file ``hi_res`` if its first five pages have more than one image on average, otherwise ``fast``; pages (file_name, page, n_images)."""
    first = F.col("page") <= 5
    return pages.groupBy("file_name").agg(F.when(F.sum(F.when(first, F.col("n_images"))) / F.greatest(F.count_if(first), F.lit(1)) > 1.0, "hi_res").otherwise("fast").alias("strategy"))


def page_text(text: Column, ocr: Column, least: int = 50) -> Column:
    """S3: the page's text, or, if it has hardly any, what OCR found, if anything."""
    return F.when(F.length(tx.strip(F.coalesce(text, F.lit("")))) > least, text).otherwise(F.coalesce(F.nullif(tx.strip(ocr), F.lit("")), text))


def page_elements(pages: DataFrame) -> DataFrame:
    """A NarrativeText element per page that isn't blank; pages (file_name, page, text)."""
    return pages.where(tx.strip(F.coalesce("text", F.lit(""))) != "").select("file_name", F.col("page").alias("ordinal"), F.lit("NarrativeText").alias("category"), "page", "text")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])))
def _pdf_entries(contents: pd.Series) -> pd.Series:
    def one(data: bytes) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [{"name": i.filename.replace("\\", "/").rsplit("/", 1)[-1], "content": z.read(i), "error": None} for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".pdf")]
        except Exception as e:  # a damaged archive is counted, not fatal
            return [{"name": None, "content": None, "error": type(e).__name__}]

    return contents.map(one)


def zip_entries(spark: SparkSession, folder: str, existing: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The PDFs in all ZIP files below the folder, with a status: extracted, overwritten, skipped or error.

    Of entries with one name the first by archive path counts. ``existing`` (file_name): what is there.
    """
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    entries = zips.select("path", F.posexplode(_pdf_entries("content")).alias("n", "e")).select("path", "n", F.col("e.name").alias("file_name"), F.col("e.content").alias("content"), F.col("e.error").alias("error"))
    w = W.partitionBy("file_name").orderBy("path", "n")
    entries = entries.withColumn("__rn", F.when(F.col("file_name").isNotNull(), F.row_number().over(w)))
    known = existing.select("file_name").distinct().withColumn("__there", F.lit(True)) if existing is not None else entries.select("file_name").limit(0).withColumn("__there", F.lit(True))
    there = F.coalesce("__there", F.lit(False)) | (F.coalesce("__rn", F.lit(1)) > 1)
    status = F.when(F.col("error").isNotNull(), "error").when(there & F.lit(force), "overwritten").when(there, "skipped").otherwise("extracted")
    return entries.join(known, "file_name", "left").withColumn("status", status).drop("__rn", "__there", "n")


def json_envelopes(spark: SparkSession, path: str, item_schema: str, summary_schema: str | None = None) -> DataFrame:
    """Path, ``ok``, ``error``, ``summary`` and items of JSON envelopes; files that can't be parsed have ok = false.

    A list instead of an object counts as its first member.
    """
    summary = f", summary: {summary_schema}" if summary_schema else ""
    schema = f"struct<success: boolean, error: string, data: struct<items: array<{item_schema}>{summary}>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    doc = F.when(listed, F.from_json("value", f"array<{schema}>")[0]).otherwise(F.from_json("value", schema))
    read = files.withColumn("doc", doc).withColumn("ok", F.col("doc.data.items").isNotNull())
    return read.select("path", "ok", F.when(~F.col("ok"), F.coalesce("doc.error", F.lit("unreadable"))).alias("error"), *([F.col("doc.data.summary").alias("summary")] if summary_schema else []), F.col("doc.data.items").alias("items"))


def narrative_files(spark: SparkSession, root: str) -> DataFrame:
    """Endpoint, file_name and text of ``<root>/<endpoint>/*.txt`` that aren't blank."""
    files = spark.read.text(f"{root}/*/*.txt", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    return files.where(tx.strip(F.col("text")) != "").select(F.url_decode(F.element_at(parts, -2)).alias("endpoint"), file_name(F.col("path")).alias("file_name"), "text")


def users(spark: SparkSession, path: str) -> DataFrame:
    """Users of a JSON file; rows that can't be read are left out."""
    return spark.read.schema("username string, password_hash string, name string, nim string, role string, is_active boolean").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def chat_log(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Messages (id, session_id, role, content, created_at, ...) of a log table, from a time on; the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if since is None else rows.where(F.col("created_at") >= F.lit(since))


def sheet_state(spark: SparkSession, path: str) -> DataFrame:
    """The numbers and message ids of a review sheet kept as CSV with a header; just these two columns are read."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select("no", "source_message_id")


def stored_objects(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Key, content and content_type of the keys that are safe and there."""
    safe = keys.where(~F.contains("key", F.lit("..")) & ~F.startswith("key", F.lit("/")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = F.lower(F.regexp_extract("key", r"\.([^./]+)$", 1))
    types = F.create_map(*[F.lit(x) for kv in (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("webp", "image/webp"), ("pdf", "application/pdf")) for x in kv])
    base = root.rstrip("/").rsplit("/", 1)[-1]
    named = files.select(F.url_decode(F.regexp_extract("path", rf"/{base}/(.*)$", 1)).alias("key"), "content")
    return named.join(safe, "key").select("key", "content", F.coalesce(F.try_element_at(types, kind), F.lit("application/octet-stream")).alias("content_type"))


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S6 over web pages: page_id, ordinal, category (Title or NarrativeText) and text of ``h1`` and ``p`` elements."""
    body = F.regexp_replace(html_col, r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h1|p)\b[^>]*>.*?</(?:h1|p)>"), F.lit(0))
    rows = pages.select(id_col, F.posexplode(found).alias("ordinal", "raw"))
    text = F.regexp_replace("raw", r"(?s)<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return rows.select(id_col, "ordinal", F.when(F.col("raw").rlike("(?i)^<h1"), "Title").otherwise("NarrativeText").alias("category"), tx.strip(text).alias("text")).where("text <> ''")


def html_table_markdown(html: Column) -> Column:
    """Rows of an HTML table as Markdown; what has no rows stays as it is."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: tx.strip(F.regexp_replace(c, "(?s)<[^>]*>", "")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(cells(F.try_element_at(rows, F.lit(1))), lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    lines = F.transform(rows, line)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")).otherwise(html)


def sse_events(chunks: DataFrame, schema: str = "type string, delta string, answer string") -> DataFrame:
    """Events of text/event-stream bodies (request_id, body): ``data:`` lines of blocks that a blank line ends; bad JSON is left out."""
    blocks = F.split("body", "\n\n")
    whole = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    rows = chunks.select("request_id", F.posexplode(whole).alias("seq", "block"))
    parsed = rows.where(F.startswith("block", F.lit("data: "))).withColumn("event", F.from_json(F.substr("block", F.lit(7)), schema, {"mode": "PERMISSIVE"}))
    return parsed.where("event.type is not null").select("request_id", "seq", "event.*")


Parser = Callable[[bytes], list[dict]]


def parse_layout(files: DataFrame, parser: Parser) -> DataFrame:
    """Elements of binary files by a parser provider; a file that it can't read has none and an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, data in zip(b["file_name"], b["content"], strict=True):
                try:
                    out += [(name, i, e.get("category"), e.get("page"), e.get("text"), None) for i, e in enumerate(parser(data))]
                except Exception as e:  # one bad file doesn't stop the index
                    out.append((name, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file_name", "ordinal", "category", "page", "text", "error"])

    return files.select("file_name", "content").mapInPandas(run, "file_name string, ordinal int, category string, page int, text string, error string")
