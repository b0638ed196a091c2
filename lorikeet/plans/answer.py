"""Whole jobs: answering a batch of questions, indexing documents, syncing reviewed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.config import DEFAULTS, Settings
from lorikeet.functions import text as tx
from lorikeet.operators import caching, chunking, dialogue, guard, indexing, retrieval


def extractive_answer(context: Column) -> Column:
    """A deterministic local generator: the first sentence of the context."""
    return F.regexp_extract(context, r"(?s)^(?:\[[^\]]*\]\n)?(.*?[.!?])(?:\s|$)", 1)


def answer(
    requests: DataFrame,
    chunks: DataFrame,
    cache: DataFrame,
    lists: dict[str, list[str]],
    moderate: Callable[[Column], Column] = lambda q: F.lit("safe"),
    classify: Callable[[Column], Column] = lambda q: F.create_map(F.lit("get_info_public"), F.lit(1.0)),
    condense: Callable[[Column, Column], Column] = lambda history, q: q,
    generate: Callable[[Column], Column] = extractive_answer,
    identity: tuple[str, ...] = ("who are you",),
    acronyms: dict[str, str] | None = None,
    disclaimer: str = "\n\n(Please check this answer.)",
    prompts: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """request_id, mode, answer, band, top_score, sources for requests (request_id, question, history, role) over chunks with ``vec``.

    Verdicts come first; just the questions that are still open are embedded and searched. Models are
    providers, functions from Columns to a Column; with ``prompts`` the generator gets a whole prompt and not
    the context alone.
    """
    rows = guard.answer_questions(requests, lists, moderate, classify, list(identity))
    condensed = tx.condense_result(F.col("question"), condense(tx.format_history(tx.clipped_history(F.col("history"))), F.col("question")))
    rows = rows.withColumn("c", condensed).withColumn("condensed", F.col("c.question")).withColumn("is_ack", F.col("c.is_ack")).drop("c")
    rows = rows.withColumn("normal", tx.normalise(F.col("condensed"))).withColumn("condensed_keyword", guard.keyword_verdict(F.col("normal"), lists))
    # the private route is open where requests bring what its call gave: token, tool, http_status, failed, data
    private = {"token", "tool", "http_status", "failed", "data"} <= set(requests.columns)
    rows = rows.withColumn("private_mode", guard.private_mode(F.col("token"), F.col("http_status"), F.col("failed")) if private else F.lit(None).cast("string"))
    rows = caching.lookup(rows, cache).withColumn("cache_hit", F.col("cached_answer").isNotNull())
    # a route that needs no retrieval is known by now: with a perfect score the mode would be rag for the rest
    early = rows.withColumn("top_score", F.lit(1.0)).withColumn("n_nodes", F.lit(1)).withColumn("mode", guard.answer_mode(settings.score_threshold))
    asked = early.where("mode = 'rag'").select(F.col("request_id").alias("query_id"), tx.expand_acronyms(F.col("condensed"), acronyms or {}).alias("q"))

    keyed = chunks.withColumn("cid", F.concat_ws("#", "file_name", F.col("chunk_index").cast("string")))
    hits = retrieval.vector_topk(asked.withColumn("vec", retrieval.embed_text(F.col("q"))), keyed, settings.top_k, "query_id", "cid", "vec")
    hits = hits.join(keyed.select("cid", "file_name", "section", "chunk_index"), "cid")
    near = retrieval.expand_neighbours(hits, chunks, settings.neighbour_radius, settings.max_expanded)
    texts = near.join(chunks.select("file_name", "chunk_index", "text", "element_type", "page").dropDuplicates(["file_name", "chunk_index"]), ["file_name", "chunk_index"])
    best = retrieval.rerank(texts.join(asked, "query_id"), retrieval.lexical_score(F.col("q"), F.col("text")), settings.top_n, tie="place")
    best = best.withColumn("labelled", tx.labelled_text(F.col("file_name"), F.col("text")))
    scores = retrieval.top_scores(best)
    cite = tx.citation(F.col("file_name"), F.col("page"), F.col("chunk_index"), F.col("element_type"), F.col("final_score"), F.col("labelled"), settings.preview_chars)
    sources = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", cite.alias("c")))), lambda x: x["c"]).alias("sources"))
    found = scores.join(sources, "query_id").join(retrieval.context(best, text_col="labelled"), "query_id")

    out = early.drop("top_score", "n_nodes", "mode").join(found.withColumnRenamed("query_id", "request_id"), "request_id", "left").withColumn("mode", guard.answer_mode(settings.score_threshold))
    asked_for = tx.prompt(F.col("history"), F.col("context"), F.col("question"), F.col("condensed"), settings.context_heading) if prompts else F.col("context")
    fresh = tx.with_disclaimer(tx.format_answer(tx.redact(generate(asked_for), settings.context_heading)), F.col("band"), disclaimer)
    said = F.when(F.col("mode") == "cache_hit", F.col("cached_answer")).when(F.col("mode") == "rag", fresh)
    if private:
        said = said.when(F.col("mode") == "get_info_private", guard.private_text(F.col("tool"), F.col("data")))
    return out.select("request_id", "mode", said.alias("answer"), "band", F.round("top_score", 4).alias("top_score"), F.when(F.col("mode") == "rag", F.col("sources")).alias("sources"))


def answer_images(requests: DataFrame, lists: dict[str, list[str]], moderate: Callable[[Column], Column], classify: Callable[[Column], Column], see: Callable[[Column, Column], Column], settings: Settings = DEFAULTS) -> DataFrame:
    """request_id, mode and answer for requests (request_id, question, images array<struct<mime,data>>).

    Images that break a rule are left out; ``see`` makes an answer of the question and the rest, null where it fails.
    """
    rows = guard.answer_questions(requests, lists, moderate, classify, [])
    valid = F.filter(F.transform("images", lambda x, i: F.struct(x["mime"].alias("mime"), x["data"].alias("data"), guard.image_error(x["mime"], x["data"], i, settings).alias("error"))), lambda x: x["error"].isNull())
    rows = rows.withColumn("valid", valid)
    early = (F.col("keyword.mode") == "block") | ~F.col("moderation.safe") | ((F.col("intent.intent") == "out_of_scope") & (F.col("intent.confidence") >= settings.image_reject))
    seen = rows.where(~early).withColumn("generated", F.when(F.size("valid") > 0, see(F.col("question"), F.col("valid"))))
    rest = rows.where(early).withColumn("generated", F.lit(None).cast("string"))
    out = seen.unionByName(rest).withColumn("mode", guard.vision_mode(settings.image_reject))
    return out.select("request_id", "mode", F.when(F.col("mode") == "vision", tx.format_answer(tx.redact(F.col("generated"), settings.context_heading))).alias("answer"))


def cache_entries(requests: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """What an answered batch adds to the cache: rag answers, under the question's key."""
    done = answers.where("mode = 'rag'").join(requests, "request_id")
    return done.select(tx.cache_key(F.col("role"), F.col("question")).alias("key"), "answer", now.alias("cached_at"))


def index_files(files: DataFrame, elements: DataFrame, table: DataFrame, settings: Settings = DEFAULTS, force: bool = False, purge: bool = False) -> DataFrame:
    """The new chunk table from files (file_name, file_hash) and their elements; just new and changed files are chunked and embedded."""
    diff = indexing.hash_diff(files, indexing.one_hash(table.where("source_type = 'pdf'")), force=force)
    wanted = diff.where(F.col("status").isin("new", "changed")).select("file_name")
    grouped = chunking.content_elements(elements).join(wanted, "file_name", "left_semi").groupBy("file_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "category", "text", "page"))), lambda x: F.struct(x["category"].alias("category"), x["text"].alias("text"), x["page"].alias("page"))).alias("elements"))
    fresh = chunking.chunk_elements(grouped, settings).join(files.select("file_name", "file_hash"), "file_name").withColumn("source_type", F.lit("pdf")).withColumn("vec", retrieval.embed_text(F.col("text")))
    return indexing.apply_diff(table, fresh, diff, purge=purge)


def index_narratives(texts: DataFrame, table: DataFrame, settings: Settings = DEFAULTS, force: bool = False) -> DataFrame:
    """The rows that narratives (endpoint, file_name, text) add to the chunk table."""
    missing = indexing.missing_narratives(texts, table.where("source_type = 'narrative'"), force)
    cut = chunking.chunk_narratives(missing, settings.narrative_tokens)
    return cut.select("endpoint", "file_name", "chunk_index", "total_chunks", F.col("chunk").alias("text"), F.lit("narrative").alias("element_type"), F.lit("narrative").alias("source_type"), retrieval.embed_text(F.col("chunk")).alias("vec"))


def sync_answers(messages: DataFrame, sheet: DataFrame, start_from=None) -> DataFrame:
    """Rows to append to a review sheet (no, source_message_id): new answers with their questions, numbered on."""
    pairs = dialogue.pair_answers(messages, cols=("id", "content", "images"))
    if start_from is not None:
        pairs = pairs.where(F.col("created_at") >= F.lit(start_from))
    fresh = dialogue.new_rows(pairs, sheet)
    start = dialogue.next_number(sheet).first().start_no
    return dialogue.sheet_rows(dialogue.number_rows(fresh, start, ["created_at", "id"]))
