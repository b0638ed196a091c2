"""Text rules as Column expressions: normalisation, labels, citations, redaction, validation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorikeet.config import DEFAULTS


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def number_text(x: Column, pattern: str) -> Column:
    """Rounded half-even, as format_number() with a pattern does."""
    return F.call_function("format_number", x, F.lit(pattern))


# ---------------------------------------------------------------- P1-P3, P5-P6: keywords

#: Look-alike letters (six Cyrillic ones and the Greek omicron), invisible characters, digits
#: and marks that stand for letters.
HOMOGLYPHS = (("а", "a"), ("ο", "o"), ("е", "e"), ("р", "p"), ("с", "c"), ("х", "x"), ("о", "o"))
INVISIBLE = "​‌‍﻿⁠"
LEET = ("013457@$", "oieastas")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; Spark has no function for it."""
    for s in batches:
        yield s.str.normalize("NFKC")


def normalise(x: Column, compatibility: bool = True) -> Column:
    """Canonical form for keyword matching. ``compatibility=False`` leaves NFKC out and stays in the JVM: right for ASCII."""
    x = F.lower(nfkc(x) if compatibility else x)
    x = F.translate(x, "".join(a for a, _ in HOMOGLYPHS), "".join(b for _, b in HOMOGLYPHS))
    x = F.translate(x, INVISIBLE, "")
    x = strip(F.regexp_replace(x, r"\s+", " "))
    return F.translate(x, *LEET)


def query_hash(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(12))


def light_normalise(x: Column) -> Column:
    """Lower case, no white space around, no closing marks."""
    return F.regexp_replace(F.lower(strip(x)), r"[?!.,]+$", "")


def contains_any(x: Column, phrases: list[str]) -> Column:
    return F.exists(F.lit(phrases), lambda p: F.contains(x, p)) if phrases else F.lit(False)


def expand_acronyms(question: Column, acronyms: dict[str, str]) -> Column:
    """Appends `` (full form)`` for each acronym that stands as a word in the question, in the dictionary's order."""
    for short, full in acronyms.items():
        found = F.upper(question).rlike(rf"(?<![\p{{L}}\p{{N}}_]){short}(?![\p{{L}}\p{{N}}_])")
        question = F.concat(question, F.when(found & ~F.contains(question, F.lit(f" ({full})")), F.lit(f" ({full})")).otherwise(F.lit("")))
    return question


# ---------------------------------------------------------------- P8-P12: scores, labels, citations


def confidence_band(score: Column, threshold: float = DEFAULTS.score_threshold, buffer: float = DEFAULTS.confidence_buffer) -> Column:
    # the sum is rounded so that 0.3 + 0.15 is the decimal it looks like
    return F.when(score < threshold, "low").when(score < round(threshold + buffer, 10), "marginal").otherwise("high")


def with_disclaimer(answer: Column, band: Column, suffix: str) -> Column:
    return F.when(band == "marginal", F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit(suffix))).otherwise(answer)


def source_label(file_name: Column) -> Column:
    """P10: file name without extension and without a trailing ``_`` part of 8 characters or more; ``_`` as spaces."""
    bare = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.replace(F.regexp_replace(bare, r"_[^_]{8,}$", ""), F.lit("_"), F.lit(" "))


def labelled_text(file_name: Column, text: Column) -> Column:
    return F.concat(F.lit("["), source_label(file_name), F.lit("]\n"), text)


def citation(file_name: Column, page: Column, chunk_index: Column, element_type: Column, score: Column, text: Column, chars: int = DEFAULTS.preview_chars) -> Column:
    return F.struct(file_name.alias("file_name"), page.alias("page"), chunk_index.alias("chunk_index"), element_type.alias("element_type"), F.round(F.coalesce(score, F.lit(0.0)), 4).alias("score"), F.left(text, F.lit(chars)).alias("text_preview"))


def format_history(history: Column) -> Column:
    """``role: content`` lines of an array of (role, content)."""
    return F.array_join(F.transform(history, lambda h: F.concat(h["role"], F.lit(": "), h["content"])), "\n")


def clipped_history(history: Column, last: int = 6, chars: int = 100) -> Column:
    """The last messages, each cut with an ellipsis."""
    clip = lambda x: F.when(F.length(x) > chars, F.concat(F.left(x, F.lit(chars)), F.lit("..."))).otherwise(x)
    recent = F.slice(history, F.greatest(F.size(history) - last + 1, F.lit(1)), last)
    return F.transform(recent, lambda h: F.struct(h["role"].alias("role"), clip(h["content"]).alias("content")))


# ---------------------------------------------------------------- P13-P15: answers

#: What a list item looks like at the start of a line, and bullets and numbers inside one.
LIST_ITEM = r"^\s*([*\-]|\d+\.)\s"
INLINE_BULLET = r"(?<=[^\n])\s+([*\-])\s+(?=\w)"
INLINE_NUMBER = r"(?<=[^\n])\s+(\d+)\.\s+(?=\w)"


def format_answer(text: Column) -> Column:
    """List items on lines of their own, and a blank line before each list."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, INLINE_BULLET, "\n$1 "), INLINE_NUMBER, "\n$1. "), "\n")

    def line(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(lines, i)).otherwise(F.lit(""))
        opens = x.rlike(LIST_ITEM) & (i > 0) & ~before.rlike(LIST_ITEM) & (strip(before) != "")
        return F.when(opens, F.concat(F.lit("\n"), x)).otherwise(x)

    return strip(F.array_join(F.transform(lines, line), "\n"))


#: What answers must not give away, by category, in the order in which it is replaced.
MODEL_NAMES = "claude|gpt-?[1-9]?o?|gemini|llama|qwen|mistral|indobert|grok|kimi|deepseek|ernie|palm|bert"
VENDORS = r"anthropic|openai|alibaba\s*cloud|alibaba|meta\s*ai|meta|google\s*deepmind|deepmind|microsoft|xai|moonshot|mistral\s*ai|baidu|huggingface|hugging\s*face"
STACK = r"qdrant|fastapi|ollama|vllm|llama[\s_]?index|langchain|redis|uvicorn|sqlalchemy|pytorch|tensorflow|transformers"
TOKEN = r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
PRIVATE_URL = r"https?://(localhost|127\.0\.0\.1|192\.168\.\d+\.\d+|10\.\d+\.\d+\.\d+)\S*"
CATEGORIES = (
    (rf"(?U)\b({MODEL_NAMES})\b", "[AI system]"),
    (rf"(?U)\b({VENDORS})\b", "[AI vendor]"),
    (rf"(?U)\b({STACK})\b", "[internal system]"),
    (TOKEN, "[TOKEN]"),
    (PRIVATE_URL, "[internal URL]"),
)
#: Labels of a prompt that an answer may repeat at its start.
LEAKED_PREFIXES = (
    r"^\s*(?:jawaban|jawab|format|panduan format|format jawaban)\s*[:：]\s*",
    r"^\s*\d+[-–]?\d*\s*kalimat\s*[:：]\s*",
    r"^\s*(?:paragraf biasa|bullet|nomor|tanpa bullet)\s*[:：]\s*",
)
#: Closing remarks on where an answer comes from.
LEAKED_SENTENCES = (
    r"\s*Informasi\s+ini\s+(?:didasarkan|berasal|diambil|diperoleh|bersumber)[^.!?]*[.!?]?\s*$",
    r"\s*Data\s+ini\s+(?:didasarkan|berasal|diambil|diperoleh|bersumber)[^.!?]*[.!?]?\s*$",
    r"\s*Menurut\s+(?:dokumen|data|ringkasan|sumber|informasi)\b[^.!?]*[.!?]?\s*$",
    r"\s*Berdasarkan\s+(?:dokumen|data|ringkasan|sumber|informasi|catatan)\b[^.!?]*[.!?]?\s*$",
)


def redact_token(text: Column) -> Column:
    """The category rules alone; a stream's deltas keep their white space."""
    for pattern, label in CATEGORIES:
        text = F.regexp_replace(text, f"(?i){pattern}", label)
    return text


def redact(text: Column, heading: str = DEFAULTS.context_heading) -> Column:
    """Prefixes, sentences that quote the prompt's ``heading`` or give away sources, white space, categories."""
    for pattern in LEAKED_PREFIXES:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    words = r"\s+".join(re.escape(w) for w in heading.split())
    for pattern in (rf"[A-Z][^.!?]*?(?:{words})[^.!?]*?[.!?]", *LEAKED_SENTENCES):
        text = F.regexp_replace(text, f"(?is){pattern}", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+\n", "\n"), r"\n\s*\n+", "\n\n")
    return redact_token(strip(text))


# ---------------------------------------------------------------- P16-P17: condensed questions

#: Marks of a template that has leaked, and prefixes that models put before a question.
LEAK_MARKS = ["[inst]", "<<sys>>", "<|", "```", "system:", "assistant:"]
CONDENSE_PREFIXES = r"^(?:pertanyaan standalone:|standalone question:|pertanyaan mandiri:|pertanyaan:)"


def validate_condensed(original: Column, condensed: Column) -> Column:
    bad = condensed.isNull() | (F.length(strip(condensed)) < 5) | (F.length(condensed) > F.greatest(F.length(original) * 3, F.lit(200))) | contains_any(F.lower(condensed), LEAK_MARKS)
    return F.when(bad, original).otherwise(condensed)


def condense_result(original: Column, generated: Column) -> Column:
    """Struct (question, is_ack) from what a model made of the question."""
    text = strip(generated)
    text = F.when(text.rlike(f"(?i){CONDENSE_PREFIXES}"), strip(F.regexp_replace(text, f"(?i){CONDENSE_PREFIXES}", ""))).otherwise(text)
    long_lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) >= 5)
    text = F.coalesce(F.try_element_at(long_lines, F.lit(1)), text)
    ack = F.startswith(text, F.lit("<ACK>")) | (F.length(text) < 3)
    return F.struct(F.when(ack, original).otherwise(validate_condensed(original, text)).alias("question"), F.coalesce(ack, F.lit(False)).alias("is_ack"))


# ---------------------------------------------------------------- other rules


def payload_text(text: Column, node_content: Column) -> Column:
    """The text, or else the text inside the JSON of the node; null if there is none."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(F.get_json_object(node_content, "$.text"), F.lit("")))


def tool_call(text: Column, schema: str = "tool STRING, params MAP<STRING,STRING>") -> Column:
    """The JSON between the first { and the last }; null if it isn't JSON."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def guard_years(x: Column) -> Column:
    """A paragraph that starts with a year and a point is no list item."""
    return F.regexp_replace(x, r"(^|\n\n)(\d{4})\. ", "$1$2\\\\. ")


#: Labels of answer modes.
MODE_LABELS = {"rag": "RAG", "rag_low_relevance": "Low relevance", "cache_hit": "Cache", "chitchat": "Chitchat", "identity": "Identity", "out_of_scope": "Out of scope", "blocked": "Blocked", "blocked_moderation": "Moderation", "clarification_needed": "Clarification", "get_info_private": "Private", "vision": "Vision", "vision_error": "Vision error"}


def mode_label(mode: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in MODE_LABELS.items() for v in kv]), mode), mode)


def debug_bar(mode: Column, seconds: Column, top_score: Column, model: Column) -> Column:
    """What is known, joined by dots."""
    return F.concat_ws(" · ", mode_label(mode), F.concat(number_text(seconds, "0.0"), F.lit("s")), F.concat(F.lit("score "), number_text(top_score, "0.000")), model)


def local_timestamp(ts: Column, offset: str = "+08:00", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, offset), pattern)


def cell(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def uuid_or_null(x: Column) -> Column:
    """canonical lower-case UUID; null if it isn't one."""
    bare = F.regexp_replace(F.lower(strip(x)), r"^urn:uuid:|[{}\-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def cache_key(role: Column, question: Column, prefix: str = "answer:") -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(":", role, question), 256), F.lit(16)))


def sources_text(sources: Column) -> Column:
    """citations (file_name, chunk_index, element_type, score, text_preview) as numbered blocks."""

    def block(s: Column, i: Column) -> Column:
        meta = F.concat_ws(" - ", F.concat(F.lit("Chunk #"), s["chunk_index"].cast("string")), F.concat(F.lit("["), F.nullif(s["element_type"], F.lit("")), F.lit("]")))
        return F.concat_ws("\n", F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(s["file_name"], F.lit("")), F.lit("-"))), F.concat(F.lit("Score: "), s["score"].cast("string")), F.nullif(meta, F.lit("")), F.nullif(strip(s["text_preview"]), F.lit("")))

    return F.coalesce(F.array_join(F.transform(sources, block), "\n\n"), F.lit(""))


def numbered_lines(values: Column) -> Column:
    """F42."""
    return F.coalesce(F.array_join(F.transform(values, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n"), F.lit(""))


def intent_text(intent: Column, confidence: Column) -> Column:
    """``intent (0.76)``, rounded half-even."""
    number = number_text(confidence.cast("double"), "0.00")
    return F.when(F.coalesce(intent, F.lit("")) == "", F.lit("")).otherwise(F.concat(intent, F.coalesce(F.concat(F.lit(" ("), number, F.lit(")")), F.lit(""))))


def quoted_sheet(name: Column) -> Column:
    """F44."""
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))


def column_letter(n: Column) -> Column:
    return F.when(n <= 26, F.chr(64 + n)).otherwise(F.concat(F.chr((64 + F.floor((n - 1) / 26)).cast("int")), F.chr((65 + (n - 1) % 26).cast("int"))))


def words_of(answer: Column) -> Column:
    """R2: a finished answer as the deltas of a stream."""
    return F.transform(F.filter(F.split(answer, " "), lambda w: w != ""), lambda w: F.concat(w, F.lit(" ")))


# ---------------------------------------------------------------- prompts, telemetry, progress


def prompt(history: Column, context: Column, question: Column, condensed: Column, heading: str = DEFAULTS.context_heading) -> Column:
    """With a history its lines and the original question, without one the condensed question; the context between."""
    lines = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, format_history(history))
    return F.concat(F.coalesce(F.concat(F.lit("Earlier:\n"), lines, F.lit("\n\n")), F.lit("")), F.lit(f"{heading}\n"), context, F.lit("\n\nQuestion: "), F.when(lines.isNotNull(), question).otherwise(condensed))


def overlay(base: Column, own: Column) -> Column:
    """A map with the entries of another laid over its own."""
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def duration_text(seconds: Column) -> Column:
    """``1h 2m 3s``, without leading parts that are 0."""
    s = F.floor(seconds).cast("long")
    part = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    short = F.concat(part(s / 60 % 60, "m "), part(s % 60, "s"))
    return F.when(s >= 3600, F.concat(part(s / 3600, "h "), short)).when(s >= 60, short).otherwise(part(s, "s"))


def progress_bar(done: Column, total: Column, width: int = 30) -> Column:
    """``[###...]  42.0%``."""
    share = F.coalesce(F.try_divide(done.cast("double"), total.cast("double")), F.lit(0.0))
    filled = F.floor(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled), F.lit("] "), F.format_string("%.1f", share * 100), F.lit("%"))


def throughput(done: Column, seconds: Column) -> Column:
    """Documents a second; 0 before the first second."""
    return F.coalesce(F.try_divide(done.cast("double"), seconds.cast("double")), F.lit(0.0))


def time_left(done: Column, total: Column, seconds: Column) -> Column:
    """Seconds that the rest takes at the speed so far; 0 where there is none yet."""
    return F.coalesce(F.try_divide((total - done).cast("double"), throughput(done, seconds)), F.lit(0.0))
