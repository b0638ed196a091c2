"""Verdicts on questions, and the route that they decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.config import DEFAULTS
from lorikeet.functions import text as tx

#: A small neutral default; deployments load their own lists.
KEYWORDS = {"hard_block": ["ignore previous instructions", "system prompt"], "soft_flag": ["bypass"], "safe_context": ["security course"]}


def keyword_lists(rows: DataFrame) -> dict[str, list[str]]:
    """Lists from rows (list, phrase): normalised, distinct, sorted. Fails if there is no hard phrase."""
    clean = rows.withColumn("phrase", tx.normalise(F.col("phrase"))).where("phrase <> ''")
    found = {r["list"]: r["phrases"] for r in clean.groupBy("list").agg(F.array_sort(F.collect_set("phrase")).alias("phrases")).collect()}  # configuration, a few hundred phrases
    if not found.get("hard_block"):
        raise ValueError("the keyword lists have no hard_block phrase")
    return {k: found.get(k, []) for k in ("hard_block", "soft_flag", "safe_context")}


def load_keywords(text: str) -> dict[str, list[str]]:
    """The lists of a YAML or JSON file's text as rows for ``keyword_lists``; each must be there and be a list."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:  # JSON is YAML, too
        import json

        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("the keyword file must hold a mapping")
    for name in KEYWORDS:
        if not isinstance(raw.get(name), list):
            raise ValueError(f"the keyword file has no list {name}")
    return {name: [str(p) for p in raw[name] if p] for name in KEYWORDS}


def keyword_verdict(norm: Column, lists: dict[str, list[str]]) -> Column:
    """Struct (mode, matched, safe) for normalised text; phrases match anywhere in it.

    The text, and what is found in it, are elements of arrays that a lambda goes over: so each is computed
    once per row and not once per phrase and branch.
    """
    none = F.array().cast("array<string>")
    found = lambda text, name: F.filter(F.lit(lists[name]), lambda p: F.contains(text, p)) if lists[name] else none
    say = lambda mode, matched, ok: F.struct(F.lit(mode).alias("mode"), matched.alias("matched"), ok.alias("safe"))

    def decide(m: Column) -> Column:
        hard, soft, safe = m["hard"], m["soft"], m["ok"]
        return (
            F.when(F.size(hard) > 0, say("block", hard, none))
            .when(F.size(soft) == 0, say("pass", none, none))
            .when(F.size(safe) > 0, say("pass", soft, safe))
            .otherwise(say("flag", soft, none))
        )

    def matches(text: Column) -> Column:
        return F.struct(found(text, "hard_block").alias("hard"), found(text, "soft_flag").alias("soft"), found(text, "safe_context").alias("ok"))

    return F.transform(F.transform(F.array(F.coalesce(norm, F.lit(""))), matches), decide)[0]


def moderation_verdict(output: Column) -> Column:
    """Struct (safe, reason, bypassed) from a model's output; no output fails open."""
    clean = tx.strip(output)
    safe = F.startswith(F.lower(clean), F.lit("safe"))
    reason = F.coalesce(F.nullif(tx.strip(F.try_element_at(F.split(clean, "\n"), F.lit(2))), F.lit("")), F.lit("unknown"))
    return F.struct((output.isNull() | safe).alias("safe"), F.when(output.isNull() | safe, F.lit(None)).otherwise(reason).alias("reason"), output.isNull().alias("bypassed"))


def intent_verdict(scores: Column, threshold: float = DEFAULTS.intent_threshold, fallback: str = "get_info_public") -> Column:
    """Struct from a map of class to score; null or empty scores fall back with confidence 0."""
    best = F.try_element_at(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(1))
    conf = F.coalesce(F.round(-best["v"], 4), F.lit(0.0))
    return F.struct(F.coalesce(best["k"], F.lit(fallback)).alias("intent"), conf.alias("confidence"), (conf < threshold).alias("low_confidence"), best.isNull().alias("fallback"))


def softmax(logits: Column) -> Column:
    """Map of class to logit as map of class to probability."""
    top = F.array_max(F.map_values(logits))
    e = F.transform_values(logits, lambda k, v: F.exp(v - top))
    total = F.aggregate(F.map_values(e), F.lit(0.0), lambda s, v: s + v)
    return F.transform_values(e, lambda k, v: v / total)


def is_identity_question(question: Column, phrases: list[str]) -> Column:
    return tx.contains_any(tx.light_normalise(question), phrases)


def answer_mode(threshold: float = DEFAULTS.score_threshold) -> Column:
    """The route, in order of precedence, over the columns keyword, moderation, is_identity, intent, private_mode, is_ack, condensed_keyword, cache_hit, top_score, n_nodes."""
    intent = F.col("intent.intent")
    return (
        F.when(F.col("keyword.mode") == "block", "blocked")
        .when(~F.col("moderation.safe"), "blocked_moderation")
        .when(F.col("is_identity"), "chitchat")
        .when(F.col("intent.low_confidence") & ~F.col("intent.fallback"), "clarification_needed")
        .when(intent == "chitchat", "chitchat")
        .when(intent == "out_of_scope", "out_of_scope")
        .when((intent == "get_info_private") & F.col("private_mode").isNotNull(), F.col("private_mode"))
        .when(F.col("is_ack"), "chitchat")
        .when(F.col("condensed_keyword.mode") == "block", "blocked")
        .when(F.col("cache_hit"), "cache_hit")
        .when((F.coalesce("n_nodes", F.lit(0)) == 0) | (F.coalesce("top_score", F.lit(0.0)) < threshold), "rag_low_relevance")
        .otherwise("rag")
    )


def vision_mode(reject: float = DEFAULTS.image_reject) -> Column:
    """The route of a question with images; ``generated`` is null where the vision model failed."""
    return (
        F.when(F.col("keyword.mode") == "block", "blocked")
        .when(~F.col("moderation.safe"), "blocked_moderation")
        .when((F.col("intent.intent") == "out_of_scope") & (F.col("intent.confidence") >= reject), "out_of_scope")
        .when(F.col("generated").isNull(), "vision_error")
        .otherwise("vision")
    )


def private_mode(token: Column, http_status: Column, failed: Column) -> Column:
    """Null falls through to retrieval."""
    return F.when(F.coalesce(token, F.lit("")) == "", "get_info_private_unauthenticated").when(failed, F.lit(None)).when(http_status == 401, "get_info_private_unauthorized").when(http_status >= 400, "get_info_private_error").otherwise("get_info_private")


def private_text(tool: Column, data: Column) -> Column:
    """What a private record (JSON) says, by the tool that fetched it; other tools' data is shown as it is."""
    at = lambda path, none: F.coalesce(F.get_json_object(data, path), F.lit(none))
    courses = F.from_json(F.get_json_object(data, "$.courses"), "array<struct<name:string,sks:string>>")
    lines = F.array_join(F.transform(courses, lambda c: F.concat(F.lit("- "), F.coalesce(c["name"], F.lit("N/A")), F.lit(" ("), F.coalesce(c["sks"], F.lit("?")), F.lit(" credits)"))), "\n")
    return (
        F.when(tool == "get_ipk", F.concat(F.lit("Your grade average is **"), at("$.ipk", "N/A"), F.lit("** with **"), at("$.total_sks", "N/A"), F.lit(" credits**.")))
        .when((tool == "get_krs") & (F.coalesce(F.size(courses), F.lit(0)) <= 0), "Your study plan is empty.")
        .when(tool == "get_krs", F.concat(F.lit("Your study plan:\n"), lines))
        .otherwise(F.concat(F.lit("Your data: "), data))
    )


ACCESS = {"public": ["public"], "student": ["public", "student"], "staff": ["public", "student", "staff"], "admin": ["public", "student", "staff", "admin"]}


def may_read(role: Column, access_level: Column, access: dict[str, list[str]] = ACCESS) -> Column:
    """P25: whether a role's cumulative levels hold the row's level; unknown roles read what is public."""
    levels = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in access.items() for x in (F.lit(k), F.lit(v))]), role), F.lit(["public"]))
    return F.array_contains(levels, F.coalesce(access_level, F.lit("public")))


def request_error(question: Column, history: Column, role: Column, roles: tuple[str, ...] = ("user", "assistant"), access: tuple[str, ...] = tuple(ACCESS)) -> Column:
    """The first rule that a request breaks; null if it is valid."""
    n = F.length(F.coalesce(question, F.lit("")))
    bad_turn = F.exists(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda h: ~F.coalesce(h["role"].isin(*roles), F.lit(False)) | ~F.length(F.coalesce(h["content"], F.lit(""))).between(1, 4000))
    return F.when(n < 1, "question is empty").when(n > 2000, "question is too long").when(F.coalesce(F.size(history), F.lit(0)) > 20, "history is too long").when(bad_turn, "history has a bad turn").when(~F.coalesce(role.isin(*access), F.lit(False)), "role is unknown")


def image_error(mime: Column, data: Column, place: Column, settings=DEFAULTS) -> Column:
    """The first rule that an image (a data URL or base64) breaks; null if it is valid. ``place``: its number, from 0."""
    raw = F.try_to_binary(F.regexp_replace(data, r"^data:[^,]*,", ""), F.lit("base64"))
    return F.when(place >= settings.max_images, "too many images").when(~F.coalesce(mime.isin("image/jpeg", "image/png", "image/webp"), F.lit(False)), "type is not allowed").when(raw.isNull(), "not base64").when(F.octet_length(raw) == 0, "empty").when(F.octet_length(raw) > settings.max_image_bytes, "too large")


def resized(width: Column, height: Column, side: int = DEFAULTS.max_image_side) -> Column:
    """Struct (width, height) within ``side``, with the aspect kept."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    part = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("int")
    return F.struct(part(width).alias("width"), part(height).alias("height"))


def answer_questions(requests: DataFrame, lists: dict[str, list[str]], moderate: Callable[[Column], Column], classify: Callable[[Column], Column], identity: list[str]) -> DataFrame:
    """Adds keyword, moderation, is_identity and intent verdicts; models see just the questions that the rules before let through.

    The stages are split so that a filter stands before each model: a model inside a CASE would run on
    every row.
    """
    # normalised text is a column of its own: a lambda can't hold the Python function in it
    rows = requests.withColumn("normal", tx.normalise(F.col("question"))).withColumn("keyword", keyword_verdict(F.col("normal"), lists)).withColumn("is_identity", is_identity_question(F.col("question"), identity))
    blocked = rows.where(F.col("keyword.mode") == "block").withColumn("moderation", moderation_verdict(F.lit(None).cast("string"))).withColumn("intent", intent_verdict(F.lit(None).cast("map<string,double>")))
    open_ = rows.where(F.col("keyword.mode") != "block").withColumn("moderation", moderation_verdict(moderate(F.left("question", F.lit(DEFAULTS.moderation_chars))))).withColumn("intent", intent_verdict(classify(F.col("question"))))
    return open_.unionByName(blocked)
