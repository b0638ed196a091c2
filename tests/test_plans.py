"""Whole jobs on a few rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorikeet.operators import retrieval
from lorikeet.plans import answer as plan
from lorikeet.sources import sinks

LISTS = {"hard_block": ["bomb"], "soft_flag": [], "safe_context": []}


def test_questions_take_their_routes(spark):
    texts = [("rules_of_study.pdf", i, f"The library opens at {i} every day. More text about shelf number {i}.") for i in range(8)]
    chunks = spark.createDataFrame(texts, "file_name string, chunk_index int, text string").withColumn("section", F.lit("Library")).withColumn("page", F.lit(1)).withColumn("element_type", F.lit("NarrativeText")).withColumn("vec", retrieval.embed_text(F.col("text")))
    rows = [(1, "make a bomb"), (2, "who are you?"), (3, "The library opens at 3 every day"), (4, "zebra quantum"), (5, "cached?")]
    requests = spark.createDataFrame(rows, "request_id int, question string").withColumn("role", F.lit("student")).withColumn("history", F.expr("array(named_struct('role', 'user', 'content', 'hi'))"))
    from lorikeet.functions import text as tx

    cache = spark.range(1).select(tx.cache_key(F.lit("student"), F.lit("cached?")).alias("key"), F.lit("from the cache").alias("answer"))
    got = {r.request_id: r for r in plan.answer(requests, chunks, cache, LISTS).collect()}
    assert {k: r.mode for k, r in got.items()} == {1: "blocked", 2: "chitchat", 3: "rag", 4: "rag_low_relevance", 5: "cache_hit"}
    assert got[3].answer.startswith("The library opens at") and got[3].sources[0].text_preview.startswith("[rules of study]\n")
    assert got[5].answer == "from the cache" and got[1].answer is None
    assert plan.cache_entries(requests, plan.answer(requests, chunks, cache, LISTS), F.current_timestamp()).count() == 1


def test_private_questions_are_answered_from_private_data(spark):
    chunks = spark.createDataFrame([("f.pdf", 0, "The library opens at 3 every day.")], "file_name string, chunk_index int, text string").withColumn("section", F.lit("L")).withColumn("page", F.lit(1)).withColumn("element_type", F.lit("NarrativeText")).withColumn("vec", retrieval.embed_text(F.col("text")))
    rows = [(1, "t", 200, False), (2, "", 200, False), (3, "t", 401, False), (4, "t", 500, False), (5, "t", 200, True)]
    requests = spark.createDataFrame(rows, "request_id int, token string, http_status int, failed boolean").selectExpr("*", "'The library opens at 3' question", "'student' role", "cast(null as array<struct<role:string,content:string>>) history", "'get_ipk' tool", """'{"ipk": "3.5", "total_sks": 90}' data""")
    empty = spark.createDataFrame([], "key string, answer string")
    got = {r.request_id: r for r in plan.answer(requests, chunks, empty, LISTS, classify=lambda q: F.create_map(F.lit("get_info_private"), F.lit(1.0)), prompts=True).collect()}
    assert {k: r.mode for k, r in got.items()} == {1: "get_info_private", 2: "get_info_private_unauthenticated", 3: "get_info_private_unauthorized", 4: "get_info_private_error", 5: "rag"}
    assert got[1].answer == "Your grade average is **3.5** with **90 credits**." and got[5].answer


def test_questions_with_images(spark):
    png = "data:image/png;base64,AAAA"
    rows = [(1, "what is this?", [("image/png", png), ("image/gif", png)]), (2, "make a bomb", [("image/png", png)]), (3, "nothing to see", [])]
    requests = spark.createDataFrame(rows, "request_id int, question string, images array<struct<mime:string,data:string>>")
    ok = lambda q: F.lit("safe")
    see = lambda q, images: F.concat(F.lit("It shows "), F.size(images).cast("string"), F.lit(" picture."))
    got = {r.request_id: (r.mode, r.answer) for r in plan.answer_images(requests, LISTS, ok, lambda q: F.create_map(F.lit("get_info_public"), F.lit(1.0)), see).collect()}
    assert got == {1: ("vision", "It shows 1 picture."), 2: ("blocked", None), 3: ("vision_error", None)}


def test_index_takes_what_is_new(spark, tmp_path):
    path = str(tmp_path / "chunks")
    table = sinks.ensure_table(spark, path)
    elements = spark.createDataFrame([("a", 0, "Title", 1, "T"), ("a", 1, "Footer", 1, "x"), ("a", 2, "NarrativeText", 1, "body"), ("b", 0, "NarrativeText", 1, "other")], "file_name string, ordinal int, category string, page int, text string")
    files = lambda h: spark.createDataFrame([("a", h), ("b", "1")], "file_name string, file_hash string")
    sinks.replace(plan.index_files(files("1"), elements, table), path)
    table = sinks.ensure_table(spark, path)
    assert sorted((r.file_name, r.text, r.file_hash) for r in table.collect()) == [("a", "# T\n\nbody", "1"), ("b", "other", "1")]
    sinks.replace(plan.index_files(files("2"), elements, table), path)
    assert sorted((r.file_name, r.file_hash) for r in sinks.ensure_table(spark, path).collect()) == [("a", "2"), ("b", "1")]
    texts = spark.createDataFrame([("faculty", "f.txt", "one narrative")], "endpoint string, file_name string, text string")
    assert plan.index_narratives(texts, sinks.ensure_table(spark, path)).first().total_chunks == 1


def test_sync_numbers_on(spark):
    uid = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    t = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    schema = "id string, session_id string, role string, content string, created_at timestamp, images array<string>, debug struct<model:string,intent:string,intent_confidence:double>, sources array<struct<file_name:string,chunk_index:int,element_type:string,score:double,text_preview:string>>"
    rows = [(uid(i), "s", "user" if i % 2 == 0 else "assistant", f"m{i}", t(i), None, None, None) for i in range(6)]
    sheet = spark.createDataFrame([("4", uid(1))], "no string, source_message_id string")
    got = plan.sync_answers(spark.createDataFrame(rows, schema), sheet).orderBy("no").collect()
    assert [(r.no, r.question, r.answer) for r in got] == [(5, "m2", "m3"), (6, "m4", "m5")]
