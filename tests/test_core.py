"""Operators on literals, and each registered query against its SQL on the smallest tables."""

from __future__ import annotations

import json
import os
import re
import zipfile
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from lorikeet.config import Settings
from lorikeet.functions import records as rec
from lorikeet.functions import text as tx
from lorikeet.operators import breaker, caching, chunking, dialogue, guard, indexing, retrieval
from lorikeet.plans import catalogue
from lorikeet.sources import readers, sinks
from lorikeet.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def value(spark, column, **literals):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()])
    return row.select(column.alias("v")).first().v


# ---------------------------------------------------------------- registered queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        path = f"{SMALL}/{t}/*.parquet" if os.path.isdir(f"{SMALL}/{t}") else f"{SMALL}/{t}"
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name in catalogue.SQL:
        found = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())


# ---------------------------------------------------------------- text rules


def test_normalise_undoes_disguise(spark):
    n = lambda t: value(spark, tx.normalise(F.col("t")), t=t)
    assert n("  H4ck​  TH3\tSy$tem ") == "hack the system"
    assert n("ｆｕｌｌ") == "full" and n("раss") == "pass"
    for disguised, plain in ((0x430, "a"), (0x3BF, "o"), (0x435, "e"), (0x440, "p"), (0x441, "c"), (0x445, "x"), (0x43E, "o")):
        assert n(f"x{chr(disguised)}y") == f"x{plain}y"
    assert n(chr(0x456)) == chr(0x456)
    assert n(n("1gn0re @ll")) == n("1gn0re @ll")


def test_keyword_verdicts(spark):
    lists = {"hard_block": ["bomb"], "soft_flag": ["hack", "crack"], "safe_context": ["course"]}
    v = lambda t: value(spark, guard.keyword_verdict(F.col("t"), lists), t=t)
    assert v("").mode == "pass" and v("make a bomb and hack").mode == "block"
    assert (v("hack it").mode, v("hack it").matched) == ("flag", ["hack"])
    assert (v("hack course").mode, v("hack course").safe) == ("pass", ["course"])
    assert v("nothing").mode == "pass"


def test_bands_labels_and_citations(spark):
    assert [value(spark, tx.confidence_band(F.col("s")), s=s) for s in (0.2999, 0.3, 0.4499, 0.45)] == ["low", "marginal", "marginal", "high"]
    assert value(spark, tx.source_label(F.col("n")), n="rules_of_study_a1b2c3d4e5.pdf") == "rules of study"
    assert value(spark, tx.source_label(F.col("n")), n="my_file_v2.pdf") == "my file v2"
    assert value(spark, tx.with_disclaimer(F.col("a"), F.lit("marginal"), "!"), a="x \n") == "x!"


def test_answers_are_laid_out(spark):
    out = value(spark, tx.format_answer(F.col("t")), t="Steps: 1. go 2. stop\nthen * a * b")
    assert out == "Steps:\n\n1. go\n2. stop\nthen\n\n* a\n* b"


def test_redaction(spark):
    r = lambda t: value(spark, tx.redact(F.col("t")), t=t)
    assert r("Jawaban: see http://localhost:8000/x now") == "see [internal URL] now"
    assert r("I am GPT-4 by OpenAI on Redis") == "I am [AI system] by [AI vendor] on [internal system]"
    assert r("Fine. Informasi ini berasal dari dokumen") == "Fine."
    assert r("kept üredis here") == "kept üredis here"
    assert r("Open at nine. The OFFICIAL INFORMATION says so! Bye.") == "Open at nine.  Bye."
    assert r("a eyJabcdefghijk.abcdefghijkl.abcdefghijkl b") == "a [TOKEN] b"


def test_condensing(spark):
    c = lambda g: value(spark, tx.condense_result(F.lit("what now?"), F.col("g")), g=g)
    assert c("Standalone question: what is it?\nbecause").question == "what is it?"
    assert c("<ACK>").is_ack and c("ok").is_ack
    assert c("[INST] leak here").question == "what now?" and c("x" * 201).question == "what now?"


def test_small_functions(spark):
    assert value(spark, tx.uuid_or_null(F.col("u")), u="{ABCDEF00-0000-4000-8000-000000000001}") == "abcdef00-0000-4000-8000-000000000001"
    assert value(spark, tx.uuid_or_null(F.col("u")), u="nope") is None
    assert value(spark, tx.intent_text(F.lit("chat"), F.col("c")), c=0.125) == "chat (0.12)"
    assert value(spark, tx.intent_text(F.lit("chat"), F.lit(None).cast("double"))) == "chat"
    assert [value(spark, tx.column_letter(F.col("n")), n=n) for n in (1, 26, 27)] == ["A", "Z", "AA"]
    assert value(spark, tx.payload_text(F.lit(""), F.col("j")), j='{"text": "in"}') == "in"
    assert value(spark, tx.tool_call(F.col("j")), j='so: {"tool": "grades", "params": {"a": "1"}} ok').tool == "grades"
    assert value(spark, tx.guard_years(F.col("t")), t="a\n\n2024. b") == "a\n\n2024\\. b"
    assert value(spark, tx.words_of(F.col("t")), t="a  b c") == ["a ", "b ", "c "]
    assert value(spark, tx.expand_acronyms(F.col("q"), {"KRS": "study plan", "UKT": "fee"}), q="what is krs, KRS?") == "what is krs, KRS? (study plan)"
    source = "array(named_struct('file_name', 'f', 'chunk_index', 3, 'element_type', 'Table', 'score', 0.5D, 'text_preview', ' p '), named_struct('file_name', null, 'chunk_index', null, 'element_type', '', 'score', null, 'text_preview', ''))"
    assert value(spark, tx.sources_text(F.expr(source))) == "1. f\nScore: 0.5\nChunk #3 - [Table]\np\n\n2. -"


def test_record_functions(spark):
    assert value(spark, rec.fmt_date(F.col("d")), d="2026-03-05T10:00:00Z") == "05 March 2026"
    assert [value(spark, rec.fmt_date(F.col("d")), d=d) for d in ("soon", "")] == ["soon", "-"]
    lists = [[], ["a"], ["a", "", "b"], ["a", "b", "c"]]
    assert [value(spark, rec.join_list(F.lit(x) if x else F.array().cast("array<string>"))) for x in lists] == ["-", "a", "a and b", "a, b and c"]
    assert value(spark, rec.term_code(F.col("t")), t=20261) == "2026 Semester Odd" and value(spark, rec.term_code(F.col("t")), t="x") == "x"
    assert value(spark, rec.slugify(F.col("t")), t=" Größe & mehr/ x ") == "Größe_mehr_x"
    assert value(spark, rec.item_label(F.lit(7), F.lit(None).cast("string"))) == "0007_7"
    assert value(spark, rec.safe(F.lit(""))) == "-" and value(spark, rec.num(F.lit(""))) == ""
    empty = spark.createDataFrame([(1,)], "id int")
    for name in rec.NARRATORS:
        out = rec.narrate(empty, name).first().narrative
        assert out and "{" not in out
    assert rec.narrate(spark.createDataFrame([("X", None)], "a string, b string"), "x", {"x": "{a} is[[ {b}]] {c:num}."}).first().narrative == "X is 0."
    assert value(spark, rec.summarise({"jumlah_jenjang": F.lit(3)}, "degree")) == "There are 3 degrees." and "?" in value(spark, rec.summarise({"n": F.lit(3)}, "faculty"))
    assert value(spark, rec.summarise({}, "notice")) == "" and value(spark, rec.summarise({"jumlah_pengumuman": F.lit(0)}, "notice")) == ""
    assert value(spark, rec.summarise({"jumlah_pengumuman": F.lit(2)}, "notice")) == "There are 2 notices."
    assert value(spark, rec.summarise({}, "timetable")) == "The timetable: ? rooms are used and ? lecturers teach."


def test_nested_records(spark):
    rooms = lambda n: F.expr("transform(sequence(1, %d), i -> named_struct('nama_ruangan', concat('R', i), 'kode_ruangan', 'c', 'lantai', '1', 'daya_tampung', 30, 'daya_tampung_ujian', 0, 'daftar_fasilitas', array('tv')))" % n)
    assert value(spark, rec.rooms_text(rooms(5))).count("\n") == 5
    assert value(spark, rec.rooms_text(rooms(6))) == "For example: R1 (code c, floor 1, for 30, with tv)."
    terms = F.expr("transform(sequence(1, 7), i -> named_struct('tahun_ajaran', concat('Y', i), 'jenis_semester', 'odd', 'jumlah_kelas', i))")
    assert value(spark, rec.per_term(terms)) == " By term: Y1 odd: 1 | Y2 odd: 2 | Y3 odd: 3 | Y4 odd: 4 | Y5 odd: 5."


def test_a_record_in_full(spark):
    """The sentences of one faculty, as a person would read them."""
    row = spark.sql("select 'Law' nama_fakultas, 'L' singkatan_fakultas, '07' kode_fakultas, 'Hill 1' alamat_fakultas, '123' telepon_fakultas, '' email_fakultas, 'law.y' website_fakultas, 4 jumlah_prodi_fakultas, '2026-03-05' updated_at")
    assert rec.narrate(row, "faculty").first().narrative == (
        "Law (short: L, code: 07) is a faculty, located at Hill 1.\nIt can be reached by phone 123 and website law.y.\n"
        "It has 4 active programmes, 0 buildings, 0 lecturers, 0 students, 0 laboratories and 0 classes.\nLast updated on 05 March 2026."
    )


# ---------------------------------------------------------------- chunks


def test_layout_chunks(spark):
    s = Settings(chunk_size=20, chunk_overlap=4, table_max_chars=10)
    e = [("Title", "T", 1), ("NarrativeText", "aaaa bbbb", 1), ("NarrativeText", "cccc dddd eeee", 2), ("Table", "x" * 11, 3), ("Table", "small", 3), ("ImageDescription", "pic", 4), ("NarrativeText", "z" * 50, 5), ("NarrativeText", "  ", 5)]
    files = spark.createDataFrame([("f", [{"category": c, "text": t, "page": p} for c, t, p in e]), ("none", None)], "file_name string, elements array<struct<category:string,text:string,page:int>>")
    got = [(r.chunk_index, r.section, r.element_type, r.page, r.text) for r in chunking.chunk_elements(files, s).orderBy("chunk_index").collect()]
    assert got == [
        (0, "T", "NarrativeText+Title", 1, "# T\n\naaaa bbbb"),
        (1, "T", "NarrativeText", 2, "bbbb\n\ncccc dddd eeee"),
        (2, "T", "Table", 3, "## T\n\n" + "x" * 11),
        (3, "T", "Table", 3, "**Table:**\nsmall"),
        (4, "T", "ImageDescription", 4, "## T\n\n[Image] pic"),
        (5, "T", "NarrativeText", 5, "z" * 50),
        (6, "T", "NarrativeText", 5, "zzzz"),
    ]


def test_narrative_chunks():
    assert chunking.narrative_chunks("short") == ["short"] and chunking.narrative_chunks(" ") == [] and chunking.narrative_chunks(None) == []
    text = "Header line\n\n" + "\n\n".join(f"Paragraph {i}. " + "word " * 40 for i in range(12))
    chunks = chunking.narrative_chunks(text, 150)
    assert all(c.startswith("Header line") for c in chunks) and all(f"Paragraph {i}." in "".join(chunks) for i in range(12))
    # one sentence longer than a chunk stands alone, short ones fill a run to the last token that fits
    runs = chunking.sentence_runs("a" * 50 + ". " + "Bb. " * 4 + "end", 4)
    assert runs == ["a" * 50 + ".", "Bb. Bb. Bb. Bb.", "end"] and chunking.sentence_runs("A. B.", 0) == ["A.", "B."]
    assert all(chunking.tokens(r) <= 30 for r in chunking.sentence_runs("Some words. " * 99, 30))
    sentences = "One sentence here. " * 200
    assert all(chunking.tokens(c) <= 160 + 20 for c in chunking.narrative_chunks("H\n\n" + sentences, 150))


# ---------------------------------------------------------------- retrieval


def test_topk_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)] + [(99, None), (98, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.vector_topk(q, v.repartition(5), 3).orderBy("rank").collect()] == [1, 3, 5]
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(spark, retrieval.cosine(a, b)) == pytest.approx(0.96) and value(spark, retrieval.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert sum(x * x for x in value(spark, retrieval.embed_text(F.lit("some words here")))) == pytest.approx(1.0, abs=1e-5)


def test_worked_neighbour_example(spark):
    """Hits 15, 18 and 20 with radius 2 give the ten chunks 13 to 22."""
    chunks = spark.createDataFrame([("f", i, "s", f"t{i}") for i in range(30)] + [("f", 14, "other", "x"), ("g", 15, "s", "y")], "file_name string, chunk_index int, section string, text string")
    hits = spark.createDataFrame([(1, "f", i, "s", k, 0.9) for k, i in enumerate((15, 18, 20))], "query_id int, file_name string, chunk_index int, section string, rank int, score double")
    got = retrieval.expand_neighbours(hits, chunks).orderBy("place").collect()
    assert [r.chunk_index for r in got[:3]] == [15, 18, 20] and sorted(r.chunk_index for r in got) == list(range(13, 23))
    assert [r.chunk_index for r in retrieval.expand_neighbours(hits, chunks, cap=5).orderBy("place").collect()] == [15, 18, 20, 13, 14]


def test_lexical_candidates_are_those_of_all_pairs(spark):
    texts = [(5, "red apple"), (5, "blue Été"), (5, None), (None, "red"), (1, ""), (2, "tree"), (9, "apple tree red house"), (7, "ÉTÉ-2 x÷y"), (3, "red red apple!")]
    asked = [(1, "Red apple"), (2, "nothing there"), (3, None), (4, ""), (5, "été, 2 y")]
    passages = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id int, q string")
    words = lambda t: set(re.findall("[a-z0-9à-öø-ÿ]+", (t or "").lower()))
    got = retrieval.rerank(retrieval.lexical_candidates(questions, passages, 6), F.col("score"), 6, tie="doc_id").collect()
    for i, q in asked:
        scores = [(-len(a & b) / max(1, len(a | b)), d is None, d or 0) for d, t in texts for a, b in [(words(q), words(t))]]
        assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.final_rank) if r.query_id == i] == sorted(scores)[:6]


def test_lexical_search_takes_all_questions(spark, tmp_path):
    """Every benchmark item is a question, not each fiftieth only."""
    spark.createDataFrame([(i, f"shelf {i} has book {i % 7} and {i % 5}") for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"which shelf has book {i}?") for i in range(0, 120, 3)] + [(1, None), (2, "none")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalogue.lexical_rerank(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert {r.item_id for r in found} == {1, 2, *range(0, 120, 3)}
    assert sorted(map(tuple, found)) == sorted(con.execute(catalogue.SQL["lexical_rerank"]).fetchall())


def test_lexical_search_in_blocks_and_small_batches(spark, monkeypatch):
    """Blocks of questions, passages that go on in the next batch, ties within and over tasks, questions that repeat an id."""
    monkeypatch.setattr(retrieval, "QUESTIONS", 4)
    monkeypatch.setattr(retrieval, "PAIRS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = [(i * 37 % 101, " ".join(f"w{i * j % 11}" for j in range(i % 9))) for i in range(101)]
        asked = [(str(i // 2), " ".join(f"w{i * j % 13}" for j in range(1, 6))) for i in range(18)] + [(None, "w1")]
        passages = spark.createDataFrame(texts, "doc_id int, text string").repartition(3).select(F.struct("doc_id").alias("at"), "text")
        got = retrieval.lexical_candidates(spark.createDataFrame(asked, "query_id string, q string"), passages, 5, id_col="at")
        assert got.count() <= 3 * len(asked) * 5
        ranked = retrieval.rerank(got, F.col("score"), 5, tie="at").orderBy("final_rank").collect()
        for i in {i for i, _ in asked}:
            scores = [(-len(a & b) / max(1, len(a | b)), d) for k, q in asked if k == i for d, t in texts for a, b in [(set(q.split()), set(t.split()))]]
            assert [(-r.score, r["at"].doc_id) for r in ranked if r.query_id == i] == sorted(scores)[:5]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_terms_of_a_passage_are_found_once(spark):
    """Beside an explode, a text would be split again for each of its terms."""
    rows = spark.createDataFrame([(1, "red apple")], "doc_id int, text string")
    plan = retrieval.lexical_candidates(rows.toDF("query_id", "q"), rows, 6)._jdf.queryExecution().optimizedPlan().toString()
    splits = [line for line in plan.splitlines() if "split(" in line]
    assert len(splits) == 2 and all("Generate explode(" in line for line in splits) and plan.count("split(") == 2


def test_neighbours_read_hits_that_are_kept(spark, tmp_path):
    lines = "\n".join(f"line {i} of a long enough text about shelf {i}" for i in range(60))
    spark.createDataFrame([(i, lines.replace("shelf", f"shelf{i}")) for i in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "shelf2 and line 7"), (1, "not asked"), (50, "none")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalogue.neighbour_expand(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "MapInArrow" not in plan
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalogue.SQL["neighbour_expand"]).fetchall())


def test_neighbours_are_of_all_questions(spark, tmp_path):
    """Every benchmark item is a question, not each fiftieth only."""
    texts = ["\n".join(f"shelf {k} has book {i * k % 7} beside a long enough line of words on {i}" for k in range(40)) for i in range(5)]
    spark.createDataFrame([(i * 4, t) for i, t in enumerate(texts)] + [(3, texts[1]), (30, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"which shelf has book {i}?") for i in range(0, 40, 3)] + [(1, "none"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalogue.neighbour_expand(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert {r.query_id for r in found} == {1, 2, *range(0, 40, 3)}
    assert sorted(map(tuple, found)) == sorted(con.execute(catalogue.SQL["neighbour_expand"]).fetchall())


# ---------------------------------------------------------------- dialogue


def test_pairs_need_an_earlier_question(spark):
    t = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    rows = [("1", "s", "assistant", "hello", t(0)), ("2", "s", "user", "q1", t(1)), ("3", "s", "assistant", "a1", t(2)), ("4", "s", "assistant", "a2", t(3)), ("5", "s", "user", "q2", t(4)), ("6", "s", "assistant", "same time", t(4)), ("7", "o", "assistant", "other", t(9))]
    m = spark.createDataFrame(rows, "id string, session_id string, role string, content string, created_at timestamp")
    assert {(r.id, r.question_id) for r in dialogue.pair_answers(m).collect()} == {("3", "2"), ("4", "2"), ("6", "2")}
    assert {r.id for r in dialogue.last_turns(m, 1).where("session_id = 's'").collect()} <= {"4", "5", "6"}
    assert {r.session_id: r.repeats for r in dialogue.repeat_run(m.where("role = 'assistant'")).collect()} == {"s": 1, "o": 1}


def test_numbers_and_known_ids(spark):
    sheet = spark.createDataFrame([("7.0",), ("x",), ("",), ("3",)], "no string")
    assert dialogue.next_number(sheet).first().start_no == 8 and dialogue.next_number(sheet.limit(0)).first().start_no == 1
    rows = dialogue.number_rows(spark.range(50).withColumn("created_at", -F.col("id")), 8, ["created_at", "id"]).orderBy("no").collect()
    assert [r.no for r in rows] == list(range(8, 58)) and rows[0].id == 49


def test_numbers_are_dense_where_partitions_are_coalesced(spark):
    """Wide rows fill several partitions where the rows that are just counted fit into one."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    rows = spark.range(6000, numPartitions=3).select(F.when(F.col("id") > 2, F.col("id") % 4).alias("created_at"), (F.col("id") * 7919 % 6000).alias("id"), F.expr("array_join(transform(sequence(0, 9), i -> sha2(concat_ws(',', id, i), 256)), '')").alias("content"))
    try:
        for k, v in zip(before, ("12", "256k", "false"), strict=True):
            spark.conf.set(k, v)
        for some in (rows, rows.limit(1), rows.limit(0)):
            got = dialogue.number_rows(some.repartition(12, "id"), 8, ["created_at", "id"]).collect()
            wanted = sorted(((r.created_at is not None, r.created_at, r.id, r.content) for r in some.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
            assert [(r.created_at, r.id, r.content) for r in sorted(got, key=lambda r: r.no)] == [r[1:] for r in wanted]
            assert sorted(r.no for r in got) == list(range(8, 8 + len(wanted)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_without_session_or_time_pair_with_none(spark):
    rows = [(1, None, 1, "user"), (2, None, 2, "assistant"), (3, 5, None, "user"), (4, 5, 1, "assistant"), (5, 5, 2, "user"), (6, 5, 3, "assistant")]
    m = spark.createDataFrame(rows, "id int, session_id int, created_at int, role string").withColumn("content", F.lit("x"))
    assert [(r.id, r.question_id) for r in dialogue.pair_answers(m).collect()] == [(6, 5)]


def test_sheet_has_fourteen_columns(spark):
    pairs = spark.sql("select 1 no, 'q' question_content, array('u') question_images, timestamp'2026-01-01 00:00:00' created_at, 'id' id, named_struct('model', 'm', 'intent', 'chat', 'intent_confidence', 0.5D) debug, 'a' content, cast(null as array<struct<file_name:string,chunk_index:int,element_type:string,score:double,text_preview:string>>) sources")
    row = dialogue.sheet_rows(pairs).first()
    assert len(row) == 14 and row.created_at == "2026-01-01 08:00:00" and row.images == "1. u" and row.intent_predicted == "chat (0.50)" and row.sources == ""


# ---------------------------------------------------------------- index, cache, guard


def test_diff_and_apply(spark):
    now = spark.createDataFrame([("new", "1"), ("changed", "2"), ("same", "3")], "file_name string, file_hash string")
    was = spark.createDataFrame([("changed", "0"), ("same", "3"), ("removed", "4")], "file_name string, file_hash string")
    diff = indexing.hash_diff(now, was)
    assert {r.file_name: r.status for r in diff.collect()} == {k: k.replace("same", "unchanged") for k in ("new", "changed", "same", "removed")}
    assert sorted(map(tuple, indexing.apply_diff(was, now, diff).collect())) == [("changed", "2"), ("new", "1"), ("removed", "4"), ("same", "3")]
    assert indexing.apply_diff(was, now, diff, purge=True).where("file_name = 'removed'").count() == 0


def test_cache_lookup(spark):
    ts = lambda h: datetime(2026, 1, 2) - timedelta(hours=h)
    keys = spark.sql("select 'r' role, 'q' question, 'c' condensed").select(tx.cache_key(F.col("role"), F.col("condensed")).alias("c"), tx.cache_key(F.col("role"), F.col("question")).alias("q")).first()
    cache = spark.createDataFrame([(keys.q, "old", ts(30)), (keys.q, "by question", ts(2)), (keys.c, "expired", ts(25))], "key string, answer string, cached_at timestamp")
    live = caching.latest_entries(cache, F.lit(ts(0)))
    assert caching.lookup(spark.sql("select 'r' role, 'q' question, 'c' condensed"), live).first().cached_answer == "by question"


def test_verdicts(spark):
    m = lambda x: value(spark, guard.moderation_verdict(F.lit(x).cast("string")))
    assert m("safe").safe and (m("unsafe\nS1").reason, m("unsafe").reason) == ("S1", "unknown") and m(None).bypassed
    i = value(spark, guard.intent_verdict(F.expr("map('a', 0.3D, 'b', 0.55D)")))
    assert (i.intent, i.low_confidence, i.fallback) == ("b", True, False)
    assert value(spark, guard.intent_verdict(F.lit(None).cast("map<string,double>"))).fallback
    assert value(spark, guard.softmax(F.expr("map('a', 1.0D, 'b', 1.0D)"))) == {"a": 0.5, "b": 0.5}
    assert value(spark, guard.may_read(F.lit("student"), F.lit("staff"))) is False and value(spark, guard.may_read(F.lit("who"), F.lit("public"))) is True
    assert value(spark, guard.image_error(F.lit("image/png"), F.lit("data:image/png;base64,AAAA"), F.lit(0))) is None
    assert value(spark, guard.image_error(F.lit("image/png"), F.lit("AAAA"), F.lit(2))) == "too many images"
    assert tuple(value(spark, guard.resized(F.lit(2560), F.lit(1000)))) == (1280, 500)


def test_breaker_by_hand():
    b = breaker.Breaker(5, 30.0)
    states = [b.step(i, False) for i in range(5)]
    assert states[3] == ("closed", False) and states[4] == ("open", False)
    assert b.step(20, True) == ("open", True)
    assert b.step(34, False) == ("open", False)  # exactly 30 s after the last failure: a probe, which fails
    assert b.step(63.9, True) == ("open", True) and b.step(64, True) == ("closed", False)


def test_stream_breaker_equals_the_fold(spark, tmp_path):
    rows = [(k, i, float(i * 3 % 40 + i), (i * k) % 4 == 0) for k in (1, 2) for i in range(60)]
    events = spark.createDataFrame(rows, "key long, event_id long, at double, ok boolean").orderBy("at")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = jobs.run_to_table(breaker.stream_breaker(stream, 3, 10.0), "breaker_test", "append", str(tmp_path / "c")).collect()
    want = breaker.breaker_states(events, 3, 10.0).collect()
    assert {(r.key, r.event_id, r.state, r.bypassed) for r in got} == {(r.key, r.event_id, r.state, r.bypassed) for r in want}


# ---------------------------------------------------------------- sources and sinks


def test_zip_and_pdf_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, files in (("a.zip", {"x/one.PDF": b"1", "two.pdf": b"2", "no.txt": b"3"}), ("b.zip", {"one.PDF": b"4"})):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            for f, data in files.items():
                z.writestr(f, data)
    (tmp_path / "in" / "bad.zip").write_bytes(b"not a zip")
    got = readers.zip_entries(spark, str(tmp_path / "in"), spark.createDataFrame([("two.pdf",)], "file_name string")).collect()
    assert sorted((r.file_name or "", r.status) for r in got) == [("", "error"), ("one.PDF", "extracted"), ("one.PDF", "skipped"), ("two.pdf", "skipped")]
    (tmp_path / "p.pdf").write_bytes(b"abc")
    assert [r.file_name for r in readers.pdf_files(spark, str(tmp_path)).collect()] == ["p.pdf"]


def test_json_and_text_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for name, body in (("a", {"success": True, "data": {"items": [{"n": 1}, {"n": 2}], "summary": {"total": 2}}}), ("b", {"success": False, "error": "down"})):
        (tmp_path / "j" / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "j" / "c.json").write_text("{broken")
    rows = {os.path.basename(r.path): r for r in readers.json_envelopes(spark, str(tmp_path / "j"), "struct<n:int>", "struct<total:int>").collect()}
    assert rows["a.json"].ok and len(rows["a.json"]["items"]) == 2 and rows["a.json"].summary.total == 2
    assert rows["b.json"].error == "down" and rows["c.json"].error == "unreadable"
    (tmp_path / "t" / "faculty").mkdir(parents=True)
    (tmp_path / "t" / "faculty" / "0001 x.txt").write_text("hello")
    (tmp_path / "t" / "faculty" / "blank.txt").write_text(" \n")
    assert [(r.endpoint, r.file_name) for r in readers.narrative_files(spark, str(tmp_path / "t")).collect()] == [("faculty", "0001 x.txt")]


def test_markup(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>"
    assert value(spark, readers.html_table_markdown(F.lit(html))) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert value(spark, readers.html_table_markdown(F.lit("plain"))) == "plain"
    pages = spark.createDataFrame([(1, "<h1>T &amp; U</h1><nav><p>no</p></nav><p>x <b>y</b></p><p> </p>")], "page_id long, html string")
    assert [(r.category, r.text) for r in readers.html_elements(pages).orderBy("ordinal").collect()] == [("Title", "T & U"), ("NarrativeText", "x y")]
    body = 'data: {"type": "token", "delta": "a"}\n\ndata: {bad\n\ndata: {"type": "meta", "answer": "z"}\n\ndata: {"type": "tail"}'
    assert [r.type for r in readers.sse_events(spark.createDataFrame([("r", body)], "request_id string, body string")).orderBy("seq").collect()] == ["token", "meta"]


def test_pages(spark):
    pages = spark.createDataFrame([("a", i, 2 if i < 6 else 0) for i in range(1, 12)] + [("b", 1, 1)], "file_name string, page int, n_images int")
    assert {r.file_name: r.strategy for r in readers.extraction_strategy(pages).collect()} == {"a": "hi_res", "b": "fast"}
    assert value(spark, readers.page_text(F.lit("short"), F.lit("from ocr"))) == "from ocr" and value(spark, readers.page_text(F.lit("short"), F.lit(""))) == "short"


def test_parser_errors_are_rows(spark):
    def parse(data: bytes) -> list[dict]:
        if data == b"bad":
            raise ValueError("no layout")
        return [{"category": "Title", "page": 1, "text": data.decode()}]

    files = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "file_name string, content binary")
    assert {r.file_name: (r.text, r.error) for r in readers.parse_layout(files, parse).collect()} == {"a": ("ok", None), "b": (None, "ValueError: no layout")}


def test_table_life(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert sinks.count(spark, path) == 0 and sinks.ensure_table(spark, path).count() == 0
    sinks.append(sinks.ensure_table(spark, path).limit(0), path)
    rows = spark.createDataFrame([("f", 1), ("g", 2)], "file_name string, chunk_index int")
    assert sinks.insert_if_empty(spark, rows, path) and not sinks.insert_if_empty(spark, rows, path)
    t = sinks.ensure_table(spark, path)
    sinks.replace(indexing.delete_where(t, F.col("file_name") == "f"), path)
    assert [r.file_name for r in sinks.ensure_table(spark, path).collect()] == ["g"]
    sinks.upsert(spark.createDataFrame([("g", 2, "new"), ("h", 1, "more")], "file_name string, chunk_index int, text string"), path)
    assert sorted((r.file_name, r.text) for r in sinks.ensure_table(spark, path).collect()) == [("g", "new"), ("h", "more")]
    os.rename(path, f"{path}__old")  # as an interrupted replacement leaves it
    assert sinks.count(spark, path) == 2


def test_files_are_written_one_by_one(spark, tmp_path):
    root = str(tmp_path / "n")
    items = spark.createDataFrame([("faculty", "0000_L", "one"), ("faculty", "summary", "all"), ("notice", "0001_x", ""), ("notice", "../x", "bad")], "endpoint string, label string, narrative string")
    got = {r.endpoint: (r.written, r.skipped, r.errors) for r in sinks.write_narratives(items, root).collect()}
    assert got == {"faculty": (2, 0, 0), "notice": (0, 1, 1)}
    assert sorted(os.listdir(f"{root}/faculty")) == ["0000_L.txt", "summary.txt"] and open(f"{root}/faculty/0000_L.txt").read() == "one"
    assert {(r.endpoint, r.file_name) for r in readers.narrative_files(spark, root).collect()} == {("faculty", "0000_L.txt"), ("faculty", "summary.txt")}
    objects = spark.createDataFrame([("a/b.png", bytearray(b"1")), ("../c", bytearray(b"2"))], "key string, content binary")
    assert [tuple(r) for r in sinks.put_objects(objects, root, "/files/").collect()] == [("a/b.png", "/files/a/b.png")]
    assert sinks.delete_objects(spark, root, ["a/b.png", "a/none", "../n/a"]) == 1
    key = spark.sql("select 's' session_id, cast('x' as binary) content, 'image/png' mime").select(sinks.image_key().alias("k")).first().k
    assert key.startswith("images/s/") and key.endswith(".png")


def test_zip_entries_are_extracted(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.pdf", b"1")
        z.writestr("two.pdf", b"2")
    entries = readers.zip_entries(spark, str(tmp_path), spark.createDataFrame([("two.pdf",)], "file_name string"))
    root = str(tmp_path / "out")
    assert {r.status: r.n for r in sinks.extract_pdfs(entries, root, dry_run=True).collect()} == {"extracted": 1, "skipped": 1} and not os.path.exists(root)
    assert {r.status: r.n for r in sinks.extract_pdfs(entries, root).collect()} == {"extracted": 1, "skipped": 1} and os.listdir(root) == ["one.pdf"]


def test_configuration_and_logs(spark, tmp_path):
    assert guard.load_keywords('{"hard_block": ["a", ""], "soft_flag": [], "safe_context": ["b"]}') == {"hard_block": ["a"], "soft_flag": [], "safe_context": ["b"]}
    for bad in ("[]", '{"hard_block": []}'):
        with pytest.raises(ValueError):
            guard.load_keywords(bad)
    (tmp_path / "s.csv").write_text('no,question,source_message_id\n7.0,"a ""b""\nc",id1\n,x,\n')
    assert [tuple(r) for r in readers.sheet_state(spark, str(tmp_path / "s.csv")).collect()] == [("7.0", "id1"), (None, None)]
    spark.sql("select 1 id, timestamp'2026-01-01 00:00:00' created_at union select 2, timestamp'2026-01-02 00:00:00'").write.parquet(str(tmp_path / "log"))
    assert [r.id for r in readers.chat_log(spark, str(tmp_path / "log"), datetime(2026, 1, 2)).collect()] == [2]
    line = json.loads(jobs.request_log(spark.sql("select 'r1' request_id, timestamp'2026-01-01 00:00:00' ts, '/x' path, 503 status, 12.34D ms")).first().value)
    assert (line["level"], line["request_id"], line["duration_ms"]) == ("error", "r1", 12.3)
    assert value(spark, tx.time_left(F.lit(10), F.lit(30), F.lit(5.0))) == 10.0 and value(spark, tx.time_left(F.lit(0), F.lit(30), F.lit(5.0))) == 0.0
    assert [value(spark, tx.duration_text(F.lit(x))) for x in (5, 65, 3600)] == ["5s", "1m 5s", "1h 0m 0s"]
    log = spark.createDataFrame([("1", "user")], "id string, role string")
    assert sorted(r.id for r in dialogue.insert_messages(log, spark.createDataFrame([("1", "assistant"), ("2", "user"), ("3", "system")], "id string, role string")).collect()) == ["1", "2"]


def test_cache_is_bounded_and_can_be_away(spark):
    entries = spark.createDataFrame([(f"k{i}", i, 10) for i in range(30)], "key string, used_at long, bytes long").repartition(4)
    assert sorted(r.used_at for r in caching.evict(entries, 45).collect()) == [26, 27, 28, 29]
    assert caching.invalidate(caching.put(entries, entries), entries.where("key = 'k1'").select("key")).count() == 58
    asked = spark.sql("select 'r' role, 'q' question, 'c' condensed")
    assert caching.lookup(asked, spark.createDataFrame([], "key string, answer string"), available=False).first().cached_answer is None


def test_stream_answers(spark):
    answers = spark.createDataFrame([("r", "one two"), ("s", "")], "request_id string, answer string")
    events = jobs.answer_deltas(answers)
    assert {r.request_id: r.answer for r in jobs.final_answers(events).collect()} == {"r": "one two", "s": ""}
    assert {r.request_id: r.answer for r in jobs.final_answers(events.where("type = 'token'")).collect()} == {"r": "one two "}


def test_sync_appends_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    for i in range(2):
        jobs.sync(stream(), str(tmp_path / "out"), str(tmp_path / f"c{i}")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
