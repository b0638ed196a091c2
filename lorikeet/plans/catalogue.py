"""Registered queries over the driver's tables, each with SQL that computes the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.functions import records as rec
from lorikeet.functions import text as tx
from lorikeet.operators import breaker, caching, chunking, dialogue, guard, indexing, retrieval
from lorikeet.sources import readers
from lorikeet.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- retrieval

#: Every fiftieth vector is a question.
_TOPK = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, c.vec_id, list_cosine_similarity(q.e, c.embedding::DOUBLE[]) AS score FROM q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e)


@query(_TOPK + "SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 12")
def vector_topk(spark, sf_dir):
    return _topk(spark, sf_dir).select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _TOPK
    + """, d AS (SELECT r.*, d.text, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.vec_id) AS final_rank
  FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE rank <= 12)
SELECT query_id, vec_id, final_rank, round(score, 4) AS score, left(text, 300) AS text_preview,
       CASE WHEN round(score, 4) < 0.3 THEN 'low' WHEN round(score, 4) < 0.45 THEN 'marginal' ELSE 'high' END AS band
FROM d WHERE final_rank <= 6"""
)
def rerank_cite(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    best = retrieval.rerank(_topk(spark, sf_dir).join(texts, "vec_id"), F.lit(None).cast("double"), tie="vec_id")
    cite = tx.citation(F.lit("documents"), F.lit(None), F.col("vec_id"), F.lit(None), F.col("score"), F.col("text"))
    return best.withColumn("c", cite).select("query_id", "vec_id", F.col("final_rank").cast("long").alias("final_rank"), F.col("c.score").alias("score"), F.col("c.text_preview").alias("text_preview"), tx.confidence_band(F.round("score", 4)).alias("band"))


@query(
    _TOPK
    + """SELECT query_id, round(avg((a.label = b.label)::INT), 4) AS "precision"
FROM r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.vec_id WHERE rank <= 12 GROUP BY query_id"""
)
def context_precision(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = _topk(spark, sf_dir).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return retrieval.context_precision(rows, F.col("label") == F.col("wanted")).select("query_id", F.round("precision", 4).alias("precision"))


@query(
    _TOPK
    + """SELECT r.query_id, round(sum((a.label = b.label)::INT) / any_value(n.n), 4) AS recall
FROM r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.vec_id
JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) n ON n.label = a.label WHERE rank <= 12 GROUP BY r.query_id"""
)
def context_recall(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "wanted")
    rows = _topk(spark, sf_dir).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(sizes, "wanted")
    return rows.groupBy("query_id").agg(F.round(F.count_if(F.col("label") == F.col("wanted")) / F.first("n"), 4).alias("recall"))


@query("""
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '')) AS ts FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '')) AS ts FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(q.ts, d.ts)) AS shared, len(q.ts) + len(d.ts) - len(list_intersect(q.ts, d.ts)) AS u FROM q, d),
r AS (SELECT item_id, doc_id, CASE WHEN u > 0 THEN shared / u ELSE 0 END AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS final_rank FROM r)
SELECT item_id, doc_id, round(score, 4) AS score, final_rank FROM k WHERE final_rank <= 6""")
def lexical_rerank(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    scored = retrieval.lexical_candidates(q, table(spark, sf_dir, "documents").select("doc_id", "text"), query_id="item_id", question="question")
    best = retrieval.rerank(scored, F.col("score"), query_id="item_id", tie="doc_id")
    return best.select("item_id", "doc_id", F.round("final_score", 4).alias("score"), F.col("final_rank").cast("long").alias("final_rank"))


_CHUNKS = """
WITH RECURSIVE e AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (
  SELECT doc_id, i, t, 0 AS ci, t AS body, length(t) AS size, t AS part FROM e WHERE i = 1
  UNION ALL
  SELECT e.doc_id, e.i, e.t,
         CASE WHEN f.size + length(e.t) > 512 AND trim(f.body, chr(10) || ' ') <> '' THEN f.ci + 1 ELSE f.ci END,
         CASE WHEN f.size + length(e.t) > 512 THEN CASE WHEN f.part <> '' THEN right(f.part, 128) || chr(10) || chr(10) || e.t ELSE e.t END ELSE f.body || chr(10) || chr(10) || e.t END,
         CASE WHEN f.size + length(e.t) > 512 THEN length(right(f.part, 128)) + length(e.t) ELSE f.size + length(e.t) END,
         e.t
  FROM f JOIN e ON e.doc_id = f.doc_id AND e.i = f.i + 1),
c AS (SELECT doc_id, ci AS chunk_index, regexp_replace(arg_max(body, i), '^\\s+|\\s+$', '', 'g') AS text FROM f GROUP BY doc_id, ci)
"""


def _line_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("file_name"), F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit("NarrativeText").alias("category"), t.alias("text"), F.lit(1).alias("page"))).alias("elements"))
    return chunking.chunk_elements(files)


@query(_CHUNKS + "SELECT doc_id, chunk_index::BIGINT AS chunk_index, length(text)::BIGINT AS n, md5(text) AS h FROM c WHERE text <> ''")
def chunk_lines(spark, sf_dir):
    return _line_chunks(spark, sf_dir).select(F.col("file_name").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n"), F.md5("text").alias("h"))


@query(
    _CHUNKS
    + """, q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '')) AS ts FROM benchmark),
d AS (SELECT doc_id, chunk_index, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda t: t <> '')) AS ts FROM c WHERE text <> ''),
s AS (SELECT item_id, doc_id, chunk_index, len(list_intersect(q.ts, d.ts)) AS shared, len(q.ts) + len(d.ts) - len(list_intersect(q.ts, d.ts)) AS u FROM q, d),
k AS (SELECT * FROM (SELECT item_id AS query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN u > 0 THEN shared / u ELSE 0 END DESC, doc_id, chunk_index) AS rank FROM s) WHERE rank <= 12),
n AS (SELECT k.query_id, c.doc_id, c.chunk_index, min(k.rank) AS rank FROM k JOIN c ON c.doc_id = k.doc_id AND c.chunk_index BETWEEN k.chunk_index - 2 AND k.chunk_index + 2 AND c.text <> '' GROUP BY ALL),
u AS (SELECT query_id, doc_id, chunk_index, rank, 0 AS kind FROM k UNION ALL
      SELECT query_id, doc_id, chunk_index, rank, 1 FROM n ANTI JOIN k USING (query_id, doc_id, chunk_index)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, rank, doc_id::VARCHAR, chunk_index) AS place FROM u)
SELECT query_id, doc_id, chunk_index::BIGINT AS chunk_index, kind::BIGINT AS kind, place::BIGINT AS place FROM p WHERE place <= 30 OR kind = 0"""
)
def neighbour_expand(spark, sf_dir):
    """The hits are each question's best chunks of all documents, by the lexical score."""
    # a chunk table, as an index has: the chunks are read twice, and cut once; so are the hits
    chunks = _kept(spark, _line_chunks(spark, sf_dir), "chunks")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    places = chunks.select(F.struct(F.col("file_name").cast("long").alias("file_name"), "chunk_index").alias("at"), "text")
    scored = retrieval.lexical_candidates(q, places, 12, question="question", id_col="at")
    best = retrieval.rerank(scored, F.col("score"), n=12, tie="at").withColumnRenamed("final_rank", "rank")
    hits = best.select("query_id", F.col("at.file_name").cast("string").alias("file_name"), "at.chunk_index", "rank", "score").join(chunks.select("file_name", "chunk_index", "section"), ["file_name", "chunk_index"])
    out = retrieval.expand_neighbours(_kept(spark, hits, "hits"), chunks)
    return out.select("query_id", F.col("file_name").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("kind").cast("long").alias("kind"), F.col("place").cast("long").alias("place"))


def _kept(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, so that readers don't compute them anew."""
    path = f"{_shared(spark)}/lorikeet-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


_HTML = r"""
WITH RECURSIVE b AS (
  SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->', '', 'g') AS body FROM pages),
x AS (
  SELECT page_id, unnest(regexp_extract_all(body, '(?is)<(?:h1|p)\b[^>]*>.*?</(?:h1|p)>')) AS raw, generate_subscripts(regexp_extract_all(body, '(?is)<(?:h1|p)\b[^>]*>.*?</(?:h1|p)>'), 1) AS o FROM b),
y AS (
  SELECT page_id, o, regexp_matches(raw, '(?i)^<h1') AS title,
         regexp_replace(replace(replace(replace(replace(replace(regexp_replace(raw, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS t FROM x),
e AS (
  SELECT page_id, title, t, row_number() OVER (PARTITION BY page_id ORDER BY o) AS i FROM y WHERE t <> ''),
f AS (
  SELECT page_id, i, 0 AS ci, CASE WHEN title THEN t ELSE '' END AS section, CASE WHEN title THEN '# ' || t ELSE t END AS body,
         length(t) + CASE WHEN title THEN 2 ELSE 0 END AS size, CASE WHEN title THEN '# ' || t ELSE t END AS part, title AS titled, NOT title AS said
  FROM e WHERE i = 1
  UNION ALL
  SELECT e.page_id, e.i,
         CASE WHEN e.title OR f.size + length(e.t) > 512 THEN f.ci + 1 ELSE f.ci END,
         CASE WHEN e.title THEN e.t ELSE f.section END,
         CASE WHEN e.title THEN '# ' || e.t WHEN f.size + length(e.t) > 512 THEN right(f.part, 128) || chr(10) || chr(10) || e.t ELSE f.body || chr(10) || chr(10) || e.t END,
         CASE WHEN e.title THEN length(e.t) + 2 WHEN f.size + length(e.t) > 512 THEN length(right(f.part, 128)) + length(e.t) ELSE f.size + length(e.t) END,
         CASE WHEN e.title THEN '# ' || e.t ELSE e.t END,
         e.title OR (f.size + length(e.t) <= 512 AND f.titled), NOT e.title
  FROM f JOIN e ON e.page_id = f.page_id AND e.i = f.i + 1)
SELECT page_id::VARCHAR AS file_name, ci::INT AS chunk_index, arg_max(section, i) AS section,
       CASE WHEN arg_max(titled, i) AND bool_or(said) THEN 'NarrativeText+Title' WHEN arg_max(titled, i) THEN 'Title' ELSE 'NarrativeText' END AS element_type,
       1::INT AS page, regexp_replace(arg_max(body, i), '^\s+|\s+$', '', 'g') AS text
FROM f GROUP BY page_id, ci"""

#: Sentences end at a mark before white space; U+0001 is put there and split at.
_NARRATIVE = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, text, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS first FROM documents WHERE regexp_matches(text, '\S')),
h AS (SELECT doc_id, text, left(first, 120) || CASE WHEN length(first) > 120 THEN '...' ELSE '' END AS header FROM b),
r AS (SELECT *, 400 - greatest(1, floor(length(header) / 3.5)) - 10 AS room FROM h WHERE greatest(1, floor(length(text) / 3.5)) > 400),
p AS (
  SELECT doc_id, room, regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^\s+|\s+$', '', 'g') AS para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS p FROM r),
q AS (
  SELECT doc_id, room, p, CASE WHEN greatest(1, floor(length(para) / 3.5)) <= room THEN [para] ELSE string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS ts FROM p WHERE para <> ''),
s AS (SELECT doc_id, room, p, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM q),
g AS (
  SELECT doc_id, room, p, i, 0 AS k, length(t) AS size FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.room, s.p, s.i, CASE WHEN greatest(1, floor((g.size + 1 + length(s.t)) / 3.5)) <= s.room THEN g.k ELSE g.k + 1 END,
         CASE WHEN greatest(1, floor((g.size + 1 + length(s.t)) / 3.5)) <= s.room THEN g.size + 1 + length(s.t) ELSE length(s.t) END
  FROM g JOIN s ON s.doc_id = g.doc_id AND s.p = g.p AND s.i = g.i + 1),
u AS (
  SELECT g.doc_id, g.p, g.k, string_agg(s.t, ' ' ORDER BY g.i) AS part FROM g JOIN s ON s.doc_id = g.doc_id AND s.p = g.p AND s.i = g.i GROUP BY ALL),
n AS (SELECT doc_id, part, greatest(1, floor(length(part) / 3.5)) AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS n FROM u),
c AS (
  SELECT doc_id, n, 0 AS ci, cost AS used FROM n WHERE n = 1
  UNION ALL
  SELECT n.doc_id, n.n, CASE WHEN c.used + n.cost <= 400 THEN c.ci ELSE c.ci + 1 END, CASE WHEN c.used + n.cost <= 400 THEN c.used + n.cost ELSE n.cost END
  FROM c JOIN n ON n.doc_id = c.doc_id AND n.n = c.n + 1),
d AS (
  SELECT c.doc_id, c.ci, string_agg(n.part, chr(10) || chr(10) ORDER BY n.n) AS chunk FROM c JOIN n ON n.doc_id = c.doc_id AND n.n = c.n GROUP BY ALL)
SELECT d.doc_id, d.ci::BIGINT AS chunk_index, count(*) OVER (PARTITION BY d.doc_id) AS total_chunks,
       CASE WHEN d.ci = 0 OR starts_with(d.chunk, left(h.header, 40)) THEN d.chunk ELSE h.header || chr(10) || chr(10) || d.chunk END AS chunk
FROM d JOIN h ON h.doc_id = d.doc_id
UNION ALL
SELECT doc_id, 0, 1, text FROM h WHERE greatest(1, floor(length(text) / 3.5)) <= 400"""


@query(_HTML)
def chunk_sections(spark, sf_dir):
    """Sections of web pages: titles open them."""
    e = readers.html_elements(table(spark, sf_dir, "pages"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "category", "text")))
    files = e.groupBy("page_id").agg(parts.alias("p")).select(F.col("page_id").cast("string").alias("file_name"), F.transform("p", lambda x: F.struct(x["category"].alias("category"), x["text"].alias("text"), F.lit(1).alias("page"))).alias("elements"))
    return chunking.chunk_elements(files)


@query(_NARRATIVE)
def chunk_narrative(spark, sf_dir):
    return chunking.chunk_narratives(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "chunk")


@query("""
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i - 1 AS ordinal, coalesce(last_value(CASE WHEN length(t) < 40 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') AS section FROM e""")
def section_carry(spark, sf_dir):
    """Short lines count as titles."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    lines = lines.withColumn("category", F.when(F.length("text") < 40, "Title").otherwise("NarrativeText"))
    return chunking.carry_sections(lines, "doc_id").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "section")


# ---------------------------------------------------------------- conversations


def _messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))


@query("""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), u AS (SELECT * FROM conversations WHERE role = 'user')
SELECT a.conv_id, a.turn, u.text AS question, a.text AS answer, row_number() OVER (ORDER BY a.turn, a.conv_id * 1000 + a.turn) AS no
FROM a ASOF JOIN u ON a.conv_id = u.conv_id AND a.turn > u.turn""")
def qa_pairs(spark, sf_dir):
    pairs = dialogue.number_rows(dialogue.pair_answers(_messages(spark, sf_dir)), 1, ["created_at", "id"])
    return pairs.select(F.col("session_id").alias("conv_id"), F.col("created_at").alias("turn"), F.col("question_content").alias("question"), F.col("content").alias("answer"), "no")


@query("""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), u AS (SELECT * FROM conversations WHERE role = 'user'),
p AS (SELECT a.conv_id, a.turn FROM a ASOF JOIN u ON a.conv_id = u.conv_id AND a.turn > u.turn)
SELECT conv_id, turn FROM p WHERE conv_id % 3 <> 0""")
def qa_new_rows(spark, sf_dir):
    """The sink holds the answers of every third conversation, under UUIDs made of their ids."""
    uuid = lambda x: F.regexp_replace(F.md5(x.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    pairs = dialogue.pair_answers(_messages(spark, sf_dir)).withColumn("uid", F.upper(uuid(F.col("id"))))
    sink = pairs.where("session_id % 3 = 0").select(F.lower("uid").alias("source_message_id")).union(spark.range(1).select(F.lit("not an id")))
    return dialogue.new_rows(pairs, sink, key="uid").select(F.col("session_id").alias("conv_id"), F.col("created_at").alias("turn"))


@query("SELECT coalesce(max(turn), 0)::BIGINT + 1 AS start_no FROM conversations")
def next_number(spark, sf_dir):
    sheet = table(spark, sf_dir, "conversations").select(F.concat(F.col("turn").cast("string"), F.lit(".0")).alias("no")).union(spark.range(1).select(F.lit("n/a")))
    return dialogue.next_number(sheet).select(F.col("start_no").cast("long").alias("start_no"))


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system')
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM m WHERE rn <= 4 GROUP BY conv_id""")
def history_last_n(spark, sf_dir):
    rows = dialogue.last_turns(_messages(spark, sf_dir), 2)
    hist = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "role", "content"))).alias("h"))
    return hist.select(F.col("session_id").alias("conv_id"), tx.format_history(F.col("h")).alias("history"))


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations WHERE role <> 'system')
SELECT conv_id, turn FROM m WHERE s <= 1200 OR rn <= 2""")
def history_budget_trim(spark, sf_dir):
    return dialogue.budget_trim(_messages(spark, sf_dir), 300).select(F.col("session_id").alias("conv_id"), F.col("created_at").alias("turn"))


@query("""
WITH l AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newest FROM events),
o AS (SELECT *, sum((event_type <> newest)::INT) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS others FROM l)
SELECT user_id, count(*) FILTER (WHERE others = 0) AS repeats FROM o GROUP BY user_id""")
def repeat_run(spark, sf_dir):
    return dialogue.repeat_run(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"))


@query("SELECT conv_id, max(turn) AS last_message_at, count(*) FILTER (WHERE role = 'assistant') AS message_count FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def session_rollup(spark, sf_dir):
    return dialogue.session_rollup(_messages(spark, sf_dir)).withColumnRenamed("session_id", "conv_id")


# ---------------------------------------------------------------- index


def _snapshot(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    now = d.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("file_name"), indexing.file_hash(F.col("text")).alias("file_hash"))
    was = d.where("doc_id % 10 <> 2").select(F.col("doc_id").alias("file_name"), F.when(F.col("doc_id") % 10 == 3, "old").otherwise(indexing.file_hash(F.col("text"))).alias("file_hash"))
    return now, was


_DIFF = """
WITH n AS (SELECT doc_id AS file_name, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1),
w AS (SELECT doc_id AS file_name, CASE WHEN doc_id % 10 = 3 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2),
d AS (SELECT coalesce(n.file_name, w.file_name) AS file_name,
       CASE WHEN w.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN n.h <> w.h THEN 'changed' ELSE 'unchanged' END AS status, n.h AS file_hash
  FROM n FULL JOIN w ON n.file_name = w.file_name)
"""


@query(_DIFF + "SELECT * FROM d")
def index_diff(spark, sf_dir):
    return indexing.hash_diff(*_snapshot(spark, sf_dir))


@query(_DIFF + "SELECT file_name, h AS file_hash FROM w ANTI JOIN (SELECT * FROM d WHERE status = 'changed') USING (file_name) UNION ALL SELECT file_name, h FROM n SEMI JOIN (SELECT * FROM d WHERE status IN ('new', 'changed')) USING (file_name)")
def index_apply(spark, sf_dir):
    now, was = _snapshot(spark, sf_dir)
    return indexing.apply_diff(was, now, indexing.hash_diff(now, was))


@query(_DIFF + "SELECT status, count(*) AS n FROM d GROUP BY status")
def index_status(spark, sf_dir):
    return indexing.status_counts(indexing.hash_diff(*_snapshot(spark, sf_dir)))


@query("SELECT source AS endpoint, count(*) AS total, count(*) FILTER (WHERE doc_id % 4 <> 0) AS new, count(*) FILTER (WHERE doc_id % 4 = 0) AS skipped FROM documents GROUP BY source")
def endpoint_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("endpoint"), F.col("doc_id").alias("file_name"))
    return indexing.endpoint_counts(d, d.where("file_name % 4 = 0"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def narratives_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("endpoint"), F.col("doc_id").alias("file_name"))
    return indexing.missing_narratives(d, d.where("file_name % 4 = 0")).select(F.col("file_name").alias("doc_id"))


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text")
def describe_once(spark, sf_dir):
    """One description per distinct content, by its hash."""
    return table(spark, sf_dir, "documents").groupBy(indexing.file_hash(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- guard and text rules

_LISTS = {"hard_block": ["the", "idiot"], "soft_flag": ["que"], "safe_context": ["les "]}
_NORM = "translate(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '013457@$', 'oieastas')"


#: Disguised texts, and what must come out of them: full-width and Cyrillic letters, a Greek omicron, an
#: invisible character, digits and marks for letters.
_DISGUISED = [(-1, "ＴＨＥ", "block", "the"), (-2, "1d1​0t", "block", "idiot"), (-3, "idiοt", "block", "idiot"), (-4, "а quе x", "flag", "que"), (-5, "lе$  qu3", "pass", "que"), (-6, " ​ ", "pass", "")]


@query(
    f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM (SELECT doc_id, nfc_normalize(text) AS text FROM documents)),
m AS (SELECT doc_id, list_filter(['the', 'idiot'], lambda p: contains(t, p)) AS hard, list_filter(['que'], lambda p: contains(t, p)) AS soft, list_filter(['les '], lambda p: contains(t, p)) AS ok, t FROM n)
SELECT doc_id, CASE WHEN t = '' THEN 'pass' WHEN len(hard) > 0 THEN 'block' WHEN len(soft) = 0 OR len(ok) > 0 THEN 'pass' ELSE 'flag' END AS mode,
       CASE WHEN t = '' THEN '' WHEN len(hard) > 0 THEN array_to_string(hard, ',') ELSE array_to_string(soft, ',') END AS matched FROM m
UNION ALL
SELECT * FROM (VALUES {", ".join(f"({i}, '{mode}', '{matched}')" for i, _, mode, matched in _DISGUISED)})"""
)
def keyword_verdict(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in _DISGUISED], "doc_id long, text string"))
    d = texts.withColumn("normal", tx.normalise(F.col("text"))).withColumn("v", guard.keyword_verdict(F.col("normal"), _LISTS))
    return d.select("doc_id", F.col("v.mode").alias("mode"), F.array_join("v.matched", ",").alias("matched"))


#: Answers that hit every rule of redaction, and what must be left of them.
_ANSWERS = [
    (-1, "Jawaban: see http://localhost:8000/x now", "see [internal URL] now"),
    (-2, "2-3 kalimat: short", "short"),
    (-3, "Tanpa bullet: plain", "plain"),
    (-4, "Format jawaban: I am GPT-4 by OpenAI on Redis", "I am [AI system] by [AI vendor] on [internal system]"),
    (-5, "It opens at nine. As the OFFICIAL  INFORMATION says, it is so. Come early.", "It opens at nine.  Come early."),
    (-6, "Fine. Informasi ini berasal dari dokumen", "Fine."),
    (-7, "Good. Data ini diperoleh dari situs.", "Good."),
    (-8, "Yes. Menurut dokumen itu benar", "Yes."),
    (-9, "No. Berdasarkan catatan lama!", "No."),
    (-10, "a eyJabcdefghijk.abcdefghijkl.abcdefghijkl b https://192.168.1.7/q", "a [TOKEN] b [internal URL]"),
    (-11, "  one \n\n \n\n two  ", "one\n two"),
    (-12, "hugging face, llama_index and Mistral AI", "[AI vendor], [internal system] and [AI system] AI"),
    (-13, "kept üredis and myllama here", "kept üredis and myllama here"),
]


@query(
    r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\s+\n', chr(10), 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents
UNION ALL
SELECT id, md5(said) FROM (VALUES """
    + ", ".join(f"({i}, '{x}')" for i, _, x in _ANSWERS)
    + ") AS t(id, said)"
)
def redact_output(spark, sf_dir):
    """The documents hold nothing to redact, so just their white space changes."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in _ANSWERS], "doc_id long, text string"))
    return texts.select("doc_id", F.md5(tx.redact(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(text) AS h FROM documents UNION ALL VALUES (-1, md5(' see [internal URL] ')), (-2, md5(' [AI system]')), (-3, md5('[TOKEN] '))")
def redact_deltas(spark, sf_dir):
    """Deltas of a stream keep their white space."""
    deltas = [(-1, " see http://localhost:1/x "), (-2, " Claude"), (-3, "eyJabcdefghijk.abcdefghijkl.abcdefghijkl ")]
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(deltas, "doc_id long, text string"))
    return texts.select("doc_id", F.md5(tx.redact_token(F.col("text"))).alias("h"))


@query("""
WITH a AS (SELECT conv_id, turn, text, regexp_matches(upper(text), '(^|[^A-Z0-9_À-ÖØ-Þ])LE($|[^A-Z0-9_À-ÖØ-Þ])') AS le, regexp_matches(upper(text), '(^|[^A-Z0-9_À-ÖØ-Þ])OF($|[^A-Z0-9_À-ÖØ-Þ])') AS ofs FROM conversations)
SELECT conv_id, turn, text || CASE WHEN le THEN ' (Learning Engine)' ELSE '' END || CASE WHEN ofs THEN ' (Open Forum)' ELSE '' END AS expanded FROM a""")
def acronym_expand(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.expand_acronyms(F.col("text"), {"LE": "Learning Engine", "OF": "Open Forum"}).alias("expanded"))


@query("""
WITH n AS (SELECT page_id, regexp_replace(url, '^.*/', '') || '_' || left(md5(url), 8) || '.pdf' AS name FROM pages)
SELECT page_id, replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '_[^_]{8,}$', ''), '_', ' ') AS label FROM n""")
def source_label(spark, sf_dir):
    name = F.concat(F.regexp_replace("url", "^.*/", ""), F.lit("_"), F.left(F.md5("url"), F.lit(8)), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", tx.source_label(name).alias("label"))


@query("""
WITH c AS (SELECT conv_id, turn, text AS original, CASE turn % 4 WHEN 0 THEN text || ' ' || turn WHEN 1 THEN repeat(text || ' ', 4) WHEN 2 THEN ' ok ' ELSE 'Assistant: ' || text END AS condensed FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 OR length(trim(condensed)) < 5 OR length(condensed) > greatest(3 * length(original), 200) THEN original ELSE condensed END AS question FROM c""")
def condense_validate(spark, sf_dir):
    """The stand-ins are made of whole texts: one that is taken, one that is too long, one too short, one with a leaked mark."""
    turn = F.col("turn") % 4
    condensed = F.when(turn == 0, F.concat("text", F.lit(" "), F.col("turn").cast("string"))).when(turn == 1, F.repeat(F.concat("text", F.lit(" ")), F.lit(4))).when(turn == 2, " ok ").otherwise(F.concat(F.lit("Assistant: "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.validate_condensed(F.col("text"), condensed).alias("question"))


@query("""
WITH v AS (SELECT conv_id, turn, length(text) AS n, role, conv_id % 7 AS a, conv_id % 11 AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a = 0 THEN 'blocked' WHEN a = 1 THEN 'blocked_moderation' WHEN a = 2 THEN 'chitchat' WHEN b < 3 THEN 'clarification_needed'
  WHEN b = 3 THEN 'chitchat' WHEN b = 4 THEN 'out_of_scope' WHEN b = 5 THEN 'get_info_private' WHEN a = 3 THEN 'chitchat' WHEN a = 4 THEN 'blocked'
  WHEN turn % 3 = 0 THEN 'cache_hit' WHEN n % 10 < 3 THEN 'rag_low_relevance' ELSE 'rag' END AS mode FROM v""")
def route_mode(spark, sf_dir):
    a, b = F.col("conv_id") % 7, F.col("conv_id") % 11
    mode = lambda cond: F.struct(F.when(cond, "block").otherwise("pass").alias("mode"))
    intent = F.when(b == 3, "chitchat").when(b == 4, "out_of_scope").when(b == 5, "get_info_private").otherwise("get_info_public")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", mode(a == 0).alias("keyword"), F.struct((a != 1).alias("safe")).alias("moderation"), (a == 2).alias("is_identity"), F.struct(intent.alias("intent"), (b < 3).alias("low_confidence"), F.lit(False).alias("fallback")).alias("intent"), F.lit("get_info_private").alias("private_mode"), (a == 3).alias("is_ack"), mode(a == 4).alias("condensed_keyword"), (F.col("turn") % 3 == 0).alias("cache_hit"), ((F.length("text") % 10) / 10.0).alias("top_score"), F.lit(6).alias("n_nodes"))
    return rows.select("conv_id", "turn", guard.answer_mode().alias("mode"))


@query("""
SELECT conv_id, turn, CASE WHEN length(text) < 1 THEN 'question is empty' WHEN length(text) > 2000 THEN 'question is too long' WHEN conv_id % 23 > 20 THEN 'history is too long'
  WHEN conv_id % 23 > 0 AND (role = 'system' OR conv_id % 5 = 0) THEN 'history has a bad turn' WHEN role = 'system' THEN 'role is unknown' END AS error FROM conversations""")
def request_errors(spark, sf_dir):
    """Histories of 0 to 22 turns: the row's own role, with its text or, in every fifth conversation, with none."""
    said = F.struct("role", F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.left("text", F.lit(4000))).alias("content"))
    history = F.array_repeat(said, (F.col("conv_id") % 23).cast("int"))
    role = F.when(F.col("role") == "system", "system").otherwise("student")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", guard.request_error(F.col("text"), history, role).alias("error"))


# ---------------------------------------------------------------- cache, limits, breaker, telemetry


@query("SELECT event_id, 'answer:' || left(sha256(event_type || ':' || user_id), 16) AS key, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts)) <= 86400000000, false) AS hit FROM events")
def cache_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), tx.cache_key(F.col("event_type"), F.col("user_id").cast("string")).alias("key"))
    return caching.hits_over_time(e).select("event_id", "key", "hit")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts) <= 2 AS allowed FROM events")
def rate_limit(spark, sf_dir):
    return caching.rate_limited(table(spark, sf_dir, "events"), unit="hour", limit=2).select("event_id", "allowed")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type NOT IN ('error', 'signup', 'click') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
s AS (
  SELECT user_id, event_id, i, 'closed' AS state, false AS bypassed, CASE WHEN ok THEN 0 ELSE 1 END AS c, CASE WHEN ok THEN NULL ELSE t END AS last FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i,
    CASE WHEN s.state = 'open' AND e.t - s.last < 3600 THEN 'open' WHEN e.ok THEN 'closed' WHEN s.state = 'open' OR s.c + 1 >= 5 THEN 'open' ELSE 'closed' END,
    s.state = 'open' AND e.t - s.last < 3600,
    CASE WHEN s.state = 'open' AND e.t - s.last < 3600 THEN s.c WHEN e.ok THEN 0 ELSE s.c + 1 END,
    CASE WHEN s.state = 'open' AND e.t - s.last < 3600 THEN s.last WHEN e.ok THEN NULL ELSE e.t END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, state, bypassed FROM s""")
def circuit_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    events = e.select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (~F.col("event_type").isin("error", "signup", "click")).alias("ok"))
    return breaker.breaker_states(events, 5, 3600.0).select("event_id", "state", "bypassed")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, max(json_extract(props, '$.k')::BIGINT) AS max_k FROM events GROUP BY event_type")
def telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.max("p.k").alias("max_k"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, sid""")
def window_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "n", F.unix_micros("w.start").alias("start_us"))


@query("SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, coalesce(sum(l.quality), 0)::BIGINT AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def quality_join(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


# ---------------------------------------------------------------- narration

_ENTITIES = {
    "region": ("region", "r_regionkey", "Region {r_name} has number {r_regionkey}."),
    "nation": ("nation", "n_nationkey", "Nation {n_name} (number {n_nationkey}) belongs to region {n_regionkey}."),
    "customer": ("customer", "c_custkey", "Customer {c_name} buys for the {c_mktsegment} segment from nation {c_nationkey}."),
    "supplier": ("supplier", "s_suppkey", "Supplier {s_name} delivers from nation {s_nationkey}."),
    "part": ("part", "p_partkey", "Part {p_name} of {p_brand} is a {p_type} of size {p_size}."),
    "orders": ("orders", "o_orderkey", "Order {o_orderkey} of customer {o_custkey} has status {o_orderstatus} and priority {o_orderpriority}."),
    "lineitem": ("lineitem", "l_orderkey", "Line {l_linenumber} of order {l_orderkey} takes part {l_partkey} from supplier {l_suppkey} ({l_returnflag}, {l_linestatus})."),
    "event": ("events", "event_id", "Event {event_id}: user {user_id} did {event_type}."),
}


def _narration(name: str) -> None:
    source, key, text = _ENTITIES[name]
    import re as _re

    parts = [f"coalesce(nullif({p[1:-1]}::VARCHAR, ''), '-')" if p.startswith("{") else "'" + p.replace("'", "''") + "'" for p in _re.split(r"(\{[^{}]+\})", text) if p]

    def run(spark, sf_dir):
        return rec.narrate(table(spark, sf_dir, source), name, {name: text}).select(F.col(key).cast("long").alias("key"), "narrative")

    run.__name__ = f"narrate_{name}"
    query(f"SELECT {key}::BIGINT AS key, {' || '.join(parts)} AS narrative FROM {source}")(run)


for _name in _ENTITIES:
    _narration(_name)


@query("""
WITH s AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'There are ' || sum(n)::VARCHAR || ' orders: ' || string_agg(k || ': ' || n::VARCHAR, ', ' ORDER BY k) || '.' AS summary FROM s""")
def summary_orders(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))), lambda x: F.concat(x["o_orderstatus"], F.lit(": "), x["n"].cast("string"))), ", ")
    one = by.agg(F.sum("n").alias("n"), parts.alias("by_status"))
    return one.select(rec.summarise({"n": F.col("n"), "by_status": F.col("by_status")}, "orders", {"orders": "There are {n} orders: {by_status}."}).alias("summary"))


@query("""
SELECT n_name AS nation, 'Nation ' || n_name || ' has ' || count(c_custkey)::VARCHAR || ' customers.' AS summary FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def summary_nation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))
    return n.select(F.col("n_name").alias("nation"), rec.summarise({"name": F.col("n_name"), "n": F.col("n")}, "x", {"x": "Nation {name} has {n} customers."}).alias("summary"))


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0') || '_' || left(regexp_replace(regexp_replace(trim(p_name), '[^a-zA-Z0-9_\\s-]', '', 'g'), '\\s+', '_', 'g'), 80) AS label FROM part")
def slug_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rec.item_label(F.col("p_partkey"), F.col("p_name")).alias("label"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y') AS day, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM orders")
def date_text(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", rec.fmt_date(F.col("o_orderdate")).alias("day"), tx.local_timestamp(ts).alias("local_time"))


# ---------------------------------------------------------------- streams and what Spark brings along


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf_dir):
    """Events that arrive twice count once."""
    from lorikeet.streaming import jobs

    e = jobs.event_stream(spark, sf_dir)
    name = f"dedup_{uuid.uuid4().hex}"
    checkpoint = f"{_shared(spark)}/{name}"
    twice = jobs.distinct_events(e.union(jobs.event_stream(spark, sf_dir)))
    return jobs.run_to_table(twice, name, "append", checkpoint).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    from lorikeet.streaming import jobs

    name = f"tumbling_{uuid.uuid4().hex}"
    out = jobs.run_to_table(jobs.tumbling(jobs.event_stream(spark, sf_dir)), name, "complete", f"{_shared(spark)}/{name}")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, sid""")
def stream_session(spark, sf_dir):
    from lorikeet.streaming import jobs

    name = f"session_{uuid.uuid4().hex}"
    out = jobs.run_to_table(jobs.sessions(jobs.event_stream(spark, sf_dir)), name, "complete", f"{_shared(spark)}/{name}")
    return out.select("user_id", "n", F.unix_micros("session_window.start").alias("start_us"))


def _shared(spark: SparkSession) -> str:
    """The folder that all share: spark.checkpoint.dir, or, where a session on one machine names none, one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


from lorikeet.plans import narration, operations  # noqa: E402,F401  they register their queries
