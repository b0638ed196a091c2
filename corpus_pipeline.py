"""The corpus pipeline: language identification, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, and any others that ``docs`` has, whatever their names. Empty tables give empty results.
``run`` writes each stage's result as Parquet to the shared folder and reads it again, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm import langid, linededup, mixing, neardup, packing
from lorikeet.llm.common import Scratch, by_place, table

#: A document stays if this share of its letters is in words of a script that a learned language uses.
LEAST_RECOGNISED = 0.5


def replaced(docs: DataFrame, plain: DataFrame, **columns) -> DataFrame:
    """The columns of ``docs`` from ``plain``, where they are named by place, with some computed anew."""
    made = [columns.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return plain.select(*made).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (``und``) or mostly in scripts of no learned language; fills null lang.

    A text in several learned languages stays. Every row is judged by its own text, so null and repeated
    ids and repeated rows are no matter; if no row teaches a language, none stays.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = langid.with_language(by_place(docs), langid.fit_for_documents(docs), at["text"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("recognised") >= LEAST_RECOGNISED))
    return replaced(docs, kept, lang=F.coalesce(at["lang"], "lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later copies of line runs out of the texts; a document with nothing left goes.

    Null and blank texts that lost nothing stay. Rows that repeat id and text are one document, so none of
    them loses lines to the other; rows with null id come last.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    done = linededup.dedup_lines(by_place(docs), at["doc_id"], at["text"])
    gone = F.size("removed") > 0
    done = done.where(~(gone & (F.btrim(F.coalesce(at["text"], F.lit(""))) == "")))
    chars = F.when(gone, F.length(at["text"]).cast("long")).otherwise(F.col(at["n_chars"])) if "n_chars" in at else None
    return replaced(docs, done, **({"n_chars": chars} if "n_chars" in at else {}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group whose five-word shingles are 0.8 alike or more.

    Null ids come last. Rows are told apart by id and text; of rows that repeat both one stays. Texts
    without words are copies of each other.
    """
    return neardup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that each source has its target's words.

    A null source is a source of its own. Texts without words are never taken. Each of several rows with
    one id has words of its own.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into sequences of 2048 tokens; a row per piece.

    Null and empty texts are their end id alone; repeated rows are packed each for itself. Columns besides
    doc_id and text are ignored.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Language identification, near-copy components and tokens can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(after)
            scratch.drop(before)
            before = docs
    return after
