"""Each registered query whole: against its SQL, or against a plain version of its whole result."""

from __future__ import annotations

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorikeet.llm import langid, queries, toxicity
from tests.llm.test_pipeline import plain_language

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        path = f"{SMALL}/{t}/*.parquet" if os.path.isdir(f"{SMALL}/{t}") else f"{SMALL}/{t}"
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, duck):
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_languages_of_all_documents(spark, docs):
    model = langid.fit_for_documents(docs)
    got = {r.doc_id: r for r in langid.op2_language_id(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = plain_language(model, r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (lang, pytest.approx(score))
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_the_language_sample_is_of_the_least_hashes(docs):
    """A bound far below the rows of a language, under several partitionings."""
    found = {tuple(map(tuple, langid.fit(docs.repartition(n), 5).logs.round(4).tolist())) for n in (2, 3, 7)}
    assert len(found) == 1
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h")).collect()
    kept = [r for r in rows if r.h <= sorted(x.h for x in rows if x.lang == r.lang)[:5][-1]]
    want = langid.fit(docs.sparkSession.createDataFrame([(i, r.text, r.lang) for i, r in enumerate(kept)], "doc_id long, text string, lang string"), 10**6)
    assert found == {tuple(map(tuple, want.logs.round(4).tolist()))}


def test_toxicity_of_all_documents(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs.where(toxicity.remainder() != 1), labels.where(toxicity.remainder() != 1))
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, SMALL).collect()}
    for r in docs.collect():
        none = 1.0  # probability that no sentence is toxic
        for sentence in toxicity.sentences((r.text or "").encode()):
            z = model.bias + sum(model.weights.by_feature.get(f, 0.0) for w in set(sentence) for f in toxicity.features(w))
            none *= 1 / (1 + np.exp(z))
        p = (1 - none) * model.odds
        want = p / (p + none) if toxicity.sentences((r.text or "").encode()) else 0.0
        row = got.pop(r.doc_id)
        assert row.score == pytest.approx(want, abs=1e-6) and row.predicted == int(row.score >= 0.7)
        assert row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert not got
