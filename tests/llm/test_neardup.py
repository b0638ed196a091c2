"""Near-dedup against brute force over planted edited copies."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

import corpus_pipeline
from lorikeet.llm import neardup, simhash
from tests.llm.test_llm import DOCS, ODD


def five(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts: list[str | None]) -> list[int]:
    sets, root = [five(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


@pytest.fixture(scope="module")
def edited() -> list[str]:
    """Texts with copies in which some words were changed: similarities from 0.5 to 1, and chains of copies."""
    rng, out = np.random.default_rng(5), []
    for base in range(40):
        text = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 300))]
        out.append(" ".join(text))
        for _ in range(5):
            text = list(text) if base % 2 else out[-1].split()
            copy = list(text)
            for at in rng.integers(0, len(copy), rng.integers(1, max(2, len(copy) // 40))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    return out


def kept(spark, texts: list[str | None]) -> list[int]:
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_edited_copies_go_from_the_pipeline(spark, edited):
    want = sorted(set(brute_groups(edited)))
    assert 40 < len(want) < len(edited) - 40
    assert kept(spark, edited) == want


def test_one_word_of_sixty_four_makes_no_new_document(spark):
    text = [f"w{i}" for i in range(64)]
    assert kept(spark, [" ".join(text), " ".join([*text[:-1], "other"]), " ".join([*text[:30], "other", *text[31:]])]) == [0]


def test_texts_of_a_key_outside_its_first_group(spark):
    """B and C are 0.8 alike or more and share keys with A, which is like neither."""
    common = [f"c{i}" for i in range(300)]
    a = common + [f"a{i}" for i in range(120)]
    b = common + [f"b{i}" for i in range(120)]
    texts = [" ".join(x) for x in (a, b, [*b[:-1], "end"], [*b[:-2], "the", "end"])]
    assert brute_groups(texts) == [0, 1, 1, 1]
    assert kept(spark, texts) == [0, 1]


def test_odd_rows(spark):
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(ODD, DOCS), "").collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 2, 6, 7]
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], DOCS), "").collect() == []


def test_recall_of_the_bands_at_the_least_similarity():
    """Sets of 180 with 160 in common are 0.8 alike."""
    rng, n = np.random.default_rng(3), 3000
    a, b = [], []
    for _ in range(n):
        x = rng.integers(0, 1 << 64, 200, np.uint64)
        a.append(x[:180])
        b.append(x[20:])
    assert (neardup.band_keys(a) == neardup.band_keys(b)).any(axis=1).all()


#: Two unrelated texts of one id, a copy of a lesser id's text under another text's id, and null ids.
REPEATED = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six"), (None, "alone as can be and no copy"), (None, "alone as can be and no copy")]


@pytest.mark.parametrize("parts", [2, 3, 7])
def test_rows_not_ids_are_kept(spark, parts):
    rows = spark.createDataFrame([*REPEATED, (2, "nothing like any of the others here")], "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id or 0, r.text) for r in neardup.drop_near_copies(rows).collect())
    assert got == [(0, REPEATED[3][1]), (1, REPEATED[0][1]), (2, "nothing like any of the others here"), (2, REPEATED[2][1])]


@pytest.mark.parametrize("limit", [2, 10**9])
def test_hot_groups_change_nothing(spark, edited, monkeypatch, limit):
    """Every key above two rows is dealt to several tasks, or none is."""
    from lorikeet.llm import common

    for module in (neardup, simhash):
        monkeypatch.setattr(module, "hot_limit", lambda *a: limit)
    assert common.hot_limit(spark, 0) == common.LEAST_HOT
    assert kept(spark, edited) == sorted(set(brute_groups(edited)))
