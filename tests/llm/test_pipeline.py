"""The corpus pipeline against a plain Python version of each stage, on its own input."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lorikeet.llm import langid
from tests.llm.test_llm import DOCS, brute_lines, words
from tests.llm.test_neardup import brute_groups

DATA = "/root/testdata/sf0.001"


def plain_language(model: langid.Model, text: str | None) -> tuple[str, float]:
    found = (text or "").lower().split()
    if not found:
        return "und", 0.0
    scores = [model.scores(w) for w in found]
    total, back = scores[0].astype(float).copy(), []
    for s in scores[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - langid.SWITCH
        back.append([i if stay[i] else top for i in range(len(total))])
        total = np.where(stay, total, total[top] - langid.SWITCH) + s
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    mass = np.zeros(len(total))
    for lang, w in zip(reversed(path), found, strict=True):
        mass[lang] += sum(map(str.isalpha, w))
    return (model.langs[int(mass.argmax())], mass.max() / mass.sum()) if mass.sum() else ("und", 0.0)


def latin_share(text: str) -> float:
    """All learned languages are written in Latin letters."""
    letters = [(c.isalpha(), next(c for c in w if c.isalpha()) < "\u0250") for w in text.lower().split() if any(map(str.isalpha, w)) for c in w]
    return sum(a and b for a, b in letters) / max(1, sum(a for a, _ in letters))


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of each stage, over real documents and a few awkward ones."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(90)
    long = "\n".join(f"the of and line number {i} is here with more words in it that and this" for i in range(9))
    more = [(9001, long, "en", "src1", len(long)), (9002, "the start of\n" + long, "en", None, 0), (9003, "123 456 !!", None, "src2", 10), (9004, None, None, None, None), (9005, long + "\nthe end", "en", "src3", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    from lorikeet.llm.common import Scratch

    scratch, out, now = Scratch(spark, "test"), {}, None
    now = scratch.keep(docs)
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.keep(stage(spark, now, DATA))
        out[name] = (sorted(now.collect(), key=repr), sorted(after.collect(), key=repr), now)
        now = after
    return out


def test_languages_that_are_rejected(stages):
    before, after, frame = stages["language_id"]
    model = langid.fit_for_documents(frame)
    want = {r.doc_id for r in before if (p := plain_language(model, r.text))[0] != "und" and latin_share(r.text) >= corpus_pipeline.LEAST_RECOGNISED}
    assert {r.doc_id for r in after} == want and {9003, 9004}.isdisjoint(want) and len(after) == len(want)
    assert all(r.lang for r in after)


def test_lines_that_go(stages):
    before, after, _ = stages["line_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    clean = dict(zip([r.doc_id for r in rows], brute_lines([r.text for r in rows], 50), strict=True))
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in clean.items() if t.strip()}
    assert clean[9002] == "the start of" and clean[9005] == "the end"


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["simhash_near_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(rows[i].doc_id for i in set(brute_groups([r.text for r in rows])))


def test_sources_have_their_targets(stages):
    before, after, _ = stages["mix_sources"]
    size = {r.doc_id: len(words(r.text)) for r in before}
    sources: dict = {}
    for r in before:
        sources.setdefault(r.source, []).append(r.doc_id)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, cap = sum(size.values()), {s: 3 * sum(size[i] for i in sources[s]) for s in names}
    target, open_ = {}, set(names)
    while True:  # fill up until none is above its cap
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > cap[s]]
        if not above:
            break
        for s in above:
            target[s] = float(cap[s])
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    taken: dict[int, int] = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    for s in names:
        budget, own = int(target[s] + 0.5), sum(size[i] for i in sources[s])
        epochs, rest = divmod(budget, own) if own else (0, 0)
        for i in sorted(sources[s], key=lambda i: hashlib.md5(f"mix-17:{i}".encode()).hexdigest()):
            last = min(size[i], rest)
            rest -= last
            assert taken.get(i, 0) == epochs * size[i] + last


def test_sequences_hold_all_tokens(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after, _ = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after) == sorted(want)
    by: dict[int, list] = {}
    for r in after:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(x.length for x in s) <= 2048


#: Names that operators use themselves.
CLASHING = ("__id", "__h", "__row", "__key", "__size", "__copy", "__range", "__tie", "size", "taken", "key", "tag", "removed", "n_lines", "lang_pred", "score", "c0", "c1", "t", "__share")
NULL_ID, MIXED, RUSSIAN = (None, "123 456 !!"), (None, "the start of a house and the end of it la maison et le jardin avec cette grande ville"), (5, "дом и сад с этим большим деревом")


@pytest.mark.parametrize("parts", [2, 3, 7])
def test_odd_rows_through_all_stages(spark, parts):
    """Null and repeated ids, repeated rows, a mixed text, another script, and columns with clashing names."""
    from pyspark.sql import functions as F

    en, fr = "the start of a house and the end of it with some more words than that", "la maison et le jardin avec cette grande ville sans fin pour nous"
    teach = [(100 + i, f"{t} {i} {i * 7}", lang, "a", 1) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 8)]
    rows = [*teach, (*NULL_ID, None, "b", 1), (*MIXED, None, "b", 1), (*RUSSIAN, None, "b", 1), (100, "another text of this id is here", "en", None, 1), (None, None, None, None, None), (7, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(parts).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        got = [(r.doc_id, r.text) for r in after.collect()]
        assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in after.collect()), name
        if name == "language_id":
            assert sorted(got, key=repr) == sorted([(r[0], r[1]) for r in rows if r[1] and r[:2] not in (NULL_ID, RUSSIAN)], key=repr)
        if name in ("line_dedup", "simhash_near_dedup"):
            assert len([g for g in got if g[0] == 100]) == 2
        assert stage(spark, docs.limit(0), "").collect() == []
        docs = spark.createDataFrame(after.collect(), after.schema).repartition(parts) if name != "mix_sources" else after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_repeated_rows_meet_the_budget(spark):
    """Three equal rows of 10 words, of which the source may give 26: each has words of its own."""
    rows = [(1, "a b c d e f g h i j", "en", "z", 0)] * 3 + [(2, "x " * 22, "en", "y", 0)]
    for parts in (2, 3, 7):
        docs = spark.createDataFrame(rows, DOCS).repartition(parts)
        want = {r.source: int(r.target + 0.5) for r in corpus_pipeline.mixing.mix_sources(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()}
        got: dict = {}
        for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
            got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert got == {s: n for s, n in want.items() if n} and 0 < want["z"] % 10


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_texts_are_taken_in_hand_by_size(spark):
    """Slices of a batch hold a bounded number of bytes, whatever the rows' number; longer texts come alone."""
    from pyspark.sql import functions as F

    from lorikeet.llm.common import SLICE_BYTES, slices, with_outputs

    def run():
        return lambda texts: [pa.array([sum(len(x or "") for x in texts.to_pylist())] * len(texts)), pa.array([len(texts)] * len(texts))]

    size = F.when(F.col("id") == 700, F.lit(SLICE_BYTES + 1)).when(F.col("id") % 5 == 0, F.lit(0)).otherwise(F.lit(9000)).cast("int")
    docs = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 7 != 1, F.repeat(F.lit("x"), size)).alias("text"))
    for frame in (docs, docs.withColumn("text", F.col("text").cast("binary"))):
        rows = with_outputs(frame, "text", ["held", "n"], "held long, n long", run).select("id", "held", "n", F.length("text").alias("size")).collect()
        want = {r.id: r.size for r in frame.select("id", F.length("text").alias("size")).collect()}
        assert {r.id: r.size for r in rows} == want and len(rows) == 1500
        assert max(r.held for r in rows if r.id != 700) <= SLICE_BYTES and [(r.held, r.n) for r in rows if r.id == 700] == [(SLICE_BYTES + 1, 1)]
    assert list(slices(pa.array(["aa", None, "bbb", "", "c" * 9, "d"]), 5)) == [(0, 4), (4, 5), (5, 6)] and list(slices(pa.array([], pa.string()))) == []


def test_words_learned_together_score_as_each_alone():
    rng = np.random.default_rng(5)
    counts, uses = rng.integers(0, 50, (3, langid.BUCKETS)).astype(float), np.zeros((3, len(langid.NAMES)))
    uses[:2, 0], uses[2, 2] = 10, 10
    model = langid.Model(["de", "en", "ru"], counts, uses)
    texts = ["the house", "", None, "дом the שלום 123 !! " + "long" * 400 + " don't x1y ǆ straße", "the дом дом 1a"]
    found = langid.Words(model)
    for part in (texts[:2], texts[2:]):
        langid.label_batch(found, part, langid.SWITCH)
    assert len(found) == len({w for t in texts if t for w in t.lower().split()})
    for word, n in found.items():
        letters = sum(map(str.isalpha, word))
        assert np.array_equal(found.table[n], model.scores(word)) and found.letters[n] == letters and found.known[n] == letters * model.knows(word), word
