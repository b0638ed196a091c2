"""Small fixtures for each training-data operator: brute force, round trips, and odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lorikeet.llm import chatformat, exact_dedup, imatch, langid, linededup, lmscore, mixing, neardup, packing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, repeated rows and ids, extra columns whose names operators might use.
ODD = [
    (1, "one two three four five six\nseven eight", "en", "a", 0),
    (1, "one two three four five six\nseven eight", "en", "a", 0),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n\t ", "fr", None, 4),
    (5, "One Two three four five six\nseven eight", "en", "b", 0),
    (None, "no id at all", "en", "b", 0),
    (6, "word " * 30_000, "en", "c", 0),
    (7, "ß ü ñ 語 \U0001f600 end", None, "é", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, DOCS)
    return rows.select("*", *[F.lit(7).alias(c) for c in ("h", "key", "size", "rank", "fp", "line", "w", "length", "start", "count", "n", "s", "b", "word", "score", "u", "pid", "__id", "__h", "__t", "__block", "__src", "__size", "__copy", "__key", "__row", "__share", "c0", "tag", "id", "deal")])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


PACK = lambda d: packing.pack_documents(d, vocabulary())


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ALL = {
    "lines": linededup.dedup_lines,
    "lm": lmscore.stupid_backoff,
    "exact": exact_dedup.content_sort_dedup,
    "imatch": imatch.imatch,
    "mix": mixing.mix_sources,
    "mixed": mixing.mixed_documents,
    "simhash": simhash.simhash_components,
    "near": neardup.drop_near_copies,
    "pack": PACK,
    "lang": lambda d: langid.detect(d, langid.fit(d)),
    "toxic": lambda d: toxicity.score_toxicity(d, toxicity.Model({"=bad": 20.0}, -10.0, 1.0)),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_are_served(name, odd):
    rows = ALL[name](odd).collect()
    if name == "mixed":
        assert sum(len(words(r.text)) for r in rows) == sum(len(words(r[1])) for r in ODD) and all(r["__size"] == 7 for r in rows)
    elif name == "near":
        assert sorted((r.doc_id or -1) for r in rows) == [-1, 1, 2, 6, 7] and all(r["__key"] == 7 for r in rows)
    elif name == "pack":
        assert {r.doc_id for r in rows} == {r[0] for r in ODD} and sum(r.start == 0 for r in rows) == len(ODD)
    elif name == "lm":
        assert {r.doc_id: r.n_words for r in rows} == {1: 16, 2: 0, 3: 0, 4: 0, 5: 8, None: 4, 6: 30_000, 7: 6}
    else:
        assert len(rows) == len(ODD)
    if name == "lines":
        assert all(r["__id"] == 7 and r["__h"] == 7 for r in rows)


@pytest.mark.parametrize("name", ALL)
def test_an_empty_table_gives_no_rows(name, none):
    assert ALL[name](none).collect() == []


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup_against_brute_force(spark):
    texts = ["same"] * 60 + ["other", "other", "", None, "alone"]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r.doc_id: r for r in exact_dedup.content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()}
        for i, t in rows:
            group = [j for j, o in rows if (o or "") == (t or "")]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(group), len(group), i == best(group))
            assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    got = exact_dedup.content_sort_dedup(spark.createDataFrame([(1, "x")] * 50 + [(None, "x")], "doc_id long, text string"), keep="largest").collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {51}


# ---------------------------------------------------------------- line dedup


def brute_lines(texts: list[str], least: int) -> list[str]:
    lines = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    gone = set()
    for a in range(len(lines)):
        for b in range(a):
            n = 0
            while a + n < len(lines) and lines[a + n][0] == lines[a][0] and b + n < len(lines) and lines[b + n][0] == lines[b][0] and lines[a + n][2] == lines[b + n][2]:
                n += 1
            if n and sum(len(words(lines[a + k][2])) for k in range(n)) >= least:
                gone |= {lines[a + k][:2] for k in range(n)}
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


@pytest.mark.parametrize("least", [1, 3, 6])
def test_line_dedup_against_brute_force(spark, least):
    rng = np.random.default_rng(least)
    line = ["a b", "c", "", "d e f", "g", "h i j k"]
    texts = ["\n".join(line[i] for i in rng.integers(0, len(line), rng.integers(1, 14))) for _ in range(25)] + ["a b\n" * 30, "c\n\n\n\nc\n\n\n\nc"]
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=least).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute_lines(texts, least)


# ---------------------------------------------------------------- language


def test_language_spans_and_scripts(spark):
    en, fr, ru = "the house and the garden with this", "la maison et le jardin avec cette", "дом и сад с этим большим деревом"
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    docs = spark.createDataFrame([(1, f"{en} {fr} {fr}"), (2, ru + " и"), (3, "123 ..."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.detect(docs, model).collect()}
    assert got[1].lang_pred == "fr" and [s.lang for s in got[1].spans] == ["en", "fr"] and got[1].spans[0].end_word == 7
    assert got[2].lang_pred == "ru" and got[2].score == 1.0
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred, got[4].score) == ("und", 0.0, "und", 0.0)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 3, (6, 4, 3)).astype(np.float32)
    labels = langid.viterbi(scores, 2.0)
    import itertools

    for t in range(4):
        value = lambda p: sum(scores[i, t, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert value(labels[:, t]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))), abs=1e-4)


# ---------------------------------------------------------------- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool:x\n", "", "@a", "As\\"]), st.text("\\#</turn>AssistantUser: \n@é", max_size=40)), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chatformat.Template().render([{"role": r, "text": t} for r, t in turns])
    assert chatformat.read_back(text) == turns
    assert [chatformat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_templates_fold_and_refuse():
    tree = chatformat.fold(chatformat.parse('a{{ "b" ~ "c" | upper }}{% if 1 == 2 or false %}x{% else %}y{% endif %}{% if m.z and not true %}q{% endif %}'))
    assert tree == [chatformat.Output(chatformat.Literal("abCy"))]
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% for m in range %}{% endfor %}", "{% if x %}", "{{ a | nope }}", "{% import os %}"):
        with pytest.raises(chatformat.TemplateError):
            chatformat.parse(bad)


def test_templates_that_cannot_be_read_back_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    other = "{% for m in messages %}<{{ m.role }}>{{ m.text }}\n{% endfor %}"
    assert chatformat.format_messages(rows, chatformat.Template(other)).first().formatted == "<user>a\n"
    for template in (other, other.replace("m.text", "index"), "no loop", chatformat.DEFAULT_TEMPLATE.replace(" | escape ", " ", 1)):
        with pytest.raises(chatformat.TemplateError):
            chatformat.format_conversations(rows, template)
    longer = "start\n" + chatformat.DEFAULT_TEMPLATE + "end"
    assert chatformat.format_conversations(rows, longer).first().formatted_chars == chatformat.format_conversations(rows).first().formatted_chars + 9


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (1, 2, "assistant", "yes \\ ###"), (None, 0, "assistant", "")]
    got = {r.conv_id: r for r in chatformat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256("\n\nuser\na\nuser\nb\nassistant\nyes \\ ###\n".encode()).hexdigest()
    assert got[1].loss_chars == 9 and got[1].loss_sha256 == hashlib.sha256(b"yes \\ ###").hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chatformat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# ---------------------------------------------------------------- language model


def micro(x: float) -> int:
    return round(float(np.log10(x)) * 1e6)


def brute_backoff(texts: list[str], corpus: list[str], order: int, least: int, backoff: float = 0.4) -> list[int]:
    """Sums of micro-units by plain dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    contexts = [Counter() for _ in range(order + 1)]
    split = lambda t, k: [tuple((["<s>"] * (k - 1) + t.lower().split())[i : i + k]) for i in range(len(t.split()))]
    for t in corpus:
        for k in range(1, order + 1):
            for g in split(t, k):
                grams[k][g] += 1
                contexts[k][g[:-1]] += 1

    def score(gram: tuple, k: int) -> float:
        n = grams[k][gram]
        if n >= (least if k > 1 else 1):
            return n / contexts[k][gram[:-1]]
        return backoff * (score(gram[1:], k - 1) if k > 1 else 1 / max(1, contexts[1][()]))

    return [sum(micro(score(g, order)) for g in split(t, order)) for t in texts]


CORPUS = ["a b a b c", "a b c a", "", "A c", "b c b c b c", "a b"]


def test_backoff_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.stupid_backoff(docs, order=2, least=2).collect()}
    # pairs seen twice: (start, a) and (a, b); (b, a) and (a, c) back off; a stands before a word three times
    assert got[1].log10_micro == micro(2 / 2) + 2 * micro(2 / 3) + micro(0.4 * 3 / 6)
    assert got[2].log10_micro == micro(2 / 2) + micro(0.4 * 1 / 6)
    assert all((got[i].n_words, got[i].log10_micro, got[i].mean_log10) == (0, 0, None) for i in (3, 4))


@pytest.mark.parametrize("order,least", [(2, 1), (3, 1), (4, 1), (3, 2)])
def test_backoff_against_brute_force(spark, order, least):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string").repartition(3)
    got = lmscore.stupid_backoff(docs, order=order, least=least).orderBy("doc_id").collect()
    assert [r.log10_micro for r in got] == brute_backoff(CORPUS, CORPUS, order, least)
    assert [r.n_words for r in got] == [len(t.split()) for t in CORPUS]


def test_scores_against_another_corpus(spark):
    texts = ["a b c", "x a b", "", "c c c"]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = lmscore.score_against(frame(texts), frame(CORPUS)).orderBy("doc_id").collect()
    assert [r.log10_micro for r in got] == brute_backoff(texts, CORPUS, 3, 1)
    own = sorted(lmscore.score_against(frame(CORPUS), frame(CORPUS)).collect())
    assert own == sorted(lmscore.stupid_backoff(frame(CORPUS)).collect())


@pytest.mark.parametrize("passes", [1, 3])
def test_passes_pieces_and_hot_keys_do_not_change_scores(spark, monkeypatch, passes):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, "hot pair " * 3 + " ".join(f"w{int(x)}" for x in rng.exponential(5, rng.integers(0, 30)))) for i in range(60)], "doc_id long, text string").repartition(3)
    want = sorted(lmscore.stupid_backoff(docs, passes=1).collect())
    monkeypatch.setattr(lmscore, "CHUNK", 40)
    monkeypatch.setattr(lmscore, "SAMPLE", 1)
    monkeypatch.setattr(lmscore, "LEAST_SAMPLED", 2)
    monkeypatch.setattr(simhash, "PIECE", 11)
    rows = lmscore.id_and_text(docs, "doc_id", "text")
    contexts, grams = lmscore.hot_counts(rows, 3, 8)
    assert contexts.count() and grams.count() and contexts.agg({"n": "max"}).first()[0] >= 60
    assert sorted(lmscore.stupid_backoff(docs, passes=passes).collect()) == want


def test_words_are_hashed_at_once(monkeypatch):
    """No step of Python per word, which took most of the time; as many hashes as words, in whatever pieces."""
    rng = np.random.default_rng(4)
    letters = ["a", "b", "\0", "\x1c", "\x85", "\xa0", "ß", "語", "\U0001f600", " ", "\t", "\n", "\x0b", "\f", "\r"]
    sizes = [1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300]
    texts = [None, "", " \t\n", "end", "start", " both ", "A\x0bB\fC", *("".join(rng.choice(letters, 60)) for _ in range(50))]
    texts += [" ".join("x" * (n - j) + "y" * j for j in range(3) if j <= n) for n in sizes for _ in range(2)]
    want = [w for t in texts for w in (t or "").lower().encode().split()]
    whole = lmscore.word_hashes([lmscore.lowered(t) for t in texts])
    assert whole[0].tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(zip(want, whole[1].tolist(), strict=True))) == len(set(want)) == len(set(whole[1].tolist()))
    (rows, keys), *rest = lmscore.chunks(texts, (3, 1))
    assert not rest and len(rows) == len(want) and keys[1][1].tolist() == whole[1].tolist()
    monkeypatch.setattr(lmscore, "CHUNK", 50)
    parts = list(lmscore.chunks(texts, (3, 1)))
    assert len(parts) > 50 and np.concatenate([r for r, _ in parts]).tolist() == rows.tolist()
    assert all(np.concatenate([k[o][c] for _, k in parts]).tolist() == keys[o][c].tolist() for o in (0, 1) for c in (0, 1))
    called = []
    monkeypatch.setattr(lmscore.xxhash, "xxh64_intdigest", lambda w: called.append(w) or xxhash.xxh3_64_intdigest(w))
    assert sum(len(r) for r, _ in lmscore.chunks(["some plain words " * 100], (3,))) == 300 and not called


def test_scores_lower_case_as_sql_does(spark):
    import duckdb

    docs = spark.createDataFrame([(1, "ΟΔΟΣ οδοσ Οδος ΣΑΣ"), (2, "İ i I i̇ Ä ä ẞ ß"), (3, "οδος οδοσ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.log10_micro) for r in lmscore.stupid_backoff(docs).collect())
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        assert got == sorted(r[:3] for r in db.execute(lmscore.OP4_SQL).fetchall())


# ---------------------------------------------------------------- fingerprints


def test_imatch_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(vocab[min(59, int(x))] for x in rng.exponential(12, rng.integers(0, 40))) for _ in range(40)]
    texts[7] = texts[3]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string"), band=(0.05, 0.5)).collect()}
    h64 = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    long = lambda v, seed: h64((v & (2**64 - 1)).to_bytes(8, "little"), seed)

    def chain(values: list[int]) -> int:
        seed = 42
        for v in values:
            seed = long(v, seed)
        return seed

    terms = lambda t: sorted({signed(h64(x.encode())) for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if x})
    frequency: dict[int, int] = {}
    for t in texts:
        for x in terms(t):
            frequency[x] = frequency.get(x, 0) + 1
    kept = {x for x, n in frequency.items() if max(2, int(0.05 * 40)) <= n <= 0.5 * 40}

    def fingerprint(t: str) -> list[str]:
        ts = terms(t)
        own = [x for x in ts if x in kept]
        everything = h64(b"all", chain(ts))
        out = []
        for i, bits in enumerate(imatch.SUBSET_BITS):
            some = [x for x in own if xxhash.xxh64_intdigest(i.to_bytes(4, "little"), long(x, 42)) >> (64 - bits) == 0]
            out.append(f"{chain(some) if some else everything:016x}")
        return out

    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for i, t in rows:
        after = texts[i - 1] if i else texts[-1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == "".join(fingerprint(t))
        assert got[i].edited_fingerprint == "".join(fingerprint(edited))
        assert got[i].near_next == same(fingerprint(t), fingerprint(after)) and got[i].near_edited == same(fingerprint(t), fingerprint(edited))
    assert got[7].fingerprint == got[3].fingerprint


def test_blocks_hand_on_the_next_text(spark, monkeypatch):
    monkeypatch.setattr(imatch, "DOCS_A_BLOCK", 3)
    monkeypatch.setattr(imatch, "COARSE", 2)
    rows = [(i * i, f"text number {i}") for i in range(20)]
    got = {r.doc_id: r for r in imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[k - 1][1] if k else rows[-1][1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_a_shuffled_lexicon_gives_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(imatch, "MAX_LEXICON", most)
    rows = [(i, f"text number {i % 5} of some {i % 3} words") for i in range(30)]
    got = sorted(imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string"), band=(0.0, 0.9)).collect())
    monkeypatch.setattr(imatch, "MAX_LEXICON", 4_000_000)
    assert got == sorted(imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string"), band=(0.0, 0.9)).collect())


@pytest.mark.parametrize("quantiles", [1, 2, 3])
def test_blocks_between_quantiles(spark, monkeypatch, quantiles):
    """Blocks rise with the id, whatever their number."""
    monkeypatch.setattr(imatch, "DOCS_A_BLOCK", 2)
    monkeypatch.setattr(imatch, "QUANTILES", quantiles)
    rows = spark.createDataFrame([(i * i - 50, "x") for i in range(40)] + [(None, "y")], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -(10**9), r["__block"]) for r in imatch.in_blocks(rows, "doc_id").collect()))
    assert [b for _, b in got] == sorted(b for _, b in got) and len({b for _, b in got}) > 8


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 50)), ["a", "b", "c", "d", None][min(4, int(rng.exponential(1.2)))]) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r[0]: r[2] for r in rows}
    for source in set(by.values()):
        mine = [r for r in got if by[r.doc_id] == source]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5)
        assert mine[0].source_size == sum(r.size for r in mine) and all(r.taken <= 3 * r.size for r in mine)
        assert mine[0].target <= 3 * mine[0].source_size
    assert sum({by[r.doc_id]: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))


def test_mixed_documents_have_the_taken_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(i % 9)), "en", "ab"[i % 7 == 0], 0) for i in range(80)], DOCS)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    found: dict[int, int] = {}
    for r in mixing.mixed_documents(docs).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + len(words(r.text))
    assert found == {i: n for i, n in taken.items() if n}


# ---------------------------------------------------------------- simhash


def brute_components(fps: dict[int, int], limit: int) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_index_links_what_brute_force_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAVES", 40)
    monkeypatch.setattr(simhash, "VISITORS", 60)
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, 12)
    fps = list(dict.fromkeys(int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for c in centres for _ in range(40)))
    from lorikeet.llm.common import Scratch

    scratch = Scratch(spark, "test")
    got = {r.u: r.root for r in simhash.star_components(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), scratch), scratch).collect()}
    want = brute_components({f: f for f in fps}, 2)
    assert {f: got.get(f, f) for f in fps} == want and len(set(want.values())) < len(fps)


def test_fingerprint_by_hand(spark):
    texts = ["The CAT sat on the mat É", "one two", "", None, "a b c a b c a b c"]
    got = [r.fingerprint for r in simhash.simhash_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for t, f in zip(texts, got, strict=True):
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert f == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 53}" for i in range(5000)).encode()
    whole = simhash.fingerprints([text])
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert simhash.fingerprints([text]) == whole


# ---------------------------------------------------------------- packing


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(vocabulary()), packing.Tokens(vocabulary())
    for text in ("a  b\n c", " lead and trail ", "x\u00a0y z", "<|endoftext|> a <|endoftext|>b", "it's 12 o'clock\r\n\ttab", "\n", " ", "語 語\u3000語 é!", "a b<|endoftext|> c"):
        ids = np.frombuffer(b"".join(own.of_text(text)), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.Tokens(path)
    assert not own.by_word and packing.Tokens(vocabulary()).by_word
    for text in ("Some WORDS here  and\nthere", "<|endoftext|> x", ""):
        assert np.frombuffer(b"".join(own.of_text(text)), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text("ab'1 \n\t\u00a0é語.<|endoftext|>", max_size=60))
def test_tokens_by_word_are_those_of_the_text(text):
    from tokenizers import Tokenizer

    if not TOKENIZERS:
        TOKENIZERS.update(t=Tokenizer.from_file(vocabulary()), own=packing.Tokens(vocabulary()))
    t, own = TOKENIZERS["t"], TOKENIZERS["own"]
    assert np.frombuffer(b"".join(own.of_text(text)), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


TOKENIZERS: dict = {}


def test_packing_places_each_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("abcdefg"[int(x)] * 3 for x in rng.integers(0, 7, int(rng.exponential(400))))) for i in range(120)] + [(500, None), (501, "x " * 9000)]
    got = PACK(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.1 * total / 2048 + 1


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(4)
    widths = np.sort(rng.choice(np.arange(1, 257), 60, replace=False))
    demand = rng.integers(1, 500, 60)
    patterns = packing.solve_patterns(widths, demand, 256)
    assert (sum(p * k for p, k in patterns) == demand).all() and all((p * widths).sum() <= 256 for p, _ in patterns)
    assert sum(k for _, k in patterns) <= sum(k for _, k in packing.first_fit(widths, demand, 256))


def test_patterns_are_near_the_bound():
    """A full set of widths, and one width with most of the demand, against bounds that no packing can beat."""
    for demand in (np.random.default_rng(1).integers(0, 10**6, 256), np.where(np.arange(256) == 99, 10**7, 10)):
        widths, demand = np.arange(1, 257)[demand > 0], demand[demand > 0]
        patterns = packing.solve_patterns(widths, demand, 256)
        assert (sum(p * k for p, k in patterns) == demand).all()
        volume = -(-int((widths * demand).sum()) // 256)
        alone = int(demand[widths > 128].sum())  # two of these never share a sequence
        pairs = -(-int(demand[widths >= 100].sum()) // 2)  # nor do three of these
        assert sum(k for _, k in patterns) <= 1.01 * max(volume, alone, pairs)


# ---------------------------------------------------------------- toxicity


def test_toxicity_finds_the_sentence(spark):
    rng = np.random.default_rng(6)
    plain = [f"word{i}" for i in range(200)]

    def text(toxic: bool) -> str:
        s = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        if toxic:
            s[3] += " horrible"
        return ". ".join(s) + "."

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), labels.where("doc_id < 300"))
    got = toxicity.score_toxicity(docs.where("doc_id >= 300"), model).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    assert all(r.worst_sentence == 3 for r in got if r.predicted)
    assert model.score(model.sentence_scores((" ".join(plain) + ". ").encode() * 500)) < 0.7


@pytest.mark.parametrize("kind", ["long", "string"])
def test_toxicity_is_equal_under_any_partitioning(spark, kind):
    """Copies with contrary labels, repeated ids, null ids and texts, string ids and clashing columns."""
    rows = [(i % 90, f"good words number {i % 7} here. and some more {i % 11}") for i in range(120)] + [(500 + i, "the same horrible copy. again") for i in range(30)] + [(None, "x"), (7, None)]
    labels = [(i, int(i % 5 == 0)) for i in range(90)] + [(500 + i, i % 2) for i in range(30)] + [(3, 1), (3, 0), (4, 7), (None, 1)]
    found = set()
    for parts in (2, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "1 as toxic", "2 as h", "'x' as bag").repartition(parts)
        known = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr(f"cast(doc_id as {kind}) doc_id", "toxic", "'y' as text").repartition(parts)
        sample = toxicity.sampled(docs, known).collect()
        assert len(sample) == len({r.text for r in sample}) and next(r.toxic for r in sample if "horrible" in r.text) == 1
        model = toxicity.fit(docs, known)
        found.add((tuple(sorted((r.text, r.toxic) for r in sample)), tuple(sorted(model.weights.by_feature.items())), model.odds))
        assert toxicity.score_toxicity(docs, model).count() == len(rows)
    assert len(found) == 1


def test_toxicity_without_labels_scores_zero(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score_toxicity(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
