"""Language identification with spans.

A word's script, from ranges of code points, narrows the candidate languages; character trigrams and
the word itself give it a log-likelihood under each candidate; Viterbi decoding over the words of a
text, with a penalty for switching, labels its spans. A text's language is the one with most letters.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE_A_LANGUAGE documents per
language, those with the least hashes of id and text. Its table has BUCKETS counts per language.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.llm.common import slices, table, with_outputs

SAMPLE_A_LANGUAGE = 1500
BUCKETS = 1 << 15
SWITCH = 8.0
CACHE = 200_000
STEP = 20_000
CELLS = 400_000
SCRIPT_SHARE = 0.01
ELSEWHERE = -50.0

#: First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = tuple(dict.fromkeys(n for n, _, _ in SCRIPTS)) + ("other",)


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


@lru_cache(1 << 14)
def script_of_letter(letter: str) -> int:
    x = ord(letter)
    return next((NAMES.index(n) for n, a, b in SCRIPTS if a <= x <= b), len(NAMES) - 1)


def script_of(word: str) -> int:
    """The script of a word's first letter; -1 without letters."""
    return next((script_of_letter(c) for c in word if c.isalpha()), -1)


@lru_cache(1 << 16)
def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a lower-cased word's trigrams, padded, and of the word; its letters only."""
    bare = letters_of(word)
    padded = f"^{bare}$"
    return [*map(bucket, map("".join, zip(padded, padded[1:], padded[2:]))), zlib.crc32(f"={bare}".encode()) % BUCKETS]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: by language and bucket. scripts: letters by language and script."""
        self.langs = langs
        smooth = counts + 0.05
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket, language
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))

    def knows(self, word: str) -> bool:
        """If a learned language uses the word's script."""
        script = script_of(word)
        return script >= 0 and bool(self.uses[:, script].any())

    def scores(self, word: str) -> np.ndarray:
        script = script_of(word)
        if script < 0:
            return np.zeros(len(self.langs), np.float32)
        found = self.logs[word_features(word)].sum(axis=0)
        allowed = self.uses[:, script]
        return found + np.where(allowed, 0, ELSEWHERE).astype(np.float32) if allowed.any() else found

    def scores_of(self, words: list[str], scripts: np.ndarray) -> np.ndarray:
        """``scores`` of words of these scripts, with features added in the same order, so equal to the last bit."""
        found = np.zeros((len(words), len(self.langs)), np.float32)
        lettered = np.flatnonzero(scripts >= 0)
        features = [word_features(words[i]) for i in lettered]
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter(chain.from_iterable(features), np.int64, int(sizes.sum()))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, total = (np.cumsum(sizes) - sizes)[order], sizes[order], np.zeros((len(order), len(self.langs)), np.float32)
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -k, "left"))  # words with more than k features
            total[:n] += self.logs[flat[starts[:n] + k]]
        found[lettered[order]] = total
        allowed = self.uses.T[scripts]
        found += np.where((scripts >= 0)[:, None] & allowed.any(axis=1, keepdims=True) & ~allowed, ELSEWHERE, 0).astype(np.float32)
        return found


class Words(dict):
    """Row numbers of words in a growing table of scores, which ``learn`` fills for the words met since."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        self.letters, self.known = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def learn(self) -> None:
        first, end = len(self) - len(self.fresh), len(self)
        if end > len(self.table):
            more = max(end, 2 * len(self.table)) - len(self.table)
            self.table, self.letters, self.known = (np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)]) for x in (self.table, self.letters, self.known))
        for at in range(first, end, STEP):
            some = self.fresh[at - first : at - first + STEP]
            scripts = np.fromiter(map(script_of, some), np.int64, len(some))
            here = slice(at, at + len(some))
            self.table[here] = self.model.scores_of(some, scripts)
            self.letters[here] = [len(letters_of(w)) for w in some]
            self.known[here] = self.letters[here] * ((scripts >= 0) & self.model.uses.any(axis=0)[scripts])
        self.fresh = []


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels for scores of shape (words, texts, languages); padding has score 0 for all."""
    steps, texts, langs = scores.shape
    switched, came = np.zeros((steps, texts, langs), bool), np.zeros((steps, texts), np.int16)
    total = scores[0].copy()
    for t in range(1, steps):
        top = total.argmax(axis=1)
        jump = total[np.arange(texts), top][:, None] - penalty
        np.greater(jump, total, out=switched[t])
        came[t] = top
        total = np.maximum(total, jump) + scores[t]
    labels, rows = np.empty((steps, texts), np.int16), np.arange(texts)
    state = total.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        labels[t] = state
        state = np.where(switched[t, rows, state], came[t], state)
    return labels


def label_batch(words: Words, texts: list[str | None], penalty: float) -> list[tuple[str, float, float, list[tuple[int, int, str]]]]:
    """(language, score, share of letters in scripts of learned languages, spans of words) of each text."""
    langs = words.model.langs
    out: list = [("und", 0.0, 0.0, [])] * len(texts)
    if not langs:
        return out
    ids = {i: np.array(list(map(words.__getitem__, found)), np.int64) for i, t in enumerate(texts) if t and (found := t.lower().split())}
    words.learn()
    order = sorted(ids, key=lambda i: len(ids[i]))
    at = 0
    while at < len(order):
        # texts of like length together, so that little is padding
        end, first = at + 1, len(ids[order[at]])
        while end < len(order) and len(ids[order[end]]) <= 1.3 * first + 16 and (end - at + 1) * len(ids[order[end]]) <= CELLS:
            end += 1
        group = order[at:end]
        longest = len(ids[group[-1]])
        scores = np.zeros((longest, len(group), len(langs)), np.float32)
        for k, i in enumerate(group):
            scores[: len(ids[i]), k] = words.table[ids[i]]
        labels = viterbi(scores, penalty)
        for k, i in enumerate(group):
            mine, letters = labels[: len(ids[i]), k], words.letters[ids[i]]
            mass = np.bincount(mine, letters, len(langs))
            if mass.sum():
                best = int(mass.argmax())
                cuts = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(mine)]
                out[i] = (langs[best], float(mass[best] / mass.sum()), float(words.known[ids[i]].sum() / mass.sum()), [(a, b, langs[mine[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        at = end
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE_A_LANGUAGE) -> Model:
    """From rows doc_id, text, lang; rows with null text or lang teach nothing, equal rows teach once.

    Hashes are cut at twice the sample's expected share before the exact cut at its last member, so what
    meets in a task is some samples' worth of hashes, however many rows a language has.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    most = float((1 << 63) - 1)
    # a row per language, as the model has
    rough = rows.groupBy("lang").count().select("lang", (F.least(F.lit(1.0), (2 * sample + 100) / F.col("count")) * most).alias("cut"))
    near = rows.join(F.broadcast(rough), "lang").where(F.col("h") <= F.col("cut")).select("lang", "h").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    last = near.select("lang", "h", place.alias("rn")).where(F.col("rn") <= sample).groupBy("lang").agg(F.max("h").alias("last"))
    chosen = rows.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last")).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for first, end in slices(b.column(1)):
                part, seen = b.slice(first, end - first), {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen.setdefault(lang, Counter()).update(text.lower().split())
                for lang, words in seen.items():
                    mine = totals.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    for word, n in words.items():
                        script = script_of(word)
                        if script >= 0:
                            for f in word_features(word):
                                mine[f] += n
                            mine[BUCKETS + script] += n * len(letters_of(word))
        for lang, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], names=["lang", "bucket", "n"])

    found = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


OUTPUTS = {"lang_pred": "string", "score": "double", "recognised": "double", "spans": "array<struct<first_word:int,end_word:int,lang:string>>"}


def with_language(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score, recognised, spans`` for every row; whole texts are read.

    Null texts and texts without letters are ``und`` with scores 0 and no spans; so is every text if the
    model has learned no language. ``score``: the share of letters in spans of the predicted language.
    ``recognised``: the share of letters in words of a script that a learned language uses. Ties go to the
    first language by name. Input columns of these names, with ``prefix``, are replaced; repeated rows are
    judged each for itself; empty input gives no rows.
    """
    kinds = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))

    def run():
        words = Words(model)

        def each(texts: pa.Array) -> list[pa.Array]:
            nonlocal words
            if len(words) >= CACHE:
                words = Words(model)
            found = label_batch(words, texts.to_pylist(), penalty)
            spans = [[{"first_word": a, "end_word": e, "lang": x} for a, e, x in f[3]] for f in found]
            return [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.float64()) for i in (1, 2)), pa.array(spans, kinds)]

        return each

    return with_outputs(docs, text_col, [prefix + c for c in OUTPUTS], ", ".join(f"{c} {t}" for c, t in OUTPUTS.items()), run)


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """``with_language`` of the ids: ``id_col, lang_pred, score, recognised, spans`` for every row."""
    return with_language(docs.select(id_col, text_col), model, text_col, penalty).drop(text_col)


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def fit_for_documents(docs: DataFrame) -> Model:
    return fit(docs.where(remainder(4) != 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect(docs, fit_for_documents(docs))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
