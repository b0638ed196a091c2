"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words and their stems
(first letters), as inflected languages need; the document's is their noisy-or, so one toxic sentence is enough. Weights are trained from document labels alone and
then say which sentences offend.

The classifier is fitted on a bounded sample of labelled rows: at most SAMPLE_TOXIC rows with label 1
and SAMPLE_CLEAN with label 0, those with the least hashes of their texts, and VOCABULARY features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.common import Scratch, table

SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
VOCABULARY, LEAST_DOCS, LEAST_LIFT = 2000, 4, 2.0
STEMS = range(3, 8)
THRESHOLD = 0.7
STEPS, RATE, DECAY, BIAS = 400, 0.05, 1e-4, -10.0
CACHE = 300_000

_ENDS, _WORD = b".!?\n", bytes(range(97, 123)) + bytes(range(48, 58)) + b"'" + bytes(range(128, 256))
#: Bytes of a text: letters to lower case, ends of sentences to line feeds, other marks to spaces.
FOLD = bytes(10 if c in _ENDS else c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def sentences(text: bytes | None) -> list[list[bytes]]:
    """Words of each sentence; sentences without words are left out."""
    return [w for s in (text or b"").translate(FOLD).split(b"\n") if (w := s.split())]


def features(word: bytes) -> list[str]:
    """The word, and its first letters where it is longer."""
    text = word.decode("utf-8", "replace")
    return ["=" + text, *(text[:n] for n in STEMS if n < len(text))]


class Weights(dict):
    """Weights of words, from those of their features; bounded."""

    def __init__(self, by_feature: dict[str, float]):
        self.by_feature = by_feature

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = sum(self.by_feature.get(f, 0.0) for f in features(word))
        return found

    def __reduce__(self):
        return Weights, (self.by_feature,)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, odds: float):
        self.weights, self.bias, self.odds = Weights(weights), bias, odds

    def sentence_scores(self, text: bytes | None) -> list[float]:
        get = self.weights.__getitem__
        return [sum(map(get, set(s))) + self.bias for s in sentences(text)]  # a repeated word counts once

    def score(self, logits: list[float]) -> float:
        """Noisy-or of the sentences; 0 without any. Its odds are scaled so that the decision falls at THRESHOLD."""
        if not logits:
            return 0.0
        p = -np.expm1(-np.logaddexp(0, np.array(logits)).sum())
        return float(p * self.odds / (p * self.odds + (1 - p)))


def noisy_or_fit(bags: list[list[list[int]]], blanks: np.ndarray, y: np.ndarray, words: int) -> tuple[np.ndarray, float]:
    """Weights by full-batch Adam, and the bias, which is fixed: so low that a long text of unknown words stays clean. bags: word numbers of each sentence; blanks: sentences without known words."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    sizes = np.array([len(s) for bag in bags for s in bag], np.int64)
    word = np.array([w for bag in bags for s in bag for w in s], np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.zeros(words + 1)
    theta[-1] = BIAS
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, theta[word], len(sizes)) + theta[-1]
        none = -np.bincount(doc, np.logaddexp(0, z), len(bags)) - blanks * np.logaddexp(0, theta[-1])  # log of no toxic sentence
        p = np.clip(-np.expm1(none), 1e-9, 1)
        pull = weight * np.where(y == 1, -(1 - p) / p, 1.0)  # of the loss, by each sentence's score
        s = 1 / (1 + np.exp(-z))
        g = np.zeros_like(theta)
        per = pull[doc] * s
        g[:words] = np.bincount(word, per[sentence], words) / len(y) + DECAY * theta[:words]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:words], float(theta[-1])


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The midpoint of the gap in p that has the highest F1 above it."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 1e-6, 1 - 1e-6))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``h, toxic, text`` of the sample: distinct texts; rows with null text, id or label teach nothing.

    A text that several rows have counts once, as toxic if one of its labels says so: copies would pass for
    evidence. Texts stand for the hash ``h``, whose own hash decides which are in the sample.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    each = rows.select("doc_id", "h").join(known, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"))
    least = lambda x, n: each.where(F.col("toxic") == x).orderBy(F.xxhash64("h"), "h").limit(n)
    chosen = least(1, SAMPLE_TOXIC).unionByName(least(0, SAMPLE_CLEAN))  # bounded, whatever the input
    return rows.join(F.broadcast(chosen), "h").groupBy("h", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From the labelled rows of ``docs`` (doc_id, text) by ``labels`` (doc_id, toxic); ids of any one type.

    Rows that repeat an id are labelled by it each; an id with several labels is toxic if one says so; other
    labels than 0 and 1 and other columns are ignored. Without both labels among the rows, as with empty
    tables, every score is 0. Equal whatever the partitioning.
    """
    sample = Scratch(docs.sparkSession, "toxic").keep(sampled(docs, labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found.update((f, toxic) for f in {f for w in {w for s in sentences(text) for w in s} for f in features(w)})
                found[("", toxic)] += 1  # the documents themselves
            rows = [(w, t, n) for (w, t), n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["word", "toxic", "n"])

    by_word = sample.select("toxic", "text").mapInArrow(count, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    totals = by_word.where(F.col("word") == "").first()
    if not totals or not totals.a or not totals.c:
        return Model({}, -50.0, 1.0)
    lift = F.log((F.col("a") + 0.5) / (totals.a + 1.0)) - F.log((F.col("c") + 0.5) / (totals.c + 1.0))
    top = by_word.where((F.col("word") != "") & (F.col("a") >= min(LEAST_DOCS, totals.a))).withColumn("lift", lift).where(F.col("lift") > LEAST_LIFT)
    words = [r.word for r in top.orderBy((F.col("lift") * F.col("a")).desc(), "word").limit(VOCABULARY).collect()]
    number = {w: i for i, w in enumerate(words)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags, blanks = [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                own = [[number[f] for w in sorted(set(s)) for f in features(w) if f in number] for s in sentences(text)]
                bags.append([s for s in own if s])
                blanks.append(sum(not s for s in own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(blanks, pa.int64())], names=["h", "toxic", "bag", "blanks"])

    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows, of vocabulary words only
    rows = sample.select("h", "toxic", "text").mapInArrow(encode, "h long, toxic int, bag array<array<int>>, blanks long").toPandas().sort_values("h", kind="stable")
    y = rows["toxic"].to_numpy(int)
    bags = [[list(map(int, s)) for s in bag] for bag in rows["bag"]]
    blanks = rows["blanks"].to_numpy(float)
    weights, bias = noisy_or_fit(bags, blanks, y, len(words))
    none = np.array([-sum(np.logaddexp(0, sum(weights[s]) + bias) for s in bag) for bag in bags]) - blanks * np.logaddexp(0, bias)
    cut = best_cut(-np.expm1(none), y)
    odds = (THRESHOLD / (1 - THRESHOLD)) / (cut / (1 - cut))
    return Model({w: float(weights[i]) for w, i in number.items()}, bias, odds)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, worst_sentence, worst_score`` for every row, from its whole text.

    worst_sentence: number of the sentence with the highest score, counted over sentences with words.
    Null, empty and blank texts score 0 and have no worst sentence. Other columns are ignored.
    """
    rows = docs.select(id_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logits = [model.sentence_scores(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            score = [model.score(z) for z in logits]
            worst = [max(range(len(z)), key=z.__getitem__) if z else None for z in logits]
            high = [1 / (1 + float(np.exp(-z[w]))) if z else None for z, w in zip(logits, worst, strict=True)]
            cols = [pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(worst, pa.int32()), pa.array(high, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "score", "predicted", "worst_sentence", "worst_score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double, predicted int, worst_sentence int, worst_score double")


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder() != 1), table(spark, sf_dir, "labels").where(remainder() != 1))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "worst_sentence", "worst_score")
