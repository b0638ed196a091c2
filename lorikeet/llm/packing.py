"""Packing documents into fixed-length sequences by cutting-stock column generation.

Texts are tokenized once, each as a whole; what leaves the tokenizer are pieces (at most a sequence
long) with their checksums. A histogram of piece lengths in units of 8 tokens (at most 256 counts,
whatever the corpus) goes to the driver. There a linear program over patterns, combinations of
lengths that fit a sequence, is solved by column generation: the program's duals price lengths, a
knapsack dynamic program finds the pattern worth most at these prices, and it enters until none is
worth more than a sequence. Patterns are rounded down; the few pieces left are packed first-fit. The
pieces of each length are then ranked by a hash in bucketed prefix sums, and rank intervals say which
copy of which pattern a piece belongs to.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.llm.common import Scratch, table

SEQUENCE = 2048
UNIT = 8
END_ID = 1
CACHE = 600_000
ROWS_A_BUCKET = 20_000
#: What stands for a space in the alphabet of byte-level BPE.
SPACE = "\u0120"
#: Marks that stand alone after a word's letters.
MARKS = frozenset(".,;:!?")
#: The program is solved until its value is proven to be within so many sequences, or that share of all, of the best.
GAP, GAP_SHARE = 1.0, 1e-6


# ---------------------------------------------------------------- tokens


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE whose words begin at a space, so that a text's ids are those of its words."""
    before, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not settings.get("normalizer")
    return plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


class Tokens(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a space and the word that is the key; bounded.

    Byte-level BPE never merges across a space that stands between two characters that aren't white
    space, so a text's ids are those of its words, which repeat. Texts that hold an added token, and all
    texts under a tokenizer of another kind, are encoded whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        settings = json.loads(self.tokenizer.to_str())
        self.by_word = splits_at_spaces(settings)
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.added = [t["content"] for t in settings.get("added_tokens") or ()]

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        # the library's own steps, without the rest of an encoding; letters are one piece with the space before
        # them, and a mark after them is another, so such words need not be split by the library
        if word[-1] in MARKS and word[:-1].isalpha():
            found = self[word[:-1]] + self.pieces([word[-1]])
        elif word.isascii() and word.isalpha():
            found = self.pieces([SPACE + word])
        else:
            found = self.pieces([p for p, _ in self.split.pre_tokenize_str(" " + word)])
        self[word] = found
        return found

    def pieces(self, pieces: list[str]) -> bytes:
        return np.array([t.id for p in pieces for t in self.model.tokenize(p)], "<u4").tobytes()

    def of_text(self, text: str) -> Iterator[bytes]:
        """The ids of a text in consecutive parts."""
        if not self.by_word or any(t in text for t in self.added):
            yield self.ids(text)
            return
        plain = "  " not in text and " \n" not in text and "\n " not in text and not ODD_SPACE.search(text) and text[:1] != " " and text[-1:] != " "
        words = text.split(" ") if plain else BETWEEN_WORDS.split(text)
        yield self.ids(words[0])
        for at in range(1, len(words), 100_000):
            yield b"".join(map(self.__getitem__, words[at : at + 100_000]))


ODD_SPACE = re.compile(r"[^\S \n]")
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def text_pieces(tokens: Tokens, text: str | None, sequence: int = SEQUENCE) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of ids with the end id, and (start, length, crc32) of each piece; a text's ids are never held as a whole."""
    whole, out, buffer, start = 4 * sequence, [], b"", 0
    for part in chain(tokens.of_text(text) if text else (), (END_ID.to_bytes(4, "little"),)):
        buffer += part
        at = 0
        while len(buffer) - at >= whole:
            out.append((start, sequence, zlib.crc32(buffer[at : at + whole])))
            start, at = start + sequence, at + whole
        buffer = buffer[at:]
    if buffer:
        out.append((start, len(buffer) // 4, zlib.crc32(buffer)))
    return start + len(buffer) // 4, out


def document_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    rows = docs.select(id_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for b in batches:
            row, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                total, pieces = text_pieces(tokens, text, sequence)
                row += [i] * len(pieces)
                found += [(*p, total) for p in pieces]
            cols = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(cols[:, i]) for i in range(4))], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


# ---------------------------------------------------------------- patterns


def best_pattern(widths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of widths within capacity with the highest price, by dynamic programming."""
    order = np.argsort(widths)
    w, v = widths[order], prices[order]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = bisect_right(w, c)
        if k:
            values = v[:k] + best[c - w[:k]]
            i = int(values.argmax())
            if values[i] > best[c] + 1e-12:
                best[c], choice[c] = values[i], i
    counts, c = np.zeros(len(w), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= w[choice[c]]
    return float(best[capacity]), counts


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product. Small enough to do without BLAS, whose threads may stall in a driver that hosts a JVM."""
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots."""
    n = len(matrix)
    both = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        k = i + int(np.abs(both[i:, i]).argmax())
        both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        there = np.flatnonzero(rest)
        both[there] -= rest[there, None] * both[i]
    return both[:, n:]


def solve_patterns(widths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, copies) that hold ``demand[i]`` items of ``widths[i]`` exactly.

    Revised simplex with column generation. If the best pattern is worth v at the duals' prices, no solution
    has less than 1 / v of the current value; pivots go on until that bound is within GAP sequences, or
    GAP_SHARE, of it. Demands are perturbed by less than a thousandth of an item so that every pivot gains and
    none comes back; rounding heeds the true ones.
    """
    if not len(widths):
        return []
    columns = starting_basis(widths, demand, capacity)
    inverse = inverted(columns)
    asked = demand + np.random.default_rng(len(widths)).uniform(1e-4, 1e-3, len(widths))
    x = np.maximum(times(inverse, asked), 0)
    turn = 0
    while True:
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        value, pattern = best_pattern(widths, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= max(GAP, GAP_SHARE * x.sum()):
            break
        direction = times(inverse, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        turn += 1
        if turn % 100 == 0:
            inverse = inverted(columns)
        x = np.maximum(times(inverse, asked), 0)
    left, used = demand.copy(), []
    for j in np.argsort(-x):
        pattern = columns[:, j].round().astype(np.int64)
        there = pattern > 0
        copies = int(min(np.floor(x[j] + 1e-3), (left[there] // pattern[there]).min()))
        if copies > 0:
            used.append((pattern, copies))
            left = left - copies * pattern
    return used + first_fit(widths, left, capacity)


def starting_basis(widths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns filled with the longest open widths first, as columns.

    Each is used, in fractions, until one of its widths runs out, which no later one has: so the matrix
    is triangular up to order.
    """
    left, open_, columns = demand.astype(float), np.ones(len(widths), bool), []
    order = np.argsort(-widths)
    while open_.any():
        room, pattern = capacity, np.zeros(len(widths))
        for i in order:
            if open_[i] and widths[i] <= room:
                pattern[i] = room // widths[i]
                room -= int(pattern[i] * widths[i])
        used = np.flatnonzero(pattern)
        copies = left[used] / pattern[used]
        out = used[copies.argmin()]
        left = np.maximum(left - copies.min() * pattern, 0)
        open_[out] = False
        columns.append(pattern)
    return np.array(columns).T


def first_fit(widths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Longest pieces first, each into the first sequence with room, filled up with the longest that fit."""
    left, out = left.copy(), []
    order = np.argsort(-widths)
    while left.any():
        room, pattern = capacity, np.zeros_like(left)
        for i in order:
            k = min(int(left[i]), room // int(widths[i]))
            pattern[i], room = k, room - k * int(widths[i])
        copies = int(min(left[pattern > 0] // pattern[pattern > 0]))
        out.append((pattern, copies))
        left = left - copies * pattern
    return out


class Plan:
    """For each width the rank intervals, with the first sequence and the pieces per sequence of each."""

    def __init__(self, widths: np.ndarray, patterns: list[tuple[np.ndarray, int]]):
        self.ranks: dict[int, list[np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {int(w): [] for w in widths}
        taken, sequence = dict.fromkeys(rows, 0), 0
        for pattern, copies in patterns:
            for w, k in zip(map(int, widths), map(int, pattern), strict=True):
                if k:
                    rows[w].append((taken[w], sequence, k))
                    taken[w] += k * copies
            sequence += copies
        self.by_width = {w: np.array(r, np.int64).reshape(-1, 3) for w, r in rows.items()}
        self.sequences = sequence

    def sequence(self, width: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(rank), np.int64)
        for w in np.unique(width):
            here, of = np.flatnonzero(width == w), self.by_width[int(w)]
            i = np.searchsorted(of[:, 0], rank[here], side="right") - 1
            out[here] = of[i, 1] + (rank[here] - of[i, 0]) // of[i, 2]
        return out


# ---------------------------------------------------------------- assignment


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Null and empty texts are packed as their end id alone. Rows with equal ids are packed each for itself.
    Documents longer than a sequence are cut after each full sequence; others stay whole. Empty input
    gives no rows. Other columns are ignored. ``tokenizer``: path of a file of the tokenizers library, of any kind.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(document_pieces(docs, tokenizer, id_col, text_col, sequence))
    pieces = pieces.withColumn("__width", F.ceil(F.col("length") / UNIT).cast("int")).withColumn("__h", F.xxhash64(id_col, "start", "ids_crc32"))
    counted = {r["__width"]: r["count"] for r in pieces.groupBy("__width").count().collect()}  # at most sequence / UNIT rows
    widths = np.array(sorted(counted), np.int64)
    demand = np.array([counted[w] for w in widths.tolist()], np.int64)
    plan = Plan(widths, solve_patterns(widths, demand, -(-sequence // UNIT)))

    buckets = max(1, int(demand.max(initial=0)) // ROWS_A_BUCKET + 1)
    # buckets are ranges of the hash, so ranks follow it through a whole width
    pieces = pieces.withColumn("__bucket", F.floor((F.shiftrightunsigned("__h", 32) * buckets) / float(1 << 32)).cast("int"))
    offsets = pieces.groupBy("__width", "__bucket").count().select("__width", "__bucket", (F.sum("count").over(W.partitionBy("__width").orderBy("__bucket")) - F.col("count")).alias("__before"))
    order = [F.col("__h"), F.col(id_col), F.col("start"), F.col("ids_crc32"), F.col("length")]
    ranked = pieces.withColumn("__rank", F.row_number().over(W.partitionBy("__width", "__bucket").orderBy(*order)) - 1).join(offsets, ["__width", "__bucket"])
    ranked = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", F.col("__width").cast("long").alias("__width"), (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))
    kept = ranked.columns[:5]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = plan.sequence(b.column(5).to_numpy(), b.column(6).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at)], names=[*kept, "sequence_id"])

    kind = ranked.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    inside = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), id_col, "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
