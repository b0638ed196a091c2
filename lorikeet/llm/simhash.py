"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are computed per whole text. Distinct fingerprints are range-partitioned by Gray rank, in
whose order neighbours differ in few bits, and every partition bulk-builds a tree: a node keeps the
bits that all fingerprints below it share as a mask and a pattern; a child's mask has only the bits
that its parent's lacks. A search walks the tree level by level, adds up the differing bits per path
and drops a node, with all below it, once they exceed the limit.

The roots of all partitions form a tree of their own (a few nodes per partition, so a bounded
broadcast); it says which partitions a fingerprint has to visit. Fingerprints that visit are dealt by
partition; a partition with many visitors is searched by several tasks, each with its own copy of the
leaves and a share of the visitors. A fingerprint has at most 2080 others within two bits, so the
links are linear in the input; each task contracts what it finds to stars before it emits them, and
large-star / small-star rounds join the stars across partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.common import Scratch, hot_limit, join_groups, shuffle_partitions, table

SHINGLE = 3
MAX_BITS = 2
SEED = 42
FANOUT = 8
ROOTS = 8
LEAVES = 200_000
VISITORS = 2_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 4 << 20


# ---------------------------------------------------------------- fingerprints


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, a few MB at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield data[at:end].translate(LOWER).split()
        at = end


def shingle_hashes(data: bytes | None, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each run of k words, repeats included; of all words if there are fewer; none for none."""
    h, tail, any_yet = xxhash.xxh64_intdigest, [], False
    for words in word_pieces(data or b""):
        words = tail + words
        if len(words) >= k:
            any_yet = True
            runs = zip(*(words[i:] for i in range(k)), strict=False)
            yield np.fromiter((h(s, SEED) for s in map(b" ".join, runs)), np.uint64, len(words) - k + 1)
        tail = words[len(words) - k + 1 :] if len(words) >= k else words
    if not any_yet and tail:
        yield np.array([h(b" ".join(tail), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(n: int, found: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Fingerprints of ``n`` texts from (text, hashes of some of its shingles): a bit is 1 if it is 1 in over half the hashes."""
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(x) for _, x in held])
            sums = np.add.reduceat(bit_counts(np.concatenate([x for _, x in held])), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64)
            np.add.at(ones, [i for i, _ in held], sums)
            np.add.at(total, [i for i, _ in held], sizes)
            held.clear()

    waiting = 0
    for i, x in found:
        if len(x):
            held.append((i, x))
            waiting += len(x)
        if waiting > 100_000:
            flush()
            waiting = 0
    flush()
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """Fingerprints over the shingles of each text, repeats included."""
    return majority(len(texts), ((i, x) for i, text in enumerate(texts) for x in shingle_hashes(text, k)))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``id_col, fp`` (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).cast(pa.binary()).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


# ---------------------------------------------------------------- the index


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray code, as a long whose signed order is the unsigned one."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """Nodes over (mask, pattern) pairs that stand in Gray order; leaves that are fingerprints have full masks."""

    def __init__(self, masks: np.ndarray, patterns: np.ndarray, fanout: int = FANOUT):
        self.levels = [(masks, patterns)]
        self.fanout = fanout
        while len(self.levels[-1][0]) > fanout:
            m, p = self.levels[-1]
            starts = np.arange(0, len(m), fanout)
            first = np.repeat(p[starts], fanout)[: len(p)]
            differ = np.bitwise_or.reduceat((p ^ first) | ~m, starts)
            self.levels.append((~differ, p[starts] & ~differ))
        # a child keeps just the bits that its parent doesn't have
        self.own = []
        for i, (m, _) in enumerate(self.levels):
            above = np.repeat(self.levels[i + 1][0], fanout)[: len(m)] if i + 1 < len(self.levels) else np.zeros_like(m)
            self.own.append(m & ~above)

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) index pairs with at most ``limit`` differing bits."""
        found_q, found_l = [], []
        for at in range(0, len(queries), 2048):
            top = len(self.levels) - 1
            width = len(self.levels[top][0])
            q = np.repeat(np.arange(at, min(at + 2048, len(queries))), width)
            node = np.tile(np.arange(width), len(q) // max(1, width))
            spent = np.zeros(len(q), np.uint8)
            for level in range(top, -1, -1):
                if level < top:
                    size = len(self.levels[level][0])
                    q, spent = np.repeat(q, self.fanout), np.repeat(spent, self.fanout)
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    there = node < size
                    q, spent, node = q[there], spent[there], node[there]
                spent = spent + np.bitwise_count((queries[q] ^ self.levels[level][1][node]) & self.own[level][node])
                near = spent <= limit
                q, node, spent = q[near], node[near], spent[near]
            found_q.append(q)
            found_l.append(node)
        none = np.zeros(0, np.int64)
        return np.concatenate(found_q or [none]), np.concatenate(found_l or [none])


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def leaves_tree(fps: np.ndarray) -> GrayTree:
    return GrayTree(np.full(len(fps), FULL), fps)


def partition_roots(leaves: DataFrame) -> DataFrame:
    """``pid, mask, pattern`` of up to ROOTS nodes for each partition of leaves (pid, place, fp)."""
    size = F.count(F.lit(1)).over(_by_pid())
    part = F.floor((F.row_number().over(_by_pid_place()) - 1) * ROOTS / size)
    grouped = leaves.select("pid", "fp", part.alias("part")).groupBy("pid", "part")
    nodes = grouped.agg(F.bit_and("fp").alias("all1"), F.bit_or("fp").alias("any1"), F.min("fp").alias("one"))
    mask = F.bitwise_not(F.col("all1").bitwiseXOR(F.col("any1")))
    return nodes.select("pid", "part", mask.alias("mask"), F.col("one").bitwiseAND(mask).alias("pattern"))


def _by_pid():
    from pyspark.sql import Window

    return Window.partitionBy("pid")


def _by_pid_place():
    return _by_pid().orderBy("place")


def contract(labels: np.ndarray, q: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Labels of leaves once the leaves that share a query are joined; q is sorted."""
    if not len(q):
        return labels
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(q)]]))
    while True:
        before = labels.copy()
        least = np.repeat(np.minimum.reduceat(labels[leaf], starts), sizes)
        np.minimum.at(labels, labels[leaf], least)
        np.minimum.at(labels, leaf, least)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
        if np.array_equal(labels, before):
            return labels


def near_links(distinct: DataFrame, scratch: Scratch, limit: int = MAX_BITS) -> DataFrame:
    """Links ``u, v`` that join just the fingerprints of ``distinct`` (fp) within ``limit`` bits of each other.

    Not each pair is listed: every connected group of a task comes as a star.
    """
    n = distinct.count()
    parts = max(1, min(shuffle_partitions(distinct.sparkSession), n // 4000), -(-n // LEAVES))
    placed = distinct.withColumn("place", gray_rank(F.col("fp"))).repartitionByRange(parts, "place")
    leaves = scratch.keep(placed.select(F.spark_partition_id().alias("pid"), "place", "fp"))
    # At most ROOTS rows for each partition of up to LEAVES fingerprints.
    roots = sorted((r.pid, r.part, r.mask, r.pattern) for r in partition_roots(leaves).collect())
    pids = np.array([r[0] for r in roots], np.int64)
    masks, patterns = (np.array([r[i] for r in roots], np.int64).view(np.uint64) for i in (2, 3))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = GrayTree(masks, patterns)
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 8192):
                q, node = top.search(fps[at : at + 8192].view(np.uint64), limit)
                # of a pair in two partitions only the one in the lower visits
                pair = np.unique(np.stack([q, pids[node]])[:, pids[node] >= own[at:][q]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1]), pa.array(fps[at:][pair[0]])], names=["pid", "fp"])

    visits = scratch.keep(leaves.select("pid", "fp").mapInArrow(route, "pid long, fp long"))
    shares = visits.groupBy("pid").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("shares"))
    shares = F.broadcast(shares)  # a row per partition
    visitors = visits.join(shares, "pid").select("pid", F.pmod(F.xxhash64("fp"), "shares").cast("int").alias("share"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), "fp")
    copies = leaves.join(shares, "pid").select(F.col("pid").cast("long"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "place", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, tree, labels = None, [], None, None

        def stars() -> Iterator[pa.RecordBatch]:
            if labels is not None:
                own = np.flatnonzero(labels != np.arange(len(labels)))
                yield edges(fps[own], fps[labels[own]])

        def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            pid, share, kind, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            key = np.stack([pid, share, kind])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(fp)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if (pid[i], share[i]) != at:
                    yield from stars()
                    at, fps, tree, labels = (pid[i], share[i]), [], None, None
                some = fp[i:j].astype(np.int64).view(np.uint64)
                if kind[i] == 0:
                    fps.append(some)
                    continue
                if tree is None:
                    fps = np.concatenate(fps)
                    tree, labels = leaves_tree(fps), np.arange(len(fps))
                for k in range(0, len(some), 8192):
                    part = some[k : k + 8192]
                    q, leaf = tree.search(part, limit)
                    other = part[q] != fps[leaf]
                    order = np.argsort(q, kind="stable")
                    labels = contract(labels, q[order], leaf[order])
                    q, leaf = q[other], leaf[other]
                    q, one = np.unique(q, return_index=True)
                    yield edges(part[q], fps[leaf[one]])
        yield from stars()

    rows = copies.unionByName(visitors).repartition(parts, "pid", "share").sortWithinPartitions("pid", "share", "kind", "place")
    return rows.select("pid", "share", "kind", "fp").mapInArrow(search, "u long, v long").where("u <> v").distinct()


# ---------------------------------------------------------------- components


def star_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, root`` for each node of ``edges`` (u, v) that isn't itself the least of its component.

    Alternates large-star and small-star; minima are taken by map-side combined aggregates and joined
    back with hubs dealt to several tasks. Each round is a table of its own.
    """
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, largest = _state(now)
    limit = hot_limit(edges.sparkSession, 2 * seen[0])
    least, size = F.min("v").alias("m"), F.count(F.lit(1)).alias("n")

    def to_least(rows: DataFrame, low: DataFrame) -> DataFrame:
        return join_groups(rows, low, ["u"], "n", limit, ["v"]) if largest > limit else rows.join(low.drop("n"), "u")

    while True:
        both = now.union(now.select("v", "u"))
        large = to_least(both, both.groupBy("u").agg(least, size).select("u", F.least("u", "m").alias("m"), "n"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(least, size)
        small = to_least(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        after, was = scratch.keep(small), seen
        seen, largest = _state(after)
        scratch.drop(now)
        now = after
        if seen == was:
            return now.select("u", F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple[tuple, int]:
    """(number and checksum of the edges), and the size of the largest hub."""
    each = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    n, x, most = each.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    return (n or 0, x), most or 0


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other. Rows that repeat an id
    are linked by their own texts. Null ids get a component but never name one, unless all of its ids
    are null. Empty input gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(with_fingerprint(docs, id_col, text_col, k).toDF("id", "fp"))
    # a row per fingerprint, counted on the map side; rows meet their component through it
    each = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = star_components(near_links(each.select("fp"), scratch, limit), scratch)
    each = scratch.keep(each.join(roots, each["fp"] == roots["u"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = scratch.keep(each.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    hot = hot_limit(docs.sparkSession, prints.count())
    named = join_groups(each.select("fp", "n", "root"), least, ["root"], "prints", hot, ["fp"]).select("fp", "n", "component_id")
    out = join_groups(prints, scratch.keep(named), ["fp"], "n", hot, ["id"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
