"""Near copies: SimHash first, then what it can't reach, all confirmed by exact Jaccard similarity of 0.8 or more.

A document's features are its distinct five-word shingles. Their SimHash fingerprints go through the
Gray-order index, and a text is compared with the first of its component. But at a similarity of 0.8 two
fingerprints differ in 9.7 of 64 bits on average (the angle is acos(8/9)), up to 16 in most cases; a Gray
index would have to look at every pair for that. So MinHash bands find the rest: a set has BANDS keys of
ROWS minima each, and two sets of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS: all but
5 in a million at 0.8, more above. Candidates are confirmed by their exact similarity, so no link is wrong.

The texts of a band key are compared with its centre first: the text that shares keys with most others, which
in a group of edited copies is the original or the least edited. Where that leaves more than one group, texts
outside the key's largest group are compared with those of other groups, unless that is ruled out: by the
shingles of their own, as of two sets with p and q shingles that no other open text has, at most
min(|A| - p, |B| - q) are common; or by the triangle inequality, which Jaccard distances obey, if their
distances from the centre differ by over 0.2.
So each pair of a key is compared, ruled out or already in one group, and a group of edited copies costs
about as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.llm import simhash
from lorikeet.llm.common import Scratch, by_place, hot_limit, join_groups
from lorikeet.llm.simhash import shingle_hashes, star_components

SHINGLE = 5
#: Least similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
BANDS = 40
ROWS = 6
#: Shingles that are hashed at once.
CHUNK = 32_000
_RANDOM = np.random.default_rng(20)
XORS, FACTORS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingle_set(data: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; none for a text without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(data, k)]))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; empty sets share theirs."""
    minima = np.full((BANDS * ROWS, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= CHUNK):
            size += len(sets[full[end]])
            end += 1
        some = full[at:end]
        x = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        y = np.empty_like(x)
        for j in range(BANDS * ROWS):
            np.bitwise_xor(x, XORS[j], out=y)
            np.multiply(y, FACTORS[j], out=y)
            minima[j, some] = np.minimum.reduceat(y, starts)
        at = end
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sets), axis=1)
    for m in minima.reshape(BANDS, ROWS, len(sets)).transpose(1, 0, 2):
        keys = (keys ^ m) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.T


def text_key(text_col: str) -> Column:
    """Texts are told apart by this hash; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _mapped(docs: DataFrame, text_col: str, fields: str, row) -> DataFrame:
    """``key`` and what ``row`` makes of a list of shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at in range(0, len(texts), 500):
                part = [shingle_set(t) for t in texts.slice(at, 500).to_pylist()]
                columns = row(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), *columns.values()], names=["key", *columns])

    return docs.select("key", F.col(text_col).cast("string")).mapInArrow(run, f"key long, {fields}")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(flat))


def _sizes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([len(s) for s in sets], pa.int64())


def _alike_sizes(a: Column, b: Column) -> Column:
    """The similarity of two sets is at most the lesser size over the greater."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _prints(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(simhash.majority(len(sets), enumerate(sets)).view(np.int64))


def near_links(keyed: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """``u, v`` that join just the texts of ``keyed`` (key, text) whose similarity is LEAST or more.

    Not each pair is listed: texts that a link joins already aren't compared again.
    """
    columns = lambda s: {"n": _sizes(s), "fp": _prints(s), "bands": _lists(list(np.ascontiguousarray(band_keys(s))))}
    texts = scratch.keep(_mapped(keyed, text_col, "n long, fp long, bands array<long>", columns).dropDuplicates(["key"]))
    limit = hot_limit(keyed.sparkSession, texts.count())

    # the Gray-order index: texts against the first of their component of fingerprints
    each = scratch.keep(texts.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first"), F.count(F.lit(1)).alias("size")))
    near = star_components(simhash.near_links(each.select("fp"), scratch), scratch)
    each = each.join(near, each["fp"] == near["u"], "left").select("fp", "first", "size", F.coalesce("root", "fp").alias("root"))
    heads = each.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("prints"), F.sum("size").alias("texts")).where("texts > 1")
    heads = scratch.keep(join_groups(each, heads.drop("texts"), ["root"], "prints", limit, ["fp"]).select("fp", "head", "size"))
    close = join_groups(texts.select("key", "n", "fp"), heads, ["fp"], "size", limit, ["key"]).where("key <> head.key").select(F.col("head.key").alias("u"), F.col("key").alias("v"), F.col("head.n").alias("un"), F.col("n").alias("vn"))
    close = close.where(_alike_sizes(F.col("un"), F.col("vn"))).select("u", "v")

    # the bands: texts that share a key against its centre
    spread = texts.select("key", "n", F.explode("bands").alias("band"))
    shared = scratch.keep(spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = scratch.keep(join_groups(spread, shared.select("band", F.col("size").alias("others"), "size"), ["band"], "size", limit, ["key"]))
    central = members.groupBy("key").agg(F.sum("others").alias("central"))
    centres = members.join(central, "key").groupBy("band").agg(F.max_by(F.struct("key", "n"), F.struct("central", "key")).alias("first"), F.count(F.lit(1)).alias("size"))
    members = scratch.keep(join_groups(members.drop("others"), scratch.keep(centres), ["band"], "size", limit, ["key"]))
    with_first = members.where((F.col("key") != F.col("first.key")) & _alike_sizes(F.col("n"), F.col("first.n"))).select(F.col("first.key").alias("u"), F.col("key").alias("v"))
    pairs = scratch.keep(close.union(with_first).distinct())

    sought = members.select("key").union(pairs.select("u")).union(pairs.select("v")).distinct()
    chosen = keyed.join(sought, "key", "left_semi").dropDuplicates(["key"])
    sets = scratch.keep(_mapped(chosen, text_col, "shingles array<long>", lambda s: {"shingles": _lists(s)}))

    def compared(pairs: DataFrame) -> DataFrame:
        """``u, v, both, union``: sizes of the intersection and union. A set that many pairs have is dealt to several tasks."""
        for own, other, name in (("u", "v", "a"), ("v", "u", "b")):
            uses = pairs.groupBy(own).agg(F.count(F.lit(1)).alias("uses"))
            groups = uses.join(sets, uses[own] == sets["key"]).select(own, "uses", F.col("shingles").alias(name))
            pairs = join_groups(pairs, groups, [own], "uses", limit, [other])
        both = F.size(F.array_intersect("a", "b"))
        rows = pairs.select("u", "v", both.alias("both"), (F.size("a") + F.size("b") - both).alias("union"))
        return scratch.keep(rows)

    alike = lambda rows: rows.where(F.col("both") * LEAST[1] >= F.col("union") * LEAST[0]).select("u", "v")
    first = compared(pairs)
    links = scratch.keep(alike(first))
    roots = star_components(links, scratch)
    distance = first.select(F.struct("u", "v").alias("pair"), F.when(F.col("union") > 0, 1 - F.try_divide("both", "union")).otherwise(F.lit(0.0)).alias("far"))
    placed = members.select("band", "key", "n", F.struct(F.col("first.key").alias("u"), F.col("key").alias("v")).alias("pair"))
    placed = placed.join(roots, placed["key"] == roots["u"], "left").select("band", "key", "n", "pair", F.coalesce("root", "key").alias("root")).join(distance, "pair", "left")
    grouped = scratch.keep(placed.select("band", "key", "n", "root", F.when(F.col("pair.u") == F.col("pair.v"), F.lit(0.0)).otherwise(F.col("far")).alias("far")))
    counts = grouped.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    open_ = counts.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("size").alias("size")).where("groups > 1").select("band", "main", "size")
    there = scratch.keep(join_groups(grouped, open_, ["band"], "size", limit, ["key"]))
    shingles = sets.join(there.select("key").distinct(), "key", "left_semi").select("key", F.explode("shingles").alias("s"))
    own = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    there = scratch.keep(there.join(own, "key", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))))
    a = there.where("root <> main").select("band", F.col("key").alias("u"), F.col("n").alias("un"), F.col("root").alias("ur"), F.col("shared").alias("us"), F.col("far").alias("uf"))
    b = there.select("band", F.col("key").alias("v"), F.col("n").alias("vn"), F.col("root").alias("vr"), F.col("shared").alias("vs"), F.col("far").alias("vf"), "main")
    most = F.least("us", "vs")
    possible = most * LEAST[1] >= (F.col("un") + F.col("vn") - most) * LEAST[0]
    in_reach = F.coalesce(F.abs(F.col("uf") - F.col("vf")) <= 1 - LEAST[0] / LEAST[1] + 1e-9, F.lit(True))
    tried = F.coalesce((F.col("uf") == 0) | (F.col("vf") == 0), F.lit(False))  # one of them is the centre
    wanted = (F.col("ur") != F.col("vr")) & ((F.col("vr") == F.col("main")) | (F.col("u") < F.col("v"))) & possible & in_reach & ~tried
    rest = a.join(b, "band").where(wanted).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return links.unionByName(alike(compared(scratch.keep(rest))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all columns: that of the least id, null ids last.

    Rows are told apart by id and text, so ids may repeat; of rows equal in both one stays, by a hash of
    the others' columns. Texts without words are copies of each other. Empty input gives no rows; columns
    may have any names.
    """
    scratch, names = Scratch(docs.sparkSession, "neardup"), docs.columns
    plain = by_place(docs)
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    tag = F.xxhash64(ident, F.col(ident).isNull(), F.col(text).cast("string"))
    rows = plain.withColumn("key", text_key(text)).withColumn("tag", tag)
    keyed = rows.select(F.col(ident).alias("id"), "key", "tag", F.col(text).alias("text"))
    roots = star_components(near_links(keyed.select("key", "text"), "text", scratch), scratch)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "tag")
    least = keyed.groupBy("key").agg(F.min(order).alias("first"))
    kept = least.join(roots, least["key"] == roots["u"], "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    hashed = [f"c{i}" for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    one = W.partitionBy("key", "tag").orderBy(F.xxhash64(*hashed))
    out = rows.join(kept.select("first.key", "first.tag"), ["key", "tag"], "left_semi").withColumn("copy", F.row_number().over(one))
    return out.where("copy = 1").select(*plain.columns).toDF(*names)
