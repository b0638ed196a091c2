"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band. Its lower edge is a share ``p``
of all documents, so at most (mean distinct terms of a document) / p terms can lie in it, however
large the corpus; it is broadcast if a count confirms that, and shuffled otherwise.
A fingerprint is the list of hashes of the sorted distinct lexicon terms under several random subsets
of the lexicon. Document frequencies are counted with map-side combination over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorikeet.llm.common import Scratch, table

#: A term is kept if its share of all documents is in this band (idf between about 1.2 and 6.9 nats).
BAND = (0.001, 0.3)
MIN_DOCS = 2
#: Share of the lexicon that each random subset keeps, as 1 / 2**bits.
SUBSET_BITS = (1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 6, 6, 6, 6)
MARK = 0  # stands in the lexicon so that texts without terms of it keep their row
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
MAX_LEXICON = 4_000_000
DOCS_A_BLOCK = 4000
#: Quantiles that are taken of the ids; between two of them blocks are equal steps of the id.
QUANTILES, COARSE = 4096, 64


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct lower-case terms."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""), lambda t: F.xxhash64(t)))


def terms_and_all(text: Column) -> Column:
    """A text's distinct term hashes and the hash of all of them; split just once."""
    return F.element_at(F.transform(F.array(term_hashes(text)), lambda k: F.struct(k.alias("terms"), F.xxhash64(F.sort_array(k), F.lit("all")).alias("all"))), 1)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``h``: hashes of the terms whose document frequency is in the band, and MARK."""
    total = docs.count()
    frequency = docs.select(F.explode(term_hashes(F.col("__t"))).alias("h")).groupBy("h").count()
    low, high = max(MIN_DOCS, int(band[0] * total)), band[1] * total
    return frequency.where(F.col("count").between(low, max(high, low)) & (F.col("h") != MARK)).select("h").union(docs.sparkSession.range(1).select(F.lit(MARK).alias("h")))


def subset_hashes(kept: Column, everything: Column) -> Column:
    """A hash per random subset of the lexicon over the sorted terms that it keeps; ``everything`` if it keeps none."""

    def one(k: Column, i: int, bits: int) -> Column:
        some = F.filter(k, lambda h: F.shiftrightunsigned(F.xxhash64(h, F.lit(i)), 64 - bits) == 0)
        return F.when(F.size(some) > 0, F.xxhash64(some)).otherwise(everything)

    # a one-element array makes the kept terms a lambda variable, which is evaluated once
    return F.flatten(F.transform(F.array(F.sort_array(kept)), lambda k: F.array(*[one(k, i, bits) for i, bits in enumerate(SUBSET_BITS)])))


def fingerprint_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(len(SUBSET_BITS)))


def in_blocks(docs: DataFrame, id_col: str) -> DataFrame:
    """Adds ``__block``, which rises with the id; a block has about DOCS_A_BLOCK rows, however many there are.

    Up to QUANTILES - 1 approximate quantiles cut the ids; where that makes more than DOCS_A_BLOCK rows, each
    stretch between two is cut again into equal steps of the id. Null ids are in the first block.
    """
    blocks = docs.count() // DOCS_A_BLOCK + 1
    if blocks == 1:
        return docs.withColumn("__block", F.lit(0).cast("long"))
    coarse = min(blocks, QUANTILES)
    steps = -(-blocks // coarse)
    found = docs.approxQuantile(id_col, [i / coarse for i in range(coarse + 1)], min(0.01, 0.2 / coarse))
    cuts = sorted(set(map(int, found)))  # with the least and the greatest id
    if len(cuts) < 2:
        return docs.withColumn("__block", F.lit(0).cast("long"))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(cuts[0]))
    inner = cuts[1:-1]
    groups = [inner[i : i + COARSE] for i in range(0, len(inner), COARSE)]
    below = lambda array: F.size(F.filter(array, lambda s: s <= own))
    if len(groups) <= 1:
        place = below(F.lit(inner)) if inner else F.lit(0)
    else:
        group = F.greatest(below(F.lit([g[0] for g in groups])), F.lit(1))
        place = (group - 1) * COARSE + below(F.element_at(F.array(*[F.lit(g) for g in groups]), group))
    place = place.cast("long")
    if steps == 1:
        return docs.withColumn("__block", place)
    placed = docs.withColumn("__place", place)
    low, high = (F.element_at(F.lit(cuts), (F.col("__place") + i).cast("int")).cast("double") for i in (1, 2))
    step = F.floor((own.cast("double") - low) * steps / F.greatest(high - low, F.lit(1.0)))
    return placed.withColumn("__block", F.col("__place") * steps + F.least(F.greatest(step, F.lit(0)), F.lit(steps - 1))).drop("__place")


def with_heads(rows: DataFrame) -> DataFrame:
    """Rows (``__block, __id, __t``) with ``__rn``, their place in the block by descending id, and ``next_t``.

    Each block also gets the first row of the block that follows it (the last one gets the first row of
    all), marked ``__halo``: so a task that sorts a block knows the next text of all its rows.
    """
    over_all = W.orderBy("__block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = rows.groupBy("__block").agg(F.max("__id").alias("__first"))
    # Blocks of high ids come first, so a block's head goes to the next higher block; the top one's to the lowest.
    heads = heads.select(F.col("__block").alias("__b"), "__first", F.coalesce(F.lead("__block").over(W.orderBy("__block")), F.min("__block").over(over_all)).alias("__to"))
    first = rows.join(F.broadcast(heads), (rows["__block"] == heads["__b"]) & rows["__id"].eqNullSafe(heads["__first"]))
    first = first.groupBy("__to").agg(F.min("__t").alias("__t"))
    first = first.select(F.col("__to").alias("__block"), F.lit(None).cast(rows.schema["__id"].dataType).alias("__id"), "__t", F.lit(1).alias("__halo"))
    w = W.partitionBy("__block").orderBy("__halo", F.col("__id").desc_nulls_last(), "__t")
    return rows.select("__block", "__id", "__t", F.lit(0).alias("__halo")).unionByName(first).select("*", F.row_number().over(w).alias("__rn"), F.coalesce(F.lead("__t").over(w), F.lit("")).alias("next_t"))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each text, and of its edited text, with their likenesses.

    Ids are numbers. Null text counts as empty. A text without lexicon terms is fingerprinted over all its terms; texts
    without terms agree with each other. Rows with equal ids follow each other by text. A single row is
    its own next one. Empty input gives no rows. Other columns are ignored.

    Texts are shuffled once, by block. The terms of a block's texts are then joined to the broadcast
    lexicon, gathered per text and hashed without leaving their task.
    """
    scratch = Scratch(docs.sparkSession, "imatch")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__t"))
    lex = scratch.keep(lexicon(rows, band))
    if lex.count() <= MAX_LEXICON:
        lex = F.broadcast(lex)
    n = F.length("__t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("__t", F.lit(1), n - half), F.substr("next_t", F.lit(1), half))
    texts = with_heads(in_blocks(rows, "__id")).select("__block", "__rn", "__halo", "__id", "__t", n.cast("long").alias("n_chars"), edited.alias("__e"))
    texts = texts.select("*", F.sha2("__e", 256).alias("edited_sha256"), terms_and_all(F.col("__t")).alias("__x"), terms_and_all(F.col("__e")).alias("__ex"))
    # What the key holds is computed before the terms are exploded, once per text.
    texts = texts.withColumn("__all", F.col("__x.all")).withColumn("__eall", F.col("__ex.all"))
    marked = lambda terms, which: F.transform(F.concat(F.array(F.lit(MARK)), F.col(terms)), lambda h: F.struct(F.lit(which).alias("which"), h.alias("h")))
    key = ["__block", "__rn", "__halo", "__id", "n_chars", "edited_sha256", "__all", "__eall"]
    exploded = texts.select(*key, F.explode(F.concat(marked("__x.terms", 0), marked("__ex.terms", 1))).alias("x")).select(*key, "x.which", "x.h")
    real = F.col("h") != MARK
    kept = exploded.join(lex, "h").groupBy(*key).agg(F.collect_list(F.when(real & (F.col("which") == 0), F.col("h"))).alias("__k"), F.collect_list(F.when(real & (F.col("which") == 1), F.col("h"))).alias("__ek"))
    prints = kept.select(*key[:-2], subset_hashes(F.col("__k"), F.col("__all")).alias("__fp"), subset_hashes(F.col("__ek"), F.col("__eall")).alias("__efp"))
    out = prints.withColumn("__next", F.lead("__fp").over(W.partitionBy("__block").orderBy("__rn"))).where("__halo = 0")
    return out.select(
        F.col("__id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("__fp")).alias("fingerprint"),
        fingerprint_text(F.col("__efp")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__efp")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("__next")).alias("near_next"),
    )


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))
