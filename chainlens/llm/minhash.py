"""Operator 6: one-permutation MinHash fingerprints. DataFrame functions alone."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONG_MIN, WORD_GAP, let, literals, longs, range_index, table, weighted_splitters, written

BINS = 128  # a power of two
BITS = 8  # low-order bits kept of each bin
SHINGLE = 5
PROBES = 6


def fingerprint(text: Column) -> Column:
    """The one-permutation MinHash fingerprint of a text's sets of SHINGLE words, as 2 hex digits for each of BINS bins.

    Every shingle is hashed once; the high bits of a hash name its bin, and the least hash of a bin stands for it. An
    empty bin b takes over another bin's value by optimal densification: it looks at bins drawn for b alone, the same
    for all texts, until one is not empty. (After PROBES draws, the bins that are not empty are ranked by a hash of b
    and theirs, which is that search without repeats.) Of each value the BITS low-order bits are kept.

    Texts of fewer words are one shingle; a text without words (null, empty) has the fingerprint ''.
    """
    shift = 64 - int(math.log2(BINS))
    draw = random.Random(20)
    probes = longs([draw.randrange(BINS) for _ in range(BINS * PROBES)])
    digits = F.expr("array(" + ",".join(f"'{i:0{BITS // 4}x}'" for i in range(2**BITS)) + ")")
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")

    def shingles(words: Column) -> Column:
        at = lambda i, k: F.get(words, i + k)
        several = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
        return F.when(F.size(words) >= SHINGLE, several).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def densified(found: Column) -> Column:
        """found: the least hash of each bin that is not empty."""
        nearest = lambda b: F.array_min(F.transform(found, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("rank"), h.alias("h"))))["h"]

        def filled(own: Column) -> Column:
            drawn = lambda b: [F.get(own, F.get(probes, b * PROBES + k).cast("int")) for k in range(PROBES)]
            return F.transform(own, lambda h, b: F.coalesce(h, *drawn(b), nearest(b)))

        own = let(F.transform(found, bin_of), lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(found, F.array_position(bins, b).cast("int") - 1)))
        return F.when(F.size(found) == BINS, _by_bin(found)).otherwise(let(own, filled))

    def _by_bin(found: Column) -> Column:
        """All bins are there, in the order of signed hashes: the upper half of the bins comes first."""
        return F.concat(F.slice(found, BINS // 2 + 1, BINS // 2), F.slice(found, 1, BINS // 2))

    def firsts(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))

    words = F.transform(F.filter(F.split(text, WORD_GAP), lambda w: w != ""), lambda w: F.xxhash64(w))
    packed = lambda found: F.array_join(F.transform(densified(found), lambda h: F.get(digits, h.bitwiseAND(2**BITS - 1).cast("int"))), "")
    body = let(words, lambda w: let(F.sort_array(shingles(w)), lambda s: let(firsts(s), lambda found: F.when(F.size(found) > 0, packed(found)).otherwise(""))))
    return F.coalesce(body, F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles: equal bins, less those that agree by chance at BITS bits, in 0 to 1."""
    n = BITS // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda s, i: s + F.when(F.substring(a, i * n + 1, F.lit(n)) == F.substring(b, i * n + 1, F.lit(n)), 1).otherwise(0))
    chance = 2.0**-BITS
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def with_next(docs: DataFrame, n_ranges: int = 512, bytes_per_range: int = 2**30) -> DataFrame:
    """docs (doc_id, text, fingerprint) with next_text and next_fingerprint: those of the next row by doc_id, the first after the last.

    Rows are ranged by sampled doc_ids and a hash of their texts, so that doc_ids that are null or repeat are no hot key;
    since a range starts at a row that was drawn, that row is also sent, marked, to the end of the range before it, and no
    range needs to see another. Rows of the same doc_id stand in the order of that hash. Null doc_ids come first. Only rows
    that are the same in doc_id and text can't be parted.
    """
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(LONG_MIN + 1)).alias("id"), F.xxhash64("text").alias("h"))
    sizes = written(docs.select(key.alias("key"), F.octet_length("text").cast("long").alias("size")), "sizes")
    total, least = sizes.agg(F.sum(F.col("size") + 8), F.min("key")).first()
    cuts = weighted_splitters(sizes, F.col("key"), F.col("size") + 8, max(n_ranges, math.ceil((total or 0) / bytes_per_range)))
    place = lambda r, later: F.struct(r.cast("int").alias("range"), F.lit(later).alias("later"))
    r, none = F.col("_range"), F.expr("cast(array() as array<struct<range:int,later:int>>)")
    is_cut = (F.col("_key") == F.get(literals(cuts), r - 1)) if cuts else F.lit(False)
    is_least = (F.col("_key") == F.get(literals([least]), F.lit(0))) if least is not None else F.lit(False)
    places = F.concat(F.array(place(r, 0)), F.when(is_cut, F.array(place(r - 1, 1))).otherwise(none), F.when(is_least, F.array(place(F.lit(len(cuts)), 1))).otherwise(none))
    rows = docs.withColumn("_key", key).withColumn("_range", range_index(F.col("_key"), cuts)).withColumn("_place", F.explode(places))
    rows = rows.select("doc_id", "text", "fingerprint", "_key", F.col("_place.range").alias("_range"), F.col("_place.later").alias("_later"))
    order = Window.partitionBy("_range").orderBy("_later", "_key")
    rows = rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    return rows.where("_later = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts. Null text is empty and has the fingerprint ''; equal texts have equal ones.

    Repeated rows each have their own next row; with one document it is its own next one; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
