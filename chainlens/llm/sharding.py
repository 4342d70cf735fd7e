"""Operator 2: sampled splitters. DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import longs, range_index, table, weighted_splitters, written


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, ranges_per_shard: int = 32, rows_per_range: int = 2_000_000) -> DataFrame:
    """Puts every row into one of n_shards shards of nearly equal bytes (no further from equal than one row at each end).

    Rows stand in the order of a key whose high bits are the text's CRC-32 and whose low bits are hashed from doc_id, so
    that equal texts are neighbours yet a text that makes up a third of all rows is no hot key. Keys drawn in proportion
    to size give splitters, the splitters give ranges, and ranges found to be overfull are subdivided by another hash of
    doc_id. Bytes and rows before each range then give every row its exact place in the whole order by a running sum
    within its range alone.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot (0, 1, ... within the shard).
    Null text counts as empty; null doc_id is a key like any other; repeated rows each get a slot; an empty table gives
    an empty result; further columns of docs are not looked at. A text larger than a shard's share fills its shard and is
    never cut; only its size and hash travel. Rows equal in doc_id and text can't be told apart, so all of them are one task's.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(rows, "sizes")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    n_ranges = max(n_shards * ranges_per_shard, math.ceil(n / rows_per_range))
    key = F.shiftleft(F.col("text_crc32"), 30).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(2**30 - 1))
    cuts = weighted_splitters(rows, key, F.col("size"), n_ranges)
    ranged = rows.withColumn("key", key).withColumn("range", range_index(F.col("key"), cuts))

    most = 1.5 * total / n_ranges
    parts = [1] * (len(cuts) + 1)
    for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        parts[r["range"]] = max(1, min(r["n"], math.ceil(r["bytes"] / most)))
    first = _before(parts)
    ranged = ranged.withColumn("cell", F.get(longs(first), F.col("range")) + F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.get(longs(parts), F.col("range"))))

    held = {r["cell"]: (r["bytes"], r["n"]) for r in ranged.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    cells = range(sum(parts))
    bytes_before = longs(_before([held.get(c, (0, 0))[0] for c in cells]))
    rows_before = longs(_before([held.get(c, (0, 0))[1] for c in cells]))
    order = Window.partitionBy("cell").orderBy("key", "doc_id", "size")
    before = F.get(bytes_before, F.col("cell")) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranged.select("doc_id", "size", "text_crc32", before.alias("before"), (F.get(rows_before, F.col("cell")) + F.row_number().over(order) - 1).alias("place"))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((2 * F.col("before") + F.col("size")) * n_shards / F.lit(2.0 * total))).cast("int"))
    placed = written(placed.drop("before"), "places")

    starts = {r["shard"]: r["place"] for r in placed.groupBy("shard").agg(F.min("place").alias("place")).collect()}
    start = F.get(longs([starts.get(s, 0) for s in range(n_shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"))


def _before(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        out.append(total)
        total += v
    return out


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
