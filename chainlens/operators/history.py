"""Chains as history: what happened when, how to name a point of it, and what is kept of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_days


def sequenced(snapshots: DataFrame) -> DataFrame:
    """snapshots with seq, each host's place in time from 0; equal times stand in the order of their paths."""
    return snapshots.withColumn("seq", F.row_number().over(Window.partitionBy("host_id").orderBy("ts_ns", "path")) - 1)


def history(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each snapshot (host_id, seq, ts, hash) with its changes against the one before, and whether it is first or last.

    Counted over the whole chain, so that a later selection of days (select_days) changes no row.
    """
    last = F.max("seq").over(Window.partitionBy("host_id"))
    out = rows.join(counts.withColumnRenamed("pair_seq", "seq"), ["host_id", "seq"], "left").fillna(0, ["material", "counters"])
    return out.withColumn("is_genesis", F.col("seq") == 0).withColumn("is_head", F.col("seq") == last)


def select_days(rows: DataFrame, since: str | None = None, until: str | None = None, zone: str = "UTC") -> DataFrame:
    return rows.where(in_days(F.col("ts"), since, until, zone))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("host_id", F.desc("seq"))


def resolve(rows: DataFrame, ref: str) -> DataFrame:
    """The snapshot of each host that ref names: HEAD, HEAD~n, or the start of a hash; a host where it names none, or several, has no row."""
    if m := re.fullmatch(r"HEAD(?:~(\d*))?", ref):
        n = int(m[1] or 0)
        newest = F.row_number().over(Window.partitionBy("host_id").orderBy(F.desc("seq")))
        return rows.withColumn("_n", newest).where(F.col("_n") == n + 1).drop("_n")
    found = rows.where(F.startswith("hash", F.lit(ref.lower())))
    once = found.groupBy("host_id").count().where("count = 1").select("host_id")
    return found.join(once, "host_id", "left_semi")


def resolve_all(index: DataFrame, refs: DataFrame) -> DataFrame:
    """Many refs at once: ref_id, status, candidates, host_id, seq, hash of refs (ref_id, host_id, ref) by an index (host_id, seq, hash).

    HEAD and HEAD~n are places counted from each host's end; anything else is the start of a hash. Index and refs are dealt by
    host once, narrow as they are, and meet there in sorted order: a start is two places among the host's hashes, between which
    its candidates lie, so even one of many candidates costs as much as any other. status is found, none, or ambiguous;
    candidates says how many there were, and seq and hash are empty unless it was one.
    """
    back = F.when(F.col("ref") == "HEAD", F.lit(0)).otherwise(F.coalesce(F.nullif(F.regexp_extract("ref", r"^HEAD~([0-9]*)$", 1), F.lit("")).try_cast("long"), F.lit(0)))
    place = F.col("ref").rlike(r"^HEAD(~[0-9]*)?$")
    asked = refs.select("ref_id", "host_id", place.alias("place"), back.cast("long").alias("back"), F.when(~place, F.nullif(F.lower(F.trim("ref")), F.lit(""))).alias("start"), F.lit(False).alias("known"))
    every = asked.unionByName(index.where("host_id is not null").select("host_id", F.col("seq").cast("long").alias("seq"), "hash", F.lit(True).alias("known")), allowMissingColumns=True).repartition("host_id")
    every = every.withColumn("at", F.when(F.col("known"), F.col("seq")).when(F.col("place"), F.max("seq").over(Window.partitionBy("host_id")) - F.col("back")))
    there = Window.partitionBy("host_id", "at")
    every = every.withColumn("n_at", F.count_if("known").over(there)).withColumn("hash_at", F.min("hash").over(there))
    mark = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("kind"))
    after = F.concat("start", F.lit(chr(0x10FFFF)))
    marks = F.when(F.col("start").isNotNull(), F.array(mark(F.col("start"), 0), mark(after, 2))).otherwise(F.array(mark(F.col("hash"), 1)))
    upto = Window.partitionBy("host_id").orderBy("text", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hashed = F.col("known") & F.col("hash").isNotNull()
    every = every.select("*", F.inline(marks)).withColumn("n", F.count_if(hashed).over(upto)).withColumn("before", F.last(F.when(hashed, F.struct("seq", "hash")), ignorenulls=True).over(upto))
    found = every.where("not known").groupBy("ref_id", "host_id").agg(
        F.max(F.struct("place", "n_at", "at", "hash_at")).alias("p"), (F.max("n") - F.min("n")).alias("n"), F.max_by("before", "kind").alias("s")
    )
    by_place = F.coalesce("p.place", F.lit(False))
    found = found.select("ref_id", "host_id", F.when(by_place, F.col("p.n_at")).otherwise(F.col("n")).alias("candidates"), F.when(by_place, F.col("p.at")).otherwise(F.col("s.seq")).alias("seq"), F.when(by_place, F.col("p.hash_at")).otherwise(F.col("s.hash")).alias("hash"))
    one = lambda c: F.when(F.col("candidates") == 1, F.col(c)).alias(c)
    status = F.when(F.col("candidates") == 0, "none").when(F.col("candidates") == 1, "found").otherwise("ambiguous")
    return found.select("ref_id", "host_id", status.alias("status"), "candidates", one("seq"), one("hash"))


def extracts(rows: DataFrame, requests: DataFrame, width_days: int = 7) -> DataFrame:
    """Many extracts in one go: rows (host_id, ts_ns and others) with bundle_id, for each request (bundle_id, host_id, from_ns, to_ns;
    to_ns itself is not in it) that they fall into. Ranges may overlap.

    Ranges are dealt to stretches of so many days, where they meet the rows by host and stretch.
    """
    width = width_days * 86_400 * 1_000_000_000
    stretch = lambda c: F.expr(f"cast(floor({c} / {width}D) as long)")
    dealt = requests.where("to_ns > from_ns").withColumn("stretch", F.explode(F.sequence(stretch("from_ns"), stretch("to_ns"))))
    met = rows.withColumn("stretch", stretch("ts_ns")).join(dealt, ["host_id", "stretch"])
    return met.where("ts_ns >= from_ns and ts_ns < to_ns").drop("stretch", "from_ns", "to_ns")


def retained(rows: DataFrame, days: int, now: str) -> tuple[DataFrame, DataFrame]:
    """rows (host_id, ts, ts_ns, path, hash, prev_hash) not older than so many days before now (0: all), and the anchors of what is left.

    No document is rewritten: an anchor says which hash the first kept document's link must hold, and verify.links
    takes it in place of the genesis hash.
    """
    kept = rows if days == 0 else rows.where(F.col("ts") >= F.expr(f"timestamp'{now}' - interval {int(days)} days"))
    order = F.struct("ts_ns", "path")
    anchors = kept.groupBy("host_id").agg(F.min_by("path", order).alias("first_kept_path"), F.min_by("prev_hash", order).alias("expected_prev_hash"))
    return kept, anchors


def removed_heads(rows: DataFrame) -> DataFrame:
    """Of each host the newest of rows (host_id, ts_ns, path, hash) that are given up: where it stood, and its hash, which is
    what the first document after it must hold."""
    place = F.struct("ts_ns", "path")
    found = rows.groupBy("host_id").agg(F.max(place).alias("at"), F.max_by("hash", place).alias("expected_prev_hash"))
    return found.select("host_id", F.col("at.ts_ns").alias("removed_ns"), F.col("at.path").alias("removed_path"), "expected_prev_hash")


def merged_heads(one: DataFrame, other: DataFrame) -> DataFrame:
    """The later of two removed heads of a host; what is already in stays whatever is removed with it or after."""
    place = F.struct("removed_ns", "removed_path")
    found = one.unionByName(other).groupBy("host_id").agg(F.max_by(F.struct("removed_ns", "removed_path", "expected_prev_hash"), place).alias("r"))
    return found.select("host_id", "r.*")


def retention_summary(rows: DataFrame, days: int, now: str) -> DataFrame:
    old = F.lit(False) if days == 0 else F.col("ts") < F.expr(f"timestamp'{now}' - interval {int(days)} days")
    return rows.groupBy("host_id").agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("remaining"))
