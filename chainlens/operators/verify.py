"""Whether a chain of documents can be trusted, and up to where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GENESIS

ORDER = ["ts_ns", "path"]


def links(rows: DataFrame, anchors: DataFrame | None = None, whole: bool = True, by: str = "host_id") -> DataFrame:
    """rows (by, ts_ns, path, hash, prev_hash) with idx from 0 and broken: the link does not hold the hash before it.

    The first must hold the genesis hash, or the one that anchors (by, expected_prev_hash) name where old documents were
    given up; with whole=False (an extract) the first is not looked at. Where anchors also tell the place of the last
    document that was given up (removed_ns, removed_path), what still lies there or before it is no part of the chain. Only these
    narrow columns are sorted.
    """
    order = Window.partitionBy(by).orderBy(*ORDER)
    rows, first = rows.select(by, *ORDER, "hash", "prev_hash"), F.lit(GENESIS)
    if anchors is not None:
        place = [c for c in ("removed_ns", "removed_path") if c in anchors.columns]
        rows = rows.join(anchors.select(by, "expected_prev_hash", *place), by, "left")
        if place:
            rows = rows.where(F.col("removed_ns").isNull() | (F.struct(*ORDER) > F.struct(*place))).drop(*place)
        first = F.coalesce("expected_prev_hash", first)
    rows = rows.withColumn("idx", F.row_number().over(order) - 1).withColumn("_before", F.lag("hash").over(order))
    wrong = F.when(F.col("idx") == 0, F.lit(whole) & ~F.col("prev_hash").eqNullSafe(first)).otherwise(~F.col("prev_hash").eqNullSafe(F.col("_before")))
    return rows.withColumn("broken", wrong).drop("_before", "expected_prev_hash")


def verdicts(linked: DataFrame, by: str = "host_id") -> DataFrame:
    """Of each chain: how many documents, the index of the first broken link (-1: none), first and last time, first and last hash."""
    return linked.groupBy(by).agg(
        F.count("*").alias("total"),
        F.coalesce(F.min(F.when(F.col("broken"), F.col("idx"))), F.lit(-1)).alias("broken_at"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
        F.min_by("hash", "idx").alias("root_hash"),
        F.max_by("hash", "idx").alias("last_hash"),
        F.max_by("path", "idx").alias("last_path"),
    )


def trust(linked: DataFrame, verdict: DataFrame, by: str = "host_id") -> DataFrame:
    """Of each document: intact before the break, suspect the one before the broken link, untrusted from there on."""
    rows = linked.join(verdict.select(by, "broken_at"), by)
    broken = F.col("broken_at")
    status = F.when((broken < 0) | (F.col("idx") < broken - 1), "intact").when(F.col("idx") == broken - 1, "suspect").otherwise("untrusted")
    return rows.withColumn("status", status)


def heads(linked: DataFrame, by: str = "host_id") -> DataFrame:
    """The newest document's hash of each chain."""
    return linked.groupBy(by).agg(F.max_by("hash", F.struct(*ORDER)).alias("head_hash"))


def head_check(verdict: DataFrame, recorded: DataFrame, by: str = "host_id") -> DataFrame:
    """Whether the recorded head (genesis, if there is none) is the last document's hash."""
    rows = verdict.join(recorded.select(by, "head_hash"), by, "left")
    return rows.withColumn("head_ok", F.col("last_hash") == F.coalesce("head_hash", F.lit(GENESIS)))


def anchors_of(marks: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Where each host's next document is to go on, as links takes it: after its mark, or after what was given up if that is later."""
    found = marks.select("host_id", F.col("last_ns").alias("removed_ns"), F.col("last_path").alias("removed_path"), F.col("last_hash").alias("expected_prev_hash"))
    if heads is None:
        return found
    later = F.max_by(F.struct("removed_ns", "removed_path", "expected_prev_hash"), F.struct("removed_ns", "removed_path"))
    return found.unionByName(heads.select(*found.columns)).groupBy("host_id").agg(later.alias("r")).select("host_id", "r.*")


def after(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows that stand after their host's anchor."""
    place = ["removed_ns", "removed_path"]
    found = rows.join(anchors.select("host_id", *place), "host_id", "left")
    return found.where(F.col("removed_ns").isNull() | (F.struct(*ORDER) > F.struct(*place))).drop(*place)


def advanced(marks: DataFrame, found: DataFrame) -> DataFrame:
    """Marks (host_id, verified, broken_at, last_ns, last_path, last_hash) with what verdicts says of the documents after them.

    A chain once broken stays broken where it was first.
    """
    new = found.select("host_id", "total", F.col("broken_at").alias("new_broken"), F.col("last_ns").alias("new_ns"), F.col("last_path").alias("new_path"), F.col("last_hash").alias("new_hash"))
    both, before = marks.join(new, "host_id", "full_outer"), F.coalesce("verified", F.lit(0))
    broken = F.when(F.coalesce("broken_at", F.lit(-1)) >= 0, F.col("broken_at")).when(F.col("new_broken") >= 0, before + F.col("new_broken")).otherwise(-1)
    later = [F.coalesce(f"new_{c}", f"last_{c}").alias(f"last_{c}") for c in ("ns", "path", "hash")]
    return both.select("host_id", (before + F.coalesce("total", F.lit(0))).cast("long").alias("verified"), broken.cast("long").alias("broken_at"), *later)


def day_digests(rows: DataFrame) -> DataFrame:
    """Of each host and day how many documents there are, and two digests of them that don't depend on their order and add up."""
    told = ["path", "hash", "prev_hash"]
    return rows.groupBy("host_id", "snap_date").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*told)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), *told)).alias("d2"))


def altered(rows: DataFrame, marks: DataFrame, digests: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """host_id and snap_date where the rows up to the marks differ from the digests of when they were verified."""
    upto = rows.join(marks.select("host_id", "last_ns", "last_path"), "host_id").where(F.struct(*ORDER) <= F.struct("last_ns", "last_path"))
    now = day_digests(upto).select("host_id", "snap_date", F.struct("n", "d1", "d2").alias("now"))
    then = digests.groupBy("host_id", "snap_date").agg(F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")).select("host_id", "snap_date", F.struct("n", "d1", "d2").alias("then"))
    both = now.join(then, ["host_id", "snap_date"], "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    if heads is not None:
        gone = F.to_date(F.timestamp_micros(F.expr("removed_ns div 1000")))
        both = both.join(heads.select("host_id", gone.alias("gone")), "host_id", "left").where(F.col("now").isNotNull() | F.col("gone").isNull() | (F.col("snap_date") > F.col("gone")))
    return both.select("host_id", "snap_date")


def manifest(rows: DataFrame, by: str = "bundle_id") -> DataFrame:
    """Of each extract: count, first and last time and hash, what the first document says, and the mean gap in whole seconds."""
    order = F.struct(*ORDER)
    told = [c for c in ("hostname", "os", "kernel") if c in rows.columns]
    out = rows.groupBy(by).agg(
        F.count("*").alias("snapshot_count"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
        F.min_by("hash", order).alias("root_hash"),
        F.max_by("hash", order).alias("head_hash"),
        *[F.min_by(c, order).alias(c) for c in told],
    )
    gap = F.expr("(last_ns - first_ns) div (snapshot_count - 1)")
    seconds = F.expr(f"({500_000_000} + (last_ns - first_ns) div (snapshot_count - 1)) div {1_000_000_000}")
    return out.withColumn("mean_gap_s", F.when((F.col("snapshot_count") >= 2) & gap.isNotNull(), seconds))


def bundle_verdicts(rows: DataFrame, manifests: DataFrame, by: str = "bundle_id") -> DataFrame:
    """Of each extract: its links (the first is not looked at) and what in its manifest does not fit ('' if all does)."""
    found = verdicts(links(rows, whole=False, by=by), by)
    both = found.join(manifests.select(by, *[F.col(c).alias(f"m_{c}") for c in ("root_hash", "head_hash", "snapshot_count")]), by, "left")
    said = lambda c: F.coalesce(f"m_{c}", F.lit(""))
    mismatch = (
        F.when(F.col("m_snapshot_count").isNull(), "manifest")
        .when((said("root_hash") != "") & (said("root_hash") != F.col("root_hash")), "root_hash")
        .when((said("head_hash") != "") & (said("head_hash") != F.col("last_hash")), "head_hash")
        .when(F.col("m_snapshot_count") != F.col("total"), "count")
        .otherwise("")
    )
    return both.select(by, "total", "broken_at", mismatch.alias("mismatch"))
