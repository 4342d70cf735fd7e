"""Verification that goes on where the last one ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verify
from . import ledger, store, versions
from .snapshots import names, remove

MARK = "host_id STRING, verified BIGINT, broken_at BIGINT, last_ns BIGINT, last_path STRING, last_hash STRING"
DIGEST = "host_id STRING, snap_date DATE, n BIGINT, d1 BIGINT, d2 BIGINT"


def unchecked(spark: SparkSession, table: str, marks: DataFrame) -> DataFrame:
    """The narrow columns of the days from the newest verified document on: no file of an older day is read."""
    rows = store.read(spark, table).select("host_id", "ts_ns", "path", "hash", "prev_hash", "snap_date")
    last = marks.agg(F.to_date(F.timestamp_micros(F.expr("max(last_ns) div 1000")))).first()[0]
    return rows if last is None else rows.where(F.col("snap_date") >= F.lit(last))


def check(spark: SparkSession, table: str, state: str, heads: str | None = None) -> DataFrame:
    """Verifies what came to a store (host_id, ts_ns, path, hash, prev_hash) since the last check, and gives MARK of every host.

    Of each host state keeps how far it is verified, and of each of its days a digest of what was there, which costs
    nothing further to add to. heads is the ledger of what was given up, for hosts that were never checked before.
    A document that comes late, before its host's mark and on an older day, is not seen by this but by altered.
    """
    marks = versions.read(spark, f"{state}/marks", MARK)
    anchors = verify.anchors_of(marks, ledger.read(spark, heads) if heads else None)
    rows = verify.after(unchecked(spark, table, marks), anchors)
    number = (versions.numbers(spark, f"{state}/marks") or [-1])[-1] + 1
    verify.day_digests(rows).write.mode("overwrite").parquet(f"{state}/digests/v={number}")
    versions.write(verify.advanced(marks, verify.verdicts(verify.links(rows, anchors))), f"{state}/marks")
    for n in names(spark, f"{state}/digests"):  # of a check that never came to its marks
        if int(n[2:]) > number:
            remove(spark, f"{state}/digests/{n}")
    return versions.read(spark, f"{state}/marks", MARK)


def altered(spark: SparkSession, rows: DataFrame, state: str, heads: str | None = None) -> DataFrame:
    """host_id and snap_date of verified days that are not what they were: rows (narrow columns, from the store or hashed anew
    from documents) against the digests. Days that were given up whole are no loss."""
    marks = versions.read(spark, f"{state}/marks", MARK)
    known = [f"{state}/digests/v={n}" for n in range((versions.numbers(spark, f"{state}/marks") or [-1])[-1] + 1)]
    digests = spark.read.schema(DIGEST).parquet(*known) if known else spark.createDataFrame([], DIGEST)
    return verify.altered(rows, marks, digests, ledger.read(spark, heads) if heads else None)
