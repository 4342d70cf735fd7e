"""A table of snapshots that grows: days and buckets of hosts, so that the number of files does not follow that of hosts.

A day's bucket gets a file with each append; compact puts those of a day together again. Files that a compaction
replaces are named in a journal before any of them goes, so that one cut short is finished, or undone, by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import exists, names, remove

BUCKETS = 8
FILE_ROWS = 2_000_000
_WORK = "_compacting"


def append(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds rows (host_id, snap_date and others); a day's bucket is one task's, in order of host and, where there is one, of time."""
    order = ["snap_date", "bucket", "host_id", *[c for c in ("ts_ns", "path") if c in rows.columns]]
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("host_id"), F.lit(buckets)).cast("int")).repartition("snap_date", "bucket").sortWithinPartitions(*order)
    spread.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("snap_date", "bucket").mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows, without the bucket; host_id is text. A table without files gives none where the schema is told."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).drop("bucket")


def _files(spark: SparkSession, path: str, day: str) -> list[str]:
    """Data files of a day, below path."""
    buckets = [f"snap_date={day}/{b}" for b in names(spark, f"{path}/snap_date={day}") if b.startswith("bucket=")]
    return [f"{b}/{f}" for b in buckets for f in names(spark, f"{path}/{b}") if f.endswith(".parquet")]


def compact(spark: SparkSession, path: str, day: str, file_rows: int = FILE_ROWS) -> int:
    """Puts a day's files together, a bucket in one as long as it has no more than file_rows rows. Returns how many files went.

    No one else may write or compact that day meanwhile; who reads it meanwhile may fail or see rows twice and must read again.
    """
    recover(spark, path)
    old = _files(spark, path, day)
    if len(old) <= len({f.rpartition("/")[0] for f in old}):
        return 0
    work = f"{path}/{_WORK}"
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{f}" for f in old])
    order = [c for c in ("host_id", "ts_ns", "path") if c in rows.columns]
    spread = rows.drop("snap_date").repartition("bucket").sortWithinPartitions("bucket", *order)
    spread.write.option("maxRecordsPerFile", file_rows).partitionBy("bucket").mode("overwrite").parquet(f"{work}/data/snap_date={day}")
    spark.createDataFrame([(f,) for f in old], "value string").coalesce(1).write.mode("overwrite").text(f"{work}/journal")
    recover(spark, path)
    return len(old)


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a compaction whose journal is whole, and takes back one that had not come so far."""
    work = f"{path}/{_WORK}"
    if exists(spark, f"{work}/journal/_SUCCESS"):
        for r in spark.read.text(f"{work}/journal").collect():  # as many as a day has files
            remove(spark, f"{path}/{r['value']}")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for day in names(spark, f"{work}/data"):
            for f in _files(spark, f"{work}/data", day.partition("=")[2]):
                store.mkdirs(hadoop(f"{path}/{f}").getParent())
                store.rename(hadoop(f"{work}/data/{f}"), hadoop(f"{path}/{f}"))
    remove(spark, work)
