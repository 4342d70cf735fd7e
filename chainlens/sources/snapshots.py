"""Where snapshots, rules and raw files come from and go to."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canon import document_hash
from ..functions.text import nanoseconds
from ..operators import rules, verify
from ..operators.entities import columns_of
from ..schema import RULE, SNAPSHOT


_ALWAYS = ("schema_version", "version", "snapshot_id", "timestamp", "prev_hash", "host", "collector_errors")
BUNDLE_BUCKETS = 16
FILES = 500  # documents that one task writes as files


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file in whatever store it is; nothing, where it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing, where it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


def _file_path() -> Column:
    """A file's path as it is named, without the escapes of its address."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _named(path: Column, name: str) -> Column:
    """The value of a folder name=value, as Spark writes them."""
    return F.url_decode(F.replace(F.regexp_extract(path, f"/{name}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """All JSON files below root: host_id, path, raw. Each file is one row, whatever it holds.

    The host is in the path: <host>/chain/<date>/<file> or host_id=<host>/.../<file>.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = _file_path()
    host = F.when(path.rlike("/host_id=[^/]*/"), _named(path, "host_id")).otherwise(F.regexp_extract(path, "([^/]+)/chain/[^/]+/[^/]+$", 1))
    return files.select(host.alias("host_id"), path.alias("path"), F.col("value").alias("raw"))


def write_documents(rows: DataFrame, root: str) -> None:
    """Rows as JSON files, one each, below root in a folder for each host (host_id=<host>), as read_documents finds them.

    What takes time is not their size but their number, so that decides how many tasks there are, and each task moves its
    own files to their places.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // FILES + 1)
    placed = rows.repartition(parts, "host_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    placed.option("maxRecordsPerFile", 1).partitionBy("host_id").mode("append").json(root)


def read_raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Texts taken from hosts, one row a file: host_id, ts, path (on the host), content.

    They lie as <host>/<ts>/raw/<path>, or as host_id=<host>/ts=<ts>/path=<path, escaped>/<file>. Many at once are better
    packed, see write_raw_files. Files outside these layouts are reported by stray_raw_files.
    """
    rows = _placed(spark, root)
    return rows.where(F.col("ts").isNotNull()).select("host_id", "ts", "path", "content")


def stray_raw_files(spark: SparkSession, root: str) -> DataFrame:
    """file: those below root of which no host, time and path can be told. They are reported, never just dropped."""
    return _placed(spark, root).where(F.col("ts").isNull()).select("file")


def _placed(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path, plain = _file_path(), "([^/]+)/([0-9]+)/raw(/.*)$"
    hive = path.rlike("/host_id=[^/]*/ts=[0-9]+/path=[^/]*/")
    part = lambda name, k: F.when(hive, _named(path, name)).otherwise(F.regexp_extract(path, plain, k))
    return files.select(path.alias("file"), part("host_id", 1).alias("host_id"), part("ts", 2).try_cast("bigint").alias("ts"), part("path", 3).alias("path"), F.col("value").alias("content"))


def write_raw_files(files: DataFrame, root: str) -> None:
    """Raw files (host_id, ts, path, content) as one table, in as many files as its rows come in, not one for each of theirs."""
    files.select("host_id", F.col("ts").cast("long").alias("ts"), "path", "content").write.mode("append").parquet(root)


def read_packed_files(spark: SparkSession, root: str) -> DataFrame:
    """What write_raw_files wrote."""
    return spark.read.schema("host_id string, ts long, path string, content string").parquet(root)


def readable() -> Column:
    """Whether raw is a JSON object with a time."""
    return document_hash(F.col("raw")).isNotNull() & F.get_json_object("raw", "$.timestamp").isNotNull()


def checked(documents: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """All documents, typed, with ts, ts_ns and the hash of what the file says; fit tells which are JSON objects with a time.

    A document is parsed once for its hash and once for its columns, whatever is asked of it later; with sections only
    the columns that these need are read.
    """
    every = StructType.fromDDL(SNAPSHOT)
    wanted = columns_of(sections)
    shape = StructType([c for c in every if wanted is None or c.name in (*_ALWAYS, *wanted)])
    # From an array of one, so that no filter on what comes out is pushed below to work it out again.
    once = F.struct("hash", F.from_json("raw", shape).alias("doc"))
    rows = documents.select("host_id", "path", "raw", document_hash(F.col("raw")).alias("hash")).select("host_id", "path", "raw", F.inline(F.array(once)).alias("hash", "doc")).select("host_id", "path", "raw", "hash", "doc.*")
    rows = rows.withColumn("fit", F.col("hash").isNotNull() & F.col("timestamp").isNotNull())
    rows = rows.withColumn("ts_ns", F.when(F.col("fit"), nanoseconds(F.col("timestamp"))))
    return rows.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withColumn("snap_date", F.to_date("ts"))


def corrupt(documents: DataFrame) -> DataFrame:
    """Files that are no JSON object with a time: host_id, path. They are reported, never just dropped."""
    return documents.where(~F.coalesce(readable(), F.lit(False))).select("host_id", "path")


def snapshots(documents: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """The readable documents, as checked gives them."""
    return checked(documents, sections).where("fit").drop("fit")


def write_bundles(rows: DataFrame, manifests: DataFrame, path: str) -> None:
    """Extracts and their manifests as two tables below path, read back and verified. Extracts lie in buckets, however many there are.

    If a link of an extract is broken or a manifest does not fit, both tables are removed again and a ValueError names
    some of the extracts.
    """
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("bundle_id"), F.lit(BUNDLE_BUCKETS)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "bundle_id", *verify.ORDER)
    spread.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/snapshots")
    manifests.write.mode("overwrite").parquet(f"{path}/manifests")
    found = verify.bundle_verdicts(*read_bundles(rows.sparkSession, path))
    bad = found.where("broken_at >= 0 or mismatch <> ''").orderBy("bundle_id").limit(20).collect()
    if bad:
        remove(rows.sparkSession, path)
        raise ValueError("not written, since these do not verify: " + ", ".join(f"{r['bundle_id']} ({r['mismatch'] or 'link ' + str(r['broken_at'])})" for r in bad))


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    manifests = spark.read.parquet(f"{path}/manifests")
    return spark.read.parquet(f"{path}/snapshots").drop("bucket"), manifests


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar.gz extracts: bundle_id (the archive), path, content, of chain documents and manifests alone.

    An archive is one task's row, as its members can't be reached but one after the other.
    """
    files = spark.read.format("binaryFile").load(path, pathGlobFilter="*.tar.gz").select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                    for m in archive:
                        if m.isfile() and (m.name.endswith("/manifest.json") or "/chain/" in m.name and m.name.endswith(".json")):
                            found.append((name, m.name, archive.extractfile(m).read().decode("utf-8", "replace")))
                yield pd.DataFrame(found, columns=["bundle_id", "path", "content"])

    return files.mapInPandas(members, "bundle_id string, path string, content string")


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, times in UTC."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def alerts(changes: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """One payload for each pair with a material change: host, timestamp, counts and the changes.

    hosts has host_id, pair_seq, hostname, ts; without it the changes have hostname and ts themselves.
    """
    row = F.struct("section", "type", "key", "old_value", "new_value", "counter")
    known = [] if hosts is not None else ["hostname", "ts"]
    found = changes.groupBy("host_id", "pair_seq", *known).agg(F.count_if(~F.col("counter")).alias("material"), F.count_if("counter").alias("counters"), F.array_sort(F.collect_list(row)).alias("changes")).where("material > 0")
    if hosts is not None:
        found = found.join(hosts, ["host_id", "pair_seq"])
    payload = F.struct(F.col("hostname").alias("host"), F.col("ts").alias("timestamp"), "material", "counters", "changes")
    return found.select("host_id", "pair_seq", F.to_json(payload).alias("payload"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The default rules with those of a JSON file (an array) in their place or after them, in the file's order.

    A file that is not there leaves the defaults as they are; one that is no such array fails.
    """
    defaults = rules.default_rules(spark)
    if not exists(spark, path):
        return defaults
    file = spark.read.text(path, wholetext=True).select(F.from_json("value", _RULES, {"mode": "FAILFAST"}).alias("r"))
    own = file.select(F.posexplode("r").alias("ord", "rule")).select("rule.*", F.col("ord").cast("int").alias("ord")).fillna({"pro": False})
    return rules.overridden(defaults, own.select(*defaults.columns))


_RULES = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in (x.split() for x in RULE.split(", "))) + ">>"


def write_rules(table: DataFrame, path: str) -> None:
    """A rules file below path of a table of rules, in their order."""
    names = [c for c in table.columns if c != "ord"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*names).alias("rule")))), lambda x: x["rule"])
    table.agg(F.to_json(listed).alias("value")).write.mode("overwrite").text(path)
