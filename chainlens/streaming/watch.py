"""Snapshots as they arrive: appended, compared with the one before, and told of."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import diff, history
from ..schema import GENESIS
from ..sources import ledger
from ..sources.snapshots import exists, names, remove

BUCKETS = 64


def archive(stream: DataFrame, path: str, checkpoint: str, partitions: list[str]) -> DataStreamWriter:
    """Each micro-batch appended to a table; the checkpoint makes a retry write nothing twice."""
    return stream.writeStream.format("parquet").outputMode("append").partitionBy(*partitions).option("path", path).option("checkpointLocation", checkpoint)


def retain(spark: SparkSession, table: str, heads: str, days: int, now: str, day: str = "snap_date") -> int:
    """Gives up the days of a table (partitioned by day; host_id, ts_ns, path, hash) that are older than so many days before now.

    No document is rewritten: of each host the newest document that goes is entered in the ledger at heads first, then
    whole day folders are removed. So a host of which nothing is left, or whose next document comes later, still has its
    anchor, and a failure in between leaves documents that the ledger already counts as gone; the next call removes them.
    Documents of such days that come later go too, and change no anchor. Returns how many days went.
    """
    if not days:
        return 0
    limit = datetime.fromisoformat(now) - timedelta(days=days)
    there = {n.partition("=")[2]: f"{table}/{n}" for n in names(spark, table) if n.startswith(f"{day}=")}
    old = [path for d, path in there.items() if d[:1].isdigit() and datetime.fromisoformat(d) + timedelta(days=1) <= limit]
    if old:
        ledger.add(spark, heads, history.removed_heads(spark.read.option("basePath", table).parquet(*old)))
    for path in old:
        remove(spark, path)
    return len(old)


class _State:
    """What is known of each host, in buckets of a hash of host_id.

    A micro-batch writes only the buckets that it touches, below v=<its number>, and a list of each bucket's number. It
    reads the list before its own, so a repeated batch does the same again; what neither this list nor the one before
    names is removed.
    """

    def __init__(self, spark: SparkSession, root: str, number: int) -> None:
        self.spark, self.root, self.number = spark, root, number
        self.before = self._list(number - 1) if number > 0 else {}

    def _list(self, number: int) -> dict[int, int]:
        path = f"{self.root}/list/{number}"
        if not exists(self.spark, path):
            raise FileNotFoundError(f"the state of micro-batch {number} is gone from {path}; nothing is compared with nothing")
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(path).collect()}

    def read(self, kind: str, touched: list[int], like: DataFrame) -> DataFrame:
        """Of the touched buckets what was known before this batch; like tells the columns."""
        wanted: dict[int, set[str]] = {}
        for b in touched:
            if b in self.before:
                wanted.setdefault(self.before[b], set()).add(f"bucket={b}")
        paths = [f"{self.root}/{kind}/v={v}/{b}" for v, bs in sorted(wanted.items()) for b in names(self.spark, f"{self.root}/{kind}/v={v}") if b in bs]
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def write(self, kind: str, rows: DataFrame) -> None:
        rows.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}/v={self.number}")

    def once(self, kind: str, rows: DataFrame) -> DataFrame:
        """Rows as a table of this batch, in place of working them out for each use; gone with the batch after next."""
        path = f"{self.root}/{kind}/v={self.number}"
        rows.write.mode("overwrite").parquet(path)
        remove(self.spark, f"{self.root}/{kind}/v={self.number - 2}")
        return self.spark.read.schema(rows.schema).parquet(path)

    def close(self, touched: list[int]) -> None:
        now = self.before | dict.fromkeys(touched, self.number)
        self.spark.createDataFrame([*now.items()] or [], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/list/{self.number}")
        known = self.number > 1 and exists(self.spark, f"{self.root}/list/{self.number - 2}")
        for b, older in (self._list(self.number - 2) if known else {}).items():
            if older != self.before.get(b):
                for kind in ("heads", "entities", "parked"):
                    remove(self.spark, f"{self.root}/{kind}/v={older}/bucket={b}")
        remove(self.spark, f"{self.root}/list/{self.number - 3}")


def bucket(host: str = "host_id") -> Column:
    return F.pmod(F.xxhash64(host), F.lit(BUCKETS)).cast("int")


def watch(
    stream: DataFrame,
    entities_of: Callable[[DataFrame], DataFrame],
    state: str,
    sink: Callable[[DataFrame, DataFrame, int], None],
    checkpoint: str,
    follow_hashes: bool = False,
    ignore_counters: bool = False,
    read: Callable[[DataFrame], DataFrame] | None = None,
    readable: Column | None = None,
    dead_letters: str | None = None,
    after: Callable[[int], None] | None = None,
    park_ns: int | None = None,
    alert: Callable[[DataFrame, DataFrame, int], None] | None = None,
) -> DataStreamWriter:
    """Compares each arriving snapshot (host_id, ts_ns, path, ...) with its host's last one, by the batch operators.

    read makes snapshots of a batch, once for all uses of them. What can't be read (rows for which readable, over what read
    gives, is not true) goes to the folder dead_letters as it came, one folder a micro-batch, and the batch goes on without it. state holds every host's last snapshot's entities
    and number in buckets, of which a micro-batch writes those of its own hosts; a repeated batch starts from the same
    state again. If the state of the batch before is gone, the batch fails: its hosts would all seem new. Within a batch
    snapshots go in time order, ties by path. With follow_hashes a document whose prev_hash is not the hash before it goes
    to breaks instead, with all of its host's after it, and does not move the state on; given again in a later batch with
    what was missing before it, it is looked at anew. sink(changes, breaks, batch) gets the changes of pairs that have a
    material one, or, unless ignore_counters, any; breaks is empty without follow_hashes. after(batch) is called at last
    (retention, see retain).

    With park_ns (and follow_hashes) a document whose link is not there yet is parked with those after it, and let in when
    what is missing comes, so batches may come in any order; what is older than its host's newest document by more than park_ns
    goes to breaks. A document (host_id, path) that is given twice while it is parked counts once.

    alert(changes, hosts, batch) gets the same changes with host_id, pair_seq, hostname and ts of their pairs (see outbox).
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = (read(batch) if read else batch).persist()
        held = [rows]
        try:
            if readable is not None:
                fit = F.coalesce(readable, F.lit(False))
                if dead_letters:
                    rows.where(~fit).select(*batch.columns).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
                rows = rows.where(fit)
            touched = sorted(r[0] for r in rows.select(bucket()).distinct().collect())
            known = _State(spark, state, number)
            if park_ns is not None:
                rows = rows.unionByName(known.read("parked", touched, rows)).dropDuplicates(["host_id", "path"])
            hashes = F.col("hash") if "hash" in rows.columns else F.lit("")
            heads = known.read("heads", touched, rows.select("host_id", F.lit(0).cast("long").alias("seq"), hashes.alias("hash")))
            numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("host_id").orderBy("ts_ns", "path")))
            rows = numbered.join(heads.select("host_id", F.col("seq").alias("head_seq"), F.col("hash").alias("head_hash")), "host_id", "left")
            breaks = rows.limit(0)
            if follow_hashes:
                before = F.coalesce(F.lag("hash").over(Window.partitionBy("host_id").orderBy("n")), "head_hash", F.lit(GENESIS))
                # Everything of a host from its first wrong link on waits for a look.
                wrong = F.max((F.col("prev_hash") != F.col("_before")).cast("int")).over(Window.partitionBy("host_id").orderBy("n"))
                rows = rows.withColumn("_before", before).withColumn("_wrong", wrong)
                rows = rows.persist()
                held.append(rows)
                breaks, rows = rows.where("_wrong = 1").drop("_before", "_wrong"), rows.where("_wrong = 0").drop("_before", "_wrong")
                if park_ns is not None:
                    newest = F.max("ts_ns").over(Window.partitionBy("host_id"))
                    waits = breaks.withColumn("_waits", F.col("ts_ns") >= newest - park_ns).drop("n", "head_seq", "head_hash")
                    known.write("parked", waits.where("_waits").drop("_waits"))
                    breaks = waits.where("not _waits").drop("_waits")
            rows = rows.withColumn("seq", F.coalesce(F.col("head_seq") + F.col("n"), F.col("n") - 1).cast("long")).persist()
            held.append(rows)
            # Written once: the sink, the counts and the state all read them again.
            new = known.once("new", entities_of(rows))
            last = known.read("entities", touched, new)
            every = last.unionByName(new)
            # A host's snapshots of a batch follow each other, so their first and last number tell its pairs.
            newest = rows.groupBy("host_id").agg(F.min("seq").alias("first"), F.max("seq").alias("seq"), F.max_by(hashes, "seq").alias("hash"))
            bounds = newest.select("host_id", F.greatest("first", F.lit(1)).alias("first"), F.col("seq").alias("last"))
            found = diff.arriving(every, bounds)
            # Every pair that has a row here has a change of some kind.
            chosen = known.once("changes", diff.with_material(found) if ignore_counters else found)
            sink(chosen, breaks, number)
            if alert:
                named = F.col("host.hostname") if "host" in rows.columns else F.col("host_id")
                alert(chosen, rows.where("seq > 0").select("host_id", F.col("seq").alias("pair_seq"), named.alias("hostname"), F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts")), number)
            newest = newest.drop("first")
            known.write("heads", heads.join(newest, "host_id", "left_anti").unionByName(newest))
            last = F.col("last")
            known.write("entities", every.where("host_id is not null").join(bounds, "host_id", "left").where(last.isNull() | (F.col("seq") == last)).select(*every.columns))
            known.close(touched)
            if after:
                after(number)
        finally:
            for df in held:
                df.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
