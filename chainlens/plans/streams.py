"""The streaming operators over the driver's tables: what they give is what the batch operators give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import entities, verify
from ..schema import GENESIS
from ..sources import ledger
from ..sources import snapshots as source
from ..streaming import cadence, watch
from .fleet import documents
from .queries import query, scratch, table


def _arriving(rows: DataFrame, parts: list[Column], folder: str, writer: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Lands the rows of one condition after the other, as many files as they come in, and lets the stream take each before the next."""
    for p in parts:
        rows.where(p).write.mode("append").parquet(f"{folder}/in")
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")
        writer(stream).trigger(availableNow=True).start().awaitTermination()


def _once(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as a table, so that landing them part by part does not work them out for each part."""
    rows.write.parquet(f"{folder}/rows")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def _thirds(day: Column) -> list[Column]:
    """Early, middle and late days; rows without a day come early."""
    return [F.coalesce(day < "2024-01-11", F.lit(True)), (day >= "2024-01-11") & (day < "2024-01-21"), day >= "2024-01-21"]


@query("SELECT event_id, user_id, event_type FROM events")
def stream_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a partitioned table as they arrive."""
    folder = scratch(spark)
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    _arriving(rows, _thirds(F.date_format("ts", "yyyy-MM-dd")), folder, lambda s: watch.archive(s, f"{folder}/out", f"{folder}/check", ["event_type"]))
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT user_id::VARCHAR AS host_id, ts, ts::DATE AS d, lpad(event_id::VARCHAR, 12, '0') AS path, sha256(event_id::VARCHAR) AS prev_hash FROM events WHERE ts IS NOT NULL),
k AS (SELECT * FROM e WHERE d >= DATE '2024-01-10')
SELECT host_id, count(*) AS kept, arg_min(path, (ts, path)) AS first_kept_path, arg_min(prev_hash, (ts, path)) AS expected_prev_hash FROM k GROUP BY host_id""")
def stream_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Days given up after each micro-batch, and the anchors of what is kept."""
    folder = scratch(spark)
    ts = F.col("ts").cast("timestamp")
    path = F.lpad(F.col("event_id").cast("string"), 12, "0")
    rows = table(spark, sf, "events").where("ts is not null").select(F.col("user_id").cast("string").alias("host_id"), ts.alias("ts"), (F.unix_micros(ts) * 1000).alias("ts_ns"), path.alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("prev_hash"), F.to_date("ts").alias("snap_date"))
    rows = rows.withColumn("hash", F.coalesce(F.lead("prev_hash").over(Window.partitionBy("host_id").orderBy("ts_ns", "path")), F.lit("")))
    out = _given_up(spark, folder, rows, _thirds(F.col("snap_date").cast("string")))
    order = F.struct("ts_ns", "path")
    kept = out.groupBy("host_id").agg(F.count("*").alias("kept"), F.min_by("path", order).alias("first_kept_path"), F.min_by("prev_hash", order).alias("first_prev_hash"))
    kept = kept.join(ledger.read(spark, f"{folder}/heads"), "host_id", "left")
    return kept.select("host_id", "kept", "first_kept_path", F.coalesce("expected_prev_hash", "first_prev_hash").alias("expected_prev_hash"))


def _given_up(spark: SparkSession, folder: str, rows: DataFrame, parts: list[Column]) -> DataFrame:
    """The rows that are left when each part has come and days older than three weeks went after each."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.partitionBy("snap_date").mode("append").parquet(f"{folder}/out")
        watch.retain(spark, f"{folder}/out", f"{folder}/heads", 21, "2024-01-31")

    _arriving(rows, parts, folder, lambda s: s.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/check"))
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("""WITH e AS (SELECT user_id::VARCHAR AS h, event_id AS k, ts, lpad(event_id::VARCHAR, 12, '0') AS p FROM events WHERE ts IS NOT NULL),
k AS (SELECT h, k, row_number() OVER (PARTITION BY h ORDER BY ts, p) - 1 AS i, count(*) OVER (PARTITION BY h) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-10')
SELECT h AS host_id, any_value(n) AS total, coalesce(min(i) FILTER (k % 97 = 0), -1) AS broken_at FROM k GROUP BY h""")
def stream_retention_links(spark: SparkSession, sf: str) -> DataFrame:
    """Chains that come in any order while old days go, then verified from the ledger on: some links do not hold, all others do."""
    folder = scratch(spark)
    ts = F.col("ts").cast("timestamp")
    path = F.lpad(F.col("event_id").cast("string"), 12, "0")
    rows = table(spark, sf, "events").where("ts is not null").select("event_id", F.col("user_id").cast("string").alias("host_id"), (F.unix_micros(ts) * 1000).alias("ts_ns"), path.alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), F.to_date("ts").alias("snap_date"))
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("host_id").orderBy("ts_ns", "path")), F.lit(GENESIS))
    rows = rows.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "none").otherwise(before))
    out = _given_up(spark, folder, rows, [F.col("event_id") % 3 == i for i in range(3)])
    found = verify.verdicts(verify.links(out, ledger.read(spark, f"{folder}/heads")))
    return found.select("host_id", "total", F.col("broken_at").cast("long").alias("broken_at"))


@query("""WITH c AS (SELECT user_id::VARCHAR AS h, strftime(ts, '%Y-%m-%d') AS d, event_type AS k, count(*)::VARCHAR AS n FROM events GROUP BY ALL),
s AS (SELECT h, d, row_number() OVER (PARTITION BY h ORDER BY d) - 1 AS seq FROM (SELECT DISTINCT h, d FROM c)), e AS (SELECT c.h, seq, k, n FROM c JOIN s USING (h, d)),
j AS (SELECT coalesce(a.h, b.h) AS h, coalesce(a.seq, b.seq) AS seq, coalesce(a.k, b.k) AS k, a.n AS o, b.n AS n FROM (SELECT h, seq + 1 AS seq, k, n FROM e) a FULL JOIN e b ON a.h = b.h AND a.seq = b.seq AND a.k = b.k)
SELECT h AS host_id, seq AS pair_seq, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'modified' END AS type, k AS key, coalesce(o, '') AS old_value, coalesce(n, '') AS new_value
FROM j WHERE o IS DISTINCT FROM n AND EXISTS (SELECT 1 FROM s WHERE s.h = j.h AND s.seq = j.seq) AND seq > 0""")
def stream_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events of a day as a snapshot, compared with the one before as it arrives."""
    folder = scratch(spark)
    day = F.date_format("ts", "yyyy-MM-dd")
    counted = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("host_id"), day.alias("path"), "event_type").agg(F.count("*").cast("string").alias("n"))
    rows = counted.groupBy("host_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("services"))
    rows = rows.withColumn("ts_ns", F.unix_date(F.to_date("path")).cast("long"))

    def found(batch: DataFrame) -> DataFrame:
        pairs = batch.select("host_id", F.col("seq").cast("long").alias("seq"), F.explode("services").alias("k", "v"))
        none = F.expr("cast(map() as map<string,decimal(20,0)>)")
        return pairs.select("host_id", "seq", F.lit("services").alias("section"), F.col("k").alias("ekey"), F.col("k").alias("dkey"), F.col("v").alias("label"), F.lit(False).alias("singleton"), F.create_map(F.lit(""), F.col("v")).alias("fields"), none.alias("counters"))

    def sink(changes: DataFrame, breaks: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    _arriving(_once(rows, folder), _thirds(F.col("path")), folder, lambda s: watch.watch(s, found, f"{folder}/state", sink, f"{folder}/check"))
    return spark.read.parquet(f"{folder}/changes").select("host_id", "pair_seq", "type", "key", "old_value", "new_value")


@query("""WITH a AS (SELECT o_custkey::VARCHAR AS h, o_orderkey AS k, o_orderstatus AS v FROM orders),
c AS (SELECT h, count(*) FILTER (k % 17 = 0) + count(*) FILTER (k % 23 = 0) + count(*) FILTER (k % 17 <> 0 AND k % 19 = 0 AND v <> 'X') AS n FROM a GROUP BY h)
SELECT h AS host_id, 'changes' AS what, n FROM c WHERE h::BIGINT % 4 <> 0 AND n > 0 UNION ALL SELECT h, 'dead letter', 1 FROM c WHERE h::BIGINT % 4 = 0""")
def stream_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as they arrive, the second of every fourth host broken: its batch goes on without it, and it is kept aside."""
    folder = scratch(spark)
    broken = (F.col("host_id").cast("long") % 4 == 0) & (F.col("path") == "1")
    rows = documents(spark, sf).withColumn("raw", F.when(broken, F.substring("raw", 1, 40)).otherwise(F.col("raw")))

    def sink(changes: DataFrame, breaks: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    def found(batch: DataFrame) -> DataFrame:
        return entities.entities(batch, ["kernel_params"])

    def read(batch: DataFrame) -> DataFrame:
        rows = source.checked(batch, ["kernel_params"])
        return rows.select("host_id", "path", F.when(~F.col("fit"), F.col("raw")).alias("raw"), "hash", "prev_hash", "ts_ns", "fit", "kernel_params")

    writer = lambda s: watch.watch(s, found, f"{folder}/state", sink, f"{folder}/check", read=read, readable=F.col("fit"), dead_letters=f"{folder}/dead")
    _arriving(rows, [F.col("path") == "0", F.col("path") == "1"], folder, writer)
    told = spark.read.parquet(f"{folder}/changes").groupBy("host_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("changes"))
    dead = spark.read.parquet(f"{folder}/dead").groupBy("host_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("dead letter"))
    return told.unionByName(dead).select("host_id", "what", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS h, event_type AS s, epoch_us(ts) // 1000000 AS t, min(event_id)::VARCHAR AS v FROM events GROUP BY ALL),
f AS (SELECT h, s, min(t) AS t FROM e GROUP BY ALL UNION ALL SELECT f.h, f.s, (SELECT min(e.t) FROM e WHERE e.h = f.h AND e.s = f.s AND e.t >= f.t + 21600) FROM f WHERE f.t IS NOT NULL)
SELECT h AS host_id, s AS section, e.t, (SELECT arg_max(x.v, x.t) FROM e x JOIN f USING (h, s, t) WHERE x.h = e.h AND x.s = e.s AND x.t <= e.t) AS value, EXISTS (SELECT 1 FROM f WHERE f.h = e.h AND f.s = e.s AND f.t = e.t) AS recorded FROM e""")
def stream_cadence(spark: SparkSession, sf: str) -> DataFrame:
    """Sections recorded when due, six hours after the last time, and carried forward in between, as ticks arrive."""
    folder = scratch(spark)
    ticks = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("host_id"), F.col("event_type").alias("section"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("event_id").cast("string").alias("value"))
    day = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd")
    _arriving(ticks, _thirds(day), folder, lambda s: cadence.fired(s, 21600).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check"))
    return spark.read.schema("host_id string, section string, t long, value string, recorded boolean").parquet(f"{folder}/out")
