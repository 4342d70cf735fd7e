"""Chains as they grow: checks that go on, refs and extracts by the thousand, streams in any order, whole documents, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cadence, diff, history, verify
from ..schema import GENESIS
from ..sources import checks, store
from ..streaming import cadence as stream_cadence
from ..streaming import outbox, watch
from .queries import query, scratch, table
from .streams import _arriving, _once, _thirds


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents: each user's chain, in which some links do not hold."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").where("ts is not null").select("event_id", "event_type", F.col("user_id").cast("string").alias("host_id"), (F.unix_micros(ts) * 1000).alias("ts_ns"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), F.to_date("ts").alias("snap_date"))
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("host_id").orderBy("ts_ns", "path")), F.lit(GENESIS))
    return rows.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "none").otherwise(before))


_E = "e AS (SELECT user_id::VARCHAR AS h, event_id AS k, event_type AS s, ts, epoch_us(ts) * 1000 AS t, lpad(event_id::VARCHAR, 12, '0') AS p, sha256(event_id::VARCHAR) AS x FROM events WHERE ts IS NOT NULL)"


@query(f"""WITH {_E}, i AS (SELECT h, k, row_number() OVER (PARTITION BY h ORDER BY ts, p) - 1 AS i FROM e),
a AS (SELECT DISTINCT h, ts::DATE::VARCHAR AS day FROM e WHERE k % 211 = 0 AND ts < TIMESTAMP '2024-01-11')
SELECT h AS host_id, count(*) AS verified, coalesce(min(i) FILTER (k % 97 = 0), -1) AS broken_at, (SELECT string_agg(day, ',' ORDER BY day) FROM a WHERE a.h = i.h) AS altered FROM i GROUP BY h""")
def verify_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A store that is checked as it grows, three times; then some of its old documents say something else, and their days show."""
    folder = scratch(spark)
    rows = _events(spark, sf)
    for part in _thirds(F.col("snap_date").cast("string")):
        store.append(rows.where(part), f"{folder}/table")
        marks = checks.check(spark, f"{folder}/table", f"{folder}/state")
    forged = (F.col("event_id") % 211 == 0) & (F.col("snap_date") < "2024-01-11")
    other = store.read(spark, f"{folder}/table").withColumn("hash", F.when(forged, F.reverse("hash")).otherwise(F.col("hash")))
    days = checks.altered(spark, other, f"{folder}/state").groupBy("host_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("snap_date").cast("string"))), ",").alias("altered"))
    return marks.select("host_id", "verified", "broken_at").join(days, "host_id", "left")


@query(f"""WITH {_E}, i AS (SELECT h, x, row_number() OVER (PARTITION BY h ORDER BY ts, p) - 1 AS i, count(*) OVER (PARTITION BY h) AS n FROM e),
r AS (SELECT k, h, CASE WHEN k % 5 = 0 THEN left(x, (1 + k % 12)::BIGINT) WHEN k % 5 = 1 THEN 'HEAD~' || k % 40 WHEN k % 5 = 2 THEN 'HEAD' ELSE 'zz' END AS ref FROM e),
m AS (SELECT r.k, i.i, i.x FROM r JOIN i ON r.h = i.h AND CASE WHEN ref LIKE 'HEAD~%' THEN i.i = i.n - 1 - r.k % 40 WHEN ref = 'HEAD' THEN i.i = i.n - 1 ELSE starts_with(i.x, ref) END)
SELECT r.k AS ref_id, r.h AS host_id, CASE count(m.k) WHEN 0 THEN 'none' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(m.k) AS candidates, CASE WHEN count(m.k) = 1 THEN min(i) END AS seq, CASE WHEN count(m.k) = 1 THEN min(x) END AS hash FROM r LEFT JOIN m USING (k) GROUP BY r.k, r.h""")
def refs_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """A ref for every event, resolved at once: heads, places before them, starts of hashes of which some name several."""
    rows, k = _events(spark, sf), F.col("event_id")
    ref = F.when(k % 5 == 0, F.substring("hash", F.lit(1), (1 + k % 12).cast("int"))).when(k % 5 == 1, F.concat(F.lit("HEAD~"), (k % 40).cast("string"))).when(k % 5 == 2, "HEAD").otherwise("zz")
    index = history.sequenced(rows.select("host_id", "ts_ns", "path", "hash")).withColumn("seq", F.col("seq").cast("long"))
    return history.resolve_all(index, rows.select(k.alias("ref_id"), "host_id", ref.alias("ref")))


@query(f"""WITH {_E}, u AS (SELECT DISTINCT h FROM e), r AS (SELECT h || '-' || j AS bundle_id, h, TIMESTAMP '2024-01-01' + to_days((3 * j)::INTEGER) AS a FROM u, range(8) x(j))
SELECT bundle_id, count(*) AS snapshot_count, min(t) AS first_ns, max(t) AS last_ns, arg_max(x, (t, p)) AS head_hash FROM r JOIN e ON e.h = r.h AND ts >= a AND ts < a + INTERVAL 10 DAY GROUP BY bundle_id""")
def extracts_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """Eight overlapping extracts of every host by one join, and their manifests."""
    rows = _events(spark, sf).select("host_id", "ts_ns", "path", "hash", "prev_hash")
    start = F.expr("unix_micros(timestamp'2024-01-01') * 1000") + F.col("j") * 3 * 86_400 * 1_000_000_000
    asked = rows.select("host_id").distinct().select("host_id", F.explode(F.array(*[F.lit(j).cast("long") for j in range(8)])).alias("j"))
    asked = asked.select(F.concat_ws("-", "host_id", F.col("j").cast("string")).alias("bundle_id"), "host_id", start.alias("from_ns"), (start + 10 * 86_400 * 1_000_000_000).alias("to_ns"))
    return verify.manifest(history.extracts(rows, asked)).select("bundle_id", "snapshot_count", "first_ns", "last_ns", "head_hash")


# --- a user's day as a snapshot: how many events of each type ---------------------------------------------------------

_DAYS = """c AS (SELECT user_id::VARCHAR AS h, strftime(ts, '%Y-%m-%d') AS d, event_type AS k, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT h, d, row_number() OVER (PARTITION BY h ORDER BY d) - 1 AS seq FROM (SELECT DISTINCT h, d FROM c)), y AS (SELECT c.h, seq, k, n FROM c JOIN s USING (h, d)),
j AS (SELECT coalesce(a.h, b.h) AS h, coalesce(a.seq, b.seq) AS seq, coalesce(a.k, b.k) AS k, a.n AS o, b.n AS n FROM (SELECT h, seq + 1 AS seq, k, n FROM y) a FULL JOIN y b ON a.h = b.h AND a.seq = b.seq AND a.k = b.k),
q AS (SELECT h, seq, k, o, n FROM j WHERE o IS DISTINCT FROM n AND seq > 0 AND EXISTS (SELECT 1 FROM s WHERE s.h = j.h AND s.seq = j.seq))"""


def _days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    counted = table(spark, sf, "events").where("ts is not null").groupBy(F.col("user_id").cast("string").alias("host_id"), day.alias("path"), "event_type").agg(F.count("*").alias("n"))
    rows = counted.groupBy("host_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("seen"))
    rows = rows.withColumn("ts_ns", F.unix_date(F.to_date("path")).cast("long") * 86_400 * 1_000_000_000).withColumn("hash", F.sha2(F.concat_ws("/", "host_id", "path"), 256))
    return rows.withColumn("prev_hash", F.coalesce(F.lag("hash").over(Window.partitionBy("host_id").orderBy("ts_ns", "path")), F.lit(GENESIS)))


def _types(batch: DataFrame) -> DataFrame:
    """Event types as entities; how many there were of one is a counter."""
    pairs = batch.select("host_id", F.col("seq").cast("long").alias("seq"), F.explode("seen").alias("k", "n"))
    none = F.expr("cast(map() as map<string,string>)")
    return pairs.select("host_id", "seq", F.lit("types").alias("section"), F.col("k").alias("ekey"), F.col("k").alias("dkey"), F.lit("seen").alias("label"), F.lit(False).alias("singleton"), none.alias("fields"), F.create_map(F.lit(".n"), F.col("n").cast("decimal(20,0)")).alias("counters"))


@query(f"WITH {_DAYS} SELECT h AS host_id, seq AS pair_seq, 'types' AS section, count(*) AS n, min(k || CASE WHEN o IS NULL OR n IS NULL THEN '' ELSE '.n' END) AS first_key FROM q GROUP BY h, seq")
def diff_by_section(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of consecutive days as one sorted array a section."""
    rows = history.sequenced(_days(spark, sf))
    found = diff.by_section(diff.consecutive(_types(rows), diff.consecutive_pairs(rows)))
    return found.select("host_id", F.col("pair_seq").cast("long").alias("pair_seq"), "section", F.size("changes").cast("long").alias("n"), F.get("changes", F.lit(0))["key"].alias("first_key"))


def _mixed(rows: DataFrame) -> list[Column]:
    """Three parts in no order of time."""
    return [F.pmod(F.xxhash64("host_id", "path"), F.lit(3)) == i for i in range(3)]


@query(f"WITH {_DAYS} SELECT h AS host_id, seq AS pair_seq, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'modified' END AS type, k || CASE WHEN o IS NULL OR n IS NULL THEN '' ELSE '.n' END AS key FROM q")
def stream_any_order(spark: SparkSession, sf: str) -> DataFrame:
    """Chained documents that arrive in no order at all: those whose link is missing wait, and the changes are those of the batch."""
    folder, rows = scratch(spark), _days(spark, sf)

    def sink(changes: DataFrame, breaks: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    _arriving(rows, _mixed(rows), folder, lambda s: watch.watch(s, _types, f"{folder}/state", sink, f"{folder}/check", follow_hashes=True, park_ns=400 * 86_400 * 1_000_000_000))
    return spark.read.parquet(f"{folder}/changes").select("host_id", "pair_seq", "type", "key")


@query(f"""WITH {_DAYS}, p AS (SELECT h, seq, count(*) FILTER (o IS NULL OR n IS NULL) AS m FROM q GROUP BY h, seq)
SELECT mode, h AS host_id, count(*) FILTER (m > 0 OR mode = 'all') AS told, count(*) FILTER (m > 0) AS payloads FROM p, (VALUES ('all'), ('material')) v(mode) GROUP BY ALL HAVING count(*) FILTER (m > 0 OR mode = 'all') > 0""")
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """From stream to alerts, with changes of counters told and not; a watch that starts over sends nothing twice."""
    rows, out = _once(_days(spark, sf), scratch(spark)), []
    for mode in ("all", "material"):
        folder = scratch(spark)

        def sink(changes: DataFrame, breaks: DataFrame, number: int, folder: str = folder) -> None:
            changes.select("host_id", "pair_seq").distinct().write.mode("overwrite").parquet(f"{folder}/told/batch={number}")

        for run in range(2 if mode == "all" else 1):
            writer = lambda s, run=run, folder=folder, sink=sink, mode=mode: watch.watch(s, _types, f"{folder}/state{run}", sink, f"{folder}/check{run}", ignore_counters=mode == "material", alert=outbox.sink(f"{folder}/outbox"))
            _arriving(rows, _thirds(F.col("path")), f"{folder}/{run}", writer)
        told = spark.read.parquet(f"{folder}/told").groupBy("host_id").agg(F.count("*").alias("told"))
        sent = outbox.pending(spark, f"{folder}/outbox").groupBy("host_id").agg(F.count("*").alias("payloads"))
        out.append(told.join(sent, "host_id", "left").fillna(0, ["payloads"]).select(F.lit(mode).alias("mode"), "host_id", "told", "payloads"))
    return out[0].unionByName(out[1])


@query(f"""WITH {_E}, l AS (SELECT e.h, e.p, x.s, arg_max(x.k, (x.ts, x.p)) AS v FROM e JOIN e x ON x.h = e.h AND (x.ts, x.p) <= (e.ts, e.p) GROUP BY e.h, e.p, x.s)
SELECT h AS host_id, p AS path, kind, string_agg(s || ':' || v, ',' ORDER BY s) AS sections FROM l, (VALUES ('batch'), ('stream')) k(kind) GROUP BY ALL""")
def whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold one section each, made whole with what the others said last, at rest and as they arrive."""
    folder, rows = scratch(spark), _events(spark, sf)
    raw = F.concat(F.lit('{"'), "event_type", F.lit('":{"v":'), F.col("event_id").cast("string"), F.lit('},"none":null}'))
    rows = rows.select("host_id", "ts_ns", "path", raw.alias("raw"), "snap_date")
    parts = _thirds(F.col("snap_date").cast("string"))
    _arriving(rows, parts, folder, lambda s: stream_cadence.whole_documents(s).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check"))
    streamed = spark.read.schema("host_id string, ts_ns long, path string, raw string").parquet(f"{folder}/out")
    every = cadence.whole_documents(rows).withColumn("kind", F.lit("batch")).unionByName(streamed.withColumn("kind", F.lit("stream")))
    sections = F.transform(F.array_sort(F.map_entries(F.from_json("raw", "map<string,struct<v:long>>"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["v"].cast("string")))
    return every.select("host_id", "path", "kind", F.array_join(sections, ",").alias("sections"))
