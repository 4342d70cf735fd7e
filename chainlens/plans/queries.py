"""The operators over the driver's tables, each with the same result in DuckDB SQL.

The tables hold no snapshots, so each query takes a table as state: keys, fields and counters of customers, orders and
so on stand for sections, and a fixed mutation of a table for a later state.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, net, redact, text
from ..operators import cadence, diff, history, inventory, parsers, rules, verify
from ..operators.entities import first_wins, last_wins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='spark-')}/engine-{uuid.uuid4().hex}"


def instant(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


# --- a state and a later one ---------------------------------------------------------------------------------------


def mutated(rows: DataFrame, key: str, field: str, value: Column) -> DataFrame:
    """rows later: keys that 17 divides are gone, field is value where 19 does, and copies of those that 23 does are new."""
    kept = rows.where(F.col(key) % 17 != 0).withColumn(field, F.when(F.col(key) % 19 == 0, value).otherwise(F.col(field)))
    return kept.unionByName(rows.where(F.col(key) % 23 == 0).withColumn(key, F.col(key) + 1_000_000_000))


def mutated_sql(name: str, key: str, field: str, value: str) -> str:
    return (
        f"(SELECT * REPLACE (CASE WHEN {key} % 19 = 0 THEN {value} ELSE {field} END AS {field}) FROM {name} WHERE {key} % 17 <> 0 "
        f"UNION ALL SELECT * REPLACE ({key} + 1000000000 AS {key}) FROM {name} WHERE {key} % 23 = 0)"
    )


def as_entities(rows: DataFrame, section: str, key: str, label: Column, fields: dict[str, Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """A table's rows as entities of one host and pair."""
    pairs = [x for k, v in (fields or {}).items() for x in (F.lit(k), v)]
    return rows.select(
        F.lit("all").alias("host_id"), F.lit(1).cast("long").alias("pair_seq"), F.lit(section).alias("section"), F.col(key).cast("string").alias("ekey"), F.col(key).cast("string").alias("dkey"), label.alias("label"),
        F.lit(False).alias("singleton"), (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).alias("fields"), F.expr("cast(map() as map<string,decimal(20,0)>)").alias("counters"), *(keep or []),
    )


def customer_changes(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    new = mutated(old, "c_custkey", "c_mktsegment", F.lit("CHANGED"))
    side = lambda rows: as_entities(rows, "users", "c_custkey", F.col("c_name"), {".nation": F.col("c_nationkey").cast("string"), ".segment": F.col("c_mktsegment")})
    return diff.changes(side(old), side(new))


CUSTOMER_CHANGES = f"""
o AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), n AS (SELECT * FROM {mutated_sql("o", "c_custkey", "c_mktsegment", "'CHANGED'")}),
j AS (SELECT o.c_custkey AS ok, n.c_custkey AS nk, o.c_name AS onm, n.c_name AS nnm, o.c_mktsegment AS os, n.c_mktsegment AS ns FROM o FULL JOIN n ON o.c_custkey = n.c_custkey),
ch AS (
  SELECT 'users' AS section, 'removed' AS type, ok::VARCHAR AS key, onm AS old_value, '' AS new_value FROM j WHERE nk IS NULL
  UNION ALL SELECT 'users', 'added', nk::VARCHAR, '', nnm FROM j WHERE ok IS NULL
  UNION ALL SELECT 'users', 'modified', ok::VARCHAR || '.segment', os, ns FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND os <> ns
)"""


@query(f"WITH {CUSTOMER_CHANGES} SELECT section, type, key, old_value, new_value, false AS counter FROM ch")
def diff_customer_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed full outer difference, material rows."""
    return diff.material(customer_changes(spark, sf)).drop("host_id", "pair_seq")


@query(f"""WITH n AS {mutated_sql("supplier", "s_suppkey", "s_name", "s_name")}
SELECT 'removed' AS type, (SELECT s_name) AS key FROM (SELECT s_name || '/' || s_suppkey AS s_name FROM supplier EXCEPT SELECT s_name || '/' || s_suppkey FROM n)
UNION ALL SELECT 'added', s_name FROM (SELECT s_name || '/' || s_suppkey AS s_name FROM n EXCEPT SELECT s_name || '/' || s_suppkey FROM supplier)""")
def diff_set_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Set difference both ways between two chosen snapshots."""
    old = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    states = old.withColumn("seq", F.lit(3).cast("long")).unionByName(mutated(old, "s_suppkey", "s_name", F.col("s_name")).withColumn("seq", F.lit(8).cast("long")))
    named = states.withColumn("k", F.concat("s_name", F.lit("/"), F.col("s_suppkey").cast("string")))
    rows = as_entities(named, "routes", "k", F.col("k"), keep=["seq"]).drop("pair_seq")
    pairs = spark.range(1).select(F.lit("all").alias("host_id"), F.lit(1).cast("long").alias("pair_seq"), F.lit(3).cast("long").alias("seq_a"), F.lit(8).cast("long").alias("seq_b"))
    return diff.between(rows, F.broadcast(pairs)).select("type", "key")


@query(f"""WITH {CUSTOMER_CHANGES}, p AS {mutated_sql("part", "p_partkey", "p_brand", "'Brand#X'")},
pj AS (SELECT a.p_partkey AS ok, b.p_partkey AS nk, a.p_brand AS ob, b.p_brand AS nb FROM part a FULL JOIN p b ON a.p_partkey = b.p_partkey),
every AS (
  SELECT section, type FROM ch
  UNION ALL SELECT 'packages', CASE WHEN nk IS NULL THEN 'removed' WHEN ok IS NULL THEN 'added' ELSE 'modified' END FROM pj WHERE nk IS NULL OR ok IS NULL OR ob <> nb
)
SELECT section, count(*) AS n, count(*) FILTER (type = 'modified') AS modified FROM every WHERE starts_with(section, 'pack') GROUP BY section""")
def diff_section_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Two sections compared at once, then one by its prefix, counted by section."""
    old = table(spark, sf, "part").select("p_partkey", "p_brand")
    side = lambda rows: as_entities(rows, "packages", "p_partkey", F.col("p_brand"), {"": F.col("p_brand")})
    both = customer_changes(spark, sf).unionByName(diff.changes(side(old), side(mutated(old, "p_partkey", "p_brand", F.lit("Brand#X")))))
    return diff.in_section(both, "pack").groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "modified").alias("modified"))


def _status_counters(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where(F.year("o_orderdate").isin(1995, 1996)).groupBy(F.year("o_orderdate").cast("long").alias("seq"), "o_orderstatus").agg(F.count("*").cast("decimal(20,0)").alias("n"))
    rows = orders.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("counters"))
    return rows.select(F.lit("all").alias("host_id"), "seq", F.lit("cpu").alias("section"), F.lit("").alias("ekey"), F.lit("").alias("dkey"), F.lit("").alias("label"), F.lit(True).alias("singleton"), F.expr("cast(map() as map<string,string>)").alias("fields"), "counters")


@query("""WITH c AS (SELECT year(o_orderdate) AS y, o_orderstatus AS k, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS o, coalesce(b.n, 0) AS n FROM (SELECT * FROM c WHERE y = 1995) a FULL JOIN (SELECT * FROM c WHERE y = 1996) b ON a.k = b.k)
SELECT k AS key, o::VARCHAR AS old_value, n || ' (delta: ' || CASE WHEN n >= o THEN '+' ELSE '' END || (n - o) || ')' AS new_value, true AS counter FROM j WHERE o <> n""")
def diff_counters_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a singleton at two times, with signed differences."""
    pairs = spark.range(1).select(F.lit("all").alias("host_id"), F.lit(1996).cast("long").alias("pair_seq"))
    return diff.consecutive(_status_counters(spark, sf), pairs).select("key", "old_value", "new_value", "counter")


def daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders by priority as a chain of daily snapshots: each day's customers with their priorities."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("host_id"), F.to_date("o_orderdate").alias("d"), "o_custkey", "o_orderstatus")
    days = orders.select("host_id", "d").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("host_id").orderBy("d")).cast("long") - 1)
    rows = orders.groupBy("host_id", "d", "o_custkey").agg(F.max("o_orderstatus").alias("status")).join(days, ["host_id", "d"])
    key = F.col("o_custkey").cast("string")
    found = rows.select("host_id", "seq", F.lit("services").alias("section"), key.alias("ekey"), key.alias("dkey"), F.col("status").alias("label"), F.lit(False).alias("singleton"), F.create_map(F.lit(""), F.col("status")).alias("fields"), F.expr("cast(map() as map<string,decimal(20,0)>)").alias("counters"))
    return days, found


@query("""WITH o AS (SELECT o_orderpriority AS h, o_orderdate::DATE AS d, o_custkey AS k, max(o_orderstatus) AS s FROM orders GROUP BY ALL),
days AS (SELECT h, d, row_number() OVER (PARTITION BY h ORDER BY d) - 1 AS seq FROM (SELECT DISTINCT h, d FROM o)),
e AS (SELECT o.h, seq, k, s FROM o JOIN days USING (h, d)),
c AS (SELECT coalesce(a.h, b.h) AS h, coalesce(a.seq, b.seq) AS seq, a.s IS NULL OR b.s IS NULL OR a.s <> b.s AS changed FROM (SELECT h, seq + 1 AS seq, k, s FROM e) a FULL JOIN e b ON a.h = b.h AND a.seq = b.seq AND a.k = b.k),
t AS (SELECT h, seq, count(*) FILTER (changed) AS n FROM c GROUP BY ALL)
SELECT d.h AS host_id, d.seq, d.d, CASE WHEN d.seq = 0 THEN 0 ELSE coalesce(n, 0) END AS material, 0::BIGINT AS counters, d.seq = 0 AS is_genesis, d.seq = max(d.seq) OVER (PARTITION BY d.h) AS is_head
FROM days d LEFT JOIN t ON t.h = d.h AND t.seq = d.seq""")
def diff_consecutive_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Each snapshot of a chain against the one before, as history rows."""
    days, found = daily(spark, sf)
    pairs = diff.consecutive_pairs(days)
    counts = diff.counts(diff.consecutive(found, pairs), pairs)
    return history.history(days, counts)


# --- rules ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {CUSTOMER_CHANGES},
r(id, severity, rank, section, kind, re) AS (VALUES ('R14_USER_ADDED', 'high', 1, 'users', 'added', NULL), ('R15_USER_MODIFIED', 'medium', 2, 'users', 'modified', NULL), ('C1', 'critical', 0, 'us', 'any', '^[^/]*9\\.segment$'))
SELECT id AS rule_id, severity, rank, count(*) AS matches FROM ch JOIN r ON starts_with(ch.section, r.section) AND (kind = 'any' OR kind = type) AND (re IS NULL OR regexp_matches(key, re)) GROUP BY ALL""")
def rules_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Rules by section prefix, type and key pattern on changes, counted and ranked."""
    own = spark.createDataFrame([("C1", "", "", "critical", "us", "any", "*9.segment", False, 0)], rules.default_rules(spark).schema)
    table_ = rules.overridden(rules.default_rules(spark), own)
    return rules.findings(customer_changes(spark, sf), table_).select("rule_id", "severity", "rank", "matches")


@query("""WITH a AS (SELECT n_nationkey AS ord, n_name AS id, 'low' AS severity FROM nation), u AS (SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS ord, c_mktsegment AS id FROM (SELECT DISTINCT c_mktsegment FROM customer)
UNION ALL SELECT 100 + n_nationkey, n_name FROM nation WHERE n_nationkey % 5 = 0)
SELECT id, 'low' AS severity, ord::INT AS ord FROM a WHERE id NOT IN (SELECT id FROM u)
UNION ALL SELECT u.id, 'high', coalesce(a.ord, u.ord + (SELECT max(ord) + 1 FROM a))::INT FROM u LEFT JOIN a USING (id)""")
def rules_override(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of one table replaced in place by those of another, and new ones put after them."""
    nation = table(spark, sf, "nation")
    defaults = nation.select(F.col("n_name").alias("id"), F.lit("low").alias("severity"), F.col("n_nationkey").cast("int").alias("ord"))
    segments = table(spark, sf, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s")).select(F.posexplode("s").alias("at", "c_mktsegment"))  # rules are a short table
    new = segments.select(F.col("c_mktsegment").alias("id"), F.lit("high").alias("severity"), F.col("at").alias("ord"))
    own = new.unionByName(nation.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("id"), F.lit("high").alias("severity"), (F.col("n_nationkey") + 100).cast("int").alias("ord")))
    return rules.overridden(defaults, own)


# --- chains --------------------------------------------------------------------------------------------------------


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """events as documents of each user's chain."""
    e = table(spark, sf, "events")
    payload = F.concat_ws("|", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.round(F.col("value") * 100).cast("bigint").cast("string"))
    return e.select(F.col("user_id").cast("string").alias("host_id"), instant().alias("ts_ns"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), payload.alias("payload"))


PAYLOADS = """
p AS (SELECT user_id::VARCHAR AS host_id, epoch_us(ts) * 1000 AS ts_ns, lpad(event_id::VARCHAR, 12, '0') AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  event_id || '|' || event_type || '|' || epoch_us(ts) || '|' || round(value * 100)::BIGINT AS payload FROM events),
l AS (SELECT host_id, list(payload ORDER BY i) AS ps FROM p GROUP BY host_id)"""
CHAIN = (
    PAYLOADS
    + """,
c AS (
  SELECT host_id, 0 AS i, repeat('0', 64) AS hash, NULL::VARCHAR AS prev_hash FROM l
  UNION ALL SELECT c.host_id, c.i + 1, sha256(c.hash || p.payload), c.hash FROM c JOIN p ON p.host_id = c.host_id AND p.i = c.i + 1
),
ch AS (SELECT p.host_id, p.ts_ns, p.path, p.i - 1 AS idx, c.hash, c.prev_hash FROM p JOIN c USING (host_id, i))"""
)


def chained(spark: SparkSession, sf: str) -> DataFrame:
    return canon.chain(payloads(spark, sf), "host_id", ["ts_ns", "path"], "payload")


@query(f"WITH RECURSIVE {CHAIN} SELECT host_id, path, hash, prev_hash FROM ch")
def chain_build_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events hashed into a chain."""
    return chained(spark, sf).select("host_id", "path", "hash", "prev_hash")


@query(f"WITH {PAYLOADS} SELECT host_id, list_reduce(list_prepend(repeat('0', 64), ps), lambda a, x: sha256(a || x)) AS head_hash FROM l")
def chain_fold_events(spark: SparkSession, sf: str) -> DataFrame:
    """The head of each user's chain as one fold over its documents."""
    return chained(spark, sf).groupBy("host_id").agg(F.max_by("hash", F.struct("ts_ns", "path")).alias("head_hash"))


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    """The chains, in which every document that 97 divides says another hash than its own."""
    return chained(spark, sf).withColumn("hash", F.when(F.col("path").cast("long") % 97 == 0, F.sha2("path", 256)).otherwise(F.col("hash")))


TAMPERED = CHAIN + ", t AS (SELECT host_id, ts_ns, path, idx, prev_hash, CASE WHEN path::BIGINT % 97 = 0 THEN sha256(path) ELSE hash END AS hash FROM ch), k AS (SELECT *, prev_hash IS DISTINCT FROM coalesce(lag(hash) OVER (PARTITION BY host_id ORDER BY idx), repeat('0', 64)) AS broken FROM t), v AS (SELECT host_id, count(*) AS total, coalesce(min(idx) FILTER (broken), -1) AS broken_at, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, arg_min(hash, idx) AS root_hash, arg_max(hash, idx) AS last_hash FROM k GROUP BY host_id)"


@query(f"WITH RECURSIVE {TAMPERED} SELECT k.host_id, path, idx, broken, CASE WHEN broken_at < 0 OR idx < broken_at - 1 THEN 'intact' WHEN idx = broken_at - 1 THEN 'suspect' ELSE 'untrusted' END AS status FROM k JOIN v USING (host_id)")
def chain_verify_events(spark: SparkSession, sf: str) -> DataFrame:
    """Links of tampered chains, and how far each document can be trusted."""
    linked = verify.links(tampered(spark, sf))
    return verify.trust(linked, verify.verdicts(linked)).select("host_id", "path", F.col("idx").cast("long").alias("idx"), "broken", "status")


@query(f"WITH RECURSIVE {TAMPERED}, h AS (SELECT host_id, last_hash AS head_hash FROM v WHERE host_id::BIGINT % 3 <> 0) SELECT v.host_id, total, broken_at, last_hash = coalesce(head_hash, repeat('0', 64)) AS head_ok FROM v LEFT JOIN h USING (host_id)")
def chain_head_check(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of chains against recorded heads, some of which are missing."""
    linked = verify.links(tampered(spark, sf))
    recorded = verify.heads(linked).where(F.col("host_id").cast("long") % 3 != 0)
    return verify.head_check(verify.verdicts(linked), recorded).select("host_id", "total", F.col("broken_at").cast("long").alias("broken_at"), "head_ok")


@query(f"""WITH RECURSIVE {TAMPERED}, x AS (SELECT * FROM t WHERE ts_ns >= epoch_us(TIMESTAMP '2024-01-05') * 1000 AND ts_ns < epoch_us(TIMESTAMP '2024-01-20') * 1000),
b AS (SELECT *, row_number() OVER o - 1 AS n, lag(hash) OVER o AS before FROM x WINDOW o AS (PARTITION BY host_id ORDER BY idx)),
m AS (SELECT host_id, count(*) AS c, min(ts_ns) AS a, max(ts_ns) AS z, arg_min(hash, idx) AS root_hash, arg_max(hash, idx) AS head_hash, coalesce(min(n) FILTER (n > 0 AND prev_hash IS DISTINCT FROM before), -1) AS broken_at FROM b GROUP BY host_id)
SELECT host_id AS bundle_id, c AS snapshot_count, a AS first_ns, z AS last_ns, root_hash, head_hash, CASE WHEN c > 1 THEN (500000000 + (z - a) // (c - 1)) // 1000000000 END AS mean_gap_s, broken_at, CASE WHEN host_id::BIGINT % 4 = 0 THEN 'head_hash' ELSE '' END AS mismatch FROM m""")
def bundle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Extracts of a range of days, their manifests, and a check of both, some manifests being wrong."""
    rows = tampered(spark, sf).withColumnRenamed("host_id", "bundle_id").withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    rows = rows.where(text.in_days(F.col("ts"), "2024-01-05", "2024-01-19", "UTC"))
    told = verify.manifest(rows)
    wrong = told.withColumn("head_hash", F.when(F.col("bundle_id").cast("long") % 4 == 0, "x").otherwise(F.col("head_hash")))
    checked = verify.bundle_verdicts(rows, wrong).select("bundle_id", F.col("broken_at").cast("long").alias("broken_at"), "mismatch")
    return told.join(checked, "bundle_id")


@query("""WITH s AS (SELECT user_id::VARCHAR AS host_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, lpad(event_id::VARCHAR, 12, '0')) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT host_id, event_id, seq, seq = 0 AS is_genesis, seq = n - 1 AS is_head FROM s WHERE ts >= TIMESTAMP '2024-01-10 08:00:00' AND ts < TIMESTAMP '2024-01-13 08:00:00'""")
def history_log(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a zone out of history, in which first and last are those of the whole chain."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("host_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), instant().alias("ts_ns"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"))
    rows = history.sequenced(rows).withColumn("seq", F.col("seq").cast("long"))
    none = rows.select("host_id", F.col("seq").alias("pair_seq"), F.lit(0).alias("material"), F.lit(0).alias("counters")).limit(0)
    found = history.select_days(history.history(rows, none), "2024-01-10", "2024-01-12", "America/Los_Angeles")
    return history.newest_first(found).select("host_id", "event_id", "seq", "is_genesis", "is_head")


@query("SELECT user_id::VARCHAR AS host_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lpad(event_id::VARCHAR, 12, '0') DESC) AS n FROM events) WHERE n = 4")
def resolve_head_n(spark: SparkSession, sf: str) -> DataFrame:
    """HEAD~3 of each user's chain."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("host_id"), "event_id", instant().alias("ts_ns"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"))
    return history.resolve(history.sequenced(rows), "HEAD~3").select("host_id", "event_id")


@query(f"WITH RECURSIVE {CHAIN}, f AS (SELECT * FROM ch WHERE starts_with(hash, 'a1')) SELECT host_id, path, hash FROM f WHERE host_id IN (SELECT host_id FROM f GROUP BY host_id HAVING count(*) = 1)")
def resolve_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The document that the start of a hash names, where it names just one of a chain."""
    return history.resolve(chained(spark, sf), "A1").select("host_id", "path", "hash")


@query(f"""WITH RECURSIVE {CHAIN}, x AS (SELECT *, ts_ns >= epoch_us(TIMESTAMP '2024-01-15') * 1000 AS kept FROM ch)
SELECT host_id, count(*) FILTER (NOT kept) AS removed, count(*) FILTER (kept) AS remaining, arg_min(path, idx) FILTER (kept) AS first_kept_path, arg_min(prev_hash, idx) FILTER (kept) AS expected_prev_hash, -1::BIGINT AS broken_at FROM x GROUP BY host_id HAVING bool_or(kept)""")
def retention_split(spark: SparkSession, sf: str) -> DataFrame:
    """Old documents given up, anchors in their place, and what is left still verified."""
    rows = chained(spark, sf).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    kept, anchors = history.retained(rows, 16, "2024-01-31")
    verdict = verify.verdicts(verify.links(kept, anchors)).select("host_id", F.col("broken_at").cast("long").alias("broken_at"))
    return history.retention_summary(rows, 16, "2024-01-31").join(anchors, "host_id").join(verdict, "host_id")


# --- cadence, top lists, attribution -------------------------------------------------------------------------------


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """A section recorded at every third time, carried forward in between."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("section"))
    return cadence.carried_forward(rows, ["section"], "user_id", ["ts", "event_id"]).select("user_id", "event_id", "section")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000000 AS t FROM events),
f AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL UNION ALL
  SELECT f.user_id, f.event_type, (SELECT min(e.t) FROM e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.t >= f.t + 21600) FROM f WHERE f.t IS NOT NULL)
SELECT user_id, event_type, t FROM f WHERE t IS NOT NULL""")
def cadence_due(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks at which each section is due, six hours after it was last recorded."""
    rows = table(spark, sf, "events").select("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).distinct()
    return cadence.fired(rows, ["user_id", "event_type"], "t", 21600)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 20")
def topn_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest of each group."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return inventory.top(rows, ["l_suppkey"], F.col("l_quantity"), "tie").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_suppkey::VARCHAR AS host_id, count(*) FILTER (l_returnflag <> 'R') AS total_tcp, count(*) FILTER (l_returnflag = 'R') AS total_udp, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS total_listen FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL")
def inventory_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by protocol and state of what has an inode."""
    proto = F.when(F.col("l_returnflag") == "R", "udp").when(F.col("l_returnflag") == "A", "tcp").otherwise("tcp6")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("host_id"), F.lit(0).alias("ts"), proto.alias("proto"), F.when(F.col("l_linestatus") == "O", "0A").otherwise("01").alias("state"), (7 - F.col("l_linenumber")).alias("inode"))
    return inventory.socket_totals(rows).drop("ts")


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber * 1000000000::BIGINT + l_suppkey AS pos, l_suppkey AS s FROM lineitem WHERE l_suppkey % 3 <> 0)
SELECT o_orderkey AS inode, coalesce((SELECT arg_min('p' || s, pos) FROM i WHERE k = o_orderkey), '') AS process FROM orders""")
def attribution_join(spark: SparkSession, sf: str) -> DataFrame:
    """The first process of each inode, '' where there is none."""
    owners = table(spark, sf, "lineitem").where("l_suppkey % 3 <> 0").select(F.lit("h").alias("host_id"), F.lit(0).alias("ts"), F.col("l_orderkey").alias("inode"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("process"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("pos"))
    sockets = table(spark, sf, "orders").select(F.lit("h").alias("host_id"), F.lit(0).alias("ts"), F.col("o_orderkey").alias("inode"))
    return inventory.attributed(sockets, owners).select("inode", "process")


@query("""WITH i AS (SELECT l_orderkey AS k, arg_max(l_suppkey, l_linenumber * 1000000000::BIGINT + l_suppkey) AS pid FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_orderpriority AS host_id, pid, coalesce(s_name, '') AS comm, count(*) FILTER (o_orderstatus <> 'P') AS tcp_count, count(*) FILTER (o_orderstatus = 'P') AS udp_count FROM orders JOIN i ON k = o_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = pid WHERE o_orderkey <> 0 GROUP BY ALL)
SELECT host_id, pid, comm, tcp_count, udp_count FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY tcp_count + udp_count DESC, pid) AS n FROM c) WHERE n <= 20""")
def socket_owner_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Processes with most sockets: inode to its last pid, pid to its command."""
    hosts = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("host_id"), F.lit(0).alias("ts"), F.col("o_orderkey").alias("inode"), F.when(F.col("o_orderstatus") == "P", "udp").otherwise("tcp").alias("proto"), F.lit("01").alias("state"))
    inodes = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("pid"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("pos")).join(hosts.select("host_id", "ts", F.col("inode").alias("l_orderkey")), "l_orderkey")
    # A name for each host and pid that owns something, not for each host and supplier.
    owners = inodes.select("host_id", "ts", "pid").distinct()
    names = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("pid"), F.col("s_name").alias("comm")).join(owners, "pid")
    return inventory.socket_owners(hosts, inodes.withColumnRenamed("l_orderkey", "inode"), names).select("host_id", "pid", "comm", "tcp_count", "udp_count")


@query("""WITH u AS (SELECT '/usr/lib/systemd/' || p_brand || '.timer' AS path, p_brand AS b, p_partkey AS v FROM part UNION ALL SELECT '/etc/systemd/' || p_brand || '.timer', p_brand, -p_partkey FROM part WHERE p_size < 10)
SELECT b, starts_with(arg_max(path, CASE WHEN starts_with(path, '/etc/') THEN 1 ELSE 0 END), '/etc/') AS from_etc FROM u GROUP BY b""")
def precedence_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Units by base name, those of /etc before others."""
    part = table(spark, sf, "part").select(F.lit("h").alias("host_id"), "p_brand", "p_size")
    low = part.withColumn("path", F.concat(F.lit("/usr/lib/systemd/"), "p_brand", F.lit(".timer")))
    high = part.where("p_size < 10").withColumn("path", F.concat(F.lit("/etc/systemd/"), "p_brand", F.lit(".timer")))
    units = inventory.precedence(low.unionByName(high), ["host_id"], "path")
    return units.select(F.col("p_brand").alias("b"), F.startswith("path", F.lit("/etc/")).alias("from_etc"))


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(round(value * 100)::BIGINT, event_id) AS cents FROM events GROUP BY ALL")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first of rows with equal keys."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("event_id").alias("pos"))
    return first_wins(rows, ["user_id", "event_type"], "pos")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(round(value * 100)::BIGINT, event_id) AS cents FROM events GROUP BY ALL")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last of rows with equal keys."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("event_id").alias("pos"))
    return last_wins(rows, ["user_id", "event_type"], "pos")


@query("SELECT o_orderpriority AS host_id, year(o_orderdate)::BIGINT AS seq, o_orderstatus AS section, count(*) AS n FROM orders GROUP BY ALL")
def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by snapshot and section."""
    from ..operators.entities import section_counts as counted

    return counted(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("host_id"), F.year("o_orderdate").cast("long").alias("seq"), F.col("o_orderstatus").alias("section")))


# --- text ----------------------------------------------------------------------------------------------------------

# The secrets' patterns as an engine of regular expressions without looking around writes them.
_SECRETS = (
    (r"(?i)\b([A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|APIKEY|API_KEY|AUTH|CREDENTIAL|PRIVATE_KEY)[A-Z0-9_]*)=([^\s;|&]+)", r"\1=<redacted>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "<redacted>"),
    (r"\bgh[opsur]_[A-Za-z0-9]{36,}\b", "<redacted>"),
    (r"(?i)(bearer)\s+([A-Za-z0-9._\-]+)", r"\1 <redacted>"),
)
_SECRETS_SQL = "{}"
for _pattern, _put in _SECRETS:
    _SECRETS_SQL = f"regexp_replace({_SECRETS_SQL}, '" + _pattern.replace("{", "{{").replace("}", "}}") + f"', '{_put}', 'g')"


@query(f"""WITH d AS (SELECT doc_id, text || chr(10) || 'MYSQL_PASSWORD=' || doc_id || ' backup.sh; Authorization: Bearer abc.' || doc_id || ' key AKIA' || lpad(doc_id::VARCHAR, 16, '0') || chr(10) || 'éAPI_TOKEN=' || doc_id || ' éAKIA' || lpad(doc_id::VARCHAR, 16, 'A') || ' xAKIA' || lpad(doc_id::VARCHAR, 16, 'A') || ' ñghp_' || repeat('a', 36) AS t FROM documents)
SELECT doc_id, sha256({_SECRETS_SQL.format("t")}) AS redacted_sha256, {_SECRETS_SQL.format("t")} <> t AS changed FROM d""")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in whole texts replaced."""
    doc_id = F.col("doc_id").cast("string")
    line = F.concat("text", F.lit("\nMYSQL_PASSWORD="), doc_id, F.lit(" backup.sh; Authorization: Bearer abc."), doc_id, F.lit(" key AKIA"), F.lpad(doc_id, 16, "0"), F.lit("\néAPI_TOKEN="), doc_id, F.lit(" éAKIA"), F.lpad(doc_id, 16, "A"), F.lit(" xAKIA"), F.lpad(doc_id, 16, "A"), F.lit(" ñghp_" + "a" * 36))
    rows = table(spark, sf, "documents").select("doc_id", line.alias("t")).withColumn("r", redact.redacted(F.col("t")))
    return rows.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), (F.col("r") != F.col("t")).alias("changed"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(lower(p_brand) || ',rw,CRED=' || p_size || ',password=x,nosuid,' || p_type, ','), lambda x: lower(split_part(x, '=', 1)) NOT IN ('password', 'credentials', 'cred'))), ',') AS options FROM part")
def mount_options(spark: SparkSession, sf: str) -> DataFrame:
    """Mount options without credentials, sorted."""
    o = F.concat(F.lower("p_brand"), F.lit(",rw,CRED="), F.col("p_size").cast("string"), F.lit(",password=x,nosuid,"), "p_type")
    return table(spark, sf, "part").select("p_partkey", redact.mount_options(o).alias("options"))


@query("SELECT p_partkey, NOT (regexp_matches(p_name, '^[^/]*a[^/]*[0-9]$') OR regexp_matches(p_name, '^[^/]art[^/]*[^1-5]$')) AS kept FROM part")
def glob_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Names that match no ignored pattern."""
    return table(spark, sf, "part").select("p_partkey", (~text.matches_any(F.col("p_name"), ["*a*[0-9]", "?art*[^1-5]"])).alias("kept"))


@query("""SELECT event_id, sha256('{"a":{"n":' || event_id % 7 || ',"x":[' || event_id * 1000 || ',null,' || event_id || '.5]},"k":' || regexp_extract(props, '[0-9]+') || ',"t":"1.0E3 x"}') AS hash FROM events""")
def canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of canonical JSON: keys out of order, spaces, exponents, and zeros at the end of fractions."""
    k = F.col("event_id").cast("string")
    raw = F.concat(F.lit('{ "t": "1.0E3 x", "a": {"x": [ '), k, F.lit("e3, null, "), k, F.lit('.50], "n": '), (F.col("event_id") % 7).cast("string"), F.lit(".0}, "), F.expr("substring(props, 2)"))
    return table(spark, sf, "events").select("event_id", canon.document_hash(raw).alias("hash"))


@query("SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE::VARCHAR AS day FROM events WHERE ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' >= TIMESTAMP '2024-01-10' AND ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' < TIMESTAMP '2024-01-12'")
def tz_window(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a zone, shown in it."""
    ts, zone = F.col("ts").cast("timestamp"), "America/Los_Angeles"
    rows = table(spark, sf, "events").where(text.in_days(ts, "2024-01-10", "2024-01-11", zone))
    return rows.select("event_id", F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd").alias("day"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'daily' ELSE c_custkey || '+1h' END AS schedule, CASE WHEN c_custkey % 3 = 0 THEN 'u' ELSE c_name || '.service' END AS unit, '"' || c_name || '@T@\"\\' || '"' AS label FROM customer""")
def timer_display(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules and units that timers fall back to, and quoted labels."""
    k = F.col("c_custkey").cast("string")
    schedule = text.timer_schedule(F.when(F.col("c_custkey") % 4 == 0, "daily").otherwise(""), k, F.lit("1h"))
    unit = text.timer_unit(F.when(F.col("c_custkey") % 3 == 0, "u").otherwise(""), F.concat(F.lit("/etc/systemd/"), "c_name", F.lit(".timer")))
    return table(spark, sf, "customer").select("c_custkey", schedule.alias("schedule"), unit.alias("unit"), text.quoted(F.concat("c_name", F.lit('@T@"\\'))).alias("label"))


# --- parsers -------------------------------------------------------------------------------------------------------


PER_FILE = 1000  # keys of a table that one raw file holds, so that files grow in number and not in length


def files(rows: DataFrame, path: str | Column, line: Column, by: str, order: str, header: str = "") -> DataFrame:
    """A raw file for each value of by and block of keys, a line for each of its rows."""
    host = F.concat(F.col(by).cast("string"), F.lit("-"), F.expr(f"{order} div {PER_FILE}").cast("string"))
    made = rows.groupBy(host.alias("host_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return made.select("host_id", F.lit(0).alias("ts"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.concat(F.lit(header), "content").alias("content"))


@query("SELECT c_nationkey || '-' || c_custkey // 1000 AS host_id, c_name AS name, c_custkey AS uid, c_nationkey::BIGINT AS gid, '' AS gecos, '/home/' || c_name AS home, '/bin/' || lower(c_mktsegment) AS shell FROM customer WHERE c_custkey % 7 <> 0")
def parse_passwd(spark: SparkSession, sf: str) -> DataFrame:
    """passwd lines, some of them comments or short."""
    k = F.col("c_custkey").cast("string")
    line = F.concat(F.when(F.col("c_custkey") % 7 == 0, F.when(F.col("c_custkey") % 2 == 0, "#").otherwise("x:")).otherwise(""), "c_name", F.when(F.col("c_custkey") % 7 == 0, ":short").otherwise(F.concat(F.lit(":x:"), k, F.lit(":"), F.col("c_nationkey").cast("string"), F.lit("::/home/"), "c_name", F.lit(":/bin/"), F.lower("c_mktsegment"))))
    return parsers.users(files(table(spark, sf, "customer"), "/etc/passwd", line, "c_nationkey", "c_custkey")).drop("ts", "pos")


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS host_id, s_name AS name, s_suppkey AS gid, array_to_string(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE ['a' || s_suppkey, 'root', 'z'] END, ',') AS members FROM supplier")
def parse_group(spark: SparkSession, sf: str) -> DataFrame:
    """group lines, members sorted."""
    k = F.col("s_suppkey").cast("string")
    line = F.concat("s_name", F.lit(":x:"), k, F.lit(":"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("z, root,a"), k, F.lit(","))))
    rows = parsers.groups(files(table(spark, sf, "supplier"), "/etc/group", line, "s_nationkey", "s_suppkey"))
    return rows.select("host_id", "name", "gid", F.array_join("members", ",").alias("members"))


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS host_id, s_suppkey % 60 || ' 1 * * *' AS schedule, 'root' AS \"user\", 'API_TOKEN=<redacted> run ' || s_name AS command FROM supplier WHERE s_suppkey % 5 > 1 UNION ALL SELECT s_nationkey || '-' || s_suppkey // 1000, '@daily', 'u' || s_suppkey, 'run ' || s_name FROM supplier WHERE s_suppkey % 5 = 1")
def parse_cron(spark: SparkSession, sf: str) -> DataFrame:
    """crontab lines with users, assignments left out, secrets redacted."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    line = F.when(k % 5 == 0, F.concat(F.lit("PATH=/bin"), s)).when(k % 5 == 1, F.concat(F.lit("@daily\tu"), s, F.lit("  run "), "s_name")).otherwise(F.concat((k % 60).cast("string"), F.lit("  1 * * * root API_TOKEN=abc run "), "s_name"))
    return parsers.cron_jobs(files(table(spark, sf, "supplier"), "/etc/crontab", line, "s_nationkey", "s_suppkey")).drop("ts", "pos", "source")


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS host_id, '/dev/sd' || s_suppkey AS source, '/mnt/a ' || s_name AS mount_point, 'ext4' AS fs_type, 'relatime,rw' AS mount_options, 'rw,seclabel' AS super_options FROM supplier WHERE s_suppkey % 4 <> 0")
def parse_mountinfo(spark: SparkSession, sf: str) -> DataFrame:
    """Mount table lines with optional fields, escapes and credentials; kernel file systems left out."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    line = F.when(k % 4 == 0, F.concat(F.lit("26 1 0:22 / /proc rw,nosuid - proc proc rw"))).otherwise(
        F.concat(F.lit("26 1 254:0 / /mnt/a\\040"), F.col("s_name"), F.lit(" rw,relatime "), F.when(k % 2 == 0, "shared:1 master:2 ").otherwise("shared:1 "), F.lit("- ext4 /dev/sd"), s, F.lit(" rw,password=x,seclabel"))
    )
    rows = parsers.mounts(files(table(spark, sf, "supplier"), "/proc/self/mountinfo", line, "s_nationkey", "s_suppkey"))
    return parsers.audit_mounts(rows).drop("ts", "pos")


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS host_id, 'm' || s_suppkey AS name, (s_suppkey * 4096)::DECIMAL(20,0)::VARCHAR AS size, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'a,b' END AS dependencies FROM supplier")
def parse_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Module lines with sorted dependencies."""
    k = F.col("s_suppkey")
    line = F.concat(F.lit("m"), k.cast("string"), F.lit(" "), (k * 4096).cast("string"), F.lit(" 2 "), F.when(k % 2 == 0, "-").otherwise("b,a,"), F.lit(" Live 0x0"))
    rows = parsers.modules(files(table(spark, sf, "supplier"), "/proc/modules", line, "s_nationkey", "s_suppkey"))
    return rows.select("host_id", "name", F.col("size").cast("string").alias("size"), F.array_join("dependencies", ",").alias("dependencies"))


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS host_id, CASE WHEN s_suppkey % 9 = 0 THEN '0.0.0.0/0' ELSE '10.0.' || s_suppkey % 256 || '.0/24' END AS destination, CASE WHEN s_suppkey % 2 = 0 THEN '10.0.0.1' ELSE '' END AS gateway, 'eth' || s_suppkey % 4 AS device, 'dhcp' AS protocol, s_suppkey AS metric FROM supplier")
def parse_route(spark: SparkSession, sf: str) -> DataFrame:
    """Route lines by their keywords."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    line = F.concat(F.when(k % 9 == 0, "default").otherwise(F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".0/24"))), F.when(k % 2 == 0, " via 10.0.0.1").otherwise(""), F.lit(" dev eth"), (k % 4).cast("string"), F.lit(" proto dhcp metric "), s)
    return parsers.routes(files(table(spark, sf, "supplier"), "ip-route", line, "s_nationkey", "s_suppkey")).drop("ts", "pos")


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS host_id, s_suppkey % 60000 AS port, 'tcp' AS protocol, '127.0.' || (s_suppkey // 256) % 256 || '.' || s_suppkey % 256 AS address, s_suppkey AS inode FROM supplier WHERE s_suppkey % 3 = 0")
def parse_socket_hex(spark: SparkSession, sf: str) -> DataFrame:
    """Listening sockets with hexadecimal addresses."""
    k = F.col("s_suppkey")
    byte = lambda v: F.lpad(F.hex(v % 256), 2, "0")
    address = F.concat(byte(k), byte(F.floor(k / 256)), F.lit("007F:"), F.lpad(F.hex(k % 60000), 4, "0"))
    line = F.concat(F.lit("  1: "), address, F.lit(" 00000000:0000 "), F.when(k % 3 == 0, "0A").otherwise("01"), F.lit(" 00000000:00000000 00:00000000 00000000     0        0 "), k.cast("string"), F.lit(" 1 0"))
    return parsers.listening_ports(files(table(spark, sf, "supplier"), "/proc/net/tcp", line, "s_nationkey", "s_suppkey", "  sl  local\n")).drop("ts", "pos")


@query("SELECT s_nationkey::VARCHAR AS host_id, 'ip' AS proto, count(*)::VARCHAR AS n, sum(s_suppkey)::VARCHAR AS total, '0' AS bad FROM supplier GROUP BY ALL")
def parse_snmp(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of name and value lines as counters; what is no number is 0."""
    rows = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("host_id")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("t"))
    content = F.concat(F.lit("Ip: N Total Bad\nIp: "), F.col("n").cast("string"), F.lit(" "), F.col("t").cast("string"), F.lit(" -1\nIcmp: X\nIcmp: 1"))
    found = parsers.kernel_counters(rows.select("host_id", F.lit(0).alias("ts"), F.lit("/proc/net/snmp").alias("path"), content.alias("content")))
    value = lambda k: F.element_at("counters", F.lit(k)).cast("string")
    return found.select("host_id", "proto", value("N").alias("n"), value("Total").alias("total"), value("Bad").alias("bad"))


@query("SELECT doc_id, 'ssh-ed25519' AS type, 'SHA256:' || rtrim(to_base64(unhex(sha256(text))), '=') AS fingerprint, CASE WHEN doc_id % 2 = 0 THEN 'command=\"a b\"' ELSE '' END AS options, 'c' || doc_id AS comment FROM documents WHERE doc_id % 5 <> 0")
def ssh_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of key bodies; lines without a body that is base64 are left out."""
    k = F.col("doc_id").cast("string")
    body = F.when(F.col("doc_id") % 5 == 0, "***").otherwise(F.replace(F.base64("text"), F.lit("\r\n"), F.lit("")))
    line = F.concat(F.when(F.col("doc_id") % 2 == 0, 'command="a b" ').otherwise(""), F.lit("ssh-ed25519 "), body, F.lit(" c"), k)
    rows = table(spark, sf, "documents").select(k.alias("host_id"), F.lit(0).alias("ts"), F.lit("u").alias("user"), F.lit("f").alias("path"), line.alias("content"))
    return parsers.ssh_keys(rows).select(F.col("host_id").cast("long").alias("doc_id"), "type", "fingerprint", "options", "comment")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '224.0.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 END AS v4, port FROM (SELECT c_custkey, c_custkey % 65536 AS port FROM customer)")
def parse_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses and ports as the kernel prints them."""
    k = F.col("c_custkey")
    byte = lambda v: F.lpad(F.hex(v % 256), 2, "0")
    hex8 = F.concat(byte(k), byte(F.floor(k / 256)), F.lit("00E0"))
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 2 == 0, net.igmp_address(hex8)).alias("v4"), net.socket_port(F.concat(F.lit("00:"), F.hex(k % 65536))).alias("port"))
