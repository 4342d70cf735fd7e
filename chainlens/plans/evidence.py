"""Raw files made from the driver's tables, and the operators from raw file to document; bundles, rules and documents as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import collect, diff, entities, history, inventory, parsers, rules, sections, verify
from ..sources import snapshots as source
from ..sources import store
from .queries import chained, files, query, scratch, table

_HOST = "s_nationkey || '-' || s_suppkey // 1000"


def _k() -> Column:
    return F.col("s_suppkey")


def _s() -> Column:
    return _k().cast("string")


def _suppliers(spark: SparkSession, sf: str, path: str | Column, line: Column, header: str = "") -> DataFrame:
    return files(table(spark, sf, "supplier"), path, line, "s_nationkey", "s_suppkey", header)


def _own_files(spark: SparkSession, sf: str, path: Column, content: Column) -> DataFrame:
    """A raw file for each supplier; hosts are nations."""
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("host_id"), F.lit(0).alias("ts"), path.alias("path"), content.alias("content"))


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query(f"""SELECT {_HOST} AS host_id, CASE WHEN s_suppkey % 2 = 0 THEN '/etc/sudoers' ELSE '/etc/sudoers.d/a' END AS source, 'u' || s_suppkey || ' ALL=(ALL) ' || s_name AS line FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 6""")
def parse_sudoers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines folded at a backslash, comments and blanks left out, drop-in files with a dot or a tilde not read."""
    line = F.when(_k() % 5 == 0, _cat("# ", F.col("s_name"))).otherwise(_cat("  u", _s(), "\tALL=(ALL) \\\n   ", F.col("s_name")))
    path = F.when(F.col("side") == 6, "/etc/sudoers.d/a.bak").when(F.col("even") == 0, "/etc/sudoers").otherwise("/etc/sudoers.d/a")
    rows = table(spark, sf, "supplier").withColumn("even", _k() % 2).withColumn("side", _k() % 7).withColumn("path", path)
    made = rows.groupBy(_cat(F.col("s_nationkey").cast("string"), "-", F.expr("s_suppkey div 1000").cast("string")).alias("host_id"), "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return parsers.sudoers(made.withColumn("ts", F.lit(0))).select("host_id", "source", "line")


@query("""SELECT s_nationkey::VARCHAR AS host_id, '/etc/systemd/system/t' || s_suppkey || '.timer' AS unit_file, 'D ' || s_name AS description, CASE WHEN s_suppkey % 2 = 0 THEN 'weekly' ELSE '' END AS on_calendar, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey || 'min' ELSE '' END AS on_boot_sec, '' AS unit
FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0""")
def parse_timers(spark: SparkSession, sf: str) -> DataFrame:
    """Timer units: keys by section, the last value of a key, comments; files without [Timer] and saved copies left out."""
    body = F.when(_k() % 2 == 0, "OnCalendar=daily\n;OnCalendar=x\nOnCalendar = weekly\n").otherwise(_cat("OnBootSec=", _s(), "min\n"))
    content = _cat("[Unit]\nDescription=D ", F.col("s_name"), "\nOnCalendar=never\n", F.when(_k() % 3 == 0, "").otherwise(_cat("[Timer]\n# no\n", body)))
    path = _cat("/etc/systemd/system/", F.when(_k() % 5 == 0, ".").otherwise(""), "t", _s(), ".timer")
    rows = parsers.timers(_own_files(spark, sf, path, content))
    return rows.select("host_id", "unit_file", "description", "on_calendar", "on_boot_sec", "unit")


@query(f"""SELECT {_HOST} AS host_id, string_agg('10.0.' || s_suppkey || '.1', ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 0) AS nameservers, string_agg('a' || s_suppkey || '.example,b.example', ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 1) AS search_domains FROM supplier GROUP BY ALL""")
def parse_dns(spark: SparkSession, sf: str) -> DataFrame:
    """Name servers and search domains in the order of their lines."""
    line = F.when(_k() % 2 == 0, _cat("nameserver 10.0.", _s(), ".1\n; no")).otherwise(_cat("search  a", _s(), ".example b.example"))
    rows = parsers.dns(_suppliers(spark, sf, "/etc/resolv.conf", line, "# made\n"))
    some = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return rows.select("host_id", some("nameservers").alias("nameservers"), some("search_domains").alias("search_domains"))


@query("SELECT s_nationkey::VARCHAR AS host_id, 'net.ipv4.x' || s_suppkey AS param, s_name AS value FROM supplier")
def parse_sysctl(spark: SparkSession, sf: str) -> DataFrame:
    """Kernel parameters, a file each, named by their paths."""
    rows = parsers.kernel_params(_own_files(spark, sf, _cat("/proc/sys/net/ipv4/x", _s()), _cat(F.col("s_name"), "\n")))
    return rows.select("host_id", F.explode("kernel_params").alias("param", "value"))


@query(f"""WITH d AS (SELECT {_HOST} AS host_id, s_suppkey AS k, s_name AS n, s_nationkey % 2 = 0 AS deb FROM supplier)
SELECT host_id, 'p' || k AS name, CASE WHEN deb THEN 'd' ELSE 'r' END || n AS version FROM d WHERE k % 4 <> 3""")
def parse_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Package listings: dpkg's counts where there is one, rpm's elsewhere; ignored names and short lines left out."""
    line = lambda tag: F.when(_k() % 4 == 3, F.when(_k() % 8 == 3, _cat("short", _s())).otherwise(_cat("ignored", _s(), "\t1"))).otherwise(_cat("p", _s(), "\t", tag, F.col("s_name")))
    even = table(spark, sf, "supplier").where("s_nationkey % 2 = 0")
    both = files(even, "dpkg-query", line("d"), "s_nationkey", "s_suppkey").unionByName(_suppliers(spark, sf, "rpm", line("r")))
    return parsers.packages(both, ["ignored*"]).select("host_id", "name", "version")


@query(f"SELECT {_HOST} AS host_id, 'svc' || s_suppkey || '.service' AS unit, CASE WHEN s_suppkey % 2 = 0 THEN 'active (running)' ELSE 'failed (dead)' END AS state FROM supplier WHERE s_suppkey % 5 <> 0")
def parse_services(spark: SparkSession, sf: str) -> DataFrame:
    """Unit listings."""
    line = F.when(_k() % 5 == 0, "too short").otherwise(_cat("  svc", _s(), ".service loaded ", F.when(_k() % 2 == 0, "active running").otherwise("failed dead"), " Some words"))
    return parsers.services(_suppliers(spark, sf, "units", line)).select("host_id", "unit", "state")


@query(f"""WITH l AS (SELECT {_HOST} AS host_id, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'ESTABLISHED' ELSE 'SYN_SENT' END AS state, s_suppkey % 4 AS r, CASE WHEN s_suppkey % 2 = 0 THEN 'p' || s_suppkey % 8 ELSE '' END AS process FROM supplier WHERE s_suppkey % 3 < 2)
SELECT host_id, state, process, '127.0.0.' || r AS remote_addr, 80 + r AS remote_port, 'tcp' AS protocol, min(k) % 60000 AS local_port FROM l GROUP BY ALL""")
def parse_connections(spark: SparkSession, sf: str) -> DataFrame:
    """Connections with their processes, of those to one remote end in one state the first."""
    line = _cat("  1: 0100007F:", F.lpad(F.hex(_k() % 60000), 4, "0"), " ", F.lpad(F.hex(_k() % 4), 2, "0"), "00007F:", F.lpad(F.hex(80 + _k() % 4), 4, "0"), F.when(_k() % 3 == 0, " 01").when(_k() % 3 == 1, " 02").otherwise(" 06"), " 0:0 00:0 0 0 0 ", _s(), " 1")
    host = _cat(F.col("s_nationkey").cast("string"), "-", F.expr("s_suppkey div 1000").cast("string"))
    owners = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(host.alias("host_id"), F.lit(0).alias("ts"), _k().alias("inode"), _cat("p", (_k() % 8).cast("string")).alias("process"), F.lit(0).alias("pos"))
    late = owners.withColumn("process", F.lit("late")).withColumn("pos", F.lit(1))
    rows = parsers.connections(_suppliers(spark, sf, "/proc/net/tcp", line, "  sl\n"), owners.unionByName(late))
    return rows.select("host_id", "state", "process", "remote_addr", "remote_port", "protocol", "local_port")


@query(f"""SELECT {_HOST} AS host_id, 'eth' || s_suppkey AS interface, '224.0.0.' || s_suppkey % 256 AS "group" FROM supplier
UNION ALL SELECT {_HOST}, 'eth' || s_suppkey, 'ff02::' || CASE WHEN s_suppkey = 0 THEN '' ELSE printf('%x', s_suppkey % 65536) END FROM supplier WHERE s_suppkey % 65536 <> 0 OR s_suppkey = 0""")
def parse_multicast(spark: SparkSession, sf: str) -> DataFrame:
    """IPv4 groups below their interface's line, and IPv6 ones."""
    four = _cat(_s(), "\teth", _s(), "      :     1      V3\n\t\t\t\t", F.lpad(F.hex(_k() % 256), 2, "0"), "0000E0     1 0:00000000\t\t0")
    six = F.when((_k() % 65536 != 0) | (_k() == 0), _cat(_s(), "    eth", _s(), "            ff020000000000000000000000", F.lpad(F.lower(F.hex(_k() % 65536)), 6, "0"), "     1 0000000C 0")).otherwise("x")
    rows = _suppliers(spark, sf, "/proc/net/igmp", four, "Idx\tDevice\n").unionByName(_suppliers(spark, sf, "/proc/net/igmp6", six))
    return parsers.multicast_groups(rows).select("host_id", "interface", "group")


@query("""SELECT s_nationkey::VARCHAR || '-' || s_suppkey AS host_id, s_suppkey::VARCHAR AS user_ticks, CASE WHEN s_suppkey % 4 = 0 THEN '0' ELSE '18446744073709551615' END AS idle, '0' AS guest, false AS short FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_nationkey::VARCHAR || '-' || s_suppkey, NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 3 = 0""")
def parse_cpu(spark: SparkSession, sf: str) -> DataFrame:
    """The cpu line's ticks, bad ones 0; hosts whose line is too short are reported."""
    rows = table(spark, sf, "supplier").select(_cat(F.col("s_nationkey").cast("string"), "-", _s()).alias("host_id"), F.lit(0).alias("ts"), F.lit("/proc/stat").alias("path"), F.when(_k() % 3 == 0, "cpu  1 2 3\ncpu0 1 2 3 4").otherwise(_cat("cpu  ", _s(), " 2 3 ", F.when(_k() % 4 == 0, "-1").otherwise("18446744073709551615"), " 5\ncpu0 9 9 9 9 9")).alias("content"))
    found = parsers.cpu(rows).select("host_id", *[F.col(c).cast("string").alias(n) for c, n in (("user", "user_ticks"), ("idle", "idle"), ("guest", "guest"))], F.lit(False).alias("short"))
    bad = parsers.short_cpu(rows).select("host_id", *[F.lit(None).cast("string").alias(n) for n in ("user_ticks", "idle", "guest")], F.lit(True).alias("short"))
    return found.unionByName(bad)


@query("""WITH p AS (SELECT s_nationkey::VARCHAR AS host_id, s_suppkey AS pid, s_name AS comm, (s_suppkey * 7) % 1000 AS rss FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT host_id, pid, 'S' AS state, rss::VARCHAR AS rss_kb, rank, total_count FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY rss DESC, pid) AS rank, count(*) OVER (PARTITION BY host_id) AS total_count FROM p) WHERE rank <= 20""")
def parse_processes(spark: SparkSession, sf: str) -> DataFrame:
    """Processes, those without a name left out: how many, and the 20 with most memory."""
    content = _cat(F.when(_k() % 4 == 0, "").otherwise(_cat("Name:\t", F.col("s_name"), "\n")), "State:\tS (sleeping)\nPPid:\t1\nVmRSS:\t   ", ((_k() * 7) % 1000).cast("string"), " kB\n")
    rows = inventory.process_totals(parsers.processes(_own_files(spark, sf, _cat("/proc/", _s(), "/status"), content)))
    return rows.select("host_id", "pid", "state", F.col("rss_kb").cast("string").alias("rss_kb"), F.col("rank").cast("long").alias("rank"), "total_count")


@query("SELECT s_nationkey::VARCHAR AS host_id, 'eth' || s_suppkey AS interface, 'ixgbe' AS driver, s_suppkey::VARCHAR AS version, s_name || ' x' AS fw_version FROM supplier WHERE s_suppkey % 3 <> 0")
def parse_nic_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """Drivers of interfaces; output without a driver left out."""
    content = _cat(F.when(_k() % 3 == 0, "").otherwise("driver: ixgbe\n"), "version: ", _s(), "\nfirmware-version: ", F.col("s_name"), " x\n")
    return parsers.nic_drivers(_own_files(spark, sf, _cat("eth", _s()), content)).select("host_id", "interface", "driver", "version", "fw_version")


@query("""SELECT 'h' || s_suppkey AS host_id, 'h' || s_suppkey AS hostname, CASE WHEN s_suppkey % 2 = 0 THEN 'OS ' || s_name ELSE 'unknown' END AS os, '5.' || s_suppkey AS kernel, CASE WHEN s_suppkey % 2 = 0 THEN 'amd64' ELSE 'riscv64' END AS arch, 'unknown' AS boot_id FROM supplier""")
def parse_host(spark: SparkSession, sf: str) -> DataFrame:
    """A host's names and versions out of several files, unknown where there is none."""
    texts = {
        "/etc/hostname": _cat("h", _s(), "\n"),
        "/etc/os-release": _cat("ID=x\n", F.when(_k() % 2 == 0, _cat('PRETTY_NAME="OS ', F.col("s_name"), '"\n')).otherwise("")),
        "/proc/version": _cat("Linux version 5.", _s(), " (x)\n"),
        "/proc/sys/kernel/arch": F.when(_k() % 2 == 0, "x86_64\n").otherwise("riscv64\n"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), c.alias("content")) for p, c in texts.items()]))
    rows = table(spark, sf, "supplier").select(_cat("h", _s()).alias("host_id"), F.lit(0).alias("ts"), each.alias("f")).select("host_id", "ts", "f.*")
    return parsers.host(rows).select("host_id", "hostname", "os", "kernel", "arch", "boot_id")


@query("""SELECT s_nationkey::VARCHAR AS host_id, 'eth' || s_suppkey AS name, 'up' AS state, CASE WHEN s_suppkey % 2 = 0 THEN 1500 ELSE 0 END AS mtu, '10.0.0.' || s_suppkey || '/24,fe80::1' AS addresses, s_suppkey::VARCHAR AS rx_bytes, '0' AS tx_bytes FROM supplier WHERE s_suppkey % 7 <> 0""")
def parse_interfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Interfaces out of one small file a value; ignored names left out."""
    name = _cat(F.when(_k() % 7 == 0, "veth").otherwise("eth"), _s())
    texts = {"operstate": F.lit("up\n"), "mtu": F.when(_k() % 2 == 0, "1500\n").otherwise("x\n"), "addresses": _cat("10.0.0.", _s(), "/24,fe80::1\n"), "statistics/rx_bytes": _cat(_s(), "\n"), "statistics/tx_bytes": F.lit("-5\n")}
    each = F.explode(F.array(*[F.struct(_cat("/sys/class/net/", name, f"/{p}").alias("path"), c.alias("content")) for p, c in texts.items()]))
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("host_id"), F.lit(0).alias("ts"), each.alias("f")).select("host_id", "ts", "f.*")
    found = parsers.interfaces(rows, ["veth*"])
    return found.select("host_id", "name", "state", "mtu", F.array_join("addresses", ",").alias("addresses"), F.col("stats.rx_bytes").cast("string").alias("rx_bytes"), F.col("stats.tx_bytes").cast("string").alias("tx_bytes"))


@query("""WITH u AS (SELECT s_nationkey::VARCHAR AS host_id, s_name AS name, '/home/' || s_suppkey // 2 AS home, s_suppkey // 2 AS k FROM supplier)
SELECT host_id, min(name) AS "user", home || '/.ssh/authorized_keys' AS path FROM u WHERE k % 3 <> 0 GROUP BY host_id, home, k""")
def key_file_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Key files of homes, each read once for its first user by name."""
    s = table(spark, sf, "supplier")
    home = _cat("/home/", F.expr("s_suppkey div 2").cast("string"))
    users = s.select(F.col("s_nationkey").cast("string").alias("host_id"), F.lit(0).alias("ts"), F.col("s_name").alias("name"), home.alias("home"))
    raw = s.where("(s_suppkey div 2) % 3 <> 0").select(F.col("s_nationkey").cast("string").alias("host_id"), F.lit(0).alias("ts"), _cat(home, "/.ssh/authorized_keys").alias("path"), F.lit("k").alias("content")).distinct()
    return inventory.key_owners(users, raw).select("host_id", "user", "path")


@query(f"SELECT {_HOST} AS host_id, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0")
def groups_with_members(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that have members."""
    line = _cat(F.col("s_name"), ":x:", _s(), ":", F.when(_k() % 3 == 0, "a,b").otherwise(" , "))
    return inventory.with_members(parsers.groups(_suppliers(spark, sf, "/etc/group", line))).select("host_id", "name")


@query(r"SELECT p_partkey, p_name, NOT (p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR strpos(p_name, '.') > 0) AS dropin, NOT (p_partkey % 4 IN (0, 1, 2)) AS unit FROM part")
def file_name_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Which files of a drop-in folder and which units are read, by their names."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, _cat(".", F.col("p_name"))).when(k == 1, _cat(F.col("p_name"), "~")).otherwise(F.col("p_name"))
    unit = F.when(k == 2, _cat(F.col("p_name"), ".rpmsave")).otherwise(name)
    return table(spark, sf, "part").select("p_partkey", "p_name", (~parsers.skipped_dropin(name)).alias("dropin"), (~parsers.skipped_unit(unit)).alias("unit"))


_EVIDENCE = """u AS (SELECT c_nationkey || '-' || c_custkey // 1000 AS h, c_custkey AS k, c_name AS n FROM customer)"""


@query(f"""WITH {_EVIDENCE}, t AS (SELECT h, t, count(*) FILTER (t = 0 OR k % 3 <> 0) AS users FROM u, range(2) r(t) GROUP BY ALL)
SELECT h AS host_id, t::BIGINT AS seq, users, CASE WHEN t = 0 THEN '' ELSE 'groups' END AS missing, CASE WHEN t = 0 THEN 0 ELSE (SELECT count(*) FROM u WHERE u.h = t.h AND k % 3 = 0) END AS removed FROM t""")
def raw_files_to_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files written and read, parsed, put together as documents, and compared: users go, and groups can't be read later."""
    folder = f"{scratch(spark)}/raw"
    line = _cat(F.col("c_name"), ":x:", F.col("c_custkey").cast("string"), ":1::/h:/s")
    rows = table(spark, sf, "customer")
    first = files(rows, "/etc/passwd", line, "c_nationkey", "c_custkey")
    gone = files(rows, "/etc/passwd", F.when(F.col("c_custkey") % 3 == 0, "# gone").otherwise(line), "c_nationkey", "c_custkey").withColumn("ts", F.lit(1))
    groups = first.select("host_id", "ts", F.lit("/etc/group").alias("path"), F.lit("wheel:x:10:").alias("content"))
    source.write_raw_files(first.unionByName(gone).unionByName(groups), folder)
    raw = source.read_packed_files(spark, folder)
    keys = ["host_id", "ts"]
    of = lambda path: raw.where(F.col("path") == path)
    made = collect.assembled({"users": parsers.users(of("/etc/passwd")), "groups": parsers.groups(of("/etc/group"))}, raw.select(*keys), {"users": of("/etc/passwd"), "groups": of("/etc/group")})
    stamp = _cat('{"timestamp":"2026-03-22T10:00:0', F.col("ts").cast("string"), 'Z",', F.expr("substring(document, 2)"))
    docs = made.select("host_id", F.col("ts").cast("string").alias("path"), stamp.alias("raw"))
    found = history.sequenced(source.snapshots(docs)).withColumn("seq", F.col("seq").cast("long"))
    changes = diff.consecutive(entities.entities(found, ["users"]), diff.consecutive_pairs(found))
    removed = changes.where("type = 'removed'").groupBy("host_id", F.col("pair_seq").alias("seq")).agg(F.count("*").alias("removed"))
    missing = made.select("host_id", F.col("ts").alias("seq"), F.array_join("collector_errors", ",").alias("missing"))
    return found.select("host_id", "seq", F.size("users").cast("long").alias("users")).join(missing, ["host_id", "seq"]).join(removed, ["host_id", "seq"], "left").fillna(0, ["removed"])


@query("""SELECT 's' || s_suppkey AS host_id, t::BIGINT AS seq, repeat('0', 64) AS prev_hash, s_name || t AS hostname FROM supplier, range(2) r(t)""")
def documents_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, one each, scanned again: host by the path, order by time."""
    folder = f"{scratch(spark)}/documents"
    rows = table(spark, sf, "supplier").select(_cat("s", _s()).alias("host_id"), "s_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    doc = rows.select("host_id", _cat("2026-03-2", (F.col("t") + 1).cast("string"), "T10:00:00Z").alias("timestamp"), F.lit("0" * 64).alias("prev_hash"), F.struct(_cat(F.col("s_name"), F.col("t").cast("string")).alias("hostname")).alias("host"))
    source.write_documents(doc, folder)
    found = history.sequenced(source.snapshots(source.read_documents(spark, folder)))
    return found.select("host_id", F.col("seq").cast("long").alias("seq"), "prev_hash", "host.hostname")


@query("""WITH x AS (SELECT user_id::VARCHAR AS bundle_id, count(*) AS snapshot_count FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT bundle_id, snapshot_count, snapshot_count AS rows_read, -1::BIGINT AS broken_at, '' AS mismatch FROM x""")
def bundle_write_read(spark: SparkSession, sf: str) -> DataFrame:
    """Extracts written, verified on the way, and read again."""
    folder = f"{scratch(spark)}/bundles"
    rows = chained(spark, sf).withColumnRenamed("host_id", "bundle_id").where(F.col("ts_ns") < F.expr("unix_micros(timestamp'2024-01-10') * 1000")).select("bundle_id", "ts_ns", "path", "hash", "prev_hash")
    source.write_bundles(rows, verify.manifest(rows), folder)
    back, told = source.read_bundles(spark, folder)
    found = verify.bundle_verdicts(back, told)
    return told.select("bundle_id", "snapshot_count").join(found.select("bundle_id", F.col("total").alias("rows_read"), F.col("broken_at").cast("long").alias("broken_at"), "mismatch"), "bundle_id")


_H = "s_nationkey || '-' || s_suppkey // 1000"
_TOP = "row_number() OVER (PARTITION BY h ORDER BY {} ) <= 20"
#: Of each section what an entity shows of a supplier (h, k, n: host, number, name), or of a host as a whole.
_SHOWN = {
    "users": "'uid=' || k || ' gid=1 shell=/s'", "groups": "'gid=' || k || ' members=[a,b]'", "sudoers": "'/etc/sudoers: u' || k || ' ALL=ALL'", "mounts": "'source=/dev/' || k || ' fs=ext4 opts=rw'",
    "modules": "'size=' || k || ' deps='", "cron": "'user=root schedule=\"@daily\" cmd=\"run' || k || '\"'", "timers": "'unit=t.service on_calendar=\"daily\"'",
    "ssh_keys": "'type=ssh-ed25519 comment=\"c' || k || '\" source=/home/' || k || '/.ssh/authorized_keys'", "network.routes": "'10.' || k || '.0/24 via 10.0.0.1 dev eth0'", "network.interfaces": "'up'", "kernel_params": "n",
    "packages": "n", "services": "'active (running)'", "listening_ports": "k % 60000 || CASE WHEN k % 2 = 0 THEN '/tcp c' ELSE '/udp c' END || k", "connections": "'ESTABLISHED [?] 127.0.0.1:22→127.0.0.2:' || k % 60000",
    "multicast_groups": "'eth' || k || '/224.0.0.1'", "nic_drivers": "'driver=ixgbe fw=' || n",
}
_WHOLE = {
    "host": "'h' || h || '|5.15|unknown'", "network.dns": "string_agg('1.1.1.' || k, ',' ORDER BY k) || '|b.example'", "cpu": "'1|2|3|4|5|6|7|8|9|10'", "kernel_counters.ip": "'1|2'", "kernel_counters.tcp": "'3'", "kernel_counters.udp": "'4'",
    "processes": "count(*)::VARCHAR", "sockets": "count(*) FILTER (k % 2 = 0) || '|' || count(*) FILTER (k % 2 = 1) || '|' || count(*) FILTER (k % 2 = 0)",
}
_COLLECTED = " UNION ALL ".join(
    [f"SELECT h, '{s}' AS section, false AS whole, count(*) AS n, min({x}) AS lo, max({x}) AS hi FROM d GROUP BY h" for s, x in _SHOWN.items()]
    + [f"SELECT h, '{s}', true, 1, {x}, {x} FROM d GROUP BY h" for s, x in _WHOLE.items()]
    + [f"SELECT h, '{s}', false, count(*), min(x), max(x) FROM (SELECT h, {x} AS x FROM d QUALIFY {_TOP.format(o)}) GROUP BY h" for s, x, o in (("processes", "'rss=' || k || 'kB'", "k DESC"), ("sockets", "CASE WHEN k % 2 = 0 THEN 'tcp=1 udp=0' ELSE 'tcp=0 udp=1' END", "k"))]
)


@query(f"""WITH d AS (SELECT {_H} AS h, s_suppkey AS k, s_name AS n FROM supplier)
SELECT h AS host_id, section, whole, n::BIGINT AS n, lo, hi, '' AS missing FROM ({_COLLECTED})""")
def documents_collected(spark: SparkSession, sf: str) -> DataFrame:
    """Raw evidence of all sections, one document of each host put together from it and read back: what each section shows."""
    s, k = table(spark, sf, "supplier"), _s()
    host = _cat(F.col("s_nationkey").cast("string"), "-", F.expr("s_suppkey div 1000").cast("string"))
    port = F.lpad(F.hex(_k() % 60000), 4, "0")
    socket = lambda state, inode, local, remote: _cat("  1: 0100007F:", local, " 0200007F:", remote, f" {state} 0:0 00:0 0 0 0 ", inode, " 1 0")
    inode = (_k() + 1).cast("string")
    listens = socket("0A", inode, port, F.lit("0000"))
    lists = {
        "/etc/passwd": _cat("u", k, ":x:", k, ":1::/home/", k, ":/s"), "/etc/group": _cat("g", k, ":x:", k, ":b,a"), "/etc/sudoers": _cat("u", k, "  ALL=ALL"), "/proc/self/mountinfo": _cat("26 1 254:0 / /mnt/", k, " rw shared:1 - ext4 /dev/", k, " rw"),
        "/proc/modules": _cat("m", k, " ", k, " 0 - Live 0x0"), "/etc/cron.d/x": _cat("@daily root run", k), "ip-route": _cat("10.", k, ".0/24 via 10.0.0.1 dev eth0"), "/etc/resolv.conf": _cat("nameserver 1.1.1.", k), "dpkg-query": _cat("p", k, "\t", F.col("s_name")),
        "units": _cat("svc", k, ".service loaded active running W"), "/proc/net/igmp": _cat(k, "\teth", k, " :     1      V3\n\t\t\t\t010000E0     1 0:00000000\t\t0"),
        "/proc/net/tcp": _cat(F.when(_k() % 2 == 0, _cat(listens, "\n")).otherwise(""), socket("01", F.lit("0"), F.lit("0016"), port)), "/proc/net/udp": F.when(_k() % 2 == 1, socket("07", inode, port, F.lit("0000"))).otherwise(""),
    }
    own = [
        (_cat("/etc/systemd/system/t", k, ".timer"), F.lit("[Timer]\nOnCalendar=daily\nUnit=t.service\n")), (_cat("/home/", k, "/.ssh/authorized_keys"), _cat("ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAIJ c", k)),
        (_cat("/sys/class/net/eth", k, "/operstate"), F.lit("up\n")), (_cat("/proc/sys/net/ipv4/x", k), F.col("s_name")), (_cat("/proc/", k, "/fd"), _cat("/dev/null\nsocket:[", inode, "]")),
        (_cat("/proc/", k, "/status"), _cat("Name:\tc", k, "\nState:\tS (sleeping)\nPPid:\t1\nVmRSS:\t ", k, " kB\n")), (_cat("ethtool/eth", k), _cat("driver: ixgbe\nversion: 1\nfirmware-version: ", F.col("s_name"), "\n")),
    ]
    once = {"/etc/hostname": F.concat(F.lit("h"), F.col("host_id")), "/proc/version": F.lit("Linux version 5.15 (x)"), "/proc/stat": F.lit("cpu  1 2 3 4 5 6 7 8 9 10"), "/proc/net/snmp": F.lit("Ip: A B\nIp: 1 2\nTcp: C\nTcp: 3\nUdp: D\nUdp: 4")}
    head = {"/etc/resolv.conf": "search b.example\n", "/proc/net/igmp": "Idx\n", "/proc/net/tcp": "  sl\n", "/proc/net/udp": "  sl\n"}
    each = lambda rows, of: rows.select("host_id", F.lit(0).alias("ts"), F.explode(F.array(*[F.struct((F.lit(p) if isinstance(p, str) else p).alias("path"), c.alias("content")) for p, c in of])).alias("f")).select("host_id", "ts", "f.*")
    line = F.array_sort(F.collect_list(F.struct("s_suppkey", *[c.alias(f"c{i}") for i, c in enumerate(lists.values())])))
    gathered = s.groupBy(host.alias("host_id")).agg(line.alias("every"))
    joined = [(p, F.concat(F.lit(head.get(p, "")), F.array_join(f"every.c{i}", "\n"))) for i, p in enumerate(lists)]
    raw = each(gathered, joined).unionByName(each(gathered, once.items())).unionByName(each(s.withColumn("host_id", host), own))
    folder = f"{scratch(spark)}/raw"
    source.write_raw_files(raw, folder)
    made = collect.collected(source.read_packed_files(spark, folder))
    docs = made.select("host_id", F.lit("0").alias("path"), _cat('{"timestamp":"2026-03-22T10:00:00Z",', F.expr("substring(document, 2)")).alias("raw"))
    missing = F.coalesce(F.array_join("collector_errors", ","), F.lit(""))
    read = sections.described(source.snapshots(docs), keep=["collector_errors"]).select("host_id", missing.alias("missing"), F.inline_outer("sections"))
    # Outer, since of an inner one Spark makes a filter that works out all sections once more.
    found = read.where("section is not null").select("host_id", "missing", "section", F.explode("entities").alias("e"))
    values = lambda c: F.transform(c, lambda x: x["value"].cast("string"))
    shown = F.when(F.col("e.singleton"), F.array_join(F.concat(values("e.fields"), values("e.counters")), "|")).otherwise(F.col("e.label"))
    told = found.groupBy("host_id", "section", F.col("e.singleton").alias("whole")).agg(F.count("*").alias("n"), F.min(shown).alias("lo"), F.max(shown).alias("hi"), F.first("missing").alias("missing"))
    return told


_IDS = ", ".join(f"('{r[0]}', {n})" for n, r in enumerate(rules.DEFAULTS))


@query(f"""WITH d(id, ord) AS (VALUES {_IDS}), o AS (SELECT CASE WHEN n_nationkey = 3 THEN 'R08_KERNEL_PARAM_CHANGED' ELSE n_name END AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation)
SELECT d.id, d.ord::INT AS ord, o.id IS NOT NULL AS own FROM d LEFT JOIN o USING (id) UNION ALL SELECT o.id, (p + {len(rules.DEFAULTS)})::INT, true FROM o ANTI JOIN d USING (id)""")
def rules_file(spark: SparkSession, sf: str) -> DataFrame:
    """A rules file written and read: one default replaced in its place, the others after all defaults, in the file's order."""
    path = f"{scratch(spark)}/rules"
    own = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 3, "R08_KERNEL_PARAM_CHANGED").otherwise(F.col("n_name")).alias("id"), F.lit("own").alias("name"), F.lit("").alias("description"), F.lit("low").alias("severity"), F.lit("x").alias("section"), F.lit("any").alias("change_type"), F.lit("").alias("key_pattern"), F.lit(False).alias("pro"), F.col("n_nationkey").alias("ord"))
    source.write_rules(own, path)
    return source.read_rules(spark, path).select("id", "ord", (F.col("name") == "own").alias("own"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON texts."""
    return source.as_json(table(spark, sf, "nation"))


@query("SELECT event_id, 'snap-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || sha256(props)[:6] AS id FROM events")
def snapshot_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that a retry gives again: a document's time and the start of its hash."""
    return table(spark, sf, "events").select("event_id", text.snapshot_id(F.col("ts").cast("timestamp"), F.col("props")).alias("id"))


@query("""SELECT user_id::VARCHAR AS host_id, ts::DATE::VARCHAR AS day, count(*) AS n, max(epoch_us(ts)) * 1000 AS last_ns FROM events WHERE event_id % 2 = 0 GROUP BY ALL""")
def snapshots_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots added in two goes to a table of days and buckets, one day put together again, read by host and day."""
    path = f"{scratch(spark)}/table"
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").where("event_id % 2 = 0").select("event_id", F.col("user_id").cast("string").alias("host_id"), (F.unix_micros(ts) * 1000).alias("ts_ns"), F.to_date(ts).alias("snap_date"))
    for part in (0, 1):
        store.append(rows.where(F.pmod(F.expr("event_id div 2"), F.lit(2)) == part), path)
    store.compact(spark, path, "2024-01-15")
    return store.read(spark, path).groupBy("host_id", F.col("snap_date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max("ts_ns").alias("last_ns"))


@query("""WITH m AS (SELECT s_nationkey::VARCHAR AS host_id, '/mnt/' || s_suppkey % 3 AS point, '/dev/' || s_suppkey AS source FROM supplier)
SELECT host_id, string_agg(point || ' ' || source, ',' ORDER BY point, source) AS mounts FROM (SELECT * FROM m) GROUP BY host_id""")
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of a document in the order of their values, whatever the order of what was read."""
    mount = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("host_id"), F.lit(0).alias("ts"), _cat("/mnt/", (_k() % 3).cast("string")).alias("mount_point"), _cat("/dev/", _s()).alias("source")).orderBy(F.rand(3))
    docs = collect.assembled({"mounts": mount}, mount, {"mounts": mount})
    found = docs.select("host_id", F.from_json("document", "mounts array<struct<mount_point:string,source:string>>").alias("d"))
    return found.select("host_id", F.array_join(F.transform("d.mounts", lambda m: F.concat(m["mount_point"], F.lit(" "), m["source"])), ",").alias("mounts"))
