"""Rules on changes: a table of them, what they match, and findings by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NEVER, glob_to_regex, severity_rank
from ..schema import RULE

# Id, severity, section, change type, key pattern, whether it needs the fuller set. Order counts for ties.
DEFAULTS = (
    ("R01_NEW_LISTEN_PORT", "high", "listening_ports", "added", "", False),
    ("R02_PORT_CLOSED", "medium", "listening_ports", "removed", "", False),
    ("R03_PACKAGE_ADDED", "high", "packages", "added", "", False),
    ("R04_PACKAGE_REMOVED", "medium", "packages", "removed", "", False),
    ("R05_PACKAGE_UPGRADED", "low", "packages", "modified", "", False),
    ("R06_SERVICE_STATE_CHANGE", "medium", "services", "modified", "", False),
    ("R07_SERVICE_ADDED", "high", "services", "added", "", False),
    ("R08_KERNEL_PARAM_CHANGED", "high", "kernel_params", "modified", "", False),
    ("R09_NETWORK_INTERFACE_CHANGE", "medium", "network.interfaces", "modified", "", False),
    ("R10_HOST_REBOOTED", "critical", "host", "modified", "boot_id", False),
    ("R14_USER_ADDED", "high", "users", "added", "", False),
    ("R15_USER_MODIFIED", "medium", "users", "modified", "", False),
    ("R16_SUDOERS_MODIFIED", "critical", "sudoers", "any", "", False),
    ("R19_SSH_KEY_ADDED", "critical", "ssh_keys", "added", "", False),
    ("R20_SSH_KEY_REMOVED", "medium", "ssh_keys", "removed", "", False),
    ("R21_CRON_MODIFIED", "high", "cron", "any", "", False),
    ("R22_TIMER_MODIFIED", "high", "timers", "any", "", False),
    ("R17_MODULE_LOADED", "high", "modules", "added", "", False),
    ("R18_MODULE_REMOVED", "medium", "modules", "removed", "", False),
    ("R23_MOUNT_ADDED", "high", "mounts", "added", "", False),
    ("R24_MOUNT_REMOVED", "medium", "mounts", "removed", "", False),
    ("R25_MOUNT_OPTIONS_CHANGED", "high", "mounts", "modified", "", False),
    ("R11_NIC_FIRMWARE_CHANGED", "high", "nic_drivers", "modified", "*.fw_version", True),
    ("R12_LARGE_PROCESS_RSS_GROWTH", "medium", "processes", "modified", "*.rss_kb", True),
    ("R13_NEW_HIGH_SOCKET_PROCESS", "medium", "sockets", "added", "", True),
)


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, name.partition("_")[2].replace("_", " ").lower(), "", severity, section, kind, key, pro, n) for n, (i, severity, section, kind, key, pro) in enumerate(DEFAULTS) for name in [i]]
    return spark.createDataFrame(rows, f"{RULE}, ord INT")


def overridden(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """defaults, with those of the same id replaced in place by own rules, and new ones after them."""
    n = defaults.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_n"))
    placed = own.join(defaults.select("id", F.col("ord").alias("_at")), "id", "left").join(F.broadcast(n))
    placed = placed.withColumn("ord", F.coalesce("_at", F.col("ord") + F.col("_n"))).select(*defaults.columns)
    return defaults.join(own, "id", "left_anti").unionByName(placed)


def compiled(rules: DataFrame) -> DataFrame:
    """rules with key_regex, the regular expression of each key pattern (null where there is none)."""
    patterns = {r["key_pattern"] for r in rules.select("key_pattern").distinct().collect() if r["key_pattern"]}
    regex = F.lit(None).cast("string")
    for p in sorted(patterns):
        regex = F.when(F.col("key_pattern") == p, glob_to_regex(p)).otherwise(regex)
    return rules.withColumn("key_regex", regex)


def matching(c: str = "c", r: str = "r") -> Column:
    """Whether rule r fits change c: the section by prefix, the type unless any or empty, the key by its pattern, never a counter."""
    col = lambda side, name: F.col(f"{side}.{name}")
    section = F.coalesce(col(r, "section"), F.lit(""))
    kind = F.coalesce(col(r, "change_type"), F.lit(""))
    return (
        ~col(c, "counter")
        & ((section == "") | F.startswith(col(c, "section"), section))
        & (kind.isin("", "any") | (kind == col(c, "type")))
        & (col(r, "key_regex").isNull() | F.regexp(col(c, "key"), F.coalesce(col(r, "key_regex"), F.lit(NEVER))))
    )


def findings(changes: DataFrame, rules: DataFrame, include_pro: bool = False) -> DataFrame:
    """How many changes of each pair each rule matches. Rules are a short table (hundreds), so they go to every task."""
    rules = compiled(rules.where(~F.col("pro") | F.lit(include_pro)))
    rules = F.broadcast(rules.select("id", "severity", "section", "change_type", "key_regex", "ord"))
    hit = changes.alias("c").join(rules.alias("r"), matching())
    out = hit.groupBy("c.host_id", "c.pair_seq", F.col("r.id").alias("rule_id"), "r.severity", "r.ord").agg(F.count("*").alias("matches"))
    return out.withColumn("rank", severity_rank(F.col("severity")))


def ranked(found: DataFrame) -> DataFrame:
    """findings from the most severe down, in the rules' order among equals."""
    return found.orderBy("host_id", "pair_seq", "rank", "ord")
