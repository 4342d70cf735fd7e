"""Counts, top lists and attributions of sockets, processes and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import first_wins, last_wins


def top(rows: DataFrame, by: list[str], most: Column, tie: str, n: int = 20) -> DataFrame:
    """The n rows of each group with the greatest value, ties by another column; rank from 1."""
    order = Window.partitionBy(*by).orderBy(most.desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def process_totals(processes: DataFrame, n: int = 20) -> DataFrame:
    """Of each host and time how many processes there are, and the n of them with most memory, ties by pid."""
    key = ["host_id", "ts"]
    totals = processes.groupBy(*key).agg(F.count("*").alias("total_count"))
    return top(processes, key, F.col("rss_kb"), "pid", n).join(totals, key)


def with_members(groups: DataFrame) -> DataFrame:
    """Groups that have members."""
    return groups.where(F.size("members") > 0)


def socket_totals(sockets: DataFrame) -> DataFrame:
    """Totals of sockets (host_id, ts, proto, state, inode) that have an inode."""
    live = sockets.where("inode <> 0")
    tcp, udp = F.startswith("proto", F.lit("tcp")), F.startswith("proto", F.lit("udp"))
    return live.groupBy("host_id", "ts").agg(F.count_if(tcp).alias("total_tcp"), F.count_if(udp).alias("total_udp"), F.count_if(tcp & (F.col("state") == "0A")).alias("total_listen"))


def socket_owners(sockets: DataFrame, inodes: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    """The n processes of each host and time with most sockets: inodes (host_id, ts, inode, pid, pos) name a pid, the last
    of several; names (host_id, ts, pid, comm) its command, '' if there is none."""
    key = ["host_id", "ts"]
    owner = last_wins(inodes, [*key, "inode"], "pos")
    owned = sockets.where("inode <> 0").join(owner, [*key, "inode"]).join(names, [*key, "pid"], "left")
    counted = owned.groupBy(*key, "pid", F.coalesce("comm", F.lit("")).alias("comm")).agg(F.count_if(F.startswith("proto", F.lit("tcp"))).alias("tcp_count"), F.count_if(F.startswith("proto", F.lit("udp"))).alias("udp_count"))
    return top(counted, key, F.col("tcp_count") + F.col("udp_count"), "pid", n)


def attributed(sockets: DataFrame, inodes: DataFrame) -> DataFrame:
    """sockets with the process of their inode, the first of several, '' if there is none; inodes (host_id, ts, inode, process, pos)."""
    key = ["host_id", "ts", "inode"]
    return sockets.join(first_wins(inodes, key, "pos"), key, "left").fillna("", ["process"])


def precedence(units: DataFrame, by: list[str], path: str, first: str = "/etc/") -> DataFrame:
    """Of units with the same base name, the one whose path starts with first, else the last by path."""
    rows = units.withColumn("_base", F.substring_index(path, "/", -1)).withColumn("_rank", F.struct(F.startswith(path, F.lit(first)), F.col(path)))
    return last_wins(rows, [*by, "_base"], "_rank").drop("_base")


def key_owners(users: DataFrame, raw_files: DataFrame, names: tuple[str, ...] = ("authorized_keys", "authorized_keys2")) -> DataFrame:
    """Key files of users' homes (host_id, ts, name, home), each home read once for its first user by name."""
    homes = users.where("home <> ''").groupBy("host_id", "ts", "home").agg(F.min("name").alias("user"))
    paths = homes.withColumn("path", F.explode(F.array(*[F.concat("home", F.lit(f"/.ssh/{n}")) for n in names])))
    return raw_files.join(paths, ["host_id", "ts", "path"]).select("host_id", "ts", "user", "path", "content")
