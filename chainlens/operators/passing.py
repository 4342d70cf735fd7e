"""Documents compared as text: what two that follow each other have in common is left out before columns are made of them."""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canon import _canonical
from ..functions.text import nanoseconds
from ..schema import SNAPSHOT
from .entities import columns_of, compared

#: Objects whose members are compared one by one, by path.
OPEN = ["network", "kernel_params", "packages", "services", "nic_drivers", "kernel_counters", "kernel_counters.ip", "kernel_counters.tcp", "kernel_counters.udp", "processes", "sockets"]
#: Of those, maps whose values must all be of one kind, as one that is not takes others of its map along.
VALUES: dict[str, type] = {"nic_drivers": dict, "kernel_counters.ip": int, "kernel_counters.tcp": int, "kernel_counters.udp": int}
#: The keys of entities, of lists by path: how they are spelled, of which fields, with what stands for a field that is missing.
KEYS: dict[str, tuple[str, list[tuple[str, str | int]]]] = {
    "network.interfaces": ("%s", [("name", "")]),
    "network.routes": ("%s dev %s", [("destination", ""), ("device", "")]),
    "listening_ports": ("%d/%s %s", [("port", 0), ("protocol", ""), ("address", "")]),
    "multicast_groups": ("%s/%s", [("interface", ""), ("group", "")]),
    "users": ("%s", [("name", "")]),
    "groups": ("%s", [("name", "")]),
    "sudoers": ("%s\t%s", [("source", ""), ("line", "")]),
    "mounts": ("%s\t%s", [("mount_point", ""), ("source", "")]),
    "modules": ("%s", [("name", "")]),
    "cron_jobs": ("%s\0%s\0%s\0%s", [("source", ""), ("user", ""), ("schedule", ""), ("command", "")]),
    "systemd_timers": ("%s", [("unit_file", "")]),
    "ssh_keys": ("%s\0%s\0%s", [("user", ""), ("type", ""), ("fingerprint", "")]),
    "processes.top_by_rss": ("%d", [("pid", 0)]),
    "sockets.top_by_count": ("%d", [("pid", 0)]),
    "connections": ("%s/%s/%s:%d", [("protocol", ""), ("process", ""), ("remote_addr", ""), ("remote_port", 0)]),
}
#: Texts in which Python's values may be equal where columns are not (true and 1, -0 and 0, halves of surrogate pairs), numbers too long for columns, or keys apart from their colons.
_ODD = r"[:,\[\s](true|false|-0)|\\u[dD]|[0-9]{1000}|\"\s+:"
_NOT_COMPARED = ("schema_version", "version", "snapshot_id", "timestamp", "prev_hash", "collector_errors")
_DEPTH, _NAME, _FIGURES = 1000, 50_000, 1000  # what Spark's JSON reader takes: levels, characters of a name, of a number


def _reader() -> Callable[[], Callable[[str, bool], tuple[bool, dict | None]]]:
    """Makes, where it runs, the function that tells whether a text is a document (as canonical JSON has it and columns can be made of it), and what it holds.

    What is told holds objects only where a snapshot has them, none with a repeated key, and no numbers but integers:
    it has as many keys at those places as its text has at most. Others are judged as canonical JSON judges them, and
    what they hold is not told.
    """
    canonical, opened, listed, depth, name, figures = _canonical(), {"", *OPEN}, {*KEYS}, _DEPTH, _NAME, _FIGURES

    def refused(token: str) -> None:
        raise ValueError(token)

    def short(token: str) -> int:
        return 0 if len(token) <= figures else refused(token)

    def keys(value: object, at: str) -> int:
        """How many keys there are at the places that objects have."""
        if type(value) is dict:
            return len(value) + (sum([keys(v, f"{at}.{k}" if at else k) for k, v in value.items() if type(v) in (dict, list)]) if at in opened else 0)
        if at not in listed or {*map(type, value)} != {dict}:
            return 0
        stats = [s for e in value if type(s := e.get("stats")) is dict] if at == "network.interfaces" else []
        return sum(map(len, value)) + sum(map(len, stats))

    def fits(level: list) -> bool:
        """Whether the reader of columns takes it: neither too deep nor with names too long."""
        for _ in range(depth):
            if any(len(k) > name for x in level if type(x) is dict for k in x):
                return False
            level = [v for x in level for v in (x.values() if type(x) is dict else x) if type(v) in (dict, list)]
            if not level:
                return True
        return False

    def reader() -> Callable[[str, bool], tuple[bool, dict | None]]:
        fractions: list[str] = []
        read = json.JSONDecoder(parse_float=fractions.append, parse_constant=refused).decode
        again = json.JSONDecoder(parse_float=short, parse_int=short).decode

        def document(raw: str, odd: bool) -> tuple[bool, dict | None]:
            fractions.clear()
            try:
                found = None if odd else read(raw)
                odd = odd or bool(fractions) or type(found) is not dict or keys(found, "") != raw.count('":')
                found = again(raw) if odd else found
            except (ValueError, RecursionError):
                return False, None
            large = len(raw) > name or raw.count("[") + (raw.count("{") if odd else 0) > depth - 5
            if type(found) is not dict or large and not fits([found]) or odd and canonical([raw])[0] is None:
                return False, None
            return True, None if odd else found

        return document

    return reader


def _lesser(wanted: list[str]) -> Callable[[dict, dict], tuple[dict, dict] | None]:
    """The function that leaves of two documents (as _reader gives them) the wanted columns, without what is the same in both; None where nothing else is left.

    Items of a list go only if each key stands once in it, as of equal keys the last counts. The host stays.
    """
    opened, values, chosen = {*OPEN}, VALUES, [c for c in wanted if c != "host"]
    keys = {at: (spelled if len(fields) > 1 else None, [(itemgetter(n), n, missing) for n, missing in fields]) for at, (spelled, fields) in KEYS.items()}

    def even(found: dict, kind: type) -> bool:
        return not {*map(type, found.values())} - {kind} and (kind is not int or all(abs(v) < 10**20 for v in found.values()))

    def keyed(items: list, at: str) -> dict | None:
        spelled, fields = keys[at]
        columns = []
        for of, name, missing in fields:
            try:
                column = [*map(of, items)]
            except (KeyError, TypeError):
                if {*map(type, items)} - {dict}:
                    return None
                column = [e.get(name, missing) for e in items]
            if {*map(type, column)} - {type(missing)} or missing == 0 and column and not -(2**63) <= min(column) <= max(column) < 2**63:
                return None
            columns.append(column)
        found = dict(zip(map(spelled.__mod__, zip(*columns)) if spelled else columns[0], items))
        return found if len(found) == len(items) else None

    def without(x: dict, y: dict) -> tuple[dict, dict] | None:
        left = {k: v for k, v in x.items() if k not in y or y[k] != v}
        right = {k: v for k, v in y.items() if k not in x or k in left}
        return (left, right) if left or right else None

    def lesser(a: object, b: object, at: str) -> tuple | None:
        """Both without what is the same; None if they are the same."""
        if a == b:
            return None
        if type(a) is not type(b):
            return a, b
        if at in keys and type(a) is list and (x := keyed(a, at)) is not None and (y := keyed(b, at)) is not None:
            rest = without(x, y)
            return rest and ([*rest[0].values()], [*rest[1].values()])
        if at not in opened or type(a) is not dict or at in values and not (even(a, values[at]) and even(b, values[at])):
            return a, b
        return members(a, b, at + ".", [*a, *(k for k in b if k not in a)]) if at in nested else without(a, b)

    def members(a: dict, b: dict, root: str, names: list[str]) -> tuple[dict, dict] | None:
        x, y = {}, {}
        for name in names:
            if name in a and name in b:
                if rest := lesser(a[name], b[name], root + name):
                    x[name], y[name] = rest
            elif name in a:
                x[name] = a[name]
            elif name in b:
                y[name] = b[name]
        return (x, y) if x or y else None

    def both(a: dict, b: dict) -> tuple[dict, dict] | None:
        hosts = [{"host": d["host"]} if "host" in d else {} for d in (a, b)]
        x, y = members(a, b, "", chosen) or ({}, {})
        return None if not x and not y and hosts[0] == hosts[1] else (hosts[0] | x, hosts[1] | y)

    nested = {"network", "kernel_counters", "processes", "sockets"}
    return both


def _following(wanted: list[str], strict: bool) -> Callable:
    """A column function of documents in each host's order: place in that order from 1, time as text, as nanoseconds, document.

    It gives a document's place among those that can be read, and it and the one before it, of which what is the same is
    left out; null for the first, and where nothing differs.
    """
    kind, odd_texts = pa.struct([("pair_seq", pa.int64()), ("o", pa.string()), ("n", pa.string())]), _ODD
    reader, lesser = _reader(), _lesser(wanted)

    @F.arrow_udf("struct<pair_seq: bigint, o: string, n: string>")
    def following(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        write = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False).encode
        document, last, seq = reader(), None, -1
        for place, text, ns, raw in batches:
            odd, out = pc.match_substring_regex(raw, odd_texts), []
            gc.disable()  # what a document is made of holds no cycles
            for n, t, at, r, o in zip(place.to_pylist(), text.to_pylist(), ns.to_pylist(), raw.to_pylist(), odd.to_pylist(), strict=True):
                if n == 1:
                    last, seq = None, -1
                pair = None
                fit, found = (False, None) if r is None or t is None else document(r, o)
                if fit:
                    if strict and at is None:
                        raise ValueError(f"no time: {t}")
                    seq += 1
                    if last is not None:
                        if found is None or last[1] is None:
                            pair = {"pair_seq": seq, "o": last[0], "n": r}
                        elif sides := lesser(last[1], found):
                            pair = {"pair_seq": seq, "o": write(sides[0]), "n": write(sides[1])}
                    last = r, found
                out.append(pair)
            gc.enable()
            yield pa.array(out, kind)

    return following.asNondeterministic()


def _time(raw: Column) -> Column:
    """The timestamp of a document as text: found at its start, where it mostly is, else read as a column."""
    start = r'^\s*\{\s*(?:"(?:schema_version|version|snapshot_id)"\s*:\s*"[^"\\]*"\s*,\s*)*"timestamp"\s*:\s*"([^"\\]*)"'
    found = F.nullif(F.regexp_extract(F.substring(raw, 1, 512), start, 1), F.lit(""))
    return F.coalesce(found, F.from_json(raw, "timestamp STRING")["timestamp"])


def consecutive(documents: DataFrame, sections: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """What sections.consecutive gives for sources.snapshots(documents), of host_id, path and raw; keep may name hostname and ts.

    Documents are sorted once by host and time, as text, and each is read once in that order; columns and entities are
    made only of what differs from the one before. Of those that can't be read none takes part. Documents that are
    already dealt by host_id are not dealt again.
    """
    order = Window.partitionBy("host_id").orderBy("ts_ns", "path")
    chosen = columns_of(sections)
    shape = StructType([c for c in StructType.fromDDL(SNAPSHOT) if c.name == "host" or (c.name in chosen if chosen else c.name not in _NOT_COMPARED)])
    strict = documents.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    rows = documents.select("host_id", "path", "raw", _time(F.col("raw")).alias("time"))
    rows = rows.withColumn("ts_ns", nanoseconds(F.col("time"), F.try_to_timestamp)).withColumn("place", F.row_number().over(order))
    pair = _following([c.name for c in shape], strict)("place", "time", "ts_ns", "raw")
    rows = rows.select("host_id", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"), pair.alias("pair")).where(F.col("pair").isNotNull())
    # From an array of one, so that the texts are not read again for each column that is asked of them.
    once = F.struct(F.from_json("pair.o", shape).alias("old"), F.from_json("pair.n", shape).alias("new"))
    rows = rows.select("host_id", "ts", "pair.pair_seq", F.inline(F.array(once)).alias("old", "new"))
    kept = {"hostname": F.col("new.host.hostname"), "ts": F.col("ts")}
    differ = rows.select("host_id", "pair_seq", *[kept[k].alias(k) for k in keep or []], F.inline(compared(sections)))
    return differ.select("host_id", "pair_seq", *(keep or []), "section", F.inline("rows"))
