"""Snapshots as one long table of keyed entities, so that every section is compared by one join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import bound
from ..functions.text import joined, quoted
from .diff import ROW, counted, counters_of, row

_NUMBER = "decimal(20,0)"
STATS = ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "rx_dropped", "tx_dropped")
TICKS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")
_FIELDS = "array<struct<key:string,value:string>>"
_COUNTERS = "array<struct<key:string,value:decimal(20,0)>>"
_NO_FIELDS, _NO_COUNTERS = f"cast(array() as {_FIELDS})", f"cast(array() as {_COUNTERS})"
_NO_ROWS = f"cast(array() as array<{ROW}>)"
_NONE = f"cast(array() as array<struct<section:string,ekey:string,dkey:string,label:string,singleton:boolean,fields:{_FIELDS},counters:{_COUNTERS},pos:int>>)"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("0"))


def _count(c: Column) -> Column:
    return F.coalesce(c.cast(_NUMBER), F.lit(0).cast(_NUMBER))


def _map(columns: dict[str, Column]) -> Column:
    """Names and values as an array in this order, which can be compared and hashed, as a map can't."""
    return F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in columns.items()])


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


class _Entity(NamedTuple):
    """What an entity is made of; counters that are not known by name are a column (of _COUNTERS)."""

    section: str
    key: Column
    label: Column
    shown: Column
    fields: dict[str, Column]
    counters: dict[str, Column] | Column
    singleton: bool

    def column(self, pos: Column) -> Column:
        every = lambda x, none: x if isinstance(x, Column) else _map(x) if x else F.expr(none)
        return F.struct(
            F.lit(self.section).alias("section"),
            self.key.alias("ekey"),
            self.shown.alias("dkey"),
            self.label.alias("label"),
            F.lit(self.singleton).alias("singleton"),
            every(self.fields, _NO_FIELDS).alias("fields"),
            every(self.counters, _NO_COUNTERS).alias("counters"),
            pos.cast("int").alias("pos"),
        )


def _entity(section: str, key: Column, label: Column, shown: Column | None = None, fields: dict[str, Column] | None = None, counters: dict[str, Column] | Column | None = None, singleton: bool = False) -> _Entity:
    return _Entity(section, key, label, key if shown is None else shown, fields or {}, {} if counters is None else counters, singleton)


Get = Callable[[str], Column]


class _Part(NamedTuple):
    """Entities that are made of the items of one array: the array (get gives a document's columns by path), an item's key, its entity."""

    items: Callable[[Get], Column]
    key: Callable[[Column], Column]
    entity: Callable[[Column], _Entity]
    pos: Callable[[Column], Column] = lambda i: i

    def all(self, get: Get) -> Column:
        return F.coalesce(F.transform(self.items(get), lambda e, i: self.entity(e).column(self.pos(i))), F.expr(_NONE))


def _single(path: str, section: str, key: str = "", fields: Callable[[Column], dict[str, Column]] | None = None, counters: Callable[[Column], dict[str, Column] | Column] | None = None, item: Callable[[Column], Column] = lambda c: c) -> _Part:
    def entity(e: Column) -> _Entity:
        return _entity(section, F.lit(key), F.lit(""), F.lit(""), fields and fields(e), counters and counters(e), singleton=True)

    return _Part(lambda get: F.when(get(path).isNotNull(), F.array(item(get(path)))), lambda e: F.lit(key), entity, lambda i: F.lit(0))


def _pairs(path: str, entity: Callable[[Column, Column], _Entity]) -> _Part:
    """The entities of a map, by its keys; entity is given key and value."""
    return _Part(lambda get: F.map_entries(get(path)), lambda e: e["key"], lambda e: entity(e["key"], e["value"]))


def _values(section: str) -> _Part:
    return _pairs(section, lambda k, v: _entity(section, k, _text(v), fields={"": _text(v)}))


Reader = Callable[[str], Column]
Part = Callable[[Reader, Reader, Column], Column]


def _each(section: str, path: str, key: Part, label: Part, shown: Part | None = None, fields: Callable | None = None, counters: Part | None = None) -> _Part:
    """The entities of an array of structs; key, label and so on are given an item's fields as text, as numbers, and the item."""
    give = lambda f, e: f(lambda n: _text(e[n]), lambda n: _number(e[n]), e) if f else None

    def entity(e: Column) -> _Entity:
        return _entity(section, give(key, e), give(label, e), give(shown, e), give(fields, e), give(counters, e))

    return _Part(lambda get: get(path), lambda e: give(key, e), entity)


def _route(t: Reader, n: Reader, e: Column) -> Column:
    return _line(t("destination"), F.when(t("gateway") != "", F.concat(F.lit(" via "), t("gateway"))).otherwise(""), " dev ", t("device"))


def _port(t: Reader, n: Reader, e: Column) -> Column:
    return _line(n("port"), "/", t("protocol"), F.when(t("process") != "", F.concat(F.lit(" "), t("process"))).otherwise(""))


def _group(t: Reader, n: Reader, e: Column) -> Column:
    return _line(t("interface"), "/", t("group"))


def _connection(t: Reader, n: Reader, e: Column) -> Column:
    process = F.when(t("process") != "", t("process")).otherwise("?")
    return _line(t("state"), " [", process, "] ", t("local_addr"), ":", n("local_port"), "→", t("remote_addr"), ":", n("remote_port"))


def _by_pid(t: Reader, n: Reader, e: Column) -> Column:
    return _line(n("pid"), " (", t("comm"), ")")


_built: dict[object, dict[str, list[Column]]] = {}
_compared: dict[object, dict[str, list[Column]]] = {}


def _once(built: dict[object, dict[str, list[Column]]], make: Callable[[_Part, str], Column]) -> dict[str, list[Column]]:
    """Section to what make gives for each of its parts. It takes thousands of calls, so it is made once for each driver's JVM."""
    jvm = SparkContext._gateway
    if jvm not in built:
        built.clear()
        built[jvm] = {name: [make(p, name) for p in parts] for name, parts in _made().items()}
    return built[jvm]


def _sections() -> dict[str, list[Column]]:
    """Section to arrays of its entities, over the columns of schema.SNAPSHOT."""
    return _once(_built, lambda part, name: part.all(F.col))


def _made() -> dict[str, list[_Part]]:
    """Section to the parts of its entities."""
    named = lambda t, *names: {f".{x}": t(x) for x in names}
    of = lambda name: lambda t, n, e: t(name)
    timer = ("description", "on_calendar", "on_boot_sec", "on_unit_active_sec", "on_unit_inactive_sec", "unit", "randomized_delay_sec")
    return {
        "host": [_single("host", "host", fields=lambda e: {x: _text(e[x]) for x in ("hostname", "kernel", "boot_id")})],
        "kernel_params": [_values("kernel_params")],
        "packages": [_values("packages")],
        "services": [_values("services")],
        "network.interfaces": [
            _each(
                "network.interfaces", "network.interfaces", of("name"), of("state"),
                fields=lambda t, n, e: {".state": t("state"), ".mtu": n("mtu"), ".addresses": joined(e["addresses"])},
                counters=lambda t, n, e: {f".stats.{x}": _count(e["stats"][x]) for x in STATS},
            )
        ],
        "network.routes": [_each("network.routes", "network.routes", lambda t, n, e: _line(t("destination"), " dev ", t("device")), _route)],
        "network.dns": [_single("network.dns", "network.dns", fields=lambda e: {x: joined(e[x]) for x in ("nameservers", "search_domains")})],
        "listening_ports": [_each("listening_ports", "listening_ports", lambda t, n, e: _line(n("port"), "/", t("protocol"), " ", t("address")), _port)],
        "multicast_groups": [_each("multicast_groups", "multicast_groups", _group, _group)],
        "users": [
            _each(
                "users", "users", of("name"), lambda t, n, e: _line("uid=", n("uid"), " gid=", n("gid"), " shell=", t("shell")),
                fields=lambda t, n, e: {".uid": n("uid"), ".gid": n("gid"), **named(t, "gecos", "home", "shell")},
            )
        ],
        "groups": [
            _each(
                "groups", "groups", of("name"), lambda t, n, e: _line("gid=", n("gid"), " members=[", joined(e["members"]), "]"),
                fields=lambda t, n, e: {".gid": n("gid"), ".members": joined(e["members"])},
            )
        ],
        "sudoers": [_each("sudoers", "sudoers", lambda t, n, e: _line(t("source"), "\t", t("line")), lambda t, n, e: _line(t("source"), ": ", t("line")))],
        "mounts": [
            _each(
                "mounts", "mounts", lambda t, n, e: _line(t("mount_point"), "\t", t("source")), lambda t, n, e: _line("source=", t("source"), " fs=", t("fs_type"), " opts=", t("mount_options")),
                of("mount_point"), lambda t, n, e: named(t, "fs_type", "mount_options", "super_options"),
            )
        ],
        "modules": [
            _each(
                "modules", "modules", of("name"), lambda t, n, e: _line("size=", n("size"), " deps=", joined(e["dependencies"])),
                fields=lambda t, n, e: {".size": n("size"), ".dependencies": joined(e["dependencies"])},
            )
        ],
        "cron": [
            _each(
                "cron", "cron_jobs", lambda t, n, e: F.concat_ws("\u0000", t("source"), t("user"), t("schedule"), t("command")),
                lambda t, n, e: _line("user=", t("user"), " schedule=", quoted(t("schedule")), " cmd=", quoted(t("command"))), of("source"),
            )
        ],
        "timers": [
            _each(
                "timers", "systemd_timers", of("unit_file"), lambda t, n, e: _line("unit=", t("unit"), " on_calendar=", quoted(t("on_calendar"))),
                fields=lambda t, n, e: named(t, *timer),
            )
        ],
        "ssh_keys": [
            _each(
                "ssh_keys", "ssh_keys", lambda t, n, e: F.concat_ws("\u0000", t("user"), t("type"), t("fingerprint")), lambda t, n, e: _line("type=", t("type"), " comment=", quoted(t("comment")), " source=", t("source")),
                lambda t, n, e: _line(t("user"), " ", t("fingerprint")), lambda t, n, e: named(t, "comment", "options", "source"),
            )
        ],
        "cpu": [_single("cpu", "cpu", counters=lambda e: {x: _count(e[x]) for x in TICKS})],
        **{f"kernel_counters.{p}": [_single(f"kernel_counters.{p}", f"kernel_counters.{p}", counters=lambda e: e["each"], item=lambda c: F.struct(F.map_entries(c).alias("each")))] for p in ("ip", "tcp", "udp")},
        "processes": [
            _single("processes", "processes", "\u0000", lambda e: {"total_count": _number(e["total_count"])}),
            _each("processes", "processes.top_by_rss", lambda t, n, e: n("pid"), lambda t, n, e: _line("rss=", n("rss_kb"), "kB"), _by_pid, counters=lambda t, n, e: {".rss_kb": _count(e["rss_kb"])}),
        ],
        "sockets": [
            _single("sockets", "sockets", "\u0000", counters=lambda e: {x: _count(e[x]) for x in ("total_tcp", "total_udp", "total_listen")}),
            _each("sockets", "sockets.top_by_count", lambda t, n, e: n("pid"), lambda t, n, e: _line("tcp=", n("tcp_count"), " udp=", n("udp_count")), _by_pid),
        ],
        "connections": [_each("connections", "connections", lambda t, n, e: _line(t("protocol"), "/", t("process"), "/", t("remote_addr"), ":", n("remote_port")), _connection)],
        "nic_drivers": [
            _pairs(
                "nic_drivers",
                lambda k, v: _entity("nic_drivers", k, _line("driver=", _text(v["driver"]), " fw=", _text(v["fw_version"])), fields={f".{x}": _text(v[x]) for x in ("driver", "fw_version")}),
            )
        ],
    }


def last_wins(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Of rows with equal keys, the one with the greatest position."""
    rest = [c for c in rows.columns if c not in key and c != position]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(*key, "r.*")


def first_wins(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key and c != position]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), position).alias("r")).select(*key, "r.*")


def entities(snapshots: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """All entities of snapshots (host_id, seq and the sections of schema.SNAPSHOT); sections selects some, none is all.

    A row's entities are one array, so each snapshot is read once, whatever the number of sections, and what is not
    selected is not read. Of entities with equal keys the last in its section stands.
    """
    parts = [x for name, xs in _sections().items() if not sections or name in sections for x in xs]
    rows = snapshots.select("host_id", "seq", F.explode(F.concat(*parts)).alias("e")).select("host_id", "seq", "e.*")
    rows = last_wins(rows, ["host_id", "seq", "section", "ekey"], "pos")
    return rows.withColumn("fields", F.map_from_entries("fields")).withColumn("counters", F.map_from_entries("counters"))


def _last(found: Column, keys: Column) -> Column:
    """Of items with equal keys only the last, the others in their order."""

    def some(both: Column) -> Column:
        pairs = F.array_sort(F.transform(both["keys"], lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        ends = lambda every: F.filter(every, lambda k, j: ~k["k"].eqNullSafe(F.get(every, j + 1)["k"]))
        kept = bound(pairs, lambda every: F.array_sort(F.transform(ends(every), lambda k: k["i"])))
        once = F.size(F.array_distinct(both["keys"])) == F.size(both["keys"])
        return F.when(once, both["found"]).otherwise(F.transform(kept, lambda i: F.get(both["found"], i)))

    return bound(F.struct(found.alias("found"), keys.alias("keys")), some)


def listed(sections: list[str] | None = None) -> Column:
    """An array of section and its entities, over the columns of schema.SNAPSHOT, of equal keys only the last; none without entities.

    An entity is ekey, dkey, label, singleton, fields and counters; arrays of it can be compared and hashed.
    """
    names = ("ekey", "dkey", "label", "singleton", "fields", "counters")
    last = lambda found: _last(found, F.transform(found, lambda e: e["ekey"]))
    parts = [F.struct(F.lit(name).alias("section"), F.concat(*xs).alias("found")) for name, xs in _sections().items() if not sections or name in sections]
    there = F.filter(F.array(*parts), lambda s: F.size(s["found"]) > 0)
    return F.transform(there, lambda s: F.struct(s["section"].alias("section"), F.transform(last(s["found"]), lambda e: F.struct(*[e[n].alias(n) for n in names])).alias("entities")))


def compared(sections: list[str] | None = None) -> Column:
    """The rows of what differs between the structs old and new (of columns of schema.SNAPSHOT): an array of section and what diff.row has.

    Items are compared as they are, by key, of equal keys the last; of those that differ only what their rows say is made.
    """
    get = lambda root: lambda path: reduce(lambda c, name: c[name], path.split("."), F.col(root))

    def rows(part: _Part, e: Column) -> Column:
        o, n = part.entity(e["o"]), part.entity(e["n"])
        single = o.singleton
        value = lambda side, text: F.when(e[side].isNotNull(), text).otherwise("") if single else text
        fields = [(x, value("o", o.fields[x]), value("n", n.fields[x])) for x in o.fields]
        modified = [F.when(a != b, row("modified", F.concat(o.shown, F.lit(x)), a, b)) for x, a, b in fields]
        if isinstance(o.counters, Column):
            changed = counters_of(F.lit(""), F.map_from_entries(o.counters), F.map_from_entries(n.counters))
        else:
            modified += [F.when(o.counters[x] != n.counters[x], counted(F.concat(o.shown, F.lit(x)), o.counters[x], n.counters[x])) for x in o.counters]
            changed = F.array_compact(F.array(*modified)) if modified else F.expr(_NO_ROWS)
        if single:
            return changed
        removed, added = row("removed", o.shown, o.label, F.lit("")), row("added", n.shown, F.lit(""), n.label)
        return F.when(e["n"].isNull(), F.array(removed)).when(e["o"].isNull(), F.array(added)).otherwise(changed)

    def differing(part: _Part, name: str) -> Column:
        def by_key(items: Column) -> Column:
            return bound(_last(items, F.transform(items, part.key)), lambda kept: F.map_from_arrays(F.transform(kept, part.key), kept))

        def met(both: Column) -> Column:
            every = F.map_zip_with(by_key(both["o"]), by_key(both["n"]), lambda k, o, n: F.struct(o.alias("o"), n.alias("n")))
            some = F.filter(F.map_values(every), lambda e: ~e["o"].eqNullSafe(e["n"]))
            return F.struct(F.lit(name).alias("section"), F.flatten(F.transform(some, lambda e: rows(part, e))).alias("rows"))

        items = lambda root: F.coalesce(part.items(get(root)), F.array())
        return bound(F.struct(items("old").alias("o"), items("new").alias("n")), lambda both: F.when(both["o"] != both["n"], met(both)))

    found = _once(_compared, differing)
    parts = [x for name, xs in found.items() if not sections or name in sections for x in xs]
    return F.array_compact(F.array(*parts))


#: The columns of schema.SNAPSHOT that each section is read from, where they have another name.
_COLUMNS = {"cron": "cron_jobs", "timers": "systemd_timers"}


def columns_of(sections: list[str] | None) -> list[str] | None:
    """The columns of schema.SNAPSHOT that these sections need; None for all."""
    return sections and sorted({_COLUMNS.get(s, s.partition(".")[0]) for s in sections})


def section_counts(found: DataFrame) -> DataFrame:
    """How many entities each section of each snapshot has."""
    return found.groupBy("host_id", "seq", "section").agg(F.count("*").alias("n"))
