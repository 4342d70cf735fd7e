"""Stores that grow, checks that go on, documents put together, and what streams keep."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chainlens.functions import canon
from chainlens.operators import cadence, collect, diff, entities, history, parsers, passing, sections, verify
from chainlens.plans import fleet
from chainlens.schema import GENESIS
from chainlens.sources import checks, ledger, store
from chainlens.sources import snapshots as source
from chainlens.streaming import cadence as stream_cadence
from chainlens.streaming import outbox, watch

from .test_core import BASE, CASES, changed, loaded, put

ROW = "host_id string, ts_ns long, path string, hash string, prev_hash string, snap_date date"
DAY = 86_400 * 10**9


def links(spark, hosts, days, broken=()):
    rows = [(h, d * DAY, f"{d:02}", f"{h}{d}", "x" if (h, d) in broken else f"{h}{d - 1}" if d else GENESIS) for h in hosts for d in days]
    return spark.createDataFrame(rows, ROW.rpartition(",")[0]).withColumn("snap_date", F.to_date(F.timestamp_seconds(F.expr("ts_ns div 1000000000"))))


def files_of(path):
    return [p for p in path.rglob("*.parquet") if "_compacting" not in str(p)]


def test_files_follow_days_not_hosts(spark, tmp_path):
    for hosts in (30, 300):
        folder = tmp_path / str(hosts)
        store.append(links(spark, [f"h{i}" for i in range(hosts)], range(4)), str(folder))
        assert len(files_of(folder)) == 4 * store.BUCKETS
    assert store.read(spark, str(folder)).groupBy("host_id").count().where("count = 4").count() == 300


def test_compaction_and_one_cut_short(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for d in range(3):
        store.append(links(spark, [f"h{i}{d}" for i in range(20)], range(2)), path)
    rows = lambda: sorted((r.host_id, r.path, str(r.snap_date)) for r in store.read(spark, path).collect())
    before, n = rows(), len(files_of(tmp_path / "t"))
    assert store.compact(spark, path, "1970-01-01") == n // 2
    assert rows() == before and len(files_of(tmp_path / "t")) == n // 2 + store.BUCKETS and store.compact(spark, path, "1970-01-01") == 0
    held = []

    def crash(session, target):
        if target.endswith(".parquet"):
            held.append(target)
            if len(held) == 3:
                raise RuntimeError("power cut")
        return real(session, target)

    real = store.remove
    with monkeypatch.context() as m:
        m.setattr(store, "remove", crash)
        with pytest.raises(RuntimeError):
            store.compact(spark, path, "1970-01-02")
    assert rows() != before  # cut short in the middle
    store.recover(spark, path)
    assert rows() == before and len(files_of(tmp_path / "t")) == 2 * store.BUCKETS
    (tmp_path / "t/_compacting/data").mkdir(parents=True)  # no journal: nothing had begun
    store.recover(spark, path)
    assert rows() == before and not (tmp_path / "t/_compacting").exists()


def test_a_check_goes_on_and_reads_new_days_only(spark, tmp_path):
    table, state = str(tmp_path / "t"), str(tmp_path / "s")
    told = lambda: {r.host_id: (r.verified, r.broken_at) for r in checks.check(spark, table, state).collect()}
    store.append(links(spark, ["a", "b"], range(3)), table)
    assert told() == {"a": (3, -1), "b": (3, -1)}
    store.append(links(spark, ["a"], range(3, 6)).unionByName(links(spark, ["b"], range(3, 5), {("b", 4)})).unionByName(links(spark, ["c"], [4], {("c", 4)})), table)
    marks = checks.versions.read(spark, f"{state}/marks", checks.MARK)
    new = checks.unchecked(spark, table, marks)
    seen = [r.f for r in new.select(F.input_file_name().alias("f")).distinct().collect()]
    assert seen and all("snap_date=1970-01-0" + d not in f for f in seen for d in "12")
    assert "PartitionFilters: [isnotnull(snap_date" in new._jdf.queryExecution().executedPlan().toString()
    assert told() == {"a": (6, -1), "b": (5, 4), "c": (1, 0)}
    assert told() == {"a": (6, -1), "b": (5, 4), "c": (1, 0)}  # nothing came
    store.append(links(spark, ["b"], [5]), table)
    assert told()["b"] == (6, 4)
    rows = store.read(spark, table)
    assert checks.altered(spark, rows, state).collect() == []
    forged = rows.withColumn("hash", F.when((F.col("host_id") == "a") & (F.col("path") == "01"), "other").otherwise(F.col("hash")))
    assert [(r.host_id, str(r.snap_date)) for r in checks.altered(spark, forged, state).collect()] == [("a", "1970-01-02")]
    assert [(r.host_id, str(r.snap_date)) for r in checks.altered(spark, rows.where("not (host_id = 'b' and path = '00')"), state).collect()] == [("b", "1970-01-01")]
    late = links(spark, ["c"], [0])
    store.append(late, table)
    assert told() == {"a": (6, -1), "b": (6, 4), "c": (1, 0)}  # an older day is not read
    assert [(r.host_id, str(r.snap_date)) for r in checks.altered(spark, store.read(spark, table), state).collect()] == [("c", "1970-01-01")]


def test_checks_and_retention(spark, tmp_path):
    table, state, heads = (str(tmp_path / x) for x in "tsh")
    store.append(links(spark, ["a", "b"], range(4)), table)
    checks.check(spark, table, state, heads)
    assert watch.retain(spark, table, heads, 2, "1970-01-05") == 2
    assert checks.altered(spark, store.read(spark, table), state, heads).collect() == []
    assert len(checks.altered(spark, store.read(spark, table), state).collect()) == 4
    store.append(links(spark, ["a"], range(4, 6)), table)
    assert {r.host_id: (r.verified, r.broken_at) for r in checks.check(spark, table, state, heads).collect()} == {"a": (6, -1), "b": (4, -1)}
    fresh = str(tmp_path / "fresh")  # never checked before: from the ledger on
    assert {r.host_id: (r.verified, r.broken_at) for r in checks.check(spark, table, fresh, heads).collect()} == {"a": (4, -1), "b": (2, -1)}
    assert ledger.read(spark, heads).count() == 2


def test_refs_and_extracts(spark):
    index = spark.createDataFrame([("h", i, h) for i, h in enumerate(["abcd1", "abcd2", "abff0", "0123456"])] + [("g", 0, "abcd1")], "host_id string, seq long, hash string")
    asked = {1: ("h", "HEAD"), 2: ("h", "HEAD~3"), 3: ("h", "HEAD~4"), 4: ("h", "abcd"), 5: ("h", "ABCD2"), 6: ("h", "a"), 7: ("h", "0"), 8: ("h", ""), 9: ("none", "HEAD"), 10: ("g", "abcd"), 11: ("h", "HEAD~"), 12: ("h", "HEAD~x"), 13: ("h", "0123456789")}
    got = history.resolve_all(index, spark.createDataFrame([(k, *v) for k, v in asked.items()], "ref_id int, host_id string, ref string"))
    want = {1: ("found", 1, 3), 2: ("found", 1, 0), 3: ("none", 0, None), 4: ("ambiguous", 2, None), 5: ("found", 1, 1), 6: ("ambiguous", 3, None), 7: ("found", 1, 3), 8: ("none", 0, None), 9: ("none", 0, None), 10: ("found", 1, 0), 11: ("found", 1, 3), 12: ("none", 0, None), 13: ("none", 0, None)}
    assert {r.ref_id: (r.status, r.candidates, r.seq) for r in got.collect()} == want
    rows = spark.createDataFrame([("h", t * DAY) for t in range(-3, 30)] + [("g", 5 * DAY)], "host_id string, ts_ns long")
    ask = spark.createDataFrame([("a", "h", 0, 10 * DAY), ("b", "h", 9 * DAY, 9 * DAY + 1), ("c", "h", 5 * DAY, 5 * DAY), ("d", "g", -100 * DAY, 100 * DAY), ("e", "h", -9 * DAY, DAY)], "bundle_id string, host_id string, from_ns long, to_ns long")
    found = history.extracts(rows, ask)
    assert {r["bundle_id"]: r["count"] for r in found.groupBy("bundle_id").count().collect()} == {"a": 10, "b": 1, "d": 1, "e": 4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_refs_are_dealt_by_host_once(spark):
    hashes = [f"{i * 2654435761 % 2**32:08x}" for i in range(300)]
    index = spark.createDataFrame([("h", i, x) for i, x in enumerate(hashes)] + [(None, 0, "00"), ("h", 300, None)], "host_id string, seq long, hash string")
    starts = [x[:n] for x in hashes[:40] for n in (1, 2, 8)] + ["zz", "0" * 9]
    asked = [(i, "h", s) for i, s in enumerate(starts)] + [(900, None, "00"), (901, "h", None), (902, None, "HEAD"), (903, "h", "HEAD"), (904, "h", "HEAD~1"), (905, "h", hashes[3].upper())]
    found = history.resolve_all(index, spark.createDataFrame(asked, "ref_id int, host_id string, ref string"))
    got = {r.ref_id: (r.status, r.candidates, r.seq, r.hash) for r in found.collect()}
    assert len(got) == len(asked)
    for i, s in enumerate(starts):
        met = [(k, x) for k, x in enumerate(hashes) if x.startswith(s)]
        assert got[i] == (("none", "found")[len(met)], len(met), *met[0]) if len(met) == 1 else got[i] == ("ambiguous" if met else "none", len(met), None, None)
    assert [got[i] for i in (900, 901, 902)] == [("none", 0, None, None)] * 3
    assert got[903] == ("found", 1, 300, None) and got[904] == ("found", 1, 299, hashes[299]) and got[905] == ("found", 1, 3, hashes[3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 2


def canonical(value):
    """The same form by Python: what a number is, by decimals."""
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(value[k]) for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, Decimal):
        if value == 0:
            return "0"
        sign, digits, exponent = value.normalize().as_tuple()
        at, s = len(digits) + exponent - 1, "".join(map(str, digits))
        if at >= 21 or at < -6:
            text = s[0] + ("." + s[1:] if len(s) > 1 else "") + f"e{'+' if at >= 0 else '-'}{abs(at)}"
        elif at < 0:
            text = "0." + "0" * (-at - 1) + s
        else:
            text = s.ljust(at + 1, "0") if len(s) <= at + 1 else s[: at + 1] + "." + s[at + 1 :]
        return ("-" if sign else "") + text
    return json.dumps(value, ensure_ascii=False)


def test_canonical_form_of_random_documents(spark):
    draw = random.Random(4)
    words = ["10.0.0.1", 'say "1.5"', "C:\\dir\\1.0", "\u001f 2.5E3", "tab\tend", "naïve 1.", "-3.5e-7", "[1.0,2]", "\\u001F", "{\"a\":1.0}", "", "日本 9.0"]

    def value(depth):
        k = draw.randrange(9 if depth else 5)
        if k == 0:
            return draw.choice(words)
        if k == 1:
            return draw.randrange(-(10**25), 10**25) if draw.random() < 0.3 else draw.randrange(-999, 999)
        if k == 2:
            return Decimal(f"{draw.randrange(-9999, 9999)}e{draw.randrange(-9, 9)}")
        if k == 3:
            return Decimal(f"{draw.randrange(1, 99)}.{draw.randrange(0, 999):03}")
        if k == 4:
            return draw.choice([True, False, None])
        return [value(depth - 1) for _ in range(draw.randrange(4))] if k < 7 else {draw.choice(words) + str(i): value(depth - 1) for i in range(draw.randrange(4))}

    def text(v):
        if isinstance(v, dict):
            return "{ " + " , ".join(json.dumps(k) + ": " + text(x) for k, x in draw.sample(list(v.items()), len(v))) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(text, v)) + " ]"
        return str(v) if isinstance(v, Decimal) else json.dumps(v)

    documents = [{f"k{i}": value(3) for i in range(draw.randrange(1, 6))} for _ in range(400)]
    rows = spark.createDataFrame([(i, text(d)) for i, d in enumerate(documents)], "i int, t string").select("i", canon.canonical_json(F.col("t")).alias("j")).collect()
    assert {r.i: r.j for r in rows} == {i: canonical(d) for i, d in enumerate(documents)}


def test_sections_give_what_entities_give(spark):
    docs = [(f"h{k}", f"{i}.json", d) for k, (edit, _) in enumerate(CASES) for i, d in enumerate((BASE, changed(lambda d, edit=edit: (edit(d), put(["timestamp"], "2026-03-22T10:05:00Z")(d)))))]
    rows = source.snapshots(loaded(spark, docs))
    table = sections.described(rows)
    numbered = history.sequenced(rows).withColumn("seq", F.col("seq").cast("long"))
    want = diff.consecutive(entities.entities(numbered), diff.consecutive_pairs(numbered))
    found = sections.pairs(table)
    got = sections.changes(table, found)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert any(not r.differ for r in found.collect())  # what did not change is not taken apart
    refs = found.select("host_id", "pair_seq", F.col("old_path").alias("path"), F.col("path").alias("old_path"))
    back = sections.changes(table, sections.chosen(table, refs))
    turned = {"added": "removed", "removed": "added", "modified": "modified"}
    assert sorted((r.host_id, turned[r.type], r.section) for r in back.collect()) == sorted((r.host_id, r.type, r.section) for r in got.collect())


def test_a_comparison_parses_once_and_sorts_narrow_rows(spark, tmp_path):
    docs = loaded(spark, [("h", f"{i}.json", changed(put(["timestamp"], f"2026-03-22T10:0{i}:00Z"))) for i in range(3)])
    docs.write.parquet(f"{tmp_path}/docs")
    plan = sections.described(source.snapshots(spark.read.parquet(f"{tmp_path}/docs")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("FileScan") == 1 and "Window" not in plan
    store.append(sections.described(source.snapshots(docs), keep=["snap_date"]), f"{tmp_path}/t")
    table = store.read(spark, f"{tmp_path}/t")
    read = sections.index(table)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in read and "entities" not in read and "from_json" not in read
    assert "entities" not in sections.pairs(table)._jdf.queryExecution().executedPlan().toString()


def test_equal_keys_keep_the_last(spark):
    doc = changed(put(["users"], [{"name": "a", "uid": 1}, {"name": "b", "uid": 2}, {"name": "a", "uid": 3}]))
    row = sections.described(source.snapshots(loaded(spark, [("h", "0.json", doc)], ), ["users"]), ["users"]).select(F.inline("sections")).first()
    assert [(e.ekey, e.fields[0].value) for e in row.entities] == [("b", "2"), ("a", "3")]


def test_shapes_of_sections(spark):
    key = "host_id string, ts int, "
    totals = spark.createDataFrame([("h", 0, 5, 2, 1, 7, "b", 3, 0, 1), ("h", 0, 5, 2, 1, 9, "a", 1, 1, 2), ("g", 0, 1, 0, 0, None, None, None, None, None)], key + "total_tcp int, total_udp int, total_listen int, pid int, comm string, tcp_count int, udp_count int, rank int")
    drivers = spark.createDataFrame([("h", 0, "eth0", "x", "1"), ("h", 0, "eth0", "y", "2")], key + "interface string, driver string, fw_version string")
    counters = spark.createDataFrame([("h", 0, "tcp", {"A": 1}), ("h", 0, "ip", {"B": 2, "C": 3})], key + "proto string, counters map<string,long>")
    found = {"sockets": totals, "nic_drivers": drivers, "kernel_counters": counters}
    made = {r.host_id: r for r in collect.assembled(found, totals, found).collect()}
    doc = json.loads(made["h"].document)
    assert doc["sockets"] == {"total_tcp": 5, "total_udp": 2, "total_listen": 1, "top_by_count": [{"pid": 7, "comm": "b", "tcp_count": 3, "udp_count": 0}, {"pid": 9, "comm": "a", "tcp_count": 1, "udp_count": 1}]}
    assert doc["nic_drivers"] == {"eth0": {"driver": "y", "fw_version": "2"}} and doc["kernel_counters"] == {"tcp": {"A": 1}, "ip": {"B": 2, "C": 3}}
    other = json.loads(made["g"].document)
    assert other["sockets"]["top_by_count"] == [] and other["collector_errors"] == ["nic_drivers", "kernel_counters"] == made["g"].collector_errors
    with pytest.raises(ValueError, match="a document has none of"):
        collect.section_value("users", counters)


def test_descriptors_and_udp(spark):
    files = spark.createDataFrame([("h", 0, "/proc/7/fd", "/dev/null\nsocket:[12]\npipe:[3]\nsocket:[13]")], "host_id string, ts int, path string, content string")
    assert [(r.pid, r.inode) for r in parsers.descriptors(files).collect()] == [(7, 12), (7, 13)]
    lines = "sl\n 1: 0100007F:0035 00000000:0000 07 0:0 00:0 0 0 0 5 1 0\n 2: 0100007F:0036 00000000:0000 01 0:0 00:0 0 0 0 6 1 0"
    udp = spark.createDataFrame([("h", 0, "/proc/net/udp", lines)], "host_id string, ts int, path string, content string")
    assert [(r.port, r.protocol, r.address) for r in parsers.listening_ports(udp).collect()] == [(53, "udp", "127.0.0.1")]


def test_stray_raw_files_are_reported(spark, tmp_path):
    for f in ("h/17/raw/etc/passwd", "notes.txt", "h/raw/etc/x"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("t")
    assert source.read_raw_files(spark, str(tmp_path)).count() == 1
    assert sorted(r.file.rpartition("/")[2] for r in source.stray_raw_files(spark, str(tmp_path)).collect()) == ["notes.txt", "x"]


STREAM = "host_id string, ts_ns long, path string, hash string, prev_hash string"


def _one(batch):
    none = F.expr("cast(map() as map<string,decimal(20,0)>)")
    return batch.select("host_id", F.col("seq").cast("long").alias("seq"), F.lit("s").alias("section"), F.lit("k").alias("ekey"), F.lit("k").alias("dkey"), F.col("path").alias("label"), F.lit(False).alias("singleton"), F.create_map(F.lit(""), F.col("path")).alias("fields"), none.alias("counters"))


def fed(spark, tmp_path, batches, **more):
    got, late = [], []
    sink = lambda c, b, n: (got.extend((r.pair_seq, r.old_value, r.new_value) for r in c.collect()), late.extend(r.path for r in b.collect()))
    for rows in batches:
        spark.createDataFrame([("h", t, f"{t}", f"h{t}", p or (f"h{t - 1}" if t else GENESIS)) for t, p in rows], STREAM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in")
        watch.watch(stream, _one, f"{tmp_path}/state", sink, f"{tmp_path}/check", follow_hashes=True, **more).trigger(availableNow=True).start().awaitTermination()
    return sorted(got), sorted(late)


def test_parked_documents_go_on_when_the_missing_one_comes(spark, tmp_path):
    got, late = fed(spark, tmp_path, [[(3, None), (1, None)], [(0, None), (3, None)], [(4, None)], [(2, None)]], park_ns=100)
    assert got == [(t, f"{t - 1}", f"{t}") for t in range(1, 5)] and late == []


def test_what_waits_too_long_goes_to_breaks(spark, tmp_path):
    got, late = fed(spark, tmp_path, [[(0, None), (1, None), (2, "wrong")], [(3, None)], [(9, "h8")], [(30, "h29")]], park_ns=5)
    assert got == [(1, "0", "1")] and late == ["2", "3", "9"]


def test_outbox_tells_each_pair_once(spark, tmp_path):
    box = str(tmp_path / "box")
    changes = spark.createDataFrame([("h", 1, "s", "added", "k", "", "v", False), ("h", 2, "s", "modified", "k", "1", "2", True)], "host_id string, pair_seq long, section string, type string, key string, old_value string, new_value string, counter boolean")
    hosts = spark.createDataFrame([("h", 1, "name"), ("h", 2, "name")], "host_id string, pair_seq long, hostname string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert outbox.pending(spark, box).count() == 0
    put_ = outbox.sink(box)
    for number in (0, 0, 5):
        put_(changes, hosts, number)
    waiting = outbox.pending(spark, box)
    assert [(r.pair_seq, json.loads(r.payload)["host"], json.loads(r.payload)["material"]) for r in waiting.collect()] == [(1, "name", 1)]
    outbox.confirm(waiting, box)
    outbox.confirm(waiting.unionByName(waiting), box)
    assert outbox.pending(spark, box).count() == 0 and outbox.payloads(spark, box).count() == 1


def test_whole_documents(spark):
    rows = [("a", 1, "1", '{"x":{"v":1},"y":[1]}'), ("a", 2, "2", '{"x":null,"y":[2,3]}'), ("a", 3, "3", "broken"), ("a", 3, "4", '{"z":"é"}'), ("b", 1, "1", None), ("b", 2, "2", '{"y":0}')]
    got = {(r.host_id, r.path): r.raw for r in cadence.whole_documents(spark.createDataFrame(rows, "host_id string, ts_ns long, path string, raw string")).collect()}
    assert got == {("a", "1"): '{"x":{"v":1},"y":[1]}', ("a", "2"): '{"x":{"v":1},"y":[2,3]}', ("a", "3"): '{"x":{"v":1},"y":[2,3]}', ("a", "4"): '{"x":{"v":1},"y":[2,3],"z":"é"}', ("b", "1"): "{}", ("b", "2"): '{"y":0}'}


def test_verdicts_of_marks(spark):
    marks = spark.createDataFrame([("a", 3, -1, 5, "p", "h")], checks.MARK)
    anchors = verify.anchors_of(marks, spark.createDataFrame([("a", 9, "q", "z"), ("b", 1, "r", "y")], ledger.LEDGER))
    assert {(r.host_id, r.expected_prev_hash) for r in anchors.collect()} == {("a", "z"), ("b", "y")}


def test_mounts_lie_in_the_order_of_their_places(spark):
    rows = spark.createDataFrame([("h", 0, "/b", "/dev/1"), ("h", 0, "/a", "/dev/3"), ("h", 0, "/a", "/dev/2")], "host_id string, ts int, mount_point string, source string")
    document = json.loads(collect.assembled({"mounts": rows}, rows, {"mounts": rows}).first().document)
    assert [(m["mount_point"], m["source"]) for m in document["mounts"]] == [("/a", "/dev/2"), ("/a", "/dev/3"), ("/b", "/dev/1")]


def test_documents_compared_as_they_pass(spark):
    """What the one pass gives is what all entities joined give, also of keys that come twice; documents are sorted once and not joined."""
    twice = put(["users"], [{"name": "a", "uid": 1}, {"name": "b", "uid": 2}, {"name": "a", "uid": 3}])
    again = put(["users"], [{"name": "a", "uid": 3}, {"name": "b", "uid": 4}, {"name": "b", "uid": 2}, {"name": "c", "uid": 5}])
    edits = [*[edit for edit, _ in CASES], again]
    docs = [(f"h{k}", f"{i}.json", d) for k, edit in enumerate(edits) for i, d in enumerate((changed(twice), changed(lambda d, edit=edit: (twice(d), edit(d), put(["timestamp"], "2026-03-22T10:05:00Z")(d)))))]
    rows = source.snapshots(loaded(spark, docs))
    numbered = history.sequenced(rows).withColumn("seq", F.col("seq").cast("long"))
    for names in (None, ["users", "network.routes", "kernel_counters.tcp"]):
        want = diff.consecutive(entities.entities(numbered, names), diff.consecutive_pairs(numbered))
        got = sections.consecutive(rows, names)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("from_json(") == 1


def test_documents_compared_as_text(spark):
    """What the texts give is what typed documents give, also of odd and unreadable ones; they are sorted once, as text, and not joined."""
    head = '{"timestamp":"2026-03-22T10:0%d:00Z",'
    users = lambda *rows: changed(put(["users"], [*rows]))
    odd = [
        head + '"packages":{"a":0,"b":{"x":1,"y":2},"c":true,"d":"1"}}', head + '"packages":{"a":-0,"b":{"y":2,"x":1},"c":1,"d":1}}', head + '"packages":{"a":0},"packages":{}}',
        head + '"packages":{"a":0.0}} x', head + '"packages":{"a":1.50,"b":1e3}}', head + '"packages":{"a":1.5,"b":1000}}', head + '"x":' + "[" * 999 + "]" * 999 + "}", head + '"x":' + "[" * 1000 + "]" * 1000 + "}",
        head + '"x":' + "9" * 1001 + "}", head + '"nic_drivers":{"e":5,"f":{"driver":"x"}}}', head + '"nic_drivers":{"e":5,"f":{"driver":"y"}}}', '{"packages":{"a":"0"},"timestamp":"2026-03-22T10:0%d:00Z"}', "[1]", "",
        users({"name": "a", "uid": 1}, {"name": "a", "uid": 2}), users({"name": "a", "uid": 3}, {"name": "a", "uid": 2}), users({"uid": 1}, {"name": "", "uid": 2}), users({"uid": "x", "name": "b"}, {"name": None}), users(5, {"name": "a"}), users({"name": "\ud800"}, {"name": "?"}),
    ]
    edits = [*[edit for edit, _ in CASES], put(["network", "routes"], [{"destination": "a dev b", "device": "c"}, {"destination": "a", "device": "b dev c", "gateway": "g"}])]
    texts = [*[json.dumps(d) if isinstance(d, dict) else d for d in odd], *[json.dumps(changed(edit)) for edit in edits]]
    docs = [(f"h{n}", f"{i}.json", (t % i if t.startswith(head[:20]) and "%d" in t or "%d" in t else t.replace("T10:00", f"T10:0{i}"))) for n in range(2 * len(texts)) for i, t in enumerate((texts[n % len(texts)], texts[(n * 7 + 3) % len(texts)], texts[(n * 5 + 1) % len(texts)]))]
    rows = loaded(spark, docs)
    for names in (None, ["users", "network.routes", "kernel_counters.tcp"]):
        want = sections.consecutive(source.snapshots(rows, names).withColumn("hostname", F.col("host.hostname")), names, ["hostname", "ts"])
        got = passing.consecutive(rows, names, ["hostname", "ts"])
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("from_json(") == 3


def test_only_what_differs_becomes_columns(spark):
    """Of documents that differ in one of many items only this one is left before columns are made."""
    users = [{"name": f"u{i}", "uid": i} for i in range(500)]
    docs = [("h", "0", changed(put(["users"], users))), ("h", "1", changed(lambda d: (put(["users"], [*users[:7], {"name": "u7", "uid": 0}, *users[8:]])(d), put(["timestamp"], "2026-03-22T10:05:00Z")(d))))]
    rows = loaded(spark, docs)
    assert [(r.key, r.old_value, r.new_value) for r in passing.consecutive(rows).collect()] == [("u7.uid", "7", "0")]
    read = passing._reader()()
    left = passing._lesser(["host", "users", "packages"])(*[read(r.raw, False)[1] for r in rows.orderBy("path").collect()])
    assert left == ({"host": BASE["host"], "users": [users[7]]}, {"host": BASE["host"], "users": [{"name": "u7", "uid": 0}]})


def test_keys_of_texts_are_those_of_entities(spark):
    """What tells items apart as text is what tells entities apart: each field of a key alone makes another entity."""
    for at, (_, fields) in passing.KEYS.items():
        for name, missing in fields:
            other = "z" if missing == "" else 9
            outer, _, inner = at.partition(".")
            of = lambda items: {outer: {inner: items} if inner else items}  # noqa: B023, E731
            doc = {"timestamp": "2026-03-22T10:00:00Z", **of([{n: m for n, m in fields}, {n: other if n == name else m for n, m in fields}])}
            row = sections.described(source.snapshots(loaded(spark, [("h", "0", doc)]))).select(F.inline("sections")).collect()
            assert sum(not e.singleton for r in row for e in r.entities) == 2, (at, name)


def test_documents_of_orders_are_what_to_json_writes(spark, tmp_path):
    """Texts joined are those that to_json writes of the same columns, with characters that it escapes too."""
    rows = [(1, 19, 'a"b\\\té', 1.5), (1, 23, "O", 2.0), (1, 17, "F", 3.25), (2, 17, "F", 4.0), (3, 46, None, 1.0), (3, 5, "O", None)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    made = {(r.host_id, r.path): r.raw for r in fleet.documents(spark, str(tmp_path)).collect()}
    assert len(made) == 6
    first, later = json.loads(made["1", "0"]), json.loads(made["1", "1"])
    assert [(u["name"], u["uid"], u["shell"]) for u in first["users"]] == [("u17", 325, "F"), ("u19", 150, 'a"b\\\té'), ("u23", 200, "O")]
    assert [(u["name"], u["uid"], u["shell"]) for u in later["users"]] == [("u19", 157, "X"), ("u23", 200, "O"), ("u1000000023", 200, "O")]
    assert json.loads(made["2", "1"])["users"] == [] and json.loads(made["2", "1"])["packages"] == {}
    assert [u.get("shell") for u in json.loads(made["3", "0"])["users"]] == ["O", None] and "metric" not in json.loads(made["3", "0"])["network"]["routes"][0]


def test_canonical_form_is_of_whole_documents_and_exact(spark):
    cases = {'{"a":1} x': None, '{"b":10000000000000000000000000000000000000000,"a":1.50}': '{"a":1.5,"b":10000000000000000000000000000000000000000}', '{"a":"#5","b":2.0}': '{"a":"#5","b":2}', '{"a":NaN}': None, '{"a":"\\ud800"}': '{"a":"?"}', None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", canon.canonical_json(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == cases


def test_documents_are_written_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    """Small documents are dealt to many tasks, one file each; before, all went to one task."""
    monkeypatch.setattr(source, "FILES", 4)
    rows = spark.range(60).select(F.concat(F.lit("h"), "id").alias("host_id"), F.explode(F.array(F.lit("2026-03-22T10:00:00Z"), F.lit("2026-03-23T10:00:00Z"))).alias("timestamp"))
    source.write_documents(rows, f"{tmp_path}/d")
    tasks = {p.name.split("-")[1] for p in (tmp_path / "d").rglob("*.json")}
    assert len([*(tmp_path / "d").rglob("*.json")]) == 120 and len(tasks) > 8
    assert sorted(r.host_id for r in source.read_documents(spark, f"{tmp_path}/d").collect()) == sorted([f"h{i}" for i in range(60)] * 2)


def test_dead_letters_are_told_from_what_was_read(spark, tmp_path):
    """A batch is read once: whether a document can be read is a column of what read gives; the dead letter is as it came."""
    docs = loaded(spark, [("h", "0.json", BASE), ("g", "0.json", BASE)]).withColumn("raw", F.when(F.col("host_id") == "g", "{nope").otherwise(F.col("raw")))
    docs.write.parquet(f"{tmp_path}/in")
    read = lambda batch: source.checked(batch, ["kernel_params"]).select("host_id", "path", "raw", "hash", "ts_ns", "fit", "kernel_params")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    found = lambda batch: entities.entities(batch, ["kernel_params"])
    watch.watch(stream, found, f"{tmp_path}/state", lambda c, b, n: c.collect(), f"{tmp_path}/check", read=read, readable=F.col("fit"), dead_letters=f"{tmp_path}/dead").trigger(availableNow=True).start().awaitTermination()
    assert [(r.host_id, r.raw) for r in spark.read.parquet(f"{tmp_path}/dead").select("host_id", "raw").collect()] == [("g", "{nope")]
    assert [r.host_id for r in spark.read.parquet(f"{tmp_path}/state/heads").collect()] == ["h"]


def test_stream_cadence_keeps_many_sections_in_a_bucket(spark, tmp_path):
    """More sections than buckets, null values among them, over three micro-batches: as gone through one by one."""
    rows = [(f"h{h}", f"s{s}", t, None if t % 7 == 0 else f"{h}.{s}.{t}") for h in range(5) for s in range(3) for t in range(h, 60, 2 + s)] + [(None, "s", 1, "n"), (None, "s", 50, "m")]
    table = spark.createDataFrame(rows, "host_id string, section string, t long, value string")
    for part in ("t < 20", "t >= 20 and t < 40", "t >= 40"):
        table.where(part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_cadence.fired(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), 10, buckets=2)
        assert stream.columns == ["host_id", "section", "t", "value", "recorded"]
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    due, want = {}, []
    for h, s, t, v in sorted(rows, key=lambda r: r[2]):
        if (recorded := t >= due.get((h, s), (0,))[0]):
            due[h, s] = (t + 10, v)
        want.append((h, s, t, due[h, s][1], recorded))
    got = spark.read.schema("host_id string, section string, t long, value string, recorded boolean").parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sections_meet_once(spark):
    told = [("a", "/etc/passwd", "r:x:0:0::/r:/s"), ("a", "/etc/group", "g:x:1:"), ("b", "/etc/passwd", "# none"), ("c", "/etc/other", "x"), ("d", "/etc/group", "g:x:1:")]
    raw = spark.createDataFrame([(h, 0, p, c) for h, p, c in told], "host_id string, ts int, path string, content string")
    of = lambda path: raw.where(F.col("path") == path)
    found = {"users": parsers.users(of("/etc/passwd")), "groups": parsers.groups(of("/etc/group"))}
    keys = raw.where("host_id <> 'd'")
    as_rows = collect.assembled(found, keys, {"users": of("/etc/passwd"), "groups": of("/etc/group")})
    assert "Join" not in as_rows._jdf.queryExecution().executedPlan().toString()
    want = {"a": ([], {"users", "groups"}), "b": (["groups"], {"users"}), "c": (["users", "groups"], set())}
    as_conditions = collect.assembled(found, keys, {"users": F.col("path") == "/etc/passwd", "groups": None})
    for made in as_rows, as_conditions:
        got = {r.host_id: (r.collector_errors, set(json.loads(r.document)) - {"collector_errors"}) for r in made.collect()}
        assert got == want
    documents = {r.host_id: json.loads(r.document) for r in as_rows.collect()}
    assert documents["b"]["users"] == [] and documents["a"]["groups"] == [{"name": "g", "gid": 1}]
    unseen = collect.assembled(found, keys, {"users": F.col("path") == "/etc/none", "groups": F.lit(False)}).where("host_id = 'a'").first()
    assert json.loads(unseen.document) == {"collector_errors": ["users", "groups"]}


def test_what_was_seen_is_looked_up_in_one_scan(spark, tmp_path):
    raw = spark.createDataFrame([("a", 0, "/proc/version", "Linux version 5 (x)"), ("a", 0, "/proc/stat", "cpu 1")], "host_id string, ts long, path string, content string")
    source.write_raw_files(raw, f"{tmp_path}/raw")
    made = collect.collected(source.read_packed_files(spark, f"{tmp_path}/raw"))
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 34  # 57 with a scan of its own for each section's files
    row = made.first()
    assert len(row.collector_errors) == 23 and json.loads(row.document) == {"collector_errors": row.collector_errors}  # no hostname, too few fields
