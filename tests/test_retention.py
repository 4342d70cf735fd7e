"""Days given up, and chains that still verify from the ledger of removed heads on."""

import pytest
from pyspark.sql import functions as F

from chainlens.operators import history, verify
from chainlens.schema import GENESIS
from chainlens.sources import ledger
from chainlens.streaming import watch

ROW = "host_id string, ts_ns long, path string, hash string, prev_hash string, snap_date string"
NOW, DAYS = "2026-03-31", 10  # what is of 2026-03-20 or before goes


def doc(host, n, before=None, day=None):
    return (host, n * 10**9, f"{n:03}", f"{host}{n}", before or (f"{host}{n - 1}" if n else GENESIS), f"2026-03-{day or n + 10}")


class Store:
    def __init__(self, spark, folder):
        self.spark, self.table, self.heads = spark, f"{folder}/table", f"{folder}/heads"

    def add(self, *rows):
        self.spark.createDataFrame(rows, ROW).write.partitionBy("snap_date").mode("append").parquet(self.table)

    def retain(self):
        return watch.retain(self.spark, self.table, self.heads, DAYS, NOW)

    def state(self):
        rows = self.spark.read.schema(ROW).parquet(self.table)
        found = verify.verdicts(verify.links(rows, ledger.read(self.spark, self.heads)))
        return {r.host_id: (r.total, r.broken_at) for r in found.collect()}

    def known(self):
        return {r.host_id: (r.removed_path, r.expected_prev_hash) for r in ledger.read(self.spark, self.heads).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, tmp_path)


def test_a_host_that_comes_back_after_all_of_it_went(store):
    store.add(*[doc("a", n) for n in (9, 10, 11, 12)], doc("b", 0))
    assert store.retain() == 3
    assert store.state() == {"a": (2, -1)} and store.known() == {"a": ("010", "a10"), "b": ("000", "b0")}
    store.add(doc("b", 1, day=25), doc("c", 0, day=25))
    assert store.retain() == 0
    assert store.state() == {"a": (2, -1), "b": (1, -1), "c": (1, -1)}


def test_nothing_left_at_all_and_on(store):
    assert store.retain() == 0
    store.add(doc("a", 0), doc("a", 1))
    assert store.retain() == 2 and store.state() == {} and store.retain() == 0
    store.add(doc("a", 2, day=28), doc("a", 3, day=28))
    assert store.retain() == 0 and store.state() == {"a": (2, -1)}


def test_a_crash_between_ledger_and_removal(store, monkeypatch):
    store.add(*[doc("a", n) for n in range(8, 14)])

    def crash(*_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(watch, "remove", crash)
        with pytest.raises(RuntimeError):
            store.retain()
    assert store.known() == {"a": ("010", "a10")} and store.state() == {"a": (3, -1)}  # what is still there counts as gone
    assert store.retain() == 3 and store.state() == {"a": (3, -1)} and store.known() == {"a": ("010", "a10")}


def test_a_version_cut_short_is_never_read(store, spark, tmp_path):
    store.add(doc("a", 10), doc("a", 11))
    assert store.retain() == 1
    (tmp_path / "heads/v=1").mkdir()
    (tmp_path / "heads/v=1/part-0.parquet").write_bytes(b"half")
    assert store.known() == {"a": ("010", "a10")}
    store.add(doc("b", 3))
    assert store.retain() == 1 and set(store.known()) == {"a", "b"}
    assert sorted(p.name for p in (tmp_path / "heads").glob("v=*")) == ["v=0", "v=1"]


def test_broken_chains_still_show(store):
    store.add(*[doc("a", n) for n in (9, 10)], doc("a", 11, before="other"), doc("a", 12), doc("b", 10), doc("b", 12))
    assert store.retain() == 2
    assert store.state() == {"a": (2, 0), "b": (1, 0)}  # b11 was taken away by someone else
    store.add(doc("d", 4, day=27))
    assert store.state()["d"] == (1, 0)  # no genesis, and nothing of it was ever given up


def test_late_documents_of_days_that_went(store):
    store.add(doc("a", 10), doc("a", 11))
    assert store.retain() == 1
    store.add(doc("a", 9))
    assert store.state() == {"a": (1, -1)} and store.retain() == 1
    assert store.known() == {"a": ("010", "a10")} and store.state() == {"a": (1, -1)}


def test_heads_merge_in_any_order(spark):
    one = history.removed_heads(spark.createDataFrame([doc("a", 1), doc("a", 2), doc("b", 5)], ROW))
    two = history.removed_heads(spark.createDataFrame([doc("a", 1), doc("b", 7), doc("c", 0)], ROW))
    want = {("a", "a2"), ("b", "b7"), ("c", "c0")}
    for x, y in ((one, two), (two, one)):
        merged = history.merged_heads(x, y)
        assert {(r.host_id, r.expected_prev_hash) for r in history.merged_heads(merged, x).collect()} == want
    assert verify.links(spark.createDataFrame([doc("a", 3)], ROW), two.drop("removed_ns", "removed_path")).where(F.col("broken")).count() == 1
