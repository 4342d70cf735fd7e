"""Snapshots as sections with digests: what did not change between two of them is never taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canon import bound
from ..schema import SNAPSHOT
from .diff import rows_of
from .entities import columns_of, compared, listed

#: What orders and chains documents. These columns are read alone, without documents.
INDEX = ["host_id", "ts_ns", "path", "hash", "prev_hash"]
BROADCAST = 200_000  # chosen documents, of some 200 bytes each, that go to all tasks; more meet their sections by a shuffle


def described(snapshots: DataFrame, sections: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each snapshot as INDEX, further columns to keep, and sections: name, two 64-bit digests, entities (see entities.listed).

    Made to be written once, when documents come: all comparisons read its narrow columns, and entities of those
    sections only whose digests differ. Sections without entities are not there.
    """
    digests = lambda s: F.struct(s["section"].alias("section"), F.xxhash64(s["entities"]).alias("d1"), F.xxhash64(F.lit(1), s["entities"]).alias("d2"), s["entities"].alias("entities"))
    return snapshots.select(*INDEX, *(keep or []), F.transform(listed(sections), digests).alias("sections"))


def index(table: DataFrame) -> DataFrame:
    """INDEX with seq, each host's place in time from 0. Only these columns are sorted."""
    order = Window.partitionBy("host_id").orderBy("ts_ns", "path")
    return table.select(*INDEX).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def pairs(table: DataFrame) -> DataFrame:
    """host_id, pair_seq, path, old_path and which sections' digests differ, of each snapshot that has one before it.

    What is sorted is a host's index with some 30 bytes a section.
    """
    order = Window.partitionBy("host_id").orderBy("ts_ns", "path")
    digests = F.arrays_zip(F.col("sections.section").alias("section"), F.col("sections.d1").alias("d1"), F.col("sections.d2").alias("d2"))
    rows = table.select("host_id", "ts_ns", "path", digests.alias("new"))
    rows = rows.withColumn("pair_seq", (F.row_number().over(order) - 1).cast("long")).withColumn("old_path", F.lag("path").over(order)).withColumn("old", F.lag("new").over(order))
    differ = F.array_union(F.array_except("new", "old"), F.array_except("old", "new"))
    return rows.where("pair_seq > 0").select("host_id", "pair_seq", "path", "old_path", F.array_distinct(F.transform(differ, lambda s: s["section"])).alias("differ"))


def chosen(table: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs (as pairs gives them) of chosen documents: refs has host_id, pair_seq, path, old_path; every section is looked at."""
    names = F.transform("sections", lambda s: s["section"])
    each = table.select("host_id", "path", names.alias("names"))
    both = refs.join(each, ["host_id", "path"]).join(each.select("host_id", F.col("path").alias("old_path"), F.col("names").alias("old_names")), ["host_id", "old_path"])
    return both.select("host_id", "pair_seq", "path", "old_path", F.array_union("names", "old_names").alias("differ"))


def changes(table: DataFrame, found: DataFrame) -> DataFrame:
    """Changes of pairs, as diff.changes has them: host_id, pair_seq, section, type, key, old_value, new_value, counter.

    found (of pairs or chosen) names the sections of two documents each; only their entities leave the table. Both
    sides of a section meet in one row, which is no longer than the documents that it is from.
    """
    found = found.where(F.size("differ") > 0)
    side = lambda path, name: found.select("host_id", "pair_seq", F.col(path).alias("path"), "differ", F.lit(name).alias("side"))
    wanted = side("path", "n").unionByName(side("old_path", "o"))
    few = found.limit(BROADCAST // 2 + 1).count() <= BROADCAST // 2
    met = table.select("host_id", "path", "sections").join(F.broadcast(wanted) if few else wanted, ["host_id", "path"])
    some = met.select("host_id", "pair_seq", "side", F.explode(F.filter("sections", lambda s: F.array_contains("differ", s["section"]))).alias("s"))
    of = lambda name: F.first(F.when(F.col("side") == name, F.col("s.entities")), ignorenulls=True).alias(name)
    both = some.groupBy("host_id", "pair_seq", F.col("s.section").alias("section")).agg(of("o"), of("n"))
    return both.select("host_id", "pair_seq", "section", F.explode(bound(F.struct("o", "n"), _compared)).alias("c")).select("host_id", "pair_seq", "section", "c.*")


def consecutive(snapshots: DataFrame, sections: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Changes of each snapshot (as sources.snapshots has them) against its host's one before it, as changes() has them, with columns to keep.

    For documents that are compared as they pass, without a table of them: they are sorted once by host and time, and no
    entity leaves its row. Documents that are already dealt by host_id are not dealt again. What is kept and compared
    more than once goes through described().
    """
    order = Window.partitionBy("host_id").orderBy("ts_ns", "path")
    every = [c.name for c in StructType.fromDDL(SNAPSHOT)]
    rows = snapshots.select("host_id", "ts_ns", "path", *(keep or []), F.struct(*(columns_of(sections) or every)).alias("new"))
    rows = rows.withColumn("pair_seq", (F.row_number().over(order) - 1).cast("long")).withColumn("old", F.lag("new").over(order)).where("pair_seq > 0")
    differ = rows.select("host_id", "pair_seq", *(keep or []), F.inline(compared(sections)))
    return differ.select("host_id", "pair_seq", *(keep or []), "section", F.inline("rows"))


def _compared(both: Column) -> Column:
    """All rows of one section: its entities by key, old beside new; equal ones give none."""
    by_key = lambda side: F.map_from_entries(F.transform(F.coalesce(side, F.array()), lambda e: F.struct(e["ekey"], e)))
    met = F.map_zip_with(by_key(both["o"]), by_key(both["n"]), lambda k, o, n: F.struct(o.alias("o"), n.alias("n")))
    differ = F.filter(F.map_values(met), lambda e: ~e["o"].eqNullSafe(e["n"]))
    maps = lambda e: e.withField("fields", F.map_from_entries(e["fields"])).withField("counters", F.map_from_entries(e["counters"]))
    both_as_maps = F.transform(differ, lambda e: F.struct(maps(e["o"]).alias("o"), maps(e["n"]).alias("n")))
    return F.flatten(F.transform(both_as_maps, lambda e: rows_of(e["o"], e["n"])))
