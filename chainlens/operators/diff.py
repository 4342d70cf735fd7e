"""What changed between two states: one keyed full outer join for every section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import delta_text

KEY = ["host_id", "pair_seq", "section", "ekey"]


def consecutive_pairs(snapshots: DataFrame) -> DataFrame:
    """host_id and pair_seq of each snapshot that has one before it; seq counts each host's from 0."""
    return snapshots.where("seq > 0").select("host_id", F.col("seq").alias("pair_seq")).distinct()


def consecutive(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes of each snapshot against the one before: the old side is just keyed by the seq after its own."""
    old = entities.withColumn("pair_seq", F.col("seq") + 1).drop("seq")
    new = entities.withColumnRenamed("seq", "pair_seq")
    return changes(old, new).join(pairs, ["host_id", "pair_seq"], "left_semi")


def between(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes between chosen snapshots: pairs has host_id, pair_seq, seq_a, seq_b."""
    side = lambda c: entities.join(pairs.select("host_id", "pair_seq", F.col(c).alias("seq")), ["host_id", "seq"]).drop("seq")
    return changes(side("seq_a"), side("seq_b"))


def arriving(entities: DataFrame, bounds: DataFrame) -> DataFrame:
    """What consecutive gives for the pairs from first to last of each host (bounds: host_id, first, last), by one shuffle.

    A host's entities meet in one task, each key in order of seq, so that the old side stands just before the new one. As
    with the join, of keys that repeat in a snapshot each meets each, and keys that are null meet none.
    """
    by = Window.partitionBy("host_id", "section", "ekey").orderBy("seq")
    side = F.struct("dkey", "label", "singleton", "fields", "counters")
    rows = entities.select("host_id", F.col("seq").cast("long").alias("seq"), "section", "ekey", side.alias("n")).repartition("host_id")
    rows = rows.select("*", F.collect_list("n").over(by.rangeBetween(-1, -1)).alias("before"), F.count("*").over(by.rangeBetween(1, 1)).alias("after"))
    rows = rows.join(bounds, "host_id")
    known, none = F.col("section").isNotNull() & F.col("ekey").isNotNull(), F.lit(None)
    pair = lambda seq, o, n: F.struct(seq.alias("pair_seq"), o.alias("o"), n.alias("n"))
    kind = entities.select(side.alias("n")).schema["n"].dataType
    seq, n = F.col("seq"), F.col("n")
    alone = F.array(pair(seq, none.cast(kind), n))
    met = F.when(known & (F.size("before") > 0), F.transform("before", lambda o: pair(seq, o, n))).otherwise(alone)
    gone = F.array(pair(seq + 1, n, none.cast(kind)))
    own = F.when(seq.between(F.col("first"), F.col("last")), met)
    left = F.when((seq + 1).between(F.col("first"), F.col("last")) & ~(known & (F.col("after") > 0)), gone)
    nothing = F.slice(alone, 1, 0)
    found = rows.select("host_id", "section", F.inline(F.concat(F.coalesce(own, nothing), F.coalesce(left, nothing))))
    return found.select("host_id", "pair_seq", "section", F.explode(rows_of(F.col("o"), F.col("n"))).alias("c")).select("host_id", "pair_seq", "section", "c.*")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """host_id, pair_seq, section, type, key, old_value, new_value, counter.

    An unmatched entity is added or removed, unless it is a singleton, whose absent side holds empty values and zeros; a
    matched one gives a modified row for each field or counter that differs, under the old side's shown key.
    """
    rest = ["dkey", "label", "singleton", "fields", "counters"]
    pack = lambda rows, name: rows.select(*KEY, F.struct(*rest).alias(name))
    both = pack(old, "o").join(pack(new, "n"), KEY, "full_outer")
    return both.select("host_id", "pair_seq", "section", F.explode(rows_of(F.col("o"), F.col("n"))).alias("c")).select("host_id", "pair_seq", "section", "c.*")


ROW = "struct<type:string,key:string,old_value:string,new_value:string,counter:boolean>"


def row(kind: str, key: Column, before: Column, after: Column, counter: bool = False) -> Column:
    return F.struct(F.lit(kind).alias("type"), key.alias("key"), before.alias("old_value"), after.alias("new_value"), F.lit(counter).alias("counter"))


def counted(key: Column, before: Column, after: Column) -> Column:
    """The row of a counter that differs."""
    return row("modified", key, before.cast("string"), delta_text(before, after), True)


def counters_of(shown: Column, old: Column, new: Column) -> Column:
    """The rows of two maps of counters; one that is not there is 0."""
    zero = F.lit(0).cast("decimal(20,0)")
    numbers = lambda side: F.coalesce(side, F.expr("cast(map() as map<string,decimal(20,0)>)"))
    pairs = F.map_zip_with(numbers(old), numbers(new), lambda k, a, b: F.struct(F.coalesce(a, zero).alias("a"), F.coalesce(b, zero).alias("b")))
    changed = F.filter(F.map_entries(pairs), lambda e: e["value"]["a"] != e["value"]["b"])
    return F.transform(changed, lambda e: counted(F.concat(shown, e["key"]), e["value"]["a"], e["value"]["b"]))


def rows_of(o: Column, n: Column) -> Column:
    """The rows that one entity gives, old and new side as structs (null where there is none): an array, empty if nothing differs."""
    single = F.coalesce(o["singleton"], n["singleton"])
    shown = F.coalesce(o["dkey"], n["dkey"])
    none = F.lit("")
    texts = lambda side: F.coalesce(side["fields"], F.expr("cast(map() as map<string,string>)"))
    fields = F.map_zip_with(texts(o), texts(n), lambda k, a, b: F.struct(F.coalesce(a, none).alias("a"), F.coalesce(b, none).alias("b")))
    changed = F.filter(F.map_entries(fields), lambda e: e["value"]["a"] != e["value"]["b"])
    modified = F.concat(F.transform(changed, lambda e: row("modified", F.concat(shown, e["key"]), e["value"]["a"], e["value"]["b"])), counters_of(shown, o["counters"], n["counters"]))
    return F.when(~single & n.isNull(), F.array(row("removed", o["dkey"], o["label"], none))).when(~single & o.isNull(), F.array(row("added", n["dkey"], none, n["label"]))).otherwise(modified)


def counts(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Material and counter changes of each pair, also of those without any."""
    summed = found.groupBy("host_id", "pair_seq").agg(F.count_if(~F.col("counter")).alias("material"), F.count_if("counter").alias("counters"))
    return pairs.join(summed, ["host_id", "pair_seq"], "left").fillna(0, ["material", "counters"])


def with_material(found: DataFrame) -> DataFrame:
    """Changes of the pairs of which one at least is no counter's."""
    pair = Window.partitionBy("host_id", "pair_seq")
    return found.withColumn("_any", F.max(~F.col("counter")).over(pair)).where("_any").drop("_any")


def in_section(found: DataFrame, prefix: str) -> DataFrame:
    """Changes of sections that start with prefix."""
    return found.where(F.startswith("section", F.lit(prefix)))


def material(found: DataFrame) -> DataFrame:
    return found.where(~F.col("counter"))


def by_section(found: DataFrame) -> DataFrame:
    """Each pair's changes of a section as one sorted array."""
    entry = F.struct("key", "type", "old_value", "new_value", "counter")
    return found.groupBy("host_id", "pair_seq", "section").agg(F.array_sort(F.collect_list(entry)).alias("changes"))
