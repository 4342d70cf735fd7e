"""What the corpus operators share: reading tables, shared scratch tables, shipping code, sampled ranges."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (ASCII white space).
WORD_GAP = r"[\x20\x09-\x0D]+"
LONG_MIN = -(2**63)
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark.sparkContext, "_chainlens_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._chainlens_scratch = root
    return root


def _made(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_chainlens_tables"):
        context._chainlens_tables = []
    return context._chainlens_tables


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs nothing before it.

    While it is written, Arrow batches are held to BATCH_ROWS, since each stands in the executor beside its heap and in the
    worker; the session's setting is put back after.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/chainlens/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH)
    try:
        if not 0 < int(rows) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    _made(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables(spark: SparkSession) -> list[str]:
    """The scratch tables of this session that are still there, in the order in which they were written."""
    return [*_made(spark)]


def clear(spark: SparkSession, tables: list[str]) -> None:
    """Deletes scratch tables. What still reads them fails afterwards, so its results must be written first."""
    for path in tables:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made(spark):
            _made(spark).remove(path)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once a session, so that Python tasks import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_chainlens_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="spark-"), "chainlens.zip"))
    with zipfile.ZipFile(target, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, str(Path(package.name) / f.relative_to(package)))
    context.addPyFile(target)
    context._chainlens_shipped = True


def tidy() -> None:
    """Gives freed memory back to the system, which allocators would else keep for the worker's life, beside other workers and the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_caches: dict[str, dict] = {}


def cache(operator: str) -> dict:
    """What an operator's tasks keep for those that follow them in a worker."""
    return _caches.setdefault(operator, {})


def release(but: str = "") -> None:
    """Drops what tasks of other operators left in this worker."""
    for operator, kept in _caches.items():
        if operator != but:
            kept.clear()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, operator: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that only a slice's texts stand beside their batch as Python objects."""
    release(operator)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        tidy()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(v: int) -> str:
    return f"{v}L" if v > LONG_MIN else f"(-{2**63 - 1}L - 1L)"


def longs(values: list[int]) -> Column:
    """A literal array<bigint>."""
    return F.expr("array(" + ",".join(map(_long, values)) + ")") if values else F.expr("cast(array() as array<bigint>)")


def literals(values: list) -> Column:
    """A literal array of longs, or of structs of longs (rows, whose names are kept)."""
    if not values or isinstance(values[0], int):
        return longs(values)
    row = lambda r: "named_struct(" + ",".join(f"'{n}',{_long(v)}" for n, v in r.asDict().items()) + ")"
    return F.expr("array(" + ",".join(map(row, values)) + ")")


def weighted_splitters(rows: DataFrame, key: Column, weight: Column, n_ranges: int, oversample: int = 16, seed: int = 7) -> list:
    """At most n_ranges - 1 keys of rows (longs or structs of longs), at equal steps of weight.

    Each row is drawn with a chance in proportion to its weight (surely, where it is a whole step's worth), so about
    n_ranges * oversample keys reach the driver, whatever the size of rows.
    """
    total = rows.agg(F.sum(weight)).first()[0] or 0
    if total <= 0 or n_ranges < 2:
        return []
    step = total / (n_ranges * oversample)
    drawn = rows.select(key.alias("k"), weight.cast("double").alias("w")).where(F.rand(seed) * step < F.col("w")).select("k", F.greatest("w", F.lit(step)).alias("w"))
    drawn = sorted(drawn.collect())
    cuts, passed, share = [], 0.0, sum(w for _, w in drawn) / n_ranges
    for k, w in drawn:
        if passed >= share * (len(cuts) + 1):
            if not cuts or k > cuts[-1]:
                cuts.append(k)
            passed = max(passed, share * len(cuts))
        passed += w
    return cuts[: n_ranges - 1]


def range_index(key: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most key, by binary search: range r > 0 starts at cuts[r - 1]."""
    if not cuts:
        return F.lit(0)
    array = literals(cuts)
    steps = [2**i for i in range(int(math.log2(len(cuts))), -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) <= key, at + s).otherwise(at))
