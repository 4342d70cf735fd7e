"""Sections recorded at their own pace: when each is due, and what stands in between."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried_forward(rows: DataFrame, columns: list[str], by: str = "host_id", order: list[str] | None = None) -> DataFrame:
    """rows in which a null of columns is the last value before it."""
    back = Window.partitionBy(by).orderBy(*(order or ["ts_ns"])).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})


def merged(held: dict[str, object], text: str | None) -> str:
    """A document's sections over those held (which it becomes), as JSON; what is no JSON object, and a section that is null, changes nothing."""
    try:
        found = json.loads(text or "null")
    except ValueError:
        found = None
    held.update({k: v for k, v in found.items() if v is not None} if isinstance(found, dict) else {})
    return json.dumps(held, ensure_ascii=False, separators=(",", ":"))


def whole_documents(rows: DataFrame) -> DataFrame:
    """rows (host_id, ts_ns, path, raw) with raw made whole: each section as the host's last document that had it said, itself included.

    A host's documents stream through one task in order of time; only the last of each section is held.
    """

    def run(batches):
        import pyarrow as pa

        current, held = None, {}
        for batch in batches:
            out = []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if host != current:
                    current, held = host, {}
                out.append(merged(held, text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=batch.schema.names)

    rows = rows.select("host_id", "ts_ns", "path", "raw")
    return rows.repartition("host_id").sortWithinPartitions("host_id", "ts_ns", "path").mapInArrow(run, rows.schema)


def fired(ticks: DataFrame, by: list[str], at: str, interval: int) -> DataFrame:
    """The ticks (by, at in seconds) at which a section is recorded: the first, then each first one that is interval or more after the last such.

    Each fires relative to the one before, so a group's ticks are gone through in order; groups are spread over tasks,
    and a group streams through its task in sorted batches with one number held.
    """
    schema = ticks.select(*by, F.col(at).cast("long").alias(at)).schema
    keys = [*range(len(by))]

    def run(batches):
        import pyarrow as pa

        current, due = None, 0
        for batch in batches:
            keep = []
            for *key, t in zip(*(batch.column(k).to_pylist() for k in keys), batch.column(len(by)).to_pylist(), strict=True):
                if key != current:
                    current, due = key, t
                keep.append(t >= due)
                if t >= due:
                    due = t + interval
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ticks.select(*by, F.col(at).cast("long").alias(at)).repartition(*by).sortWithinPartitions(*by, at).mapInArrow(run, schema)
