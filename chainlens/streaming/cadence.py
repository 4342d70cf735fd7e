"""Sections at their own pace in a stream: state holds when each is due next and its last value."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cadence import merged


#: Python is called once a micro-batch for each of so many buckets of sections.
BUCKETS = 512
_FIRED = "host_id string, section string, t long, value string, recorded boolean"


def fired(ticks: DataFrame, interval: int, idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The ticks (host_id, section, t in seconds, value) at which a section is recorded, as operators.cadence.fired has them.

    A tick between two recordings is given too, with the value carried forward (recorded: false). Ticks of a micro-batch
    go in time order; one that is older than the last recording is taken for what it is, a tick before the next is due.
    State holds the sections of a bucket of hosts together, so a micro-batch calls Python once a bucket and not once a
    section. With idle (needs a watermark on the stream), a section's state goes after so long without ticks, so each is kept
    by itself.
    """
    if idle:
        return _fired_by_section(ticks, interval, idle)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(host, section): (due, held) for host, section, due, held in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat([*batches]).sort_values("t", kind="stable")
        values, marks = [], []
        for host, section, t, value in zip(rows["host_id"].tolist(), rows["section"].tolist(), rows["t"].tolist(), rows["value"].tolist(), strict=True):
            due, held = known.get((host, section), (None, None))
            recorded = due is None or t >= due
            if recorded:
                held = value
                known[host, section] = (t + interval, value)
            values.append(held)
            marks.append(recorded)
        state.update((json.dumps([[*k, *v] for k, v in known.items()], ensure_ascii=False, separators=(",", ":")),))
        yield pd.DataFrame({"host_id": rows["host_id"], "section": rows["section"], "t": rows["t"], "value": pd.Series(values, rows.index, object), "recorded": pd.Series(marks, rows.index, bool)})

    bucket = F.pmod(F.xxhash64("host_id", "section"), F.lit(buckets)).cast("int")
    rows = ticks.select("host_id", "section", "t", "value", bucket.alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(step, _FIRED, "known string", "append", GroupStateTimeout.NoTimeout)


def _fired_by_section(ticks: DataFrame, interval: int, idle: str) -> DataFrame:
    """fired with a state for each section, that times out."""
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        due, held = state.get if state.exists else (None, None)
        rows = pd.concat([*batches]).sort_values("t", kind="stable")
        out = []
        for t, value in zip(rows["t"].tolist(), rows["value"].tolist(), strict=True):
            recorded = due is None or t >= due
            if recorded:
                due, held = t + interval, value
            out.append((*key, t, held, recorded))
        state.update((due, held))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["host_id", "section", "t", "value", "recorded"])

    return ticks.groupBy("host_id", "section").applyInPandasWithState(step, _FIRED, "due long, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def whole_documents(stream: DataFrame, idle: str | None = None) -> DataFrame:
    """Documents of some sections (host_id, ts_ns, path, raw) as they arrive, each made whole, as operators.cadence has them.

    State holds the last JSON of each host's sections, one text a host. Documents of a micro-batch go in time order; one that
    comes in a later batch than a newer one counts when it comes. With idle (needs a watermark) a host's state goes after so long.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat([*batches]).sort_values(["ts_ns", "path"], kind="stable")
        out = [(*key, t, path, merged(held, raw)) for t, path, raw in zip(rows["ts_ns"].tolist(), rows["path"].tolist(), rows["raw"].tolist(), strict=True)]
        state.update((json.dumps(held, ensure_ascii=False),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["host_id", "ts_ns", "path", "raw"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy("host_id").applyInPandasWithState(step, "host_id string, ts_ns long, path string, raw string", "held string", "append", timeout)
