"""Canonical JSON, hashes, and the fold that chains documents."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GENESIS


#: Before a number that JSON's own writer would spell otherwise; no document that holds one is written with it.
_MARK = "\ue000"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _canonical() -> Callable[[Iterable[str | None]], list[str | None]]:
    """The function that spells a batch of documents. It is made here, so that it reaches workers that have not this package."""

    def number(token: str) -> str:
        """A number as the shortest decimal: no zero fraction, no exponent from 1e-6 up to below 1e21, and e+21, e-7 beyond."""
        value = Decimal(token)
        if "e" in token or "E" in token or len(token) > 38:
            value = Decimal(repr(float(token)))
            if not value.is_finite():
                raise ValueError(token)
        if not value:
            return "0"
        sign, figures, exponent = value.as_tuple()
        digits, at = "".join(map(str, figures)).rstrip("0"), len(figures) + exponent - 1  # the power of ten of the first digit
        if at >= 21 or at < -6:
            text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{at:+d}"
        elif at < 0:
            text = "0." + "0" * (-at - 1) + digits
        else:
            text = digits.ljust(at + 1, "0") if len(digits) <= at + 1 else digits[: at + 1] + "." + digits[at + 1 :]
        return "-" * sign + text

    def distinct(pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("a repeated key")
        return found

    def refused(token: str) -> None:
        raise ValueError(token)

    def canonical(batch: Iterable[str | None]) -> list[str | None]:
        texts, mark, odd = list(batch), _MARK, []
        while any(t is not None and mark in t for t in texts):
            mark += _MARK

        def marked(token: str) -> str:
            odd.append(token)
            return mark + "#" + number(token)

        read = json.JSONDecoder(parse_float=marked, parse_constant=refused, object_pairs_hook=distinct).decode
        write = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode

        def spelled(raw: str | None) -> str | None:
            if raw is None:
                return None
            odd.clear()
            try:
                text = write(read(raw))
            except (ValueError, RecursionError):
                return None
            if "\\u" in raw:  # halves of surrogate pairs, which no text can hold
                text = text.encode("utf-8", "replace").decode()
            return re.sub(f'"{mark}#([^"]*)"', r"\1", text) if odd else text

        gc.disable()  # what a document is made of holds no cycles
        try:
            return [spelled(t) for t in texts]
        finally:
            gc.enable()

    return canonical


def canonical_json(raw: Column) -> Column:
    """A document with keys sorted at every level and nothing between tokens; null where it is no JSON.

    Integers stay exact, however large. Other numbers are shortest decimals: 1e3 and 1000.0 are 1000. A document with a
    repeated key, of which no one can tell which value was meant, or with a number beyond double precision's range is
    null, so it counts as corrupt and is reported.
    """
    canonical = _canonical()

    @F.pandas_udf("string")
    def texts(raw: pd.Series) -> pd.Series:
        return pd.Series(canonical(raw), dtype=object)

    return texts(raw)


def document_hash(raw: Column) -> Column:
    """The SHA-256 of a document's canonical JSON."""
    canonical = _canonical()

    @F.pandas_udf("string")
    def hashes(raw: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else hashlib.sha256(t.encode()).hexdigest() for t in canonical(raw)], dtype=object)

    return hashes(raw)


def chain_head(payloads: Column) -> Column:
    """The last link of a chain over an array of payloads in order: each link hashes the one before and its payload."""
    return F.aggregate(payloads, F.lit(GENESIS), lambda head, p: F.sha2(F.concat(head, p), 256))


def chain(rows: DataFrame, host: str, order: list[str], payload: str) -> DataFrame:
    """rows with prev_hash and hash, each host's chained in order.

    A chain is sequential in itself, so a host is in one task; its rows stream through in sorted order and only one hash
    is held, however many there are.
    """
    schema = rows.select("*", F.lit("").alias("prev_hash"), F.lit("").alias("hash")).schema
    at, key = rows.columns.index(payload), rows.columns.index(host)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, head = None, GENESIS
        for batch in batches:
            before, after = [], []
            for h, p in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if h != current:
                    current, head = h, GENESIS
                before.append(head)
                head = hashlib.sha256((head + (p or "")).encode()).hexdigest()
                after.append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    return rows.repartition(host).sortWithinPartitions(host, *order).mapInArrow(fold, schema)
