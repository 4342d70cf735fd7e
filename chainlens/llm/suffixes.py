"""Operator 12: byte strings that repeat, by a distributed merge sort of front-coded suffix runs, and their removal."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_MIN, pieces, ship, table, tidy, written
from .substring import keyed

WINDOW = 200
GRAM = 32
SPAN = WINDOW - GRAM + 1  # grams of a window
LARGE = 16_384  # distinct passages of one shard beyond which its windows are counted one by one
RANGE = 16_384  # passages that one merge takes in, about
_SEGMENT = 1 << 20  # windows of a text that are looked at at once

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_HEAD = struct.Struct("<HHHBBqq")  # common bytes with the one before, further bytes, bytes on the left, windows, anchor's place, times, content
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        size = _SEGMENT + WINDOW
        _tables["byte"] = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
        for key, p in (("up", _P), ("down", _INVERSE)):
            _tables[key] = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, p, np.uint64))))
    return _tables[name]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _sums(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_table("byte")[raw] * _table("up")[: len(raw)], dtype=np.uint64)))


def _strings(sums: np.ndarray, length: int) -> np.ndarray:
    """A hash of every string of so many bytes, wherever it stands."""
    n = len(sums) - length
    return _mixed((sums[length:] - sums[:-length]) * _table("down")[:n])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n, cover = len(v) - width + 1, 1
    while cover * 2 <= width:
        v = np.minimum(v[:-cover], v[cover:])
        cover *= 2
    return np.minimum(v[:n], v[width - cover : width - cover + n])


def passages(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A text's windows, dealt into passages: anchor, content hash, and at = first window, anchor's place in it, windows.

    A window's anchor is its gram of least hash, the first of equal ones. Equal windows have equal anchors at equal
    places, so a window can only repeat among passages of the same anchor; neighbouring windows that share their anchor's
    place make one passage, and every window is in exactly one.
    """
    for s in range(0, max(0, len(raw) - WINDOW + 1), _SEGMENT):
        part = raw[s : s + _SEGMENT + WINDOW - 1]
        sums = _sums(part)
        g = _strings(sums, GRAM)
        low = np.uint64(2 * _SEGMENT - 1)
        place = (_least((g & ~low) | np.arange(len(g), dtype=np.uint64), SPAN) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        size = np.diff(np.append(first, len(place)))
        offset = place[first] - first
        shape = (size * 256 + offset).astype(np.uint64)
        content = (sums[first + size + WINDOW - 1] - sums[first]) * _table("down")[first]
        yield g[place[first]].view(np.int64), _mixed(_mixed(content) ^ shape * _P).view(np.int64), (first + s) << 16 | offset << 8 | size


def _bytes(text: pa.StringScalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "content", "did", "th", "at"]
    for batch in pieces(batches):
        parts: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for anchor, content, at in passages(_bytes(text)):
                parts.append((anchor, content, np.full(len(at), did), np.full(len(at), th), at))
                held += len(at)
                if held > 100_000:
                    yield told()
                    held = 0
        if parts:
            yield told()


def spread(anchor: int) -> bytes:
    """An anchor as 8 bytes that are dealt evenly: anchors are the least of many hashes, so their own first bits hardly differ."""
    return ((anchor * int(_P)) % 2**64).to_bytes(8)


def gathered(key: bytes) -> int:
    """The anchor of what spread() gave."""
    anchor = (int.from_bytes(key) * int(_INVERSE)) % 2**64
    return anchor - 2**64 if anchor >= 2**63 else anchor


def shared(a: bytes, b: bytes, known: int) -> int:
    """How many bytes a and b have in common from their start, of which `known` need no look."""
    n = min(len(a), len(b)) - known
    differs = int.from_bytes(a[known : known + n]) ^ int.from_bytes(b[known : known + n])
    return known + n - (differs.bit_length() + 7) // 8


def front_coded(run: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """A sorted run of (suffix, left, windows, anchor's place, times, content), each suffix without what it shares with the one before."""
    out, before = [], b""
    for suffix, left, size, offset, times, content in run:
        same = shared(before, suffix, 0)
        out += [_HEAD.pack(same, len(suffix) - same, len(left), size, offset, times, content), suffix[same:], left]
        before = suffix
    return b"".join(out)


def decoded(block: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """What front_coded() was given, with how much each suffix shares with the one before."""
    at, suffix = 0, b""
    while at < len(block):
        same, more, left, *rest = _HEAD.unpack_from(block, at)
        at += _HEAD.size
        suffix = suffix[:same] + block[at : at + more]
        at += more
        yield same, suffix, (block[at : at + left], *rest)
        at += left


def merged(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Sorted runs as one, each with what it shares with the one before, by a tree of losers.

    Each head knows how much it shares with what came out last: the next of its run by its front code, a loser by the match
    that it lost. Whoever shares more is smaller; only heads that share as much are compared, from there on, so no byte
    that is known to be common is looked at again.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[tuple[bytes, tuple] | None] = [None] * size
    known = [-1] * size  # -1: nothing is left, which loses to all
    for i, run in enumerate(runs):
        if (head := next(run, None)) is not None:
            known[i], heads[i] = 0, head[1:]

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser, which knows afterwards how much it shares with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = heads[a][0], heads[b][0]
        k = shared(x, y, ka)
        a_first = k == len(x) or (k < len(y) and x[k] < y[k])
        known[b if a_first else a] = k
        return (a, b) if a_first else (b, a)

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while known[top] >= 0:
        yield known[top], *heads[top]
        head = next(runs[top], None)
        known[top], heads[top] = (head[0], head[1:]) if head else (-1, None)
        node = (top + size) >> 1
        while node:
            top, losers[node] = match(top, losers[node])
            node >>= 1


def repeated_windows(sorted_suffixes: Iterator[tuple[int, bytes, tuple]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(anchor, content, repeated windows) of passages that come by anchor (8 bytes, see spread) and then by their bytes from the anchor on.

    A window that starts l bytes before the anchor repeats if another passage of the anchor has the same l bytes before and
    the same WINDOW - l from there on. What shares the latter are neighbours in the order of suffixes, what shares the former
    in that of the reversed left sides; so each window is known by two places in these orders.
    """
    rows = list(sorted_suffixes)
    if not rows:
        return
    n = len(rows)
    right = np.array([k - 8 for k, _, _ in rows])
    lefts = [p[0][::-1] for _, _, p in rows]
    size, offset, times, content = (np.array([p[i] for _, _, p in rows], np.int64) for i in (1, 2, 3, 4))
    anchor = np.array([gathered(s[:8]) for _, s, _ in rows], np.int64)
    order = sorted(range(n), key=lefts.__getitem__)
    left = np.array([0, *(shared(lefts[a], lefts[b], 0) for a, b in zip(order, order[1:], strict=False))])
    order = np.array(order)
    found = np.zeros((n, SPAN), bool)
    place = np.empty(n, np.int64)
    for back in range(SPAN):
        there = np.flatnonzero((offset - size < back) & (back <= offset))
        if len(there) > 1:
            place[order] = np.cumsum(left < back)
            key = np.cumsum(right < WINDOW - back)[there] * (n + 1) + place[there]
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            again = there[count[which] > 1]
            found[again, offset[again] - back] = True
    whole = np.flatnonzero(times > 1)
    found[whole] = np.arange(SPAN)[None] < size[whole, None]
    for i in np.flatnonzero(found.any(1)).tolist():
        yield int(anchor[i]), int(content[i]), found[i]


def _extract(shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts and their wanted passages (text, wanted, did, th): blocks of sorted, front-coded runs, one for each range of
    anchors; or hashes of windows of large shards. Rows that repeat come one after the other and are taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in pieces(batches):
            found: list[tuple] = []
            counted: list[tuple] = []
            for text, wanted, did, th in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if before == (did, th):
                    continue
                before = (did, th)
                raw = _bytes(text)
                for w in wanted.as_py():
                    first, offset, size = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    own = raw[first : first + size + WINDOW - 1]
                    if w["large"]:
                        counted.append((w["anchor"], w["content"], w["times"], _strings(_sums(own), WINDOW).view(np.int64).tolist()))
                    else:
                        own = own.tobytes()
                        found.append((spread(w["anchor"]) + own[offset:], own[:offset], size, offset, w["times"], w["content"]))
            found.sort()
            yield _blocks(found, shift)
            if counted:
                a, c, t, h = zip(*counted, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()), *(pa.array(x, pa.int64()) for x in (a, c, t)), pa.array(h, pa.list_(pa.int64()))], names=["range", "block", "anchor", "content", "times", "hashes"])

    return run


def _blocks(found: list[tuple], shift: int) -> pa.RecordBatch:
    ranges = np.array([int.from_bytes(f[0][:8]) >> shift for f in found], np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
    blocks = [front_coded(found[a:b]) for a, b in zip(cuts, [*cuts, len(found)][1:], strict=True)]
    n = len(cuts)
    return pa.RecordBatch.from_arrays([pa.array(ranges[cuts]), pa.array(blocks, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.list_(pa.int64()))], names=["range", "block", "anchor", "content", "times", "hashes"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: range, block, sorted by range. The runs of a range are merged; what repeats in it goes out."""
    now, blocks = None, []

    def told() -> pa.RecordBatch:
        out = list(zip(*repeated_windows(merged([decoded(b) for b in blocks])), strict=True)) or [(), (), ()]
        blocks.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([np.packbits(f).tobytes() for f in out[2]], pa.binary())], names=["anchor", "content", "bits"])

    for batch in pieces(batches):
        for r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blocks and r != now:
                yield told()
            now = r
            blocks.append(block)
    if blocks:
        yield told()


def repeats(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """docs (did, th, text) with spans, [(at, bits, windows)] of the passages that hold repeated windows; null where none does.

    Suffixes are taken at anchors only, since every window holds one and equal windows hold it at the same place. Most
    anchors are there once: nothing of them repeats. Identical passages meet first, with their count; where
    all passages of an anchor are the same, each of their windows repeats. Of other anchors each distinct passage is fetched
    once: tasks sort theirs and send front-coded runs, a range of anchors goes to one task, which merges its runs, and the
    windows that repeat are read off the order. An anchor of over `large` distinct passages is not put into one task:
    its windows are counted by hash.

    Null and empty texts, and those of fewer than WINDOW bytes, have no spans. Rows of equal did and th share their spans and
    repeat one another. An empty table gives an empty result. Anchors and passages are known by 64-bit hashes, a passage by both.
    """
    key = ["did", "th"]
    every = written(docs.select(*key, "text").mapInArrow(_find, "anchor long, content long, did long, th long, at long"), "passages")
    often = every.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") == F.max("content")).alias("same")).where("n > 1")
    often = written(often.select("anchor", "same"), "anchors")
    hits = written(every.join(often, "anchor"), "hits")
    mixed = hits.where("not same")
    one = mixed.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("did", "th", "at")).alias("r"))
    one = written(one.select("anchor", "content", "times", "r.*"), "distinct")
    many = written(one.groupBy("anchor").count().where(F.col("count") > large).select("anchor", F.lit(True).alias("large")), "large")
    some_large, n = many.count(), one.count()
    if some_large:
        one = one.join(F.broadcast(many) if some_large <= 100_000 else many, "anchor", "left")
    shift = 64 - max(0, (n // RANGE).bit_length())
    wanted = F.struct("anchor", "content", "times", "at", F.coalesce("large", F.lit(False)).alias("large") if some_large else F.lit(False).alias("large"))
    wanted = one.groupBy(*key).agg(F.collect_list(wanted).alias("wanted"))
    others = [c for c in docs.columns if c not in ("text", *key)]
    # All columns go along, so that this join and the last one below share one exchange of the texts.
    fetched = docs.join(wanted, key).select("text", "wanted", *key, *others)
    fetched = fetched.mapInArrow(_extract(shift), "range long, block binary, anchor long, content long, times long, hashes array<long>")
    fetched = written(fetched, "runs") if some_large else fetched
    blocks = fetched.where("block is not null").select("range", "block")
    found = blocks.repartition("range").sortWithinPartitions("range").mapInArrow(_merge, "anchor long, content long, bits binary")
    found = found.withColumn("windows", F.expr("cast(null as array<int>)"))
    if some_large:
        each = fetched.where("hashes is not null").select("anchor", "content", "times", F.posexplode("hashes").alias("i", "h"))
        twice = each.groupBy("anchor", "h").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
        counted = each.join(twice, ["anchor", "h"]).groupBy("anchor", "content").agg(F.collect_set("i").alias("windows"))
        found = found.unionByName(counted.select("anchor", "content", F.expr("cast(null as binary)").alias("bits"), "windows"))
    spans = hits.where("same").select(*key, "at", F.expr("cast(null as binary)").alias("bits"), F.expr("cast(null as array<int>)").alias("windows"))
    spans = spans.unionByName(mixed.join(found, ["anchor", "content"]).select(*key, "at", "bits", "windows"))
    return docs.join(spans.groupBy(*key).agg(F.collect_list(F.struct("at", "bits", "windows")).alias("spans")), key, "left")


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of a text's n bytes lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        first, size = s["at"] >> 16, s["at"] & 255
        if s["bits"] is None and s["windows"] is None:
            edge[first] += 1
            edge[first + size + WINDOW - 1] -= 1
        else:
            k = np.flatnonzero(np.unpackbits(np.frombuffer(s["bits"], np.uint8))) if s["windows"] is None else np.array(s["windows"])
            edge[first + k] += 1
            edge[first + k + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [*[pa.int64()] * 4, pa.string()]
    for batch in pieces(batches):
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw, n_spans = _bytes(text), 0
            n = len(raw)
            if spans.is_valid:
                gone = covered(n, spans.as_py())
                n_spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                raw = raw[~gone]
            out.append((doc_id, n, n - len(raw), n_spans, hashlib.sha256(raw).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        tidy()


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeats() of all documents, and what is left without the bytes that repeated windows cover. Null and empty texts have
    no bytes; repeated rows are strings that start elsewhere, so both lose them; rows of one doc_id, or none, are told apart by
    their texts."""
    ship(spark)
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc_id")
    doc_id = F.when(F.col("did") != LONG_MIN + 1, F.col("did")).alias("doc_id")
    return repeats(docs).select(doc_id, "text", "spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
