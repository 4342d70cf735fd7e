"""Operator 13: hard negatives by rotated one-bit codes, whose bounds leave few rows to score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, ship, table, tidy, written

STAGES = 4  # codes of a vector, each of what the ones before leave
PLANES = 6  # bits of an anchor's rotated components
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100  # negatives score from LOW to HIGH hundredths of the positive
GROUP = 20_000  # anchors that are broadcast at once: some 25 MB at 64 components
SAMPLE = 4_096  # rows from which anchors get the least scores that can matter
LIMIT = 2**28  # components beyond this (a million and more before they are scaled) count as this
_ANCHORS, _ROWS = 512, 1_024  # of a block of pairs
_LEAST = -(2**62)

_CODES = "vec_id long, label long, x array<long>, code array<long>, along array<double>, left array<double>"


@lru_cache(maxsize=4)
def rotations(dims: int) -> np.ndarray:
    """STAGES random orthogonal matrices, the same wherever they are made."""
    draw = np.random.default_rng(13)
    return np.stack([np.linalg.qr(draw.standard_normal((dims, dims)))[0] for _ in range(STAGES)])


def _bits(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(on, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integer vectors: code words (rows x stages x words), their alignment with what they stand for, and the norms left over.

    Stage s turns what is left of x by its own rotation and keeps the signs, that is, the unit vector u of these signs;
    along is the inner product of u with what was left, and what is left now is orthogonal to u.
    """
    rest, dims = x.astype(np.float64), x.shape[1]
    codes, along, left = [], [], []
    for turn in rotations(dims):
        turned = rest @ turn.T
        on = turned > 0
        codes.append(_bits(on))
        along.append(np.abs(turned).sum(1) / np.sqrt(dims))
        rest = rest - (along[-1][:, None] / np.sqrt(dims)) * (np.where(on, 1.0, -1.0) @ turn)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, 1), np.stack(along, 1), np.stack(left, 1)


class Anchors:
    """Anchors made ready for bounds: their components in each rotation as PLANES bit planes, with all that this loses."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, q = x, x.astype(np.float64)
        self.dims, self.norm = x.shape[1], np.linalg.norm(q, axis=1)
        self.stages = []
        for turn in rotations(self.dims):
            y = q @ turn.T
            low = y.min(1)
            step = np.maximum(y.max(1) - low, 1e-9) / (2**PLANES - 1)
            k = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
            lost = np.linalg.norm(y - low[:, None] - step[:, None] * k, axis=1)
            self.stages.append(([_bits((k >> b) & 1 == 1) for b in range(PLANES)], low, step, k.sum(1), lost))

    def bounds(self, at: slice, code: np.ndarray, along: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product that each anchor can have with each row (rows x anchors), by its codes alone.

        x is the sum of along * u over the stages and of a rest. Popcounts give an anchor's product with each u up to what
        its bit planes lose; the rest, by Cauchy and Schwarz, adds no more than the anchor's norm without its part along the last u,
        times the norm left.
        """
        middle, slack = 0.0, 0.0
        for s, (planes, low, step, total, lost) in enumerate(self.stages):
            ones = np.bitwise_count(code[:, s]).sum(1, dtype=np.int64)
            hits = sum((np.bitwise_count(code[:, None, s] & p[None, at]).sum(2, dtype=np.int32) << b) for b, p in enumerate(planes))
            product = (low[at] * (2 * ones[:, None] - self.dims) + step[at] * (2 * hits - total[at])) / np.sqrt(self.dims)
            middle = middle + along[:, s, None] * product
            slack = slack + along[:, s, None] * lost[at]
        own = np.maximum(np.abs(product) - lost[at], 0)
        across = np.sqrt(np.maximum(self.norm[at] ** 2 - own**2, 0))
        slack = slack + left[:, -1, None] * across + 1e-7 * (np.abs(middle) + self.norm[at] * left[:, -1, None]) + 1e-3
        return middle - slack, middle + slack


def scores(rows: np.ndarray, anchors: np.ndarray, of_row: np.ndarray, of_anchor: np.ndarray) -> np.ndarray:
    """The integer inner products of pairs."""
    out = np.empty(len(of_row), np.int64)
    for i in range(0, len(out), 1 << 14):
        at = slice(i, i + (1 << 14))
        out[at] = np.einsum("ij,ij->i", rows[of_row[at]], anchors[of_anchor[at]])
    return out


class Best:
    """The first `most` (score, id) of each key: higher scores first, then smaller ids. floor is what can still matter of a key."""

    def __init__(self, keys: int, most: int, floor: np.ndarray) -> None:
        self.most, self.floor = most, floor.copy()
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.keys = keys

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < self.most
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        full = rank == self.most - 1
        self.floor[key[full]] = np.maximum(self.floor[key[full]], score[full])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1 if n else 0)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """ids, labels, vectors, codes, alignments and norms left of a slice of the index."""
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    x, code, along, left = (_matrix(batch.column(i), k) for i, k in ((2, np.int64), (3, np.int64), (4, np.float64), (5, np.float64)))
    return ids, labels, x, code.view(np.uint64).reshape(len(ids), STAGES, -1), along, left


def _index(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            n, vectors = batch.num_rows, batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            x = np.zeros((n, dims))
            x[np.arange(dims)[None] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(256 * x), -LIMIT, LIMIT).astype(np.int64)
            code, along, left = encode(x)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), m.size // max(n, 1)) for m in (x, code.reshape(n, -1).view(np.int64), along, left)] if n else []
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(a.cast(k) for a, k in zip(lists, kinds, strict=True))], names=["vec_id", "label", "x", "code", "along", "left"])

    return index


def indexed(rows: DataFrame) -> DataFrame:
    """The codes of all rows (vec_id, label, embedding) that have a vec_id, a label and a vector of finite numbers alone.

    Vectors may differ in length: a component that is not there is 0. Labels of rows whose vec_id is divisible by 7 move on
    by one, modulo 10.
    """
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(fit).where(~F.exists("embedding", odd))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    dims = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    return written(rows.select("vec_id", label.alias("label"), "embedding").mapInArrow(_index(dims), _CODES), "codes")


class _Sample:
    """Some rows, all of whose scores are known: the last of a key's first `most` among them bounds what can still matter."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x.astype(np.float64)  # whole numbers below 2**53 stay exact; others lose to the margin

    def floors(self, x: np.ndarray, fits: Callable[[int, np.ndarray], list[np.ndarray]], most: int) -> list[list[int]]:
        """Of each vector of x, for each set of rows that fits(i, its scores) gives, the score of the last of the first `most`."""
        out = []
        for i in range(len(x)):
            found = self.x @ x[i].astype(np.float64)
            out.append([int(np.partition(s, len(s) - most)[len(s) - most] - 1e-9 * abs(s).max()) - 1 if len(s) >= most else _LEAST for s in (found[w] for w in fits(i, found))])
        return out


def _search(batches: Iterator[pa.RecordBatch], anchors: Anchors, best: Best, wanted: Callable, keyed: Callable) -> Iterator[pa.RecordBatch]:
    """Each row of the index against all anchors, in blocks: bounds first, then scores of those pairs whose bounds fit.

    wanted(anchors, labels, ids, low, high) says which pairs their bounds leave; keyed(rows' labels, anchors, scores) gives
    (pair, key) of those scores that count.
    """
    for batch in pieces(batches, _ROWS):
        ids, labels, x, code, along, left = _unpacked(batch)
        for a in range(0, len(anchors.x), _ANCHORS):
            at = slice(a, min(a + _ANCHORS, len(anchors.x)))
            low, high = anchors.bounds(at, code, along, left)
            row, anchor = np.nonzero(wanted(at, labels, ids, low, high))
            anchor += a
            score = scores(x, anchors.x, row, anchor)
            pair, key = keyed(anchor, score)
            keep = score[pair] >= best.floor[key]
            best.add(key[keep], score[pair][keep], ids[row[pair]][keep])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (best.key, best.score, best.id)], names=["key", "score", "id"])
    tidy()


def _positives(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, labels, floor = shared.value
        best = Best(len(x), POSITIVES, floor)
        wanted = lambda at, label, own, low, high: (label[:, None] == labels[None, at]) & (own[:, None] != ids[None, at]) & (high >= best.floor[None, at])
        yield from _search(batches, Anchors(x), best, wanted, lambda anchor, score: (np.arange(len(anchor)), anchor))

    return run


def _negatives(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, labels, least, most, floor = shared.value  # the last three: anchors x positives
        slots = least.shape[1]
        best = Best(least.size, NEGATIVES, np.maximum(floor, least).reshape(-1))

        def wanted(at: slice, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            can = best.floor.reshape(least.shape)[at].min(1)
            return (label[:, None] != labels[None, at]) & (own[:, None] != ids[None, at]) & (high >= can[None]) & (low <= most[at].max(1)[None])

        def keyed(anchor: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair, slot = np.nonzero((score[:, None] >= least[anchor]) & (score[:, None] <= most[anchor]))
            return pair, anchor[pair] * slots + slot

        yield from _search(batches, Anchors(x), best, wanted, keyed)

    return run


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` of each key over all tasks' own firsts, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _numpy(df: DataFrame, *columns: str) -> list[np.ndarray]:
    got = df.select(*columns).toArrow()
    return [_matrix(c.combine_chunks(), np.int64) if pa.types.is_list(c.type) else c.to_numpy() for c in got.columns]


def _floor_of(value: Column, by: int) -> Column:
    """value * by / WHOLE, rounded down, of whole numbers."""
    return F.floor(value.cast("decimal(38,0)") * by / WHOLE).cast("long")


def hard_negatives(rows: DataFrame, anchor: Column, group: int = GROUP) -> DataFrame:
    """rows (vec_id, label, embedding) that `anchor` names, each with its positives' hard negatives.

    A row's score is the inner product of its components, times 256 and rounded down, with the anchor's. An anchor's
    positives are the first POSITIVES other rows of its label; a positive's negatives the first NEGATIVES rows of another
    label that score from LOW to HIGH hundredths of it. Higher scores come first, then smaller vec_id.

    All rows are indexed. Anchors are taken in groups of a bounded number, which is what is broadcast, and all rows are read
    once for the positives and once for the negatives of a group; each task keeps the firsts of what it has read, so
    what leaves it doesn't grow with copies of a vector. Bounds never drop a row that belongs: they only save scores.

    Rows without vec_id, label or vector and rows with a component that is null, NaN or infinite take no part. Vectors of
    different lengths meet as if filled up with zeros. Rows of one vec_id are neither positives nor negatives of each other,
    but each counts for others and is an anchor of its own. Fewer positives or negatives than asked for are all there are; an
    anchor or positive without any has no row. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    index = indexed(rows)
    named = index.where(anchor).select("vec_id", "label", "x")
    n = named.count()
    groups = max(1, -(-2 * n // group))  # by hash, so a group has half of the bound on average
    some = index.where(F.lit(n > 0)).select("vec_id", "label", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = _Sample(*_numpy(some, "vec_id", "label", "x"))
    out: list[DataFrame] = []
    for g in range(groups if n else 0):
        mine = named.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else named
        ids, labels, x = _numpy(mine.orderBy("vec_id", "label", "x"), "vec_id", "label", "x")
        if not len(ids):
            continue
        floor = sample.floors(x, lambda i, _: [(sample.labels == labels[i]) & (sample.ids != ids[i])], POSITIVES)
        shared = spark.sparkContext.broadcast((x, ids, labels, np.array(floor, np.int64)[:, 0]))
        found = _first(index.mapInArrow(_positives(shared), "key long, score long, id long"), POSITIVES)
        found = written(found.select("key", "rank", "id", "score", (-_floor_of(-F.col("score"), LOW)).alias("least"), _floor_of(F.col("score"), HIGH).alias("most")), "positives")
        key, rank, pid, pscore, least, most = _numpy(found, "key", "rank", "id", "score", "least", "most")
        slots = [np.full((len(ids), POSITIVES), v, np.int64) for v in (0, 0, -_LEAST, _LEAST)]
        for slot, values in zip(slots, (pid, pscore, least, most), strict=True):
            slot[key, rank - 1] = values
        floor = sample.floors(x, lambda i, s: [(sample.labels != labels[i]) & (sample.ids != ids[i]) & (s <= u) for u in slots[3][i]], NEGATIVES)
        shared = spark.sparkContext.broadcast((x, ids, labels, slots[2], slots[3], np.array(floor, np.int64)))
        negatives = _first(index.mapInArrow(_negatives(shared), "key long, score long, id long"), NEGATIVES)
        names = spark.createDataFrame(pa.table({"key": np.arange(len(ids) * POSITIVES), "anchor_id": np.repeat(ids, POSITIVES), "positive_id": slots[0].reshape(-1), "positive_score": slots[1].reshape(-1)}))
        told = negatives.join(F.broadcast(names), "key").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(written(told, "negatives"))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for part in out:
        empty = empty.unionByName(part)
    return empty


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hard_negatives() of all embeddings; anchors are the rows whose vec_id is divisible by 100."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: The same in SQL: every anchor against every row.
OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)])::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
