"""Operator 5: SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, release, ship, table, tidy, written

WORDS = 4
SEED = 42
DISTANCE = 4
FAN = 8  # children of an upper node
PAIRS = 2_000_000  # (query, node) pairs held at once
#: keep_one: texts are linked that share LIKE[0] of LIKE[1] parts of their sets of COPY_WORDS words.
COPY_WORDS = 5
LIKE = (4, 5)
BANDS, BAND_ROWS = 20, 5
LEADERS = 8  # texts of a bucket that meet all of it
HELD = 1_000_000  # shingles of a tile, and postings counted at once
_SLICE = 1 << 16


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a whole text (null: empty), each shingle counted as often as it comes; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space alone, on bytes
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = start + size
    if len(found) >= words:
        start, end = start[: len(found) - words + 1], end[words - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(start), _SLICE):
        spans = zip(start[at : at + _SLICE].tolist(), end[at : at + _SLICE].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    release()
    for batch in texts:
        yield pa.array(np.array([fingerprint_of(t.as_py()) for t in batch], np.uint64).view(np.int64))
        tidy()


def fingerprint() -> Column:
    """A function of a text column: the fingerprint's bits as a long."""
    return F.arrow_udf(_fingerprints, "long")


def gray_rank(fp: Column) -> Column:
    """The place of fp among all 64-bit words in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def near_pairs(fp: np.ndarray, first: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one group whose fingerprints differ in at most distance bits.

    fp is sorted by group and, within it, by Gray rank; first holds each group's first row. Over every FAN neighbours
    stands a node with the bits they share (mask, value), up to one root a group. A search goes down from the root and
    adds up, node by node, the differences in those bits that the parent does not share; it leaves a node out with all
    below it once the sum is over distance. At a row the sum is the Hamming distance.
    """
    full = np.uint64(2**64 - 1)
    levels = []  # from rows up: mask, value, group's first node, node's first child, children, last row
    mask, value, at = np.full(len(fp), full), fp, first
    last = np.arange(len(fp))
    child = count = None
    while True:
        levels.append((mask, value, child, count, last))
        sizes = np.diff(np.append(at, len(value)))
        if (sizes == 1).all():
            break
        n = -(-sizes // FAN)
        up = np.concatenate(([0], np.cumsum(n)[:-1]))
        child = np.repeat(at, n) + FAN * (np.arange(n.sum()) - np.repeat(up, n))
        count = np.diff(np.append(child, len(value)))
        count = np.minimum(count, FAN)
        both, any_ = np.bitwise_and.reduceat(value, child), np.bitwise_or.reduceat(value, child)
        shared = np.bitwise_and.reduceat(mask, child) & ~(both ^ any_)
        mask, value, last, at = shared, both & shared, last[child + count - 1], up
    sizes = np.diff(np.append(first, len(fp)))
    root = np.repeat(np.arange(len(first)), sizes)
    load = np.cumsum(np.repeat(sizes, sizes))
    begin = 0
    while begin < len(fp):
        stop = max(begin + 1, int(np.searchsorted(load, (load[begin - 1] if begin else 0) + PAIRS)))
        query = np.arange(begin, stop)
        node, differ = root[begin:stop], np.zeros(stop - begin, np.uint8)
        for k in range(len(levels) - 1, 0, -1):
            upper, (low_mask, low_value, _, _, low_last) = levels[k], levels[k - 1]
            n = upper[3][node]
            query, differ, parent = np.repeat(query, n), np.repeat(differ, n), np.repeat(node, n)
            node = np.repeat(upper[2][node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            differ = differ + np.bitwise_count((fp[query] ^ low_value[node]) & low_mask[node] & ~upper[0][parent])
            keep = (differ <= distance) & (low_last[node] > query)
            query, node, differ = query[keep], node[keep], differ[keep]
        yield query, node
        begin = stop


def stars(fp: np.ndarray, first: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """For each row linked to others of its group, directly or not: its fingerprint and that of its component's first row."""
    parent = np.arange(len(fp))

    def roots(x: np.ndarray) -> np.ndarray:
        x = parent[x]
        while (up := parent[x]) is not None and (up != x).any():
            x = up
        return x

    for i, j in near_pairs(fp, first, distance):
        while len(i):
            i, j = roots(i), roots(j)
            apart = i != j
            i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
            np.minimum.at(parent, j, i)
    root = roots(np.arange(len(fp)))
    linked = root != np.arange(len(fp))
    return fp[linked], fp[root[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: fp as the last column, the group's columns before it; a group's rows come together."""
    held: list[pa.RecordBatch] = []

    def solve(rows: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        columns = [c.to_numpy() for c in whole.columns]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)) + 1
        first = np.concatenate(([0], change))
        end = whole.num_rows if last else first[-1]
        rest = None if last else whole.slice(end).to_batches()
        first = first[first < end]
        sizes = np.diff(np.append(first, end))
        keep = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        out = None
        if len(sizes):
            a, b = stars(columns[-1][:end][keep].view(np.uint64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
            a, b = np.maximum(s := a.view(np.int64), t := b.view(np.int64)), np.minimum(s, t)
            out = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        return out, rest

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= 200_000 and any(c[0] != c[-1] for c in batch.columns[:-1]):
            out, held = solve(held, False)
            if out is not None:
                yield out
    if held:
        out, _ = solve(held, True)
        if out is not None:
            yield out
    tidy()


def block_masks(agreeing: int, distance: int = DISTANCE) -> list[int]:
    """Masks of which any two words within distance agree on one at least: all choices of agreeing out of distance + agreeing blocks."""
    n = distance + agreeing
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(2**b - 1) ^ (2**a - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    return [signed(sum(c)) for c in combinations(blocks, agreeing)]


def links(fps: DataFrame, tile: int = 4096) -> DataFrame:
    """Pairs (a, b), a > b, that connect just what the fingerprints of fps (fp, distinct) within DISTANCE bits connect.

    Words within DISTANCE bits agree on some choice of blocks; each fingerprint goes to one group for each choice, and
    more blocks must agree the more fingerprints there are, so that groups stay small: 1, 2 or 3. A group larger than
    tile is cut into tiles by a hash, and each two tiles meet in a task of their own; none is dropped or cut short.
    Within a group the Gray-order index finds the links and keeps a star for each connected set, at most one pair a row.
    """
    ship(fps.sparkSession)
    n = fps.count()
    agreeing = next((k for k in (1, 2) if n / 2 ** (64 * k // (DISTANCE + k)) <= tile / 2), 3)
    masks = F.array(*[F.struct(F.lit(i).alias("which"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(block_masks(agreeing))])
    rows = fps.select("fp", F.explode(masks).alias("m")).select(F.col("m.which").alias("which"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bits"), "fp")
    large = written(rows.groupBy("which", "bits").count().where(F.col("count") > tile).select("which", "bits", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "large")
    few = large.count()
    if few:
        rows = rows.join(F.broadcast(large) if few <= 100_000 else large, ["which", "bits"], "left")
    else:
        rows = rows.withColumn("tiles", F.lit(1))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    rows = rows.select("which", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"), "fp")
    rows = rows.select("which", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    group = ["which", "bits", "low", "high"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, gray_rank(F.col("fp")))
    return rows.mapInArrow(_links, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Each word of the pairs (a, b) but the least of its connected set, as a, with that least one as b.

    Large and small stars by turns: every word hands its neighbours on to the least of them, until nothing changes.
    """
    state = None
    edges = written(pairs, "edges")
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (n, total) == state or not n:
            return edges
        state = (n, total)
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(moved.where("a > b").distinct(), "edges")


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """fps (fp, distinct, and others) with root, the least fingerprint that links reach."""
    return fps.join(components(links(fps.select("fp"))).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, fp, root and component_id (the least doc_id that links reach) of each row of docs (doc_id, text), with extra columns.

    root is the least fingerprint of the component and names it; component_id need not, where doc_ids are null or repeat.

    Equal fingerprints meet before anything is compared. Null text is empty text; all texts without words have the
    fingerprint 0 and are one component. Null doc_ids count only where a component has no other.
    """
    ship(docs.sparkSession)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint()("text").alias("fp"), *(extra or [])), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    placed = fingerprint_components(fps)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = written(placed.join(least, "root").select("fp", "root", "component_id"), "placed")
    return rows.join(placed, "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = COPY_WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; a text of fewer words is one shingle, also one of none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def band_hashes(shingles: np.ndarray) -> list[int]:
    """For each band a hash of BAND_ROWS least values of the set under random functions: equal sets have equal bands."""
    draw = np.random.default_rng(SEED)
    factor, shift = draw.integers(0, 2**63, (2, BANDS * BAND_ROWS), np.uint64)
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * (2 * factor + np.uint64(1)) + shift).min(0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - 2**63 for k, b in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """th, text to th, the text's fingerprint, and size, key and bands of its shingle set."""
    for some in pieces(batches):
        fp, size, key, bands = [], [], [], []
        for text in some.column(1):
            fp.append(fingerprint_of(text.as_py()))
            shingles = shingle_set(text.as_py())
            size.append(len(shingles))
            key.append(xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63)
            bands.append(band_hashes(shingles))
        fps = pa.array(np.array(fp, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([some.column(0), fps, pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["th", "fp", "size", "key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, buckets, text to key, buckets and the text's shingles."""
    for some in pieces(batches, 100):
        shingles = pa.array([shingle_set(t.as_py()).tobytes() for t in some.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), shingles], names=["key", "buckets", "shingles"])


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """The first row of each row's component, rows being linked by a likeness of LIKE; all pairs, counted exactly."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.concatenate(([0], np.cumsum(size)))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    first = np.searchsorted(ids[order], np.arange(ids.max() + 2))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(1, len(sets)):
        own = ids[start[i] : start[i + 1]]
        a, n = first[own], first[own + 1] - first[own]
        common, upto, begin = np.zeros(len(sets), np.int64), np.cumsum(n), 0
        while begin < len(own):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HELD)))
            m = n[begin:end]
            common += np.bincount(holder[np.repeat(a[begin:end] - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(sets))
            begin = end
        common = common[:i]
        for j in np.flatnonzero(LIKE[1] * common >= LIKE[0] * (size[i] + size[:i] - common)):
            x, y = sorted((root(i), root(int(j))))
            parent[y] = x
    return np.array([root(i) for i in range(len(sets))])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: band, bucket, low, high, key, shingles; a group's rows come together. Pairs of one key are none."""
    group, keys, sets = None, [], []

    def solve() -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            key = np.array(keys, np.int64)
            head = key[alike(sets)]
            a, b = np.maximum(key, head), np.minimum(key, head)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    for batch in batches:
        for *name, key, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != group:
                yield from solve()
                group, keys, sets = name, [], []
            keys.append(key)
            sets.append(np.frombuffer(shingles, np.uint64))
        tidy()
    yield from solve()


_GROUP = ["band", "bucket", "low", "high"]


def first_groups(bands: DataFrame, shared: DataFrame) -> DataFrame:
    """Which groups a text (key) joins at first: its tile of each bucket that it shares, and, for a bucket's LEADERS, all of
    its tiles. So a bucket's groups grow with its texts, and copies of one form come together through its leaders."""
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    tiles = F.when(F.array_contains("leaders", F.col("key")), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own))
    placed = bands.join(shared, ["band", "bucket"]).select("th", "key", "band", "bucket", F.explode(tiles).alias("low"))
    return placed.withColumn("high", F.col("low"))


def last_groups(bands: DataFrame, shared: DataFrame, roots: DataFrame, tile: int) -> DataFrame:
    """The groups in which texts of cut buckets meet that first_groups did not connect: those outside a bucket's greatest
    component, tile by tile, with each other and with it. Within it no two texts meet again."""
    bucket = ["band", "bucket"]
    cut = bands.join(shared.where("tiles > 1").select(*bucket), bucket)
    rooted = written(cut.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    parts = rooted.groupBy(*bucket, "root").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    tiles = lambda n, held: F.greatest(F.ceil(n / tile), F.ceil(held / HELD)).cast("int")
    sides = parts.groupBy(*bucket).agg(F.max_by(F.struct("root", "n", "held"), F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("held").alias("held")).where("n > main.n")
    rest = tiles(F.col("n") - F.col("main.n"), F.col("held") - F.col("main.held"))
    sides = sides.select(*bucket, F.col("main.root").alias("main"), rest.alias("rest"), tiles(F.col("main.n"), F.col("main.held")).alias("tiles"))
    met = rooted.join(sides, bucket)
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    within = F.transform(upto("rest"), lambda j: pair(F.least(own("rest"), j), F.greatest(own("rest"), j)))
    across = F.transform(upto("tiles"), lambda j: pair(own("rest"), F.col("rest") + j))
    beside = F.transform(upto("rest"), lambda i: pair(i, F.col("rest") + own("tiles")))
    groups = F.when(F.col("root") == F.col("main"), beside).otherwise(F.concat(within, across))
    return met.select("th", "key", *bucket, F.inline(groups))


def _pairs(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of texts that are alike within groups (th, key, band, bucket, low, high)."""
    met = groups.groupBy("th", "key").agg(F.collect_list(F.struct(*_GROUP)).alias("buckets"))
    some = texts.dropDuplicates(["th"]).join(met, "th")
    sets = some.select("key", "buckets", "text").mapInArrow(_sets, "key long, buckets array<struct<band:int,bucket:long,low:int,high:int>>, shingles binary")
    sets = sets.select(F.explode("buckets").alias("m"), "key", "shingles").select("m.*", "key", "shingles")
    return sets.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_copies, "a long, b long").distinct()


def meetings(rows: DataFrame) -> DataFrame:
    """The buckets (key, th, size, band, bucket) in which texts (th, fp, size, key, bands) may meet, one th for each key.

    Band 0 is the SimHash index: its buckets are the components of fingerprints, by their roots. The other bands are those of
    the shingle sets, for texts that are alike but more than DISTANCE bits apart. A key whose texts have several fingerprints
    is in the component of each.
    """
    one = rows.groupBy("key").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("size", "bands")])
    placed = fingerprint_components(written(rows.select("fp").distinct(), "distinct"))
    found = rows.select("key", "fp").distinct().join(placed, "fp").select("key", F.col("root").alias("bucket")).distinct()
    found = found.join(one.select("key", "th", "size"), "key").select("key", "th", "size", F.lit(0).alias("band"), "bucket")
    banded = one.select("key", "th", "size", F.posexplode("bands").alias("band", "bucket"))
    return found.unionByName(banded.withColumn("band", F.col("band") + 1))


def copies(docs: DataFrame, tile: int = 512) -> DataFrame:
    """th (a hash of the text) and root of each distinct text of docs (text): texts that links of likeness LIKE connect have one root.

    Texts of equal shingle sets meet first. Texts whose fingerprints the SimHash index connects share a bucket, and so do
    texts that agree in a band (see meetings); within a bucket they are compared by
    their whole sets. A bucket of over tile texts or HELD shingles is cut into tiles: at first texts meet within their tile
    and with the bucket's leaders, and then only those that no link has brought into the bucket's greatest component
    meet the rest of it, so a million copies of one form cost as much as they are. None is dropped or cut short. Buckets
    of the very same texts, as near copies share many, would find the same links, so one of them stands for all.
    Texts are known by 64 bits of a hash, a bucket's texts by their number and 128 bits.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.xxhash64("text").alias("th"), "text")
    rows = written(texts.mapInArrow(_sketches, "th long, fp long, size long, key long, bands array<long>"), "sketches")
    rows = written(rows.groupBy("th").agg(*[F.first(c).alias(c) for c in ("fp", "size", "key", "bands")]), "texts")
    bands = written(meetings(rows), "bands")
    tiles = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / HELD)).cast("int")
    leaders = F.array(*[F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(LEADERS)])
    members = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"m{i}") for i in range(2)]
    shared = bands.groupBy("band", "bucket").agg(F.count("*").alias("n"), *members, tiles.alias("tiles"), leaders.alias("leaders")).where("n > 1")
    shared = written(shared.dropDuplicates(["n", "m0", "m1"]).select("band", "bucket", "tiles", "leaders"), "shared")
    pairs = _pairs(texts, first_groups(bands, shared))
    if not shared.where("tiles > 1").isEmpty():
        pairs = written(pairs, "pairs")
        roots = components(pairs).toDF("key", "root")
        pairs = pairs.union(_pairs(texts, last_groups(bands, shared, roots, tile))).distinct()
    return rows.select("th", "key").join(components(pairs).toDF("key", "root"), "key", "left").select("th", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies (see copies): the first by doc_id, null ones last.

    Of repeated rows, and of rows of one text and doc_id, one stays. Null and empty texts and texts of white space alone
    are copies of one another. All columns come back as they were, whatever their names; an empty table gives an empty result.
    """
    keys = [F.xxhash64("text").alias("th"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    roots = copies(docs).toDF("th", "root")
    first = rows.select("th", "id", "none").distinct().join(roots, "th").groupBy("root").agg(F.min(F.struct("none", "id", "th")).alias("k"))
    names = ["th", "id", "none"]
    kept = rows.join(first.select(*[F.col(f"k.{n}") for n in names]), names, "left_semi")
    one = Window.partitionBy(*names).orderBy(F.lit(0))
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
