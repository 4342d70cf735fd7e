"""Operator 11: the prefix trie of conversations, from sorted matrices of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, ship, table, tidy, written

BLOCK = 64  # turns of a row: longer conversations are several rows, each known by what comes before it
ROWS = 8192  # rows of a matrix
EMPTY = hashlib.sha256(b"").hexdigest()

_TURN = "array<struct<a long, b long, g1 long, g2 long, size long>>"
_ROW = f"level long, p1 long, p2 long, conv long, ended boolean, turns {_TURN}, more_leaves long, more_saved long"
#: node: all is known but perhaps conv of the parent, which k1 and k2 tell; part: what one matrix adds to the node g1, g2;
#: ends: conv_ids that end there, in order of conv; edge: the first and last row of a task; weight: what a row of a
#: longer conversation adds to all that comes before it.
_OUT = f"kind string, depth long, conv long, parent long, g1 long, g2 long, k1 long, k2 long, n long, children long, leaves long, saved long, text string, task int, first struct<level long, p1 long, p2 long, conv long, ended boolean, turns {_TURN}>, last struct<level long, p1 long, p2 long, conv long, ended boolean, turns {_TURN}>"
_SCHEMA = pa.schema(
    [("kind", pa.string()), *((c, pa.int64()) for c in ("depth", "conv", "parent", "g1", "g2", "k1", "k2", "n", "children", "leaves", "saved")), ("text", pa.string()), ("task", pa.int32())]
    + [(c, pa.struct([("level", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("conv", pa.int64()), ("ended", pa.bool_()), ("turns", pa.list_(pa.struct([(t, pa.int64()) for t in ("a", "b", "g1", "g2", "size")])))])) for c in ("first", "last")]
)


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns (conv, pos from 0, a, b, size) of conversations (conv_id, turn, role, text) in order of turn, null first.

    a and b, two 64-bit hashes, stand for role and text, null ones as empty; size is the text's bytes. Turns of one number
    stand in the order of these hashes. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("size"))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "a", "b")) - 1
    return rows.select("conv", pos.cast("long").alias("pos"), "a", "b", "size")


def spliced(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own first h, where h is
    crc32 of the decimal c, modulo heads; and the conversations that have no turn then. Turns are (conv, part, pos, a, b, size)."""
    conv = F.col("conv")
    h = F.crc32(conv.cast("string").cast("binary")) % heads
    turns = written(turns, "turns")
    turn = F.struct("pos", "a", "b", "size")
    known = turns.groupBy("conv").agg(F.count("*").alias("n"), F.collect_list(F.when((conv % every == 0) & (F.col("pos") < heads - 1), turn)).alias("head"))
    donors = known.where(conv % every == 0).select(conv.alias("donor"), F.col("head"))
    given = known.drop("head").withColumn("donor", conv - conv % every).join(donors, "donor", "left")
    given = written(given.select("conv", "n", F.filter("head", lambda t: t["pos"] < h).alias("head")), "heads")
    got = given.select("conv", F.lit(0).alias("part"), F.inline("head"))
    own = turns.where(F.col("pos") >= h).select("conv", F.lit(1).alias("part"), "pos", "a", "b", "size")
    return got.unionByName(own), given.where((F.coalesce(F.size("head"), F.lit(0)) <= 0) & (F.col("n") <= h)).select("conv")


def _rows(turns: DataFrame, turnless: DataFrame, block: int) -> DataFrame:
    """`block` turns of a conversation each, with a hash of every prefix (g1, g2) and of what comes before (p1, p2)."""
    order = Window.partitionBy("conv").orderBy("part", "pos")
    turns = turns.withColumn("d", F.row_number().over(order).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    for g, parts in (("g1", ("a", "b", "d")), ("g2", ("d", "b", "a"))):
        turns = turns.withColumn(g, F.bit_xor(F.xxhash64(*parts)).over(so_far))
    for p, g in (("p1", "g1"), ("p2", "g2")):
        turns = turns.withColumn(p, F.coalesce(F.lag(g).over(order), F.lit(0).cast("long")))
    turns = turns.withColumn("ended", F.lead("d").over(order).isNull())
    each = F.struct("d", F.struct("a", "b", "g1", "g2", "size").alias("t"))
    blocks = turns.groupBy("conv", F.expr(f"(d - 1) div {block}").alias("level")).agg(F.min_by("p1", "d").alias("p1"), F.min_by("p2", "d").alias("p2"), F.bool_or("ended").alias("ended"), F.transform(F.sort_array(F.collect_list(each)), lambda x: x["t"]).alias("turns"))
    zero = F.lit(0).cast("long")
    none = turnless.select("conv", zero.alias("level"), zero.alias("p1"), zero.alias("p2"), F.lit(True).alias("ended"), F.expr(f"cast(array() as {_TURN})").alias("turns"))
    blocks = blocks.unionByName(none).withColumn("more_leaves", zero).withColumn("more_saved", zero)
    return blocks.select(*[c.split(" ")[0] for c in _ROW.split(", ") if c.split(" ")[0] in blocks.columns])


class _Matrix:
    """Rows of turn ids, padded, in lexicographic order, and where nodes of every depth start in it."""

    def __init__(self, batch: pa.RecordBatch, before: dict | None) -> None:
        column = {name: batch.column(name) for name in batch.schema.names}
        of = lambda name, kind=np.int64: column[name].to_numpy(zero_copy_only=False).astype(kind)
        turns = column["turns"]
        length = np.diff(turns.offsets.to_numpy()).astype(np.int64)
        flat = turns.flatten()
        part = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("a", "b", "g1", "g2", "size")}
        n, width = batch.num_rows, int(length.max(initial=0))
        filled = np.arange(1, width + 1)[None] <= length[:, None]

        def padded(first: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.zeros((n, width + 1), np.int64)
            out[:, 0] = first
            out[:, 1:][filled] = values
            return out

        group = _dense(of("level"), of("p1"), of("p2"))
        ids = padded(group, _dense(part["a"], part["b"]))  # from 1 on, so that 0 fills up and comes first
        conv, ended = of("conv"), of("ended", bool)
        order = np.lexsort((conv, ~ended, *ids.T[::-1]))
        ids, self.conv, self.length = ids[order], conv[order], length[order]
        self.level, self.ended = of("level")[order], ended[order]
        self.g1, self.g2 = padded(of("p1"), part["g1"])[order], padded(of("p2"), part["g2"])[order]
        self.size = padded(np.zeros(n, np.int64), part["size"])[order]
        self.more_leaves, self.more_saved = of("more_leaves")[order], of("more_saved")[order]
        pick = batch.take(pa.array(order[[0, -1]]))
        self.first, self.last = pick.slice(0, 1).to_pylist()[0], pick.slice(1, 1).to_pylist()[0]

        differs = np.ones_like(ids, bool)
        differs[1:] = ids[1:] != ids[:-1]
        if before is not None:
            same = common(before, self.first)
            differs[0] = np.arange(width + 1) > same
        self.changed = np.logical_or.accumulate(differs, axis=1)
        self.there = np.arange(width + 1)[None] <= self.length[:, None]
        self.start = self.changed & self.there
        followed = np.append(~self.changed[np.arange(1, n), self.length[:-1]], False)
        self.leaf = self.ended & ~followed
        self.width, self.n = width, n
        #: bytes of a row's turns from each depth on that it shares with the row above: what it saves.
        self.saved = np.cumsum((self.size * ~self.start)[:, ::-1], axis=1)[:, ::-1] + self.more_saved[:, None]


def _dense(*parts: np.ndarray) -> np.ndarray:
    """Whole numbers from 1 on in the order of the parts."""
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(order), np.int64)
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def common(one: dict, other: dict) -> int:
    """How many turns two rows share from their start on; -1 if they don't follow the same turns."""
    if any(one[c] != other[c] for c in ("level", "p1", "p2")):
        return -1
    k = 0
    for x, y in zip(one["turns"], other["turns"], strict=False):
        if (x["a"], x["b"]) != (y["a"], y["b"]):
            break
        k += 1
    return k


def _path(row: dict) -> list[tuple[int, int]]:
    return [(row["p1"], row["p2"]), *((t["g1"], t["g2"]) for t in row["turns"])]


def not_a_leaf(last: dict, first: dict, weights: bool, block: int) -> list[dict]:
    """What to take back where a task or matrix took its last row for a leaf that the next one's first row follows."""
    if not last["ended"] or common(last, first) < len(last["turns"]):
        return []
    if weights:
        return [{"kind": "weight", "conv": last["conv"], "depth": last["level"], "leaves": -1, "saved": 0}]
    return [{"kind": "part", "depth": last["level"] * block + j, "g1": g1, "g2": g2, "n": 0, "children": 0, "leaves": -1, "saved": 0} for j, (g1, g2) in enumerate(_path(last)) if j or not last["level"]]


def not_a_start(last: dict, first: dict, weights: bool, block: int) -> list[dict]:
    """What to take back where a task took all nodes of its first row for new, though the row before has some of them."""
    same = common(last, first)
    if same < 0:
        return []
    sizes = [0, *(t["size"] for t in first["turns"][:same])]
    if weights:
        return [{"kind": "weight", "conv": first["conv"], "depth": first["level"], "leaves": 0, "saved": sum(sizes)}]
    return [{"kind": "part", "depth": first["level"] * block + j, "g1": g1, "g2": g2, "n": 0, "children": -int(j < same), "leaves": 0, "saved": sum(sizes[j:]) if j or not first["level"] else 0} for j, (g1, g2) in enumerate(_path(first)[: same + 1])]


def _nodes(m: _Matrix, block: int) -> Iterator[pa.RecordBatch]:
    """Nodes of every depth. Those that hold the first or the last row may go on in other matrices, so they are parts; so are
    the tops of rows and what stands at their full length, which two levels tell of."""
    ids = m.conv.astype(str)
    parents: tuple | None = None
    for j in range(m.width + 1):
        at = np.flatnonzero(m.changed[:, j])
        if not len(at) or at[0]:
            at = np.concatenate(([0], at))
        end = np.append(at[1:], m.n)
        part = np.zeros(len(at), bool)
        part[[0, -1]] = True
        part |= j in (0, block)
        own = m.level[at] == 0 if j == 0 else np.ones(len(at), bool)  # the top of a later row counts as the row before has it
        conv = np.minimum.reduceat(m.conv, at)
        sums = {
            "n": (end - at) * own,
            "children": np.add.reduceat(m.start[:, j + 1].astype(np.int64), at) if j < m.width else np.zeros(len(at), np.int64),
            "leaves": np.add.reduceat(m.leaf + m.more_leaves, at) * own,
            "saved": np.add.reduceat(m.saved[:, j], at) * own,
        }
        ending = m.ended & (m.length == j)
        rows = np.flatnonzero(ending)
        where = np.searchsorted(at, rows, "right") - 1
        lists: dict[int, str] = {}
        if len(rows):
            cut = np.flatnonzero(np.diff(where)) + 1
            lists = {int(where[r[0]]): ",".join(ids[rows[r]]) for r in np.split(np.arange(len(rows)), cut)}
        there = m.length[at] >= j
        whole, some = np.flatnonzero(there & ~part), np.flatnonzero(there & part)
        up = None if parents is None else np.searchsorted(parents[0], at, "right") - 1
        digest = (m.g1[at, j], m.g2[at, j])
        above = (m.g1[at, j - 1], m.g2[at, j - 1]) if j else None
        depth = m.level[at] * block + j
        if len(whole):
            open_ = parents[2][up[whole]]
            texts = [hashlib.sha256(lists[k].encode()).hexdigest() if k in lists else EMPTY for k in whole.tolist()]
            yield _batch("node", len(whole), depth=depth[whole], conv=conv[whole], parent=pa.array(parents[1][up[whole]], mask=open_), k1=pa.array(above[0][whole], mask=~open_), k2=pa.array(above[1][whole], mask=~open_), text=texts, **{k: v[whole] for k, v in sums.items()})
        if len(some):
            links = {"k1": above[0][some], "k2": above[1][some], "parent": pa.array(parents[1][up[some]], mask=parents[2][up[some]])} if j else {}
            yield _batch("part", len(some), depth=depth[some], conv=pa.array(conv[some], mask=~own[some]), g1=digest[0][some], g2=digest[1][some], **links, **{k: v[some] for k, v in sums.items()})
            if held := [k for k in some.tolist() if k in lists]:
                first = [int(lists[k].partition(",")[0]) for k in held]
                yield _batch("ends", len(held), depth=depth[held], conv=first, g1=digest[0][held], g2=digest[1][held], text=[lists[k] for k in held])
        parents = (at, conv, part)


def _batch(kind: str, count: int, /, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * count)]
    for f in list(_SCHEMA)[1:]:
        v = columns.get(f.name)
        arrays.append(pa.nulls(count, f.type) if v is None else v if isinstance(v, pa.Array) else pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _records(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=_SCHEMA)


def _tries(weights: bool, block: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    edge = lambda row: {c: row[c] for c in ("level", "p1", "p2", "conv", "ended", "turns")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first = before = None
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                m = _Matrix(batch.slice(at, size), before)
                first = first or edge(m.first)
                if before is not None and (taken := not_a_leaf(before, m.first, weights, block)):
                    yield _records(taken)
                if weights:
                    yield _batch("weight", m.n, depth=m.level, conv=m.conv, leaves=m.leaf.astype(np.int64), saved=m.saved[:, 0])
                else:
                    yield from _nodes(m, block)
                before = edge(m.last)
            tidy()
        if first:
            yield _records([{"kind": "edge", "task": TaskContext.get().partitionId(), "first": first, "last": before}])

    return run


def _mend(weights: bool, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += not_a_leaf(row["before"], row["first"], weights, block) + not_a_start(row["before"], row["first"], weights, block)
            yield _records(out)

    return run


def _sorted_tries(rows: DataFrame, weights: bool, block: int, size: int) -> DataFrame:
    """Rows in order over all tasks, a matrix for every `size` of them, and what their borders take back: a row for each two tasks."""
    key = ["level", "p1", "p2", "turns", F.desc("ended"), "conv"]  # what goes on comes after what ends with the same turns
    found = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_tries(weights, block, size), _OUT), "tries")
    edges = found.where("kind = 'edge'").select("first", F.lag("last").over(Window.orderBy("task")).alias("before"))
    return found.where("kind <> 'edge'").unionByName(edges.where("before is not null").mapInArrow(_mend(weights, block), _OUT))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a node's lists, in their order, with a comma between; of a node of a third of all rows, too, only the hash is held."""
    node, sha = None, None
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["depth", "g1", "g2", "ends"])
        out.clear()
        return batch

    for batch in batches:
        for depth, g1, g2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != (depth, g1, g2):
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, g1, g2), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield told()
    if node:
        out.append((*node, sha.hexdigest()))
        yield told()


def trie(turns: DataFrame, turnless: DataFrame, block: int = BLOCK, size: int = ROWS) -> DataFrame:
    """The nodes of the prefix trie of conversations (turns: conv, part, pos, a, b, size; turnless: conv).

    Rows of up to `block` turns are sorted over all tasks by what comes before them and by their turns, and read as matrices in
    which nodes of a depth are runs; so copies of a conversation, or what follows a common start, are cut anywhere. Nodes that
    go on over a border come as parts and are added up; what a border hid is taken back. Rows of longer
    conversations are read first, so that what is below them counts where they hang.

    A conversation is narrow rows of one task when its turns are numbered, and one row for every `block` turns after. Rows that
    repeat are turns of their own. Without conversations there is no node. Turns and prefixes are known by 128 bits of hashes.
    """
    ship(turns.sparkSession)
    rows = written(_rows(turns, turnless, block), "rows")
    if not rows.where("level > 0").isEmpty():
        by_level = Window.partitionBy("conv").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
        weights = _sorted_tries(rows.where("level > 0"), True, block, size).groupBy("conv", F.col("depth").alias("level")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        more = weights.select("conv", (F.col("level") - 1).alias("level"), F.sum("leaves").over(by_level).alias("leaves"), F.sum("saved").over(by_level).alias("saved"))
        longer = rows.where("not ended").join(more, ["conv", "level"])
        longer = longer.withColumn("more_leaves", F.col("leaves")).withColumn("more_saved", F.col("saved")).select(*rows.columns)
        rows = rows.where("ended").unionByName(longer)
    found = _sorted_tries(rows, False, block, size)
    name = ["depth", "g1", "g2"]
    ends = found.where("kind = 'ends'").select(*name, "conv", "text").repartition(*name).sortWithinPartitions(*name, "conv").select(*name, "text").mapInArrow(_hashed, "depth long, g1 long, g2 long, ends string")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    parts = found.where("kind = 'part'").groupBy(*name).agg(F.min("conv").alias("conv"), *sums, *[F.max(c).alias(c) for c in ("parent", "k1", "k2")])
    parts = written(parts.join(ends, name, "left").withColumn("text", F.coalesce("ends", F.lit(EMPTY))).drop("ends"), "parts")
    parents = parts.select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("k1"), F.col("g2").alias("k2"), F.col("conv").alias("of"))
    if parts.count() <= 200_000:  # some 10 MB
        parents = F.broadcast(parents)
    columns = ["depth", "conv", "parent", "k1", "k2", "n", "children", "leaves", "saved", "text"]
    nodes = found.where("kind = 'node'").select(*columns).unionByName(parts.select(*columns))
    asking = nodes.where("parent is null")
    every = nodes.where("parent is not null").drop("k1", "k2").unionByName(asking.join(parents, ["depth", "k1", "k2"], "left").withColumn("parent", F.col("of")).select(*[c for c in columns if c not in ("k1", "k2")]))
    return every.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("text").alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trie() of all conversations, each with the first turns of its fifth's first one. Null role and text are empty, null
    turns come first; rows without conv_id belong to none; columns beyond the four don't matter."""
    return trie(*spliced(numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: The same in SQL: every prefix of every conversation as a list; CRC-32 bit by bit.
OP11_SQL = """
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
b AS (SELECT h.c, 0 AS k, p, t FROM h JOIN o ON o.c = h.c - h.c % 5 AND p < h UNION ALL SELECT o.c, 1, p, t FROM o JOIN h USING (c) WHERE p >= h),
s AS (SELECT c, row_number() OVER w AS d, sha256(to_json(list(t) OVER w)) AS g, strlen(t.x) AS n FROM b WINDOW w AS (PARTITION BY c ORDER BY k, p) UNION ALL SELECT c, 0, '', 0 FROM h),
e AS (SELECT c, max(d) AS d FROM s GROUP BY c),
v AS (SELECT s.g, s.d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(s.n) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e.d = s.d), '')) AS ends FROM s JOIN e USING (c) GROUP BY s.g, s.d),
f AS (SELECT v.*, (SELECT p.c FROM s q JOIN v p ON p.g = q.g AND p.d = q.d WHERE q.c = v.c AND q.d = v.d - 1) AS up FROM v),
x AS (SELECT f.*, (SELECT count(*) FROM f y WHERE y.up = f.c AND y.d = f.d + 1) AS kids FROM f)
SELECT x.c AS conv_id, x.d AS depth, x.up AS parent_conv_id, x.n AS n_convs, x.kids AS n_children,
(SELECT count(*) FROM s m JOIN x y ON y.c = m.c AND y.d >= x.d WHERE m.g = x.g AND m.d = x.d AND y.kids = 0)::BIGINT AS n_leaves,
(SELECT sum(y.saved) FROM s m JOIN x y ON y.c = m.c AND y.d >= x.d WHERE m.g = x.g AND m.d = x.d)::BIGINT AS saved_tokens, x.ends AS ends_sha256 FROM x
"""
