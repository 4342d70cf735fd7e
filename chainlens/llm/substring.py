"""Operator 7: passages that repeat, found by suffix automata of reference shards, and their removal."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_MIN, pieces, ship, table, tidy, written

WINDOW = 35
GRAM = 6
SPAN = WINDOW - GRAM + 1  # grams of a window
LARGE_SHARD = 2000  # distinct passages of one shard beyond which its windows are counted one by one

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _rolling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their weighted running sums, and what scales a difference of sums to its place."""
    n = len(words)
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for k, p in enumerate((_P, _P_INVERSE)):
            _powers[k] = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, p, np.uint64))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    return h, np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers[0][:n], dtype=np.uint64))), _powers[1]


def window_hashes(words: list[bytes]) -> np.ndarray:
    n = len(words) - WINDOW + 1
    _, sums, scale = _rolling(words)
    return _mixed((sums[WINDOW:] - sums[:-WINDOW]) * scale[:n])


def passages(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's windows of WINDOW words, dealt into passages: anchor, content hash, first window, windows.

    A window's anchor is its gram of least hash, the last of equal ones. Equal windows have equal anchors at equal
    places, so a window can only repeat among passages of the same anchor; neighbouring windows that share their anchor's
    place make one passage, and every window is in exactly one.
    """
    n = len(words) - WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.uint64)
        return none, none, none, none
    h, sums, scale = _rolling(words)
    g = np.zeros(len(words) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        g = g * _P + h[j : len(g) + j]
    g = _mixed(g)
    view = np.lib.stride_tricks.sliding_window_view(g, SPAN)[:, ::-1]
    place = np.concatenate([view[at : at + 16384].argmin(1) for at in range(0, n, 16384)])
    place = np.arange(n) + SPAN - 1 - place
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    size = np.diff(np.append(first, n))
    content = (sums[first + size + WINDOW - 1] - sums[first]) * scale[first]
    shape = (size * 64 + place[first] - first).astype(np.uint64)
    return g[place[first]], _mixed(content ^ shape * _P), first, size


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        parts: list[tuple] = []
        held = 0
        for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            a, c, first, size = passages(_split(text.as_py()))
            if len(a):
                parts.append((a.view(np.int64), c.view(np.int64), np.full(len(a), did), np.full(len(a), th), (first.astype(np.int64) << 8) | size.astype(np.int64)))
                held += len(a)
            if held > 100_000:
                yield _batch(parts)
                parts, held = [], 0
        if parts:
            yield _batch(parts)


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["anchor", "content", "did", "th", "at"])


class Automaton:
    """The suffix automaton of several word sequences, each standing for so many occurrences.

    After learn() of all of them, statistics() gives at each word of one the length of the longest suffix that occurs at
    another place too (at that many occurrences in all: two or more).
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]

    def _clone(self, p: int, word: bytes, q: int) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.times.append(0)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def learn(self, words: list[bytes], times: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, word, q)
            else:
                new, p = len(nxt), last
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                self.times.append(0)
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
                last = new
            self.times[last] += times

    def close(self) -> None:
        """Adds up, from long to short, at how many places each state's sequences end."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.times[self.link[s]] += self.times[s]

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        state = 0
        for n, word in enumerate(words, 1):
            state = self.next[state][word]
            if self.times[state] >= 2:
                yield n
            else:
                up = self.link[state]
                while self.times[up] < 2 and up:
                    up = self.link[up]
                yield self.length[up]


def repeated_windows(shard: list[tuple[list[bytes], int]]) -> list[int]:
    """For each passage (words, occurrences) of a shard, bit i set where its window i occurs at two places or more."""
    machine = Automaton()
    for words, times in shard:
        machine.learn(words, times)
    machine.close()
    out = []
    for words, times in shard:
        if times >= 2:
            out.append((1 << len(words) - WINDOW + 1) - 1)
        else:
            out.append(sum(1 << e - WINDOW + 1 for e, n in enumerate(machine.statistics(words)) if n >= WINDOW))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: anchor, content, times, words, sorted by anchor."""
    anchor, rows = None, []
    out: list[tuple[int, int, int]] = []

    def flush() -> None:
        masks = repeated_windows([(w.split(), n) for _, n, w in rows])
        out.extend((anchor, content, mask) for (content, _, _), mask in zip(rows, masks, strict=True) if mask)

    for batch in batches:
        for a, content, times, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and a != anchor:
                flush()
                rows = []
            anchor = a
            rows.append((content, times, words))
        yield _masks(out)
        out.clear()
        tidy()
    if rows:
        flush()
        yield _masks(out)


def _masks(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "content", "mask"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: text, wanted [(anchor, content, times, at, large)]; rows of those passages with their words, or window hashes."""
    for batch in pieces(batches):
        out: list[tuple] = []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            words = _split(text.as_py())
            for w in wanted.as_py():
                first, size = w["at"] >> 8, w["at"] & 255
                own = words[first : first + size + WINDOW - 1]
                if w["large"]:
                    out.append((w["anchor"], w["content"], w["times"], None, window_hashes(own).view(np.int64).tolist()))
                else:
                    out.append((w["anchor"], w["content"], w["times"], b" ".join(own), None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "content", "times", "words", "hashes"])


def repeats(docs: DataFrame) -> DataFrame:
    """docs (did, th, text) with spans, [(at, mask)] of their repeated windows, null where there are none.

    Identical passages meet first: a shard is what shares an anchor, and only shards with two passages or more go on. If
    all passages of a shard are the same, every window of theirs repeats. From other shards each distinct passage is
    fetched once, with the number of its occurrences, and the shard's suffix automaton gives the windows that occur
    elsewhere. A shard with more than LARGE_SHARD distinct passages (a phrase that a good part of all documents hold) is
    not put into one task: each of its windows is a reference of its own, counted by hash.

    Rows of fewer than WINDOW words (null and empty texts among them) have no windows and so no spans. Rows that are the
    same in did and th share their spans; th tells texts apart, so rows of equal text and did repeat one another and every
    window of theirs is a repeat. An empty table gives an empty result.
    """
    key = ["did", "th"]
    all_passages = written(docs.select(*key, "text").mapInArrow(_find, "anchor long, content long, did long, th long, at long"), "passages")
    # Written, so that both sides of the joins by anchor are plain exchanges, of which Spark splits a hot anchor's.
    often = written(all_passages.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    hits = written(all_passages.join(often, "anchor"), "hits")
    shards = written(hits.groupBy("anchor").agg((F.min("content") == F.max("content")).alias("same")), "shards")
    hits = written(hits.join(shards, "anchor"), "judged")
    mixed = hits.where("not same")
    one = mixed.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("did", "th", "at")).alias("r"))
    one = written(one.select("anchor", "content", "times", "r.*"), "distinct")
    large = written(one.groupBy("anchor").count().where(F.col("count") > LARGE_SHARD).select("anchor", F.lit(True).alias("large")), "large")
    some_large = large.count()
    if some_large:
        one = one.join(F.broadcast(large) if some_large <= 100_000 else large, "anchor", "left")
    wanted = F.struct("anchor", "content", "times", "at", F.coalesce("large", F.lit(False)).alias("large") if some_large else F.lit(False).alias("large"))
    wanted = one.groupBy(*key).agg(F.collect_list(wanted).alias("wanted"))
    # All columns go along, so that this join and the last one below share one exchange of the texts.
    others = [c for c in docs.columns if c != "text"]
    fetched = docs.join(wanted, key).select("text", "wanted", *others).mapInArrow(_extract, "anchor long, content long, times long, words binary, hashes array<long>")
    masks = fetched.where("words is not null").select("anchor", "content", "times", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_solve, "anchor long, content long, mask long")
    if some_large:
        each = fetched.where("hashes is not null").select("anchor", "content", "times", F.posexplode("hashes").alias("i", "h"))
        twice = each.groupBy("anchor", "h").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
        bits = each.join(twice, ["anchor", "h"]).groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
        masks = masks.union(bits)
    whole = F.expr("shiftleft(1L, cast(at & 255 as int)) - 1")
    spans = hits.where("same").select(*key, "at", whole.alias("mask")).union(mixed.join(masks, ["anchor", "content"]).select(*key, "at", "mask"))
    spans = spans.groupBy(*key).agg(F.collect_set(F.struct("at", "mask")).alias("spans"))
    return docs.join(spans, key, "left")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with did and th, by which rows are known: doc_id, and where some doc_id is not unique, a hash of the text."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MIN + 1))
    shared = docs.select(did.alias("did")).groupBy("did").count().where("count > 1").limit(1).count()
    return docs.withColumn("did", did).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))) if shared else F.lit(0).cast("long"))


def covered(n_words: int, spans: Iterable[dict]) -> np.ndarray:
    """Which words lie in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        first, mask = s["at"] >> 8, s["mask"]
        while mask:
            low = mask & -mask
            run = (mask // low + 1) & -(mask // low + 1)  # the run of set bits from the lowest
            a = first + low.bit_length() - 1
            edge[a] += 1
            edge[a + run.bit_length() - 1 + WINDOW - 1] -= 1
            mask &= ~((run - 1) * low)
    return np.cumsum(edge[:-1]) > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = _split(text.as_py())
            n = len(words)
            if spans.is_valid:
                gone = covered(n, spans.as_py())
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out.append((doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by repeats(). Null and empty texts have no words; repeated rows are windows that start elsewhere, so
    both lose them; rows of one doc_id are told apart by their texts, null doc_ids among them."""
    ship(spark)
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc_id")
    doc_id = F.when(F.col("did") != LONG_MIN + 1, F.col("did")).alias("doc_id")
    return repeats(docs).select(doc_id, "text", "spans").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same in SQL: every window by its words, those that are there twice, and the words that none of them covers.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1), range(0, 35) r(k)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d) ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in columns:
        yield pa.array([_without(t.as_py(), s.as_py()) if t.is_valid and s.is_valid and len(s) else t.as_py() for t, s in zip(texts, spans, strict=True)], pa.string())
        tidy()


def _cut_of(text: str, spans: str) -> Column:
    """Marked as one whose result may differ, so that no filter on it is pushed down to compute it again."""
    return F.arrow_udf(_cut, "string").asNondeterministic()(text, spans)


def _without(text: str, spans: Iterable[dict]) -> str:
    """text without its covered words and the white space after them; all else stays as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.start() for m in _WORD.finditer(raw)]
    gone = covered(len(places), spans)
    edges = [*places, len(raw)]
    keep = [raw[: edges[0]]]
    change = [0, *(np.flatnonzero(np.diff(gone)) + 1).tolist(), len(places)]
    keep += [raw[edges[a] : edges[b]] for a, b in zip(change, change[1:], strict=False) if a < b and not gone[a]]
    return b"".join(keep).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut from text, n_chars set to what is left, without those of which no word is left.

    A row without repeats is as it was, whatever it holds: null and empty texts stay, so do texts of under WINDOW words.
    Repeated rows, of whatever doc_id, are repeats of one another and are cut whole if they have WINDOW words, so none of
    them is left: a stage that keeps one of them comes before. All other columns come back as they were, whatever their
    names; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    others = [F.col(f"`{c}`") for c in columns if c != "text"]
    rows = keyed(docs.select(F.struct(*others).alias("row"), "doc_id", "text")).drop("doc_id")
    rows = repeats(rows).withColumn("left", _cut_of("text", "spans"))
    rows = rows.where(F.col("spans").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("left").cast("long")) if "n_chars" in columns else None
    new = {"text": F.col("left"), "n_chars": length}
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns])
