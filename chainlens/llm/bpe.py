"""Operator 10: byte-level BPE by recursive DuckDB queries within each Spark task."""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache, release, ship, table, tidy

_KEPT = 48 * 2**20  # bytes that a worker's known words may take before it begins to forget; there are two such generations
_SHORT = 64  # bytes of a word up to which one pair is contracted a step; longer words are not kept
_PORTION = 4 * 2**20  # characters of text encoded at once

#: Every way to cut a token's bytes in two tokens; pair holds both.
_MERGES = """
CREATE TABLE merges AS
WITH cut AS (SELECT id, h, unnest(range(1, len(h) // 2)) AS i FROM vocabulary)
SELECT l.id AS l, r.id AS r, l.id::BIGINT * 1048576 + r.id AS pair, c.id AS rank FROM cut c JOIN vocabulary l ON l.h = c.h[:2 * c.i] JOIN vocabulary r ON r.h = c.h[2 * c.i + 1:]
"""

#: words(w, h, toks): a word's number, its bytes in hex and its bytes' tokens in order. Each step joins the neighbours at
#: every place of a word to the merge table and contracts its leftmost pair of least rank; a word without pairs is done.
_ENCODE = """
CREATE OR REPLACE TABLE encoded AS
WITH RECURSIVE state(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM words ANTI JOIN vocabulary USING (h)
  UNION ALL
  SELECT s.w, s.toks[:b.best % 1048576 - 1] || [(b.best // 1048576)::INT] || s.toks[b.best % 1048576 + 2:]
  FROM state s JOIN (
    SELECT w, min(m.rank::BIGINT * 1048576 + pos) AS best
    FROM (SELECT w, unnest(range(1, len(toks))) AS pos, unnest(toks[:-2])::BIGINT * 1048576 + unnest(toks[2:]) AS pair FROM state) p
    JOIN merges m ON m.pair = p.pair GROUP BY w
  ) b ON b.w = s.w
)
SELECT w, toks FROM state UNION ALL SELECT w, [id] FROM words JOIN vocabulary USING (h)
"""

#: What may grow at a token's place. before(s, r) is the least rank of (x, r) over the tokens x that end with s but are
#: longer; after(l, s) that of (l, y) over longer tokens y that begin with s; spans(s, p) are neighbours that some pair
#: (x, y) may hold, x ending with or being s, y beginning with or being p.
_REACH = """
CREATE TABLE tails AS SELECT x.id, s.id AS s FROM (SELECT id, h, unnest(range(1, len(h) // 2)) AS i FROM vocabulary) x JOIN vocabulary s ON s.h = x.h[2 * x.i + 1:];
CREATE TABLE heads AS SELECT y.id, s.id AS s FROM (SELECT id, h, unnest(range(1, len(h) // 2)) AS i FROM vocabulary) y JOIN vocabulary s ON s.h = y.h[:2 * y.i];
CREATE TABLE before AS SELECT t.s, m.r, min(m.rank) AS rank FROM merges m JOIN tails t ON t.id = m.l GROUP BY ALL;
CREATE TABLE after AS SELECT m.l, t.s, min(m.rank) AS rank FROM merges m JOIN heads t ON t.id = m.r GROUP BY ALL;
CREATE TABLE spans AS SELECT DISTINCT t.s, u.s AS p FROM merges m
JOIN (FROM tails UNION ALL SELECT id, id FROM vocabulary) t ON t.id = m.l JOIN (FROM heads UNION ALL SELECT id, id FROM vocabulary) u ON u.id = m.r;
"""

#: The same result for long words in few steps. Neighbours that no pair can ever hold part a word for good, and each part
#: is contracted as a word of its own: its leftmost pair of least rank, and every pair that no other can forestall.
#: A pair (t, b) of rank k between l and n is one if
#: (1) t can't be taken from the left first: (l, t), and (x, t) for any longer token x that may grow at l, rank over k;
#: (2) b can't be taken from the right first: (b, n) and (b, y) rank k or more (of equal ranks the left one is first);
#: (3) its token c opens no pair of lower rank: (l, c), (x, c), (c, n), (c, y) rank over k.
#: By (1) and (2) one pair a step would contract it too, before anything else touches t or b; by (3) what it opens comes
#: after all that one pair a step does before it, so nothing else changes. Where neighbouring pairs have equal rank (a run
#: of one token), every other one from the run's first is contracted, as long as all before it are such pairs.
_ENCODE_LONG = """
CREATE OR REPLACE TABLE encoded AS
WITH RECURSIVE state(w, part, pos, tok, done) AS (
  SELECT w, 0::BIGINT, unnest(range(len(toks))), unnest(toks), false FROM words ANTI JOIN vocabulary USING (h)
  UNION ALL
  SELECT w, part, pos, CASE WHEN chosen THEN rank ELSE tok END, best IS NULL
  FROM (
    SELECT *, coalesce(lag(chosen) OVER o, false) AS taken
    FROM (
      SELECT *, coalesce(pos = first OR (rn - min(rn) OVER run) % 2 = 0 AND bool_and(sure) OVER (PARTITION BY w, part, chain ORDER BY pos), false) AS chosen
      FROM (
        SELECT *, sum(CASE WHEN rank = lag_rank THEN 0 ELSE 1 END) OVER o AS chain, row_number() OVER o AS rn, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY w, part) AS first
        FROM (
          SELECT p.*, p.rank IS NOT NULL AND (p.lag_rank IS NULL OR p.rank <= p.lag_rank) AND (p.lead_rank IS NULL OR p.rank <= p.lead_rank)
            AND (x.rank IS NULL OR p.rank < x.rank) AND (y.rank IS NULL OR p.rank <= y.rank)
            AND (cl.rank IS NULL OR p.rank < cl.rank) AND (cx.rank IS NULL OR p.rank < cx.rank) AND (cn.rank IS NULL OR p.rank < cn.rank) AND (cy.rank IS NULL OR p.rank < cy.rank) AS sure
          FROM (
            SELECT w, pos, tok, b, rank, lag_rank, lead_rank, CASE WHEN joined THEN l END AS l, CASE WHEN next_open THEN n END AS n, part, min(rank) OVER (PARTITION BY w, part) AS best
            FROM (
              SELECT *, max(CASE WHEN joined THEN NULL ELSE pos END) OVER o AS part, lead(open) OVER o AS next_open
              FROM (
                SELECT *, coalesce(lag(open) OVER o, false) AS joined, lag(rank) OVER o AS lag_rank, lead(rank) OVER o AS lead_rank
                FROM (
                  SELECT s.w, s.part AS old, s.pos, s.tok, s.l, s.b, s.n, m.rank, q.s IS NOT NULL AS open
                  FROM (SELECT *, lag(tok) OVER o AS l, lead(tok) OVER o AS b, lead(tok, 2) OVER o AS n FROM state WHERE NOT done WINDOW o AS (PARTITION BY w, part ORDER BY pos)) s
                  LEFT JOIN merges m ON m.l = s.tok AND m.r = s.b LEFT JOIN spans q ON q.s = s.tok AND q.p = s.b
                ) WINDOW o AS (PARTITION BY w, old ORDER BY pos)
              ) WINDOW o AS (PARTITION BY w, old ORDER BY pos)
            )
          ) p
          LEFT JOIN before x ON x.s = p.l AND x.r = p.tok LEFT JOIN after y ON y.l = p.b AND y.s = p.n
          LEFT JOIN merges cl ON cl.l = p.l AND cl.r = p.rank LEFT JOIN before cx ON cx.s = p.l AND cx.r = p.rank
          LEFT JOIN merges cn ON cn.l = p.rank AND cn.r = p.n LEFT JOIN after cy ON cy.l = p.rank AND cy.s = p.n
        ) WINDOW o AS (PARTITION BY w, part ORDER BY pos)
      ) WINDOW run AS (PARTITION BY w, part, chain)
    ) WINDOW o AS (PARTITION BY w, part ORDER BY pos)
  ) WHERE NOT taken
)
SELECT w, list(tok ORDER BY pos) AS toks FROM state WHERE done GROUP BY w UNION ALL SELECT w, [id] FROM words JOIN vocabulary USING (h)
"""

#: The ids decoded: their tokens' bytes, put together in the order of their places.
_DECODE = """
SELECT e.w, e.toks AS ids, d.decoded FROM encoded e JOIN (
  SELECT w, string_agg(h, '' ORDER BY pos) AS decoded
  FROM (SELECT w, unnest(toks) AS id, unnest(range(len(toks))) AS pos FROM encoded) JOIN vocabulary USING (id) GROUP BY w
) d ON d.w = e.w
"""


class Merger:
    """Encodes words by the ranks of one file; one a worker process, since the merge table takes a second to make.

    A word is encoded and decoded when it is first met. What it came to is kept for later ones, in a bounded memory: once
    the known words take more than _KEPT bytes, those not met since the last such time are forgotten.
    """

    def __init__(self, path: str) -> None:
        import duckdb
        import public_tokenizers
        import regex

        self.words_of = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+", r"\p{White_Space}+").replace(r"\S", r"\P{White_Space}")).findall
        with open(path, "rb") as f:
            ranks = [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in f if x.strip())]
        self.token_of_byte = np.zeros(256, np.int32)
        for raw, rank in ranks:
            if len(raw) == 1:
                self.token_of_byte[raw[0]] = rank
        self.kind = np.dtype("<u2" if max(r for _, r in ranks) < 2**16 else "<u4")
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.odd: dict[str, bytes] = {}  # decoded bytes of words that are not decoded to themselves
        self.db = duckdb.connect()
        self.db.execute(f"SET threads = 1; SET memory_limit = '300MB'; SET temp_directory = '{tempfile.gettempdir()}'")
        self.db.register("ranks", pa.table({"h": [raw.hex() for raw, _ in ranks], "id": pa.array([i for _, i in ranks], pa.int32())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT h, id FROM ranks")
        self.db.execute(_MERGES)
        self.reach = False

    def learn(self, words: set[str]) -> None:
        new = []
        for w in words:
            if w not in self.ids:
                found = self.older.get(w)
                if found is None:
                    new.append(w)
                else:
                    self._keep(w, found)
        raw = [w.encode() for w in new]
        long = [len(x) > _SHORT for x in raw]
        for some, query in ((False, _ENCODE), (True, _ENCODE_LONG)):
            if some in long:
                if some and not self.reach:
                    self.db.execute(_REACH)
                    self.reach = True
                self._merge([w for w, x in zip(new, long, strict=True) if x == some], [x for x in raw if (len(x) > _SHORT) == some], query)

    def forget(self, words: set[str]) -> None:
        """Long words go at once, those not met for long once there are too many."""
        for w in words:
            if len(w) > _SHORT // 4 and len(w.encode()) > _SHORT:
                self.ids.pop(w, None)
                self.odd.pop(w, None)
        if self.held > _KEPT:
            self.older, self.ids, self.held = self.ids, {}, 0
            self.odd = {w: x for w, x in self.odd.items() if w in self.older}

    def _keep(self, word: str, ids: bytes) -> None:
        self.ids[word] = ids
        self.held += 200 + len(word) + len(ids)  # as CPython takes it, about

    def _merge(self, words: list[str], raw: list[bytes], query: str) -> None:
        flat = self.token_of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum([0, *map(len, raw)])
        toks = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32()))
        self.db.register("words", pa.table({"w": pa.array(range(len(words)), pa.int32()), "h": [x.hex() for x in raw], "toks": toks}))
        self.db.execute(query)
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("words")
        ids = got.column("ids").combine_chunks()
        flat, at, size = ids.flatten().to_numpy().astype(self.kind).tobytes(), ids.offsets.to_pylist(), self.kind.itemsize
        for k, (w, h) in enumerate(zip(got.column("w").to_pylist(), got.column("decoded").to_pylist(), strict=True)):
            self._keep(words[w], flat[size * (at[k] - at[0]) : size * (at[k + 1] - at[0])])
            if (decoded := bytes.fromhex(h)) != raw[w]:
                self.odd[words[w]] = decoded

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded bytes of each text."""
        split = [self.words_of(t or "") for t in texts]
        every = set().union(*split)
        self.learn(every)
        for words in split:
            ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), self.kind).astype("<u4").tobytes()
            yield ids, b"".join(self.odd.get(w) or w.encode() for w in words) if self.odd else "".join(words).encode()
        self.forget(every)


_mergers: dict[str, Merger] = cache("bpe")


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary) and decoded (binary) of each row of docs.

    Null and empty text have no ids. Each row is encoded by itself: repeated rows and doc_ids, null ones too, each give
    their row, and no row depends on another. Further columns of docs are not looked at; an empty table gives an empty result.
    """
    path = ranks or _ranks()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("bpe")
        work = merger(path)

        def done(keys: list, texts: list) -> pa.RecordBatch:
            pairs = list(work(texts))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["doc_id", "ids", "decoded"])

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= _PORTION:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield done(keys, texts)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
