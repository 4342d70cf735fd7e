"""Operator 9: documents packed into sequences along a Hilbert curve through their projected vectors."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cache, longs, pieces, range_index, ship, table, weighted_splitters, written

LENGTH = 2048
END = 1  # the id after each document
DIMENSIONS = 4
LEVELS = 10  # bits of a coordinate
SPREAD = 0.2  # a mean sign of this size lies three quarters of the way from the middle to the edge of the grid
_KEPT = 200_000  # words after which a task begins to forget
_LONG = 200  # bytes of a word beyond which its ids are not kept

#: How the byte level shows a byte: printable ones as they are, others by the characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: Letters whose lower case depends on their neighbours or is no single letter.
_ODD = re.compile("[\u03a3\u0130]")
#: Marks between a letter or digit and white space: the tokenizer's pattern parts them from the word as well.
_MARK, _LETTER = r"[!-&(-/:-@\[-`{-~]", "[a-z0-9\u00e0-\u00f6\u00f8-\u00ff]"
_MARKS = re.compile(rf"{_MARK}(?<={_LETTER}{_MARK}){_MARK}*(?=[ \t\n\r]|$)")


class Words(dict):
    """Bytes of a word's ids, made when first asked for, by a tokenizer that never joins across ASCII white space.

    Texts are lower-cased and marks after words set apart first, as the tokenizer does itself, so that there are fewer
    words to know. Once there are more than _KEPT, words not asked for since the last such time are forgotten.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 2**16 else ("<u4", "I")

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self._plain(word) or array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(word) <= _LONG:
            if len(self) >= _KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def _plain(self, word: bytes) -> bytes | None:
        """By the merges alone, if the word is nothing but lower-case Latin letters, which need no normalizing."""
        if word.isascii():
            if not (word.isalpha() and word.islower()):
                return None
            shown = word.decode()
        else:
            text = word.decode()
            if not text.isalpha() or max(text) >= "\u0250" or text != text.lower():
                return None
            shown = word.decode("latin-1").translate(_VISIBLE)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text and END, as little-endian numbers of this tokenizer's kind."""
        text = text or ""
        if "<|" not in text and not _ODD.search(text) and unicodedata.is_normalized("NFC", text):
            text = _MARKS.sub(r" \g<0>", text.lower())
        return b"".join([*map(self.__getitem__, text.encode("utf-8", "replace").split()), np.array([END], self.kind).tobytes()])


_words: dict[str, Words] = cache("packing")


def words_of(path: str) -> Words:
    """One a worker process, so that tasks that follow one another share what it knows."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def hilbert_key(points: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """The place along the Hilbert curve of each row of points, unsigned coordinates of so many bits.

    The usual way from coordinates to the curve's transposed index (reflections and exchanges from the highest bit
    down, then a Gray code over all axes), whose bits are interleaved at last.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for axis in range(n):
            here = (x[axis] & q) > 0
            swap = np.where(here, 0, (x[0] ^ x[axis]) & p)
            x[0] ^= np.where(here, p, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = key << 1 | (x[axis] >> level) & 1
    return key


def _directions() -> np.ndarray:
    """Random signs by hashed id: the projection of 65,536 buckets to DIMENSIONS."""
    return np.random.default_rng(9).choice(np.array([-1, 1], np.int8), (2**16, DIMENSIONS))


def _encode(path: str):
    """doc_id, text to doc_id, tokens, curve, kind (bytes an id) and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signs = words_of(path), _directions()
        for some in pieces(batches, operator="packing"):
            if some.num_rows:
                ids, points = [], np.zeros((some.num_rows, DIMENSIONS))
                for i, text in enumerate(some.column(1)):
                    ids.append(words.ids(text.as_py()))
                    own = np.frombuffer(ids[-1], words.kind)[:-1]
                    if len(own):
                        points[i] = signs[own & 0xFFFF].mean(0)
                grid = np.clip((np.tanh(points / SPREAD) + 1) / 2, 0, 1 - 1e-9) * 2**LEVELS
                size = np.dtype(words.kind).itemsize
                columns = [some.column(0), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(hilbert_key(grid.astype(np.int64)), pa.int64()), pa.array([size] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tokens", "curve", "kind", "ids"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, first (its first id's place among all), kind, ids to PIECE."""
    for some in pieces(batches, operator="packing"):
        if some.num_rows:
            out: list[tuple] = []
            for doc_id, first, kind, ids in zip(*(some.column(k).to_pylist() for k in range(4)), strict=True):
                raw = np.frombuffer(ids, f"<u{kind}").astype("<u4").tobytes()
                n = len(raw) // 4
                for s in range(first // LENGTH, (first + n - 1) // LENGTH + 1):
                    a, b = max(first, s * LENGTH), min(first + n, (s + 1) * LENGTH)
                    out.append((doc_id, a - first, b - a, zlib.crc32(raw[4 * (a - first) : 4 * (b - first)]), n, s, a - s * LENGTH))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=PIECE.replace(" long", "").split(", "))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, n_ranges: int = 512, tokens_per_range: int = 500_000_000) -> DataFrame:
    """The pieces (PIECE) of docs (doc_id, text) in sequences of LENGTH tokens, all full but the last.

    A document's vector is the share of each hashed token id; random signs project it to DIMENSIONS, so that a coordinate
    is the mean sign of its tokens, whatever their number, and a soft bound puts it on the grid, whose cell has a place
    along the Hilbert curve. Documents stand along that curve, ties by doc_id and then by a hash of their ids, and are
    cut where a sequence is full, so neighbours on the curve share sequences. Ranges of the curve between keys drawn in
    proportion to tokens are summed first; a document's place is then a running sum within its range. Texts are encoded
    once; the ids are written to the shared folder and dealt to ranges from there.

    Null text is empty: one piece of one id. Rows of equal doc_id and text follow one another, each with its own pieces; they
    can't be told apart, so all of them are one task's. A very long text is cut into as many pieces as it needs; its ids are one
    row. Further columns are not looked at, whatever their names; an empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(_encode(tokenizer), "doc_id long, tokens long, curve long, kind int, ids binary")
    # A cell of the curve may hold a group of copies: 22 bits of a hash of doc_id (of the row's number, where it is null)
    # below its 40 or fewer split it. The table is written, so that they stay as they are.
    own = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    rows = written(rows.withColumn("key", F.shiftleft("curve", 22).bitwiseOR(own.bitwiseAND(2**22 - 1))).drop("curve"), "encoded")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    cuts = weighted_splitters(rows, F.col("key"), F.col("tokens"), max(n_ranges, math.ceil(total / tokens_per_range)))
    ranged = rows.withColumn("range", range_index(F.col("key"), cuts))
    held = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("tokens").alias("n")).collect()}
    before, passed = [], 0
    for r in range(len(cuts) + 1):
        before.append(passed)
        passed += held.get(r, 0)
    order = Window.partitionBy("range").orderBy("key", "doc_id", F.xxhash64("ids"))
    first = F.get(longs(before), F.col("range")) + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return ranged.select("doc_id", first.alias("first"), "kind", "ids").mapInArrow(_cut, PIECE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
