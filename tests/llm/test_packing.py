import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from chainlens.llm import packing
from chainlens.llm.packing import END, LENGTH, Words, hilbert_key, pack


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, END]


def check(rows, pieces):
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(t))
    got, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
        filled[p.sequence_id].append((p.offset, p.length))
    assert {k: len(v) for k, v in want.items()} == {k: sum(p.start == 0 for p in v) for k, v in got.items()}
    for i, lists in want.items():
        expected = sorted(len(x) for x in lists)
        assert sorted(p.doc_tokens for p in got[i] if p.start == 0) == expected
        if len(lists) == 1:
            at = 0
            for p in sorted(got[i], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(lists[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(lists[0])
    for s, spans in filled.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == LENGTH or s == max(filled) and at <= LENGTH


def test_pieces_cover_every_id_once(spark, sf_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], pack(docs).collect())


def test_words_as_the_library_does():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(3)
    texts = ["Don't THE's 'LL they'll rock'n'roll 's's", "İstanbul ΣΑΣ ς ǅ ß ẞ ŉ ﬁne ª º µ ÿ Ÿ", "e\u0301 a\u0308\u0323,", "x…, «q», a-b--c !!'s '", "１２ ½ 3rd 4x4, ʼn", "中文, 日本。 한국", "a\u00a0b\u2003c\x85d\x1ce"]
    texts += ["".join(draw.choice("abesEBÉéßñÑÜü,.!'s0₂ -%中") for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(words.ids(t), words.kind).tolist()[:-1] == library.encode(t, add_special_tokens=False).ids, t


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Hello, WORLD's  café ẞİ é 12"), (3, "Hello, WORLD's  café ẞİ é 12"), (4, "a" * 9000), (5, "word " * 7000), (None, "x"), (6, "\x00    b\x1cc <|endoftext|> d")]
    check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_neighbours_on_the_curve_are_alike(spark):
    """Of documents of three vocabularies and all lengths, neighbours mostly share theirs; no long one falls into another's cell."""
    draw = random.Random(7)
    kinds = [[f"{a}{b}" for b in ("an", "el", "ir", "om", "us", "ath", "eng", "ion")] for a in ("gr", "pl", "sch")]
    rows = [(i, " ".join(draw.choice(kinds[i % 3]) for _ in range(draw.choice([50, 500, 4000])))) for i in range(150)]
    keys = [(k, i) for batch in _encoded(rows) for i, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    order = [i for _, i in sorted(keys)]
    same = sum(a % 3 == b % 3 for a, b in zip(order, order[1:], strict=False)) / (len(order) - 1)
    assert same > 0.8
    long = [k for k, i in keys if len(rows[i][1]) > 10_000]
    assert len(set(long)) > 0.9 * len(long)


def _encoded(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    return list(packing._encode(public_tokenizers.path("word_bpe_49k.json"))([batch]))


def test_curve_visits_neighbours():
    bits, n = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * n), -1).reshape(-1, n)
    keys = hilbert_key(grid, bits)
    assert sorted(keys) == list(range(2 ** (bits * n)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()
