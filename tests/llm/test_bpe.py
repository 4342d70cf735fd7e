import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chainlens.llm import bpe
from chainlens.llm.bpe import encode, merger


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_as_the_library_does(library):
    draw = random.Random(3)
    texts = [None, "", "a", "aaaa" * 500, "ab" * 700, "abab aba ababa", "  \n\n x\x1c\x1d y\x85z　 ​", "don't 'LL <|endoftext|> ½ 12３", "é" * 300, "😀👩‍👩‍👧 ok", "#" * 999, "\x00\x01"]
    texts += ["".join(draw.choice("abcdeno \n'tshri.-éß") for _ in range(draw.randrange(1, 300))) for _ in range(400)]
    texts += ["".join(draw.choice("aehlnorst") for _ in range(60)) for _ in range(300)]
    work = merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text, (ids, decoded) in zip(texts, work(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or ""), repr(text)
        assert decoded == (text or "").encode()


def test_long_words_as_the_library_does(library):
    """Words of over 64 bytes are contracted by another rule: random letters, few letters, runs, mixed scripts."""
    draw = random.Random(4)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    texts = [some("aehlnorst", 100) for _ in range(60)] + [some("abcdefghijklmnopqrstuvwxyz", draw.randrange(65, 300)) for _ in range(100)] + [some("ab", 200) for _ in range(60)]
    texts += ["a" * n for n in range(60, 100)] + ["ab" * n for n in range(30, 60)] + ["aab" * n for n in range(25, 60)] + ["#" * 999 + "=" * 1001]
    texts += [some(["the", "ing", "aaaa", "tion", "zzz", "éé", "q", "日本", "\U0001f600"], 60) for _ in range(60)]
    texts += [some("abcdefghijklmnopqrstuvwxyz", 200_000), "a" * 200_000]
    work = merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    began = time.time()
    got = list(work(texts))
    assert time.time() - began < 60
    for text, (ids, decoded) in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:100]
        assert decoded == text.encode()


def test_words_are_forgotten_and_learned_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT", 5000)
    work = bpe.Merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [" ".join(f"word{i * j % 97}x{i}" for j in range(30)) for i in range(60)]
    for some in (texts[:20], texts[20:40], texts[:30], texts):
        assert [np.frombuffer(a, "<u4").tolist() for a, _ in work(some)] == [library.encode_ordinary(t) for t in some]


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    got = encode(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(want[r.doc_id]) and bytes(r.decoded) == want[r.doc_id].encode()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "x y", 5), (2, "x y", 5)], "doc_id long, text string, ids int")
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in encode(docs).collect()) == [("1", b""), ("2", b"x y"), ("2", b"x y"), ("None", b"")]
    assert encode(docs.limit(0)).collect() == []
