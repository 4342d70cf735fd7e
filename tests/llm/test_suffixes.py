import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm import suffixes
from chainlens.llm.substring import keyed
from chainlens.llm.suffixes import WINDOW, decoded, front_coded, gathered, merged, op12_suffix_dedup, passages, repeated_windows, repeats, shared, spread


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + WINDOW] for b in raw for i in range(len(b) - WINDOW + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - WINDOW + 1):
            if times[b[i : i + WINDOW]] > 1:
                gone[i : i + WINDOW] = True
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=2, n=70):
    draw = random.Random(seed)
    some = lambda k: "".join(draw.choice("abcdefgh ßé") for _ in range(k))
    common = [some(draw.randrange(150, 700)) for _ in range(6)]
    texts = []
    for i in range(n):
        t = some(draw.randrange(0, 400))
        if i % 3 == 0:
            t += common[i % 6] + some(draw.randrange(0, 300))
        if i % 4 == 0:
            t += common[2][: draw.randrange(100, 150)] + some(9)
        texts.append(t)
    for t in texts[:25]:
        k = draw.randrange(len(t) + 1)
        texts.append(t[:k] + "#" + t[k:])
    texts += texts[:4]
    texts += ["a" * 700, "ab" * 200, "a" * 200, "a" * 199, "z" * 201, "q" * 200, None, "", " \n", common[0] + "|" + common[0]]
    return texts


def answer(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_result_equals_brute_force(spark, tmp_path):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, did int, spans string")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(op12_suffix_dedup(spark, str(tmp_path))) == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("large", [1, 3])
def test_large_shards_give_the_same(spark, large):
    texts = corpus(7)
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("doc_id")
    got = {r.did: sum(suffixes.covered(len((r.text or "").encode()), r.spans or []).tolist()) for r in repeats(docs, large).collect()}
    assert got == {i: b[1] for i, b in enumerate(brute(texts))}


def test_rows_that_share_a_doc_id_and_repeat(spark, tmp_path):
    texts = corpus(4, 30)
    rows = [(None if i % 9 == 0 else i % 4, t) for i, t in enumerate(texts)]
    rows += [rows[3]] * 20
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op12_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == sorted(brute([t for _, t in rows]))


def test_empty_table_and_a_very_long_text(spark, tmp_path):
    draw = random.Random(1)
    long = "".join(draw.choice("abcdefghijklmnop") for _ in range(2_500_000))
    part = long[1_048_000:1_049_200]  # lies over the end of a segment
    rows = [(1, long), (2, part), (3, "x" + part[5:210])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = answer(op12_suffix_dedup(spark, str(tmp_path)))
    assert {k: v[:3] for k, v in got.items()} == {1: (2_500_000, 1200, 1), 2: (1200, 1200, 1), 3: (206, 205, 1)}
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_suffix_dedup(spark, f"{tmp_path}/none").collect() == []


def test_merge_never_looks_at_known_bytes(monkeypatch):
    draw = random.Random(3)
    some = sorted("".join(draw.choice("ab") for _ in range(draw.randrange(1, 40))).encode() for _ in range(900))
    runs = [some[k::7] for k in range(7)] + [[]]
    looked = []
    monkeypatch.setattr(suffixes, "shared", lambda a, b, known: looked.append((a[:known], b[:known])) or shared(a, b, known))
    coded = [front_coded([(s, s[:3], 1, 2, 3, 4) for s in r]) for r in runs]
    assert sum(map(len, coded)) < sum(map(len, some)) + 900 * (suffixes._HEAD.size + 3)
    looked.clear()
    got = list(merged([decoded(b) for b in coded]))
    assert [s for _, s, _ in got] == some and all(p == (s[:3], 1, 2, 3, 4) for _, s, p in got)
    assert [k for k, _, _ in got][1:] == [shared(a, b, 0) for a, b in zip(some, some[1:])]
    assert all(a == b for a, b in looked) and sum(bool(a) for a, _ in looked) > 500
    assert list(merged([])) == []


def test_anchors_are_dealt_evenly():
    draw = random.Random(9)
    some = [min(draw.randrange(-(2**63), 2**63) for _ in range(100)) for _ in range(2000)]
    assert [gathered(spread(a)) for a in some] == some
    held = Counter(spread(a)[0] >> 4 for a in some)
    assert len(held) == 16 and max(held.values()) < 200


def test_windows_of_a_shard():
    draw = random.Random(5)
    text = bytes(draw.randrange(97, 103) for _ in range(420))
    items = []
    for cut in ((0, 400), (20, 420), (100, 390)):
        own = text[cut[0] : cut[1]]
        for anchor, content, at in passages(np.frombuffer(own, np.uint8)):
            for a, c, p in zip(anchor.tolist(), content.tolist(), at.tolist()):
                first, offset, size = p >> 16, p >> 8 & 255, p & 255
                s = own[first : first + size + WINDOW - 1]
                items.append((spread(a) + s[offset:], s[:offset], size, offset, 1, c))
    got = Counter()
    for _, _, found in repeated_windows(merged([decoded(front_coded(sorted(items)))])):
        got["n"] += int(found.sum())
    starts = Counter(k for a, b in ((0, 400), (20, 420), (100, 390)) for k in range(a, b - WINDOW + 1))
    assert got["n"] == sum(v for v in starts.values() if v > 1)
