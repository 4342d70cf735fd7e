import hashlib
import random
from collections import Counter

import pytest

from chainlens.llm import substring
from chainlens.llm.substring import WINDOW, op7_substring, remove_repeats, repeated_windows


def brute(texts):
    split = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for t in texts]
    times = Counter(tuple(w[i : i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - WINDOW + 1) if times[tuple(w[i : i + WINDOW])] > 1 for k in range(WINDOW)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def corpus(seed=2, n=120):
    draw = random.Random(seed)
    some = lambda n, v=900: [f"w{draw.randrange(v)}" for _ in range(n)]
    passages = [some(draw.randrange(30, 90)) for _ in range(6)]
    texts = []
    for i in range(n):
        words = some(draw.randrange(0, 80))
        if i % 3 == 0:
            words += passages[i % 6] + some(draw.randrange(0, 60))
        if i % 5 == 0:
            words += passages[2][: draw.randrange(30, len(passages[2]))] + some(3)
        texts.append(" ".join(words))
    edited = [t.split(" ") for t in texts[:30]]
    for w in edited:
        w[draw.randrange(len(w))] = "new"
    texts += [" ".join(w) for w in edited] + texts[:5]
    texts += ["a " * 200, "a b " * 60, "a " * 36, "a " * 35, "z " * 34, None, "", "\n \t", " ".join(passages[0]) + "\n" + " ".join(passages[0])]
    return texts


@pytest.mark.parametrize("large", [2000, 3])
def test_result_equals_brute_force(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(substring, "LARGE_SHARD", large)
    texts = corpus()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7_substring(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_rows_that_share_a_doc_id(spark, tmp_path):
    texts = corpus(4, 40)
    spark.createDataFrame([(None if i % 9 == 0 else i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in op7_substring(spark, str(tmp_path)).collect())
    assert got == sorted(brute(texts))


def test_automaton_counts_places():
    words = [f"w{i}".encode() for i in range(50)]
    assert repeated_windows([(words[:40], 1), (words[3:50], 1)]) == [0b111000, 0b111]
    assert repeated_windows([(words[:36], 2)]) == [0b11]


def test_pipeline_form_keeps_the_rest_as_it_is(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one\n two  {passage}\nthree", "en", 9), (2, f"{passage} four", "en", 9), (3, passage, "en", 9), (4, "as\n it  is ", "en", 9), (5, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string, n_chars long")
    got = {r.doc_id: (r.text, r.did, r.n_chars) for r in remove_repeats(docs).collect()}
    assert got == {1: ("one\n two  three", "en", 15), 2: ("four", "en", 4), 4: ("as\n it  is ", "en", 9), 5: (None, None, None)}
    assert remove_repeats(docs.limit(0)).collect() == []
