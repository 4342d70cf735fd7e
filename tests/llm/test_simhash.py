import numpy as np
import xxhash
from pyspark.sql import functions as F

from chainlens.llm import simhash
from chainlens.llm.simhash import DISTANCE, fingerprint_of, keep_one, near_duplicates, near_pairs


def brute_components(ids, fps):
    least = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= DISTANCE and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    out = []
    for i in range(len(fps)):
        r = i
        while least[r] != r:
            r = least[r]
        out.append(r)
    return [min(ids[j] for j in range(len(fps)) if out[j] == out[i]) for i in range(len(fps))]


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_fingerprint_equals_the_definition():
    for t in (None, "", " \n", "One", "one TWO three", "a b c d", "É b\tc d É b c d e", "x " * 300):
        assert fingerprint_of(t) == brute_fingerprint(t)


def test_index_finds_every_pair():
    draw = np.random.default_rng(1)
    centre = draw.integers(0, 2**64, 6, np.uint64)
    flips = lambda n: sum((np.uint64(1) << np.uint64(b) for b in draw.choice(64, n, False)), np.uint64(0))
    fp = np.unique(np.array([centre[i % 6] ^ flips(int(draw.integers(0, 6))) for i in range(400)] + list(draw.integers(0, 2**64, 200, np.uint64)), np.uint64))
    gray = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    fp = fp[np.argsort(gray)]
    first = np.array([0, 7, 8, 300])
    want = {(i, j) for a, b in zip(first, [*first[1:], len(fp)], strict=True) for i in range(a, b) for j in range(i + 1, b) if int(fp[i] ^ fp[j]).bit_count() <= DISTANCE}
    simhash.PAIRS, before = 500, simhash.PAIRS
    try:
        got = {(int(i), int(j)) for q, n in near_pairs(fp, first) for i, j in zip(q, n, strict=True)}
    finally:
        simhash.PAIRS = before
    assert got == want and len(want) > 100


def texts(n=160):
    draw = np.random.default_rng(5)
    base = [[f"w{x}" for x in draw.integers(0, 50, 120)] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(base[i % 8])
        for _ in range(int(draw.integers(0, 3))):
            w[int(draw.integers(0, len(w)))] = f"e{draw.integers(0, 9)}"
        out.append(" ".join(w))
    return [*out, None, "", "  ", *out[:5]]


def test_components_equal_brute_force(spark, monkeypatch):
    all_texts = texts()
    rows = [(1000 - i, t, "x") for i, t in enumerate(all_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for tile in (4096, 3):
        monkeypatch.setattr(simhash.links, "__defaults__", (tile,))
        got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in near_duplicates(docs).collect()}
        fps = [brute_fingerprint(t) for t in all_texts]
        want = brute_components([r[0] for r in rows], fps)
        assert got == {r[0]: (f, w) for r, f, w in zip(rows, fps, want, strict=True)}


def test_keep_one_of_each_component(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "l"), (1, "a b c d e", "l"), (2, "a b c d e", "l"), (None, "z y x", "l"), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(keep_one(docs).collect(), key=str) == sorted(docs.where("doc_id is null or doc_id != 2").distinct().collect(), key=str)
    assert keep_one(docs.limit(0)).collect() == []


def test_keep_one_by_component_not_by_its_least_doc_id(spark):
    rows = [(None, "one text without an id"), (None, "quite another one, also without"), (7, "some words under seven"), (7, "seven again, but different words"), (8, "some words under seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs).collect()), key=str) == sorted(rows[:4], key=str)


def near_texts():
    draw = np.random.default_rng(3)
    out = []
    for _ in range(6):
        base = [f"w{x}" for x in draw.integers(0, 400, 150)]
        for _ in range(25):
            w = list(base)
            for _ in range(int(draw.integers(0, 9))):
                w[int(draw.integers(0, len(w)))] = f"e{draw.integers(0, 99)}"
            out.append(" ".join(w))
    return [*out, None, "", "  ", "Short text", "short  TEXT", "short"]


def test_keep_one_equals_brute_force_at_four_fifths_of_five_word_shingles(spark, monkeypatch):
    all_texts = near_texts()
    words = [(t or "").lower().split() for t in all_texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    want = {min(i for i, p in enumerate(part) if p == q) for q in part}
    assert 10 < len(want) < len(sets) - 50
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    for tile in (512, 4):
        monkeypatch.setattr(simhash.copies, "__defaults__", (tile,))
        assert {r.doc_id for r in keep_one(docs).collect()} == want


def form_letters(n):
    """Near copies of one letter, each with a word of its own, and some texts that share parts of it only."""
    draw = np.random.default_rng(8)
    base = [f"w{x}" for x in draw.integers(0, 5000, 120)]
    out = []
    for i in range(n):
        w = list(base)
        w[int(draw.integers(0, len(w)))] = f"n{i}"
        out.append(" ".join(w if i % 40 else w[:60] + [f"z{i}x{k}" for k in range(20)]))
    return out


def test_work_on_one_large_group_follows_its_size(spark, monkeypatch):
    """Near copies by the hundred, in tiles of ten: groups hold each text some times, not once for every tile."""
    held = {}
    first, last = simhash.first_groups, simhash.last_groups
    monkeypatch.setattr(simhash, "first_groups", lambda *a: held.setdefault("first", first(*a)))
    monkeypatch.setattr(simhash, "last_groups", lambda *a: held.setdefault("last", last(*a)))
    monkeypatch.setattr(simhash.copies, "__defaults__", (10,))
    docs = spark.createDataFrame(list(enumerate(form_letters(600))), "doc_id long, text string")
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert kept == {1, *range(0, 600, 40)}  # one of the letters, and every text that has half of it
    a_tile = held["first"].groupBy("band", "bucket", "low").count().agg({"count": "max"}).first()[0]
    assert a_tile < 60 and held["first"].count() < 3 * 600 * 20 and held["last"].count() < 600 * 20


def test_keep_one_meets_copies_by_the_fingerprint_index(spark, monkeypatch):
    """Without a band in common, near copies are still found through their fingerprints: and only those that are alike."""
    draw = np.random.default_rng(4)
    base = [[f"w{x}" for x in draw.integers(0, 5000, 3000)] for _ in range(5)]
    near = [" ".join([*w[:200], "other", *w[201:]]) for w in base]
    all_texts = [*(" ".join(w) for w in base), *near, "x y z", "x y z w"]
    apart = [(fingerprint_of(a) ^ fingerprint_of(b)).bit_count() for a, b in zip(all_texts[:5], near, strict=True)]
    assert max(apart) <= DISTANCE
    meetings = simhash.meetings
    monkeypatch.setattr(simhash, "meetings", lambda rows: meetings(rows).where("band = 0"))
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == {0, 1, 2, 3, 4, 10, 11}
    # One bucket of all texts, which the index may well give: likeness alone decides.
    monkeypatch.setattr(simhash, "meetings", lambda rows: meetings(rows).where("band = 0").withColumn("bucket", F.lit(0).cast("long")))
    assert {r.doc_id for r in keep_one(docs).collect()} == {0, 1, 2, 3, 4, 10, 11}


def test_the_same_texts_meet_in_one_bucket_only(spark, monkeypatch):
    """Near copies share many bands: their shingles travel once for each set of texts, not once for each band."""
    held = {}
    first = simhash.first_groups
    monkeypatch.setattr(simhash, "first_groups", lambda *a: held.setdefault("bands", a[0]) and held.setdefault("first", first(*a)))
    docs = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    keep_one(docs).collect()
    every = {frozenset(r.keys) for r in held["bands"].groupBy("band", "bucket").agg(F.collect_set("key").alias("keys")).collect() if len(r.keys) > 1}
    met = [frozenset(r.keys) for r in held["first"].groupBy("band", "bucket", "low").agg(F.collect_set("key").alias("keys")).collect()]
    assert set(met) == every and len(met) == len(every) > 10
