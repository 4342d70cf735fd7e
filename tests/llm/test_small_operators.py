"""Operators 1 to 4 and 6 against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm import host_quality, langid, minhash, sharding, toxicity

SMALL = "/root/testdata/sf0.001"
EDGES = [(1, None, "en", None), (2, "", None, "s"), (3, " \n\t", "en", "s"), (None, "12 34 !!", None, "s"), (5, "word " * 30, "en", "s"), (5, "word " * 30, "en", "s"), (6, "é" * 50_000, "fr", "t")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(*r, 7, "x") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, key string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- 2: sharding


def check_shards(rows, texts, n, slack):
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    total = sum(r.size for r in rows)
    assert all(0 <= r.shard < n for r in rows)
    largest = max((r.size for r in rows), default=0)
    assert all(abs(sum(r.size for r in rows if r.shard == s) - total / n) <= slack * largest for s in range(n))


def test_shards_are_equal_in_bytes(spark, docs, edges):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_shards(sharding.op2_sharding(spark, SMALL).collect(), texts, 24, 1)
    check_shards(sharding.shard_by_bytes(docs, 5, ranges_per_shard=2).collect(), texts, 5, 1)
    check_shards(sharding.shard_by_bytes(edges, 2).collect(), [(r[0], r[1]) for r in EDGES], 2, 1)
    assert sharding.shard_by_bytes(edges.limit(0)).collect() == []


def test_one_text_for_a_third_of_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    check_shards(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect(), rows, 24, 1)


# --- 3: language


def test_grams_of_slices_are_those_of_the_whole(monkeypatch):
    draw = random.Random(1)
    for text in ["".join(draw.choice("abc é1\n") for _ in range(3000)), "a" * 300, "ab" + " " * 250 + "c", " 1" * 150 + "x", "𝒳y " * 120]:
        whole = np.sort(np.concatenate([*langid.grams(text)]))
        flat = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        assert len(whole) == sum(sum(k + n > 1 for k in range(len(flat) - n + 1)) for n in langid.ORDERS)  # all but the first space alone
        for size in (1, 2, 3, 100):
            monkeypatch.setattr(langid, "SLICE", size)
            assert (np.sort(np.concatenate([*langid.grams(text)])) == whole).all()
        monkeypatch.setattr(langid, "SLICE", 2**20)
    assert [*langid.grams("12 !\n")] == [] == [*langid.grams("")]


def test_batch_scores_are_those_of_each_text(monkeypatch):
    weights = np.random.default_rng(2).normal(size=(2**16, 3)).astype(np.float32)
    texts = ["some text", None, "", "12", "another one, longer than others", "b"]
    for held in (2**19, 7):
        monkeypatch.setattr(langid, "HELD", held)
        total, second, n = langid.sums(texts, weights, True)
        for i, t in enumerate(texts):
            g = np.concatenate([*langid.grams(t or ""), np.zeros(0, np.int32)])
            w = weights[g].astype(float)
            assert n[i] == len(g) and np.allclose(total[i], w.sum(0), atol=1e-4) and np.allclose(second[i], (w * w).sum(0), atol=1e-3)


def test_a_language_that_was_not_taught_goes(spark, docs):
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    more = spark.createDataFrame([(900_000 + i, t, None, "s", len(t or "")) for i, t in enumerate([*foreign, None, "", "123 !"])], docs.schema)
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_language_held_out(spark, docs, edges):
    got = {r.doc_id: r for r in langid.op3_language_id(spark, SMALL).collect()}
    labelled = [(r.doc_id, r.lang) for r in docs.collect() if r.lang]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(i, x) for i, x in labelled if got[i].held_out]
    assert np.mean([got[i].lang_pred == x for i, x in held]) > 0.95
    model = langid.learn(edges)
    found = edges.select("doc_id", "text", langid.identify(model)("text").alias("g")).collect()
    assert all((r.g.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in found)
    assert langid.keep_known(edges).columns == edges.columns and langid.keep_known(edges.limit(0)).collect() == []


# --- 4: quality rules


def plain_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), len(lines)


def test_counts_equal_the_definition():
    draw = random.Random(2)
    texts = [t for _, t, *_ in EDGES if len(t or "") < 1000] + ["".join(draw.choice("ab #\n\t\x1c\xa0é") for _ in range(200)) for _ in range(60)] + ["a b c d e f g h " * 3 + "x", "a " * 9]
    for t in texts:
        assert host_quality.counts_of(t) == plain_counts(t), repr(t)


def test_verdicts_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(host_quality.OP4_SQL)
    got = host_quality.op4_quality_rules(spark, SMALL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_hosts_that_fail_lose_all(spark, edges):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad" if i % 10 < 9 else good, "bad.example") for i in range(200)] + [(1000 + i, good, "good.example") for i in range(200)] + [(2000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for few in (50_000, 0):
        kept = {r.doc_id for r in host_quality.judge(docs, broadcast_hosts=few).where("kept").collect()}
        assert kept == {1000 + i for i in range(200)} | {2000}
    assert host_quality.judge(edges).count() == len(EDGES) and host_quality.judge(edges.limit(0)).collect() == []


def test_hosts_decide_over_documents(spark):
    """Thirty ordinary hosts (4 of 100 documents full of symbols), one that is bad by symbols, and one with a clean record."""
    good = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"word{i}###" for i in range(40))
    rows = [(1000 * h + i, junk if i < 4 else good, f"h{h}") for h in range(30) for i in range(100)]
    rows += [(40_000 + i, junk if i < 60 else good, "symbols.example") for i in range(100)]
    rows += [(50_000 + i, junk if i < 2 else good, "clean.example") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_quality.judge(docs).where("kept").collect()}
    assert not any(40_000 <= i < 40_100 for i in kept)  # good documents fall with their host
    assert {i for i in kept if i < 30_000} == {i for i, t, _ in rows if i < 30_000 and t == good}
    assert {50_000, 50_001} <= kept  # two failures of four thousand are forgiven


# --- 1: toxicity


def test_severity_of_planted_words(spark):
    draw = random.Random(3)
    some = lambda n: [f"{draw.choice('abcdefgh')}{draw.choice('aeiou')}{draw.choice('lmnrst')}o" for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        n = 0 if i % 4 else 1 + i // 4 % 6
        words = some(draw.randrange(20, 60))
        for _ in range(n):
            words.insert(draw.randrange(len(words)), draw.choice(["grumbly", "snarkish", "snarkoid", "Vileness,"]))
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(n > 0)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, told)
    assert len(model.value.thresholds) == 3 and list(model.value.thresholds) == sorted(model.value.thresholds)
    got = {r.doc_id: r.g for r in docs.select("doc_id", toxicity.grade(model)("text").alias("g")).collect()}
    unseen = range(400, 600)
    assert all((got[i].p_toxic >= 0.5) == (i % 4 == 0) for i in unseen)
    assert np.mean([got[i].severity for i in unseen if i % 4 == 0 and i // 4 % 6 == 5]) > np.mean([got[i].severity for i in unseen if i % 4 == 0 and i // 4 % 6 == 0])  # six and one telling words
    assert len(toxicity.keep_civil(docs, told).where("doc_id >= 400").collect()) == 150


def test_evidence_against_and_rows_bounded(spark):
    """Words that only clean documents have speak for a text; a doc_id that repeats is one labelled row."""
    draw = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"word{draw.randrange(80)}" for _ in range(30)] + ["crudely"] * (i % 2 == 0) + ["kindly"] * (i % 2 == 1 or i % 8 == 0)
        rows.append((i, " ".join(words)))
    rows += [(0, f"crudely again {k}") for k in range(50)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 2 == 0 and i % 8 > 0)) for i in range(400)], "doc_id long, toxic int")
    assert toxicity.sample(docs, told, 300).count() == 300 and toxicity.sample(docs, told, 1000).count() == 400
    weights = toxicity.fit(docs, told).weights
    assert weights["crudely"] > 1 and weights["kindly"] < -1


def test_toxicity_edges(spark, edges):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_civil(edges, none).count() == len(EDGES)
    assert toxicity.keep_civil(edges.limit(0), spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, toxic int")).collect() == []


# --- 6: MinHash


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_and_next(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in minhash.op6_minhash(spark, SMALL).collect()}
    errors = []
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(shingles(t), shingles(edited)), r.near_next - jaccard(shingles(t), shingles(after))]
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.01


def test_fingerprint_edges(spark, edges):
    near = minhash.likeness(F.col("a"), F.col("b"))
    pairs = [("a b c d e f", "a  b\nc d e f"), ("x", "x"), ("x", "y"), ("", None), ("x", "")]
    rows = spark.createDataFrame(pairs, "s string, t string").select(minhash.fingerprint(F.col("s")).alias("a"), minhash.fingerprint(F.col("t")).alias("b")).withColumn("near", near)
    assert [round(r.near, 1) for r in rows.collect()] == [1.0, 1.0, 0.0, 1.0, 0.0]
    assert {len(r.a) for r in rows.collect()} == {0, 2 * minhash.BINS}
    made = minhash.with_next(edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("f").alias("fingerprint")), n_ranges=3).collect()
    assert len(made) == len(EDGES) and all(r.next_text is not None for r in made)


def test_next_of_null_and_repeated_ids(spark):
    """A third of rows without doc_id and a third of one doc_id are parted by their texts; each row has the one after it."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.col("text"))
    got = minhash.with_next(docs, n_ranges=20).collect()
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    after = {r.text: r.next_text for r in got}
    ids = {t: -1 if i is None else i for i, t in rows}
    seen, t = [], min(after, key=lambda t: (ids[t], t))
    for _ in rows:
        seen.append(ids[t])
        t = after[t]
    turn = seen.index(min(seen)) if seen[0] != min(seen) else 0
    assert sum(a > b for a, b in zip(seen, seen[1:], strict=False)) <= 1 and len(set(after)) == 120 and turn >= 0


def test_language_values_beyond_the_bound_teach_nothing(spark):
    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro cinco"}
    rows = [(i, f"{words[k]} {i}", k) for i in range(60) for k in words] + [(900 + i, f"zzz qqq {i}", f"dirty{i}") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)
    assert model.langs == ["aa", "bb"] and model.weights.shape[1] == 2
    assert langid.predict(["beta gamma", "tres cuatro"], model)[0] == ["aa", "bb"]
