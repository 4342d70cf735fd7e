import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm import negatives
from chainlens.llm.negatives import Anchors, encode, hard_negatives, op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = [(i, l if i % 7 else (l + 1) % 10, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in kept:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, l == la) for i, l, v in kept if i != a)
        for p, pid, same in [s for s in scored if s[2]][:5]:
            fit = [(s, i) for s, i, other in scored if not other and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def draw(n, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    center = rng.standard_normal((10, dims))
    labels = rng.integers(0, 10, n)
    v = (center[labels] * 0.6 + rng.standard_normal((n, dims))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, v[i].tolist(), int(labels[i])) for i in range(n)]


def answer(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("sample", [64, 4096])
def test_equals_brute_force_with_nulls_copies_and_ties(spark, tmp_path, monkeypatch, sample):
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    rows = draw(900)
    for i in range(150, 450):  # a third of all rows is one vector, under several labels
        rows[i] = (i, rows[7][1], i % 3)
    rows[300] = (300, None, 1)
    rows[21], rows[22], rows[23], rows[24] = (21, [None] * 24, 1), (22, [float("nan")] * 24, 1), (23, [float("inf")] * 24, 2), (24, rows[24][1], None)
    rows[30], rows[31], rows[32] = (30, [], 4), (31, [0.5, -0.25], 4), (None, rows[32][1], 5)
    rows[100] = (100, [-x for x in rows[100][1]], rows[100][2])
    spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], SCHEMA + ", rank string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(i, None if v is None else v + [0.0] * (24 - len(v)), lab) for i, v, lab in rows])
    assert answer(op13_hard_negatives(spark, str(tmp_path))) == want and len(want) > 100


def test_groups_of_anchors_give_the_same(spark):
    rows = draw(400, 70, 5)  # more components than a word has bits
    df = spark.createDataFrame(rows, SCHEMA)
    every = F.col("vec_id") % 100 == 0
    assert answer(hard_negatives(df, every, group=2)) == answer(hard_negatives(df, every)) == brute(rows)


def test_empty_tables_and_anchors_without_partners(spark):
    df = spark.createDataFrame(draw(50), SCHEMA)
    assert hard_negatives(df.limit(0), F.lit(True)).collect() == []
    assert hard_negatives(df, F.lit(False)).collect() == []
    assert hard_negatives(df.where("vec_id < 1"), F.lit(True)).collect() == []
    assert hard_negatives(df.withColumn("label", F.lit(1)).where("vec_id % 7 != 0"), F.lit(True)).collect() == []


def test_repeated_rows_count_each(spark):
    rows = draw(60)
    df = spark.createDataFrame([*rows, rows[5]], SCHEMA)
    got = [r for r in hard_negatives(df, F.col("vec_id") == 0).collect()]
    assert all(r.anchor_id == 0 and r.positive_id != 0 and r.negative_id != 0 for r in got)


def test_bounds_hold_and_leave_few():
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in draw(3000, 64)], np.int64)
    code, along, left = encode(x)
    assert (np.diff(left, axis=1) < 0).all()
    low, high = Anchors(x[:50]).bounds(slice(0, 50), code, along, left)
    exact = x @ x[:50].T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(exact, axis=0)[-5]
    assert (high >= fifth).mean() < 0.1
