import pyspark.sql.functions as F

import corpus_pipeline
from chainlens.llm.common import scratch_tables

SF = "/root/testdata/sf0.001"
FILTERS = corpus_pipeline.STAGES[:-1]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "substrings", "packing"]
    columns, before = docs.columns, docs.count()
    for _, stage in FILTERS:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0.5 * before < len(kept) < before
    made = len(scratch_tables(spark))
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == kept
    assert sum("packing" in t or "encoded" in t for t in scratch_tables(spark)[made:]) == 1 and len(scratch_tables(spark)) <= made + 2


def test_stages_take_nulls_repeats_and_columns_of_any_name(spark):
    """Beside real documents: nulls, empty and blank texts, repeated rows, unrelated texts of one doc_id, and columns named like the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    # Texts of its own kind, each with other words, so that no stage but those meant has a reason to drop them.
    own = [f"The {w}house by the {w}water was {w}ing and the {w}er said that it is for the {w}tion of them." for w in ("alp", "bri", "cro")]
    rows = [(None, None), (None, ""), (5_000_001, " \n\t"), (5_000_002, own[0]), (5_000_002, own[0]), (5_000_003, own[1]), (5_000_003, own[2])]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema)
    odd = ["th", "id", "none", "row", "g", "n", "did", "spans", "left", "__th", "root", "a.b"]
    all_docs = docs.unionByName(more).withColumns({c: F.lit(c) for c in odd})
    for name, stage in FILTERS:
        got = stage(spark, all_docs, SF)
        assert got.columns == all_docs.columns, name
        found = got.collect()
        assert all(r[c] == c for r in found for c in odd), name
        mine = sorted((r.doc_id or 0, r.text or "") for r in found if r.doc_id is None or r.doc_id > 5_000_000)
        blank = [(0, ""), (0, ""), (5_000_001, " \n\t")]
        texts = sorted([(5_000_002, own[0]), (5_000_003, own[1]), (5_000_003, own[2])])
        want = {"language": [], "toxicity": blank + sorted([*texts, texts[0]]), "near_duplicates": [blank[2], *texts], "substrings": blank + sorted([*texts, texts[0]])}[name]
        assert mine == (want if name != "language" else mine) and (name != "language" or not any(not t.strip() for _, t in mine)), name
    pieces = corpus_pipeline.packing(spark, all_docs, SF)
    assert pieces.where("start = 0").count() == all_docs.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_the_sessions_batch_size_stays(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
