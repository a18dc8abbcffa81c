"""The pipeline's stages on planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_registered():
    names = list(queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "pipeline" not in oracle_sql()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_run_applies_the_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF)
        if name != "tokens":
            assert kept.columns == docs.columns
            ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
            assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
    want = {(r["doc_id"], r["ids_sha256"]) for r in kept.collect()}
    assert want == {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(want) < docs.count()


def test_planted_cases(spark, docs):
    """Copies, a passage and a secret are found; what is clean stays as it is."""
    clean = docs.filter("lang = 'en' AND n_chars BETWEEN 600 AND 3000").limit(5)
    first = clean.orderBy("doc_id").first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (10**6, first["text"], "en", "x", None),
        (10**6 + 1, "Entirely other words " + item + " and some more words after it", "en", "x", 7),
        (10**6 + 2, "Here one finds password=abc123def456 among the words of this text", None, None, 7),
        (10**6 + 3, None, None, None, None), (10**6 + 4, "", None, None, 0), (None, "a text without a name is kept", "en", None, 1),
    ]
    planted = clean.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(clean.limit(1))
    kept = corpus_pipeline.near_duplicates(spark, planted, SF)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 10**6 not in ids and len(ids) == len(set(ids)) and None in ids and 10**6 + 3 in ids
    kept = corpus_pipeline.decontamination(spark, planted, SF)
    gone = {r["doc_id"] for r in planted.join(kept, "doc_id", "left_anti").collect()} - {None}
    assert 10**6 + 1 in gone and 10**6 + 2 not in gone
    by_id = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, planted, SF).collect()}
    assert by_id[10**6 + 2]["text"] == "Here one finds [SECRET] among the words of this text"
    assert by_id[10**6 + 2]["n_chars"] == len(by_id[10**6 + 2]["text"])
    assert by_id[first["doc_id"]]["text"] == first["text"] and by_id[10**6 + 3]["text"] is None
    tokens = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, planted, SF).collect()}
    assert tokens[10**6 + 3]["n_tokens"] == tokens[10**6 + 4]["n_tokens"] == 0


def test_no_rows(spark, docs):
    none = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_stages_decide_by_row(spark, docs):
    """One id with several texts, and rows without an id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    copied = " ".join(f"copied{i}" for i in range(60))
    unique = " ".join(f"unique{i}" for i in range(60))
    nameless = " ".join(f"nameless{i}" for i in range(60))
    rows = [
        (7, copied, "en", "x", 1), (3, copied, "en", "x", 1), (7, unique, "en", "x", 1), (None, copied, "en", "x", 1),
        (None, nameless, "en", "x", 1), (None, nameless, "en", "x", 1), (None, "before " + item, "en", "x", 1),
        (9, "before it " + item, "en", "x", 1), (9, "clean words under the same id", "en", "x", 1), (9, None, "en", "x", 1),
    ]
    planted = spark.createDataFrame(rows, docs.schema).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, planted.filter(~F.coalesce(F.col("text"), F.lit("")).contains(item)), SF).collect()]
    want = [(3, copied), (7, unique), (None, nameless), (9, "clean words under the same id"), (9, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, planted, SF).collect()]
    assert sorted(kept, key=str) == sorted([(r[0], r[1]) for r in rows if item not in (r[1] or "")], key=str)
