"""Text ids give what numbers give, and columns of any name may be there."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from molcorpus.llm import bradley_terry, decontaminate, katz, minhash, suffix
from molcorpus.llm.text import fresh

NAMES = F.format_string("<urn:%05d>", "doc_id")


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(i, f"text number {i} of many words {passage if i % 3 else ''} and {item if i == 4 else 'an end'}") for i in range(12)]
    rows += [(20, rows[1][1]), (21, None), (22, ""), (23, rows[2][1] + " more")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def named(docs):
    """With text ids, one row without an id, and the names that operators use inside."""
    named = docs.withColumn("number", F.col("doc_id")).withColumn("doc_id", NAMES)
    for name in ("_row", "row", "k", "n", "id", "t", "_quality", "spans", "component_id", "b", "chunk", "digest"):
        named = named.withColumn(name, F.lit("clash"))
    return named


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i1", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id string, text string")


def same(by_number, by_name, columns=()):
    """Equal rows once numbers are written as names."""
    by_number = by_number.withColumn("doc_id", NAMES)
    for c in columns:
        by_number = by_number.withColumn(c, F.format_string("<urn:%05d>", c))
    assert by_number.columns == by_name.columns
    want, got = (sorted(map(tuple, df.collect()), key=str) for df in (by_number, by_name))
    assert got == want and got


def test_katz(docs, named):
    held, held_named = F.col("doc_id") % 5 == 1, F.col("number") % 5 == 1
    by_number = katz.score(docs, held).withColumn("score", F.round("score", 9)).withColumn("base_score", F.round("base_score", 9))
    by_name = katz.score(named, held_named).withColumn("score", F.round("score", 9)).withColumn("base_score", F.round("base_score", 9))
    same(by_number, by_name)


def test_repeats(docs, named):
    same(suffix.remove_repeated(docs), suffix.remove_repeated(named))
    renamed = suffix.remove_repeated(named.drop("_row").withColumnRenamed("doc_id", "_row"), key="_row")
    same(suffix.remove_repeated(docs), renamed.withColumnRenamed("_row", "doc_id"))


def test_near_duplicates(docs, named):
    same(minhash.near_duplicates(docs), minhash.near_duplicates(named), ["component_id"])
    lost = named.withColumn("doc_id", F.when(F.col("number") != 3, F.col("doc_id")))
    assert [r["component_id"] for r in minhash.near_duplicates(lost).filter("doc_id IS NULL").collect()] == [None]


def test_passages(docs, named, items):
    same(decontaminate.passages(docs, items), decontaminate.passages(named, items))


def test_quality_with_other_labels(named, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    ranked = bradley_terry.rank_quality(named, labels, F.lit(True))
    assert {r["score"] for r in ranked.collect()} == {0.5}


def test_stages(spark, named, docs):
    folder = "/root/testdata/sf0.001"
    columns = docs.schema.names
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.quality, corpus_pipeline.secrets):
        by_name = stage(spark, named, folder)
        assert by_name.columns == named.columns
        rows = by_name.collect()
        assert all(r["_row"] == r["_quality"] == r["spans"] == "clash" for r in rows)
        by_number = stage(spark, docs.withColumn("doc_id", F.col("doc_id")), folder).select(columns).collect()
        if stage is not corpus_pipeline.quality:
            assert {r["number"] for r in rows} == {r["doc_id"] for r in by_number}


def test_fresh_names(docs):
    assert fresh(docs, "_row") == "_row" and fresh(docs.withColumn("_ROW", F.lit(1)), "_row") == "_row_"
