"""Properties of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from molcorpus.functions.tokenizers import tok_element, tok_whitespace
from molcorpus.operators import annotate, extract, learned, ranking, vocab, windows
from molcorpus.sources.samples import table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projections_do_not_shuffle(documents):
    ids = F.transform(tok_whitespace(F.col("text")), lambda t: F.length(t))
    for df in (
        annotate.annotate(documents, "text"),
        annotate.with_context(documents, "doc_id", "text"),
        extract.extract_segments(documents, "doc_id", "text"),
        windows.token_windows(documents.select("doc_id", ids.alias("ids")), "ids", 64, 16),
    ):
        assert "Exchange" not in plan(df)


def test_a_prefix_reaches_the_scan(documents):
    text = plan(ranking.portion(documents, ["doc_id"], 0.3))
    assert "PushedFilters: [IsNotNull(doc_id), LessThanOrEqual(doc_id," in text
    assert "Exchange" not in text and "Sort" not in text


def test_a_sample_is_a_filter(documents):
    text = plan(ranking.sample_n(documents, ["doc_id"], 50))
    assert "Exchange" not in text and "Sort" not in text


def test_only_needed_columns_are_read(documents):
    assert "ReadSchema: struct<text:string>" in plan(extract.normalise_text(documents, "text"))
    counted = learned.word_counts(documents, tok_whitespace(F.col("text")))
    assert "ReadSchema: struct<text:string>" in plan(counted)


def test_counts_and_first_places_are_hashed(documents):
    tokens = documents.select("doc_id", tok_element(F.col("text")).alias("tokens"))
    rows = vocab.token_rows(tokens, ["doc_id"], "tokens")
    text = plan(vocab._first_seen(rows, ["doc_id", "pos"]))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    # The tokenizer runs once per row, not again to test for empty arrays.
    assert text.count("regexp_extract_all") == 1


def test_ranks_have_no_single_task_over_all_rows(documents):
    text = plan(ranking.rank_rows(documents.select("doc_id", "source"), ["doc_id"], ["source"]))
    assert "SinglePartition" not in text


def test_pooling_counts_ids_before_the_join(spark):
    """Without broadcasts ids are counted per row first, and no null id is joined."""
    from molcorpus.operators import embed

    rows = spark.createDataFrame([(i, [1, 1, 2], [1, 1, 0]) for i in range(50)], "k bigint, ids array<bigint>, m array<int>")
    base = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "token_id bigint, embedding array<double>")
    pooled = embed.mean_pool(rows, ["k"], "ids", "m", base, 2)
    text = pooled._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(token_id" in text and "Generate" not in text.split("Join")[-1].split("Relation")[0]
    assert {tuple(r["embedding"]) for r in pooled.collect()} == {(1.0, 2.0)}
