"""SQL text against the Columns it was made from."""

import pytest
from pyspark.sql import functions as F

from molcorpus.functions.smiles import is_smiles
from molcorpus.functions.tokenizers import TOKENIZERS
from molcorpus.operators import sql_functions
from molcorpus.operators.annotate import annotate
from molcorpus.operators.extract import extract_segments
from molcorpus.operators.windows import token_windows

TEXTS = [
    "We saw CCO, and c1ccccc1.", None, "", "hydrogen fluoride HF and [Na+].[Cl-] it's 'quoted' \\ back", "C(=O)O (CC(=O)O), IF",
    "[START_SMILES]CCO[END_SMILES] x [START_SMILES] [13CH4]Br [END_SMILES]", "sodium Na Na `a` lambdafunction(x, y)",
]


@pytest.fixture(scope="module")
def view(spark):
    names = sql_functions.register(spark)
    assert {"is_smiles", "annotate", "segments", "windows", "tokens_element"} <= set(names)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    df.createOrReplaceTempView("sql_texts")
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_annotate(spark, view):
    want = annotate(view, "text").select("doc_id", "text_reannotated")
    assert rows(spark.sql("SELECT doc_id, annotate(text) AS t FROM sql_texts")) == rows(want)


def test_detection(spark, view):
    words = view.select(F.explode(F.split("text", " ")).alias("w")).withColumn("p", F.lit("fluoride"))
    words.createOrReplaceTempView("sql_words")
    assert rows(spark.sql("SELECT w, is_smiles(w, p) AS s FROM sql_words")) == rows(words.select("w", is_smiles(F.col("w"), F.col("p"))))


@pytest.mark.parametrize("name", list(TOKENIZERS))
def test_tokenizers(spark, view, name):
    want = view.select("doc_id", TOKENIZERS[name](F.col("text")).alias("t"))
    assert rows(spark.sql(f"SELECT doc_id, tokens_{name}(text) AS t FROM sql_texts")) == rows(want)


def test_tables(spark, view):
    got = spark.sql("SELECT doc_id, s.seg, s.smiles FROM sql_texts, LATERAL segments(text) AS s")
    assert rows(got) == rows(extract_segments(view, "doc_id", "text"))
    ids = spark.createDataFrame([(1, list(range(10))), (2, []), (3, [5]), (4, list(range(4)))], "doc_id bigint, ids array<bigint>")
    ids.createOrReplaceTempView("sql_ids")
    got = spark.sql("SELECT doc_id, w.win, w.part FROM sql_ids, LATERAL windows(ids, 4, 1) AS w")
    assert rows(got) == rows(token_windows(ids, "ids", 4, 1).select("doc_id", "win", "ids"))


def test_no_python_in_the_plan(spark, view):
    df = spark.sql("SELECT doc_id, annotate(text) AS t, tokens_rings(text) AS r FROM sql_texts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_arrows():
    text = "transform(x, lambdafunction(concat(y_1, 'lambdafunction(a, b)', `)`), y_1, i_2))"
    assert sql_functions.with_arrows(text) == "transform(x, (y_1, i_2) -> concat(y_1, 'lambdafunction(a, b)', `)`))"
    nested = "f(lambdafunction(g(x_1, lambdafunction(h(y_2), y_2)), x_1))"
    assert sql_functions.with_arrows(nested) == "f(x_1 -> g(x_1, y_2 -> h(y_2)))"
