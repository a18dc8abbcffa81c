"""Work that is stopped half-way goes on where it was."""

import os

import pytest
from pyspark.sql import functions as F

from molcorpus.operators.annotate import annotate
from molcorpus.sources import resumable


@pytest.fixture
def shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"we saw CCO {i} times") for i in range(40)], "doc_id bigint, text string")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def tagged(df):
    return annotate(df, "text")


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text_reannotated").collect()))


def test_only_the_rest_is_done(spark, shards, tmp_path):
    out, seen = f"{tmp_path}/out", []

    def project(df):
        seen.append(len(df.inputFiles()))
        return tagged(df)

    assert resumable.project_shards(spark, shards, out, project, together=2, most=1) == 2
    os.makedirs(f"{out}/part-left", exist_ok=True)  # of a job that was stopped before its commit
    assert resumable.project_shards(spark, shards, out, project, together=2) == 3
    assert resumable.project_shards(spark, shards, out, project, together=2) == 0
    assert seen == [2, 2, 1]
    assert rows(resumable.read_projected(spark, out)) == rows(tagged(spark.read.parquet(shards)))


def test_a_failed_projection_commits_nothing(spark, shards, tmp_path):
    out = f"{tmp_path}/out"

    def broken(df):
        return df.select(F.raise_error(F.lit("broken")).alias("text"))

    with pytest.raises(Exception, match="broken"):
        resumable.project_shards(spark, shards, out, broken)
    assert resumable.committed(spark, out) == []
    with pytest.raises(FileNotFoundError):
        resumable.read_projected(spark, out)
    assert resumable.project_shards(spark, shards, out, tagged) == 5


def test_shards_are_known_by_content(spark, shards, tmp_path):
    out = f"{tmp_path}/out"
    resumable.project_shards(spark, shards, out, tagged)
    (first, *_) = [f for f in os.listdir(shards) if f.endswith(".parquet")]
    os.rename(f"{shards}/{first}", f"{shards}/renamed.parquet")
    assert resumable.project_shards(spark, shards, out, tagged) == 0
    # a copy of a shard has its rows once more; a new shard is new
    spark.createDataFrame([(99, "a C"), (99, "a C")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(shards)
    assert resumable.project_shards(spark, shards, out, tagged) == 1
    assert resumable.read_projected(spark, out).count() == 42


def test_fingerprints_see_nulls_and_order(spark, tmp_path):
    for name, data in (("a", [(None, "x"), (1, None)]), ("b", [(1, None), (None, "x")]), ("c", [(1, "x"), (None, None)])):
        spark.createDataFrame(data, "i int, s string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    a, b, c = (list(resumable.fingerprints(spark.read.parquet(f"{tmp_path}/{n}")).values())[0] for n in "abc")
    assert a == b != c


def test_one_large_shard_is_work_for_all_cores(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "concat('we saw CCO ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/in")
    resumable.project_shards(spark, f"{tmp_path}/in", f"{tmp_path}/out", tagged)
    done = resumable.read_projected(spark, f"{tmp_path}/out")
    assert done.select(F.input_file_name()).distinct().count() >= spark.sparkContext.defaultParallelism
    assert rows(done) == rows(tagged(spark.read.parquet(f"{tmp_path}/in")))
