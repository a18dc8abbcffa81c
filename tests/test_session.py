"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from molcorpus import session


def fake(master, folder=None):
    context = SimpleNamespace(master=master, applicationId="app")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder or default))


def test_the_named_folder_is_used():
    assert session.scratch_folder(fake("yarn", "hdfs:///shared")) == "hdfs:///shared/app"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_folder(fake("yarn"))


def test_one_machine_keeps_its_folder():
    spark = fake("local[2]")
    assert session.scratch_folder(spark) == session.scratch_folder(spark)


def test_materialize(spark):
    df = session.materialize(spark.range(7))
    assert df.count() == 7 and df.dtypes == [("id", "bigint")]


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 3)
    assert session.spread(many) is many
