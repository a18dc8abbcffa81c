import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from molcorpus.session import drop_scratch, local_session  # noqa: E402

# Expressions are built when test modules are read, which needs a session.
SPARK = local_session("4", shuffle_partitions=4, checkpoint_dir=tempfile.mkdtemp(prefix="molcorpus-tests-"))
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    drop_scratch(SPARK)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def strings(spark):
    """A table of strings under one key."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, s string")

    return make


@pytest.fixture
def column(strings):
    """Values of an expression over strings, in order."""

    def evaluate(values, expression):
        rows = strings(values).select("doc_id", expression.alias("out")).collect()
        return [row["out"] for row in sorted(rows, key=lambda r: r["doc_id"])]

    return evaluate
