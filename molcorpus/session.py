"""Session defaults and the place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("molcorpus")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders chosen for applications on one machine that name none.
_local_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder the cluster names in
    ``spark.checkpoint.dir``. A local folder is chosen only where that is unset and
    Spark runs on one machine."""
    application = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if application not in _local_folders:
            _local_folders[application] = tempfile.mkdtemp(prefix="molcorpus-")
        folder = _local_folders[application]
    return f"{folder}/{application}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, when no result that reads
    them is needed any more."""
    _stored.clear()
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once,
    its lineage ends there, and it survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table that is the input of many queries: built and written once per session
    and folder of tables."""

    @wraps(build)
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = (spark.sparkContext.applicationId, build.__qualname__, sf_dir)
        if name not in _stored:
            _stored[name] = materialize(build(spark, sf_dir))
        return _stored[name]

    return load


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores, such as one small
    file. A large input has more splits than that and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of a few driver-side rows, held in the plan itself."""
    names, types = zip(*(field.split() for field in schema.split(", ")))
    arrow = {"string": pa.string(), "bigint": pa.int64()}
    columns = [pa.array([row[i] for row in rows], arrow[t]) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=list(names)))
