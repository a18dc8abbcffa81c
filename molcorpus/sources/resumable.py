"""A projection of a folder of shards that goes on where it was stopped.

Shards are known by a fingerprint of their rows, not by name or time: a shard that was renamed is
not done again, one that was changed is. Some shards at a time are projected and written to a
folder of their own; the commit is one small file of the manifest, which names the folder and the
fingerprints and appears whole. Folders that no manifest names are left from stopped work and
are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


def fingerprints(shards: DataFrame) -> dict[str, str]:
    """Path of every shard with a fingerprint of its rows, whatever their order. One row per shard
    reaches the driver."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in shards.columns])
    hashed = shards.select(F.col("_metadata.file_path").alias("path"), row.alias("h"))
    per = hashed.groupBy("path").agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")
    )
    return {r["path"]: f"{r['n']}-{r['x']}-{r['s']}" for r in per.collect()}


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, out: str) -> list[dict]:
    """What the manifest says: folders of results with the fingerprints they are made from."""
    path, files = _path(spark, f"{out}/{MANIFEST}")
    if not files.exists(path):
        return []
    entries = spark.read.text(f"{out}/{MANIFEST}/*.json", wholetext=True).collect() if len(files.listStatus(path)) else []
    return [json.loads(r["value"]) for r in entries]


def commit(spark: SparkSession, out: str, folder: str, shards: list[str]) -> None:
    """Name a finished folder: written under another name first, so that it is whole when seen."""
    waiting, files = _path(spark, f"{out}/{MANIFEST}/_{folder}")
    stream = files.create(waiting, True)
    stream.write(bytearray(json.dumps({"folder": folder, "shards": shards}).encode()))
    stream.close()
    done, _ = _path(spark, f"{out}/{MANIFEST}/{folder}.json")
    if not files.rename(waiting, done):
        raise OSError(f"could not commit {folder}")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores. A file's row groups cannot be split, so a few shards would
    otherwise be read by as many tasks as they have row groups, however many splits are planned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, rows.rdd.getNumPartitions()))


def project_shards(
    spark: SparkSession, folder: str, out: str, project: Callable[[DataFrame], DataFrame], together: int = 8, most: int | None = None
) -> int:
    """Project the Parquet shards below a folder that are not done yet, ``together`` per commit, and
    return how many were done now; ``most`` ends the work after so many commits. Equal shards
    are projected as often as they are there."""
    known = fingerprints(spark.read.parquet(folder))
    done = [s for entry in committed(spark, out) for s in entry["shards"]]
    todo = []
    for path, name in sorted(known.items()):
        if name in done:
            done.remove(name)
        else:
            todo.append((path, name))
    groups = [todo[i : i + together] for i in range(0, len(todo), together)][:most]
    for group in groups:
        name = f"part-{uuid.uuid4().hex}"
        project(_dealt(spark.read.parquet(*[path for path, _ in group]))).write.parquet(f"{out}/{name}")
        commit(spark, out, name, [shard for _, shard in group])
    return sum(map(len, groups))


def read_projected(spark: SparkSession, out: str) -> DataFrame:
    """All committed results."""
    folders = [f"{out}/{entry['folder']}" for entry in committed(spark, out)]
    if not folders:
        raise FileNotFoundError(f"nothing is committed in {out}")
    return spark.read.parquet(*folders)
