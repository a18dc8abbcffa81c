"""Corpora kept as Arrow IPC files, as a Spark data source to read and write."""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from molcorpus.sources.arrow_messages import Ranges, ranges_of_share

FORMAT = "arrow_files"
# A file is read by one task per this many bytes.
SPLIT_BYTES = 128 * 1024**2
# A task starts a new file once it holds this many bytes of batches.
FILE_BYTES = 64 * 1024**2
# Key of the footer under which a file's smallest and largest values are kept, by column and
# batch; of longer strings none are kept.
RANGES = "molcorpus.ranges"
LONGEST_BOUND = 64


class Share(InputPartition):
    """Every ``parts``-th record batch of a file, from batch number ``part`` on. Of a file of the
    streaming layout, the batches that begin in that part of its bytes: the heads of the
    messages before are read, not their bodies."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


def _open(path: str):
    """A local file is mapped into memory, so that batches passed over cost nothing."""
    system, inner = fs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if system.type_name == "local" else system.open_input_file(inner)


def _reader(source, columns: list[str] | None = None):
    """Reader for either IPC layout; a file that can be jumped about in starts
    with a mark. With ``columns`` only these are decoded."""
    jumps = source.read(6) == b"ARROW1"
    opener = ipc.open_file if jumps else ipc.open_stream
    source.seek(0)
    if columns is None:
        return opener(source), jumps
    names = opener(source).schema.names
    source.seek(0)
    options = ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns])
    return opener(source, options=options), jumps


def excluded(test: Filter, low, high) -> bool:
    """Whether no value between two bounds can pass a filter."""
    value = test.value
    try:
        if isinstance(test, EqualTo):
            return value < low or value > high
        if isinstance(test, In):
            return all(v is None or v < low or v > high for v in value)
        if isinstance(test, GreaterThan):
            return high <= value
        if isinstance(test, GreaterThanOrEqual):
            return high < value
        if isinstance(test, LessThan):
            return low >= value
        return low > value
    except TypeError:  # bounds of another type say nothing
        return False


class ArrowReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], columns: list[str]):
        self.files, self.columns, self.filters = files, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a column help to pass over batches; Spark still tests all rows."""
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.filters = [f for f in filters if isinstance(f, kinds) and len(f.attribute) == 1]
        return filters

    def partitions(self) -> list[InputPartition]:
        shares: list[InputPartition] = []
        for path, parts in self.files:
            shares += [Share(path, part, parts) for part in range(parts)]
        return shares

    def _wanted(self, reader, numbers: Iterable[int]) -> Iterator[int]:
        """The batches that may hold a row which passes all filters."""
        known = json.loads((reader.metadata or {}).get(RANGES.encode(), b"{}"))
        for i in numbers:
            bounds = ((f, known.get(f.attribute[0], {}).get(str(i))) for f in self.filters)
            if not any(b and excluded(f, *b) for f, b in bounds):
                yield i

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as source:
            reader, jumps = _reader(source, self.columns)
            if jumps:
                numbers = range(partition.part, reader.num_record_batches, partition.parts)
                batches = (reader.get_batch(i) for i in self._wanted(reader, numbers))
            elif partition.parts == 1:
                batches = reader
            else:
                ranges = ranges_of_share(source, source.size(), partition.part, partition.parts)
                if not ranges:
                    return
                source.seek(0)
                names = ipc.open_stream(source).schema.names
                options = ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns])
                file = pa.PythonFile(io.BufferedReader(Ranges(source, ranges), 1 << 20), "r")
                batches = ipc.open_stream(file, options=options)
            for batch in batches:
                yield batch.select(self.columns)


def bounds_of(column: pa.Array) -> list | None:
    """The smallest and largest value of a column of numbers or short strings."""
    kind = column.type
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)):
        return None
    found = [v.as_py() for v in pc.min_max(column).values()]
    if found[0] is None or pa.types.is_floating(kind) and (pc.any(pc.is_nan(column)).as_py() or not all(map(math.isfinite, found))):
        return None
    if pa.types.is_string(kind) and max(map(len, found)) > LONGEST_BOUND:
        return None
    return found


@dataclass
class Written(WriterCommitMessage):
    """Finished files under their working names."""

    paths: list[str]


class ArrowWriter(DataSourceArrowWriter):
    """Files of bounded size. They get their ``.arrow`` name, which readers look for, when all
    tasks are done. A file's footer holds the bounds of its batches, so its batches are held
    until it is full."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder)
        paths: list[str] = []
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            if not held:
                return
            ranges = {
                name: {str(i): b for i, batch in enumerate(held) if (b := bounds_of(batch.column(name)))}
                for name in held[0].schema.names
            }
            path = f"{folder}/{uuid.uuid4().hex}.writing"
            footer = {RANGES: json.dumps(ranges)}
            with system.open_output_stream(path) as file, ipc.new_file(file, held[0].schema, metadata=footer) as sink:
                for batch in held:
                    sink.write_batch(batch)
            paths.append(path)
            held.clear()

        size = 0
        for batch in iterator:
            held.append(batch)
            size += batch.nbytes
            if size >= FILE_BYTES:
                finish()
                size = 0
        finish()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for path in (p for m in messages if m for p in m.paths):
            system.move(path, path.removesuffix("writing") + "arrow")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for path in (p for m in messages if m for p in m.paths):
            system.delete_file(path)


class ArrowStreamReader(DataSourceStreamReader):
    """Files as they arrive. Which files came together is written to a log before the offset that
    stands for them is told, so that after a restart an offset means the same files, and no
    file is read twice or left out, whatever its time or name."""

    def __init__(self, source: ArrowFiles, columns: list[str]):
        self.source, self.columns = source, columns
        self.log = source.options["log"]

    def _logged(self) -> list[str]:
        system, folder = fs.FileSystem.from_uri(self.log)
        system.create_dir(folder)
        found = system.get_file_info(fs.FileSelector(folder))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".json"))

    def _read_log(self, path: str) -> list[tuple[str, int]]:
        system, _ = fs.FileSystem.from_uri(self.log)
        with system.open_input_stream(path) as file:
            return [tuple(entry) for entry in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self, *ignored) -> dict:
        logged = self._logged()
        seen = {path for entry in logged for path, _ in self._read_log(entry)}
        new = [f for f in self.source.files(missing_ok=True) if f[0] not in seen]
        if new:
            system, folder = fs.FileSystem.from_uri(self.log)
            name = f"{folder}/{len(logged):09d}"
            with system.open_output_stream(f"{name}.writing") as file:
                file.write(json.dumps(new).encode())
            system.move(f"{name}.writing", f"{name}.json")
        return {"entries": len(logged) + bool(new)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        entries = self._logged()[start["entries"] : end["entries"]]
        files = [f for entry in entries for f in self._read_log(entry)]
        return ArrowReader(files, self.columns).partitions()

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return ArrowReader([], self.columns).read(partition)

    def commit(self, end: dict) -> None:
        """The log stays: it is what tells new files from old ones."""


class ArrowFiles(DataSource):
    """Options: ``path`` (a folder), ``pattern`` and ``columns`` (comma-separated;
    only these are decoded); for streams ``log``, a folder of the stream's own."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def files(self, missing_ok: bool = False) -> list[tuple[str, int]]:
        """Paths and numbers of tasks, from the listing alone."""
        folder = self.options["path"]
        system, inner = fs.FileSystem.from_uri(folder)
        pattern = self.options.get("pattern", "**/*.arrow")
        # what stands before the path, such as a scheme with its authority
        prefix = "" if system.type_name == "local" else folder.rstrip("/").removesuffix(inner.rstrip("/"))
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        below = lambda f: PurePosixPath(f.path).relative_to(inner)
        files = [f for f in found if f.is_file and below(f).full_match(pattern)]
        if not files and not missing_ok:
            raise FileNotFoundError(f"no {pattern} under {folder}")
        return sorted((prefix + f.path, max(1, -(-f.size // SPLIT_BYTES))) for f in files)

    def schema(self) -> StructType:
        with _open(self.files()[0][0]) as source:
            schema = from_arrow_schema(_reader(source)[0].schema)
        columns = self.options.get("columns")
        return StructType([schema[c] for c in columns.split(",")]) if columns else schema

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.files(), schema.names)

    def streamReader(self, schema: StructType) -> ArrowStreamReader:
        return ArrowStreamReader(self, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        if overwrite:
            raise ValueError("Arrow files are only added; choose an empty folder")
        return ArrowWriter(self.options["path"])


def scan_arrow(
    spark: SparkSession, folder: str, pattern: str = "**/*.arrow", columns: list[str] | None = None
) -> DataFrame:
    """All matching Arrow files below a folder; name the columns to decode only those. Filters reach
    the files, where the bounds of batches are known."""
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("path", folder).option("pattern", pattern)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load()


def write_arrow(df: DataFrame, folder: str) -> None:
    """Add the rows to a folder of Arrow files."""
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format(FORMAT).option("path", folder).mode("append").save()


def stream_arrow(
    spark: SparkSession, folder: str, log: str, schema: StructType | str | None = None, pattern: str = "**/*.arrow"
) -> DataFrame:
    """Matching Arrow files below a folder as they arrive. ``log`` is a shared folder of this
    stream's own, kept as long as its checkpoint; the schema is that of a first file, if not given."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.readStream.format(FORMAT).option("path", folder).option("pattern", pattern).option("log", log)
    return (reader.schema(schema) if schema else reader).load()
