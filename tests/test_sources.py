"""Files in and out, and the projections on a stream."""

import io
import json
import os

import pyarrow as pa
import pytest
from pyarrow import ipc
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from molcorpus.functions.tokenizers import tok_element
from molcorpus.operators.annotate import annotate
from molcorpus.sources import files, shards
from molcorpus.sources.arrow_files import ArrowFiles, ArrowReader, ArrowWriter, scan_arrow, stream_arrow, write_arrow
from molcorpus.sources.arrow_messages import BATCH, SCHEMA, messages
from molcorpus.streaming import corpus


def write_file(path, opener, batches):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opener(path, batches[0].schema) as sink:
        for batch in batches:
            sink.write_batch(batch)


@pytest.fixture
def arrow_folder(tmp_path):
    def batches(start):
        return [
            pa.record_batch({"text": [f"t{start + i + j}" for j in range(3)],
                             "n_chemicals": pa.array([start + i + j for j in range(3)], pa.int64()),
                             "score": [0.5] * 3})
            for i in range(0, 9, 3)
        ]

    write_file(f"{tmp_path}/a/one.arrow", ipc.new_stream, batches(0))
    write_file(f"{tmp_path}/b/two.arrow", ipc.new_file, batches(100))
    (tmp_path / "b" / "notes.txt").write_text("no data")
    return str(tmp_path)


def test_arrow(spark, arrow_folder, monkeypatch):
    df = scan_arrow(spark, arrow_folder)
    assert dict(df.dtypes) == {"text": "string", "n_chemicals": "bigint", "score": "double"}
    got = sorted((r["text"], r["n_chemicals"]) for r in df.collect())
    assert got == sorted((f"t{i}", i) for start in (0, 100) for i in range(start, start + 9))
    some = scan_arrow(spark, arrow_folder, "**/two.arrow", ["n_chemicals"])
    assert some.columns == ["n_chemicals"]
    assert some.agg(F.sum("n_chemicals")).first()[0] == sum(range(100, 109))


@pytest.mark.parametrize("opener", [ipc.new_stream, ipc.new_file])
@pytest.mark.parametrize("parts", [1, 2, 5])
def test_arrow_shares_cover_a_file(tmp_path, opener, parts):
    batches = [pa.record_batch({"a": [i], "b": [str(i)]}) for i in range(9)]
    write_file(f"{tmp_path}/f.arrow", opener, batches)
    reader = ArrowReader([(f"{tmp_path}/f.arrow", parts)], ["b"])
    shares = [list(reader.read(p)) for p in reader.partitions()]
    assert len(shares) == parts
    assert sorted(b["b"][0].as_py() for share in shares for b in share) == [str(i) for i in range(9)]


@pytest.mark.parametrize("parts", [2, 3, 7, 40])
def test_a_stream_is_split_with_its_dictionaries(tmp_path, parts):
    """Every batch is read by one share, with dictionaries that change on the way."""
    schema = pa.schema([("i", pa.int64()), ("word", pa.dictionary(pa.int32(), pa.string()))])
    with ipc.new_stream(f"{tmp_path}/s.arrow", schema) as sink:
        for i in range(20):
            words = pa.array([f"w{i // 6}", "x", None]).dictionary_encode()
            sink.write_batch(pa.record_batch([pa.array([3 * i, 3 * i + 1, 3 * i + 2]), words], schema=schema))
    reader = ArrowReader([(f"{tmp_path}/s.arrow", parts)], ["i", "word"])
    shares = [[row for b in reader.read(p) for row in b.to_pylist()] for p in reader.partitions()]
    want = [{"i": 3 * i + j, "word": w} for i in range(20) for j, w in enumerate([f"w{i // 6}", "x", None])]
    assert [row for share in shares for row in share] == want
    if parts < 20:
        assert sum(map(bool, shares)) > 1


def test_the_heads_of_messages(tmp_path):
    """Sizes and kinds against the library, which reads all of every message."""
    batches = [pa.record_batch({"a": ["x" * (i * 100)], "b": [i]}) for i in range(5)]
    write_file(f"{tmp_path}/s.arrow", ipc.new_stream, batches)
    raw = open(f"{tmp_path}/s.arrow", "rb").read()
    found = list(messages(io.BytesIO(raw), len(raw)))
    assert [m.kind for m in found] == [SCHEMA] + [BATCH] * 5
    source = pa.BufferReader(raw)
    for m in found:
        assert source.tell() == m.start
        ipc.read_message(source)
        assert source.tell() == m.start + m.size


def test_a_stream_that_is_cut_off(spark, tmp_path):
    batches = [pa.record_batch({"a": list(range(1000))}) for _ in range(4)]
    write_file(f"{tmp_path}/s.arrow", ipc.new_stream, batches)
    raw = open(f"{tmp_path}/s.arrow", "rb").read()
    whole = list(messages(io.BytesIO(raw), len(raw)))
    for size in (whole[-1].start + 30, whole[-1].start + 3, len(raw) - 400):
        with open(f"{tmp_path}/s.arrow", "wb") as file:
            file.write(raw[:size])
        reader = ArrowReader([(f"{tmp_path}/s.arrow", 3)], ["a"])
        with pytest.raises(ValueError, match="cut off"):
            [list(reader.read(p)) for p in reader.partitions()]
    # a stream may end without its end mark
    with open(f"{tmp_path}/s.arrow", "wb") as file:
        file.write(raw[: whole[-1].start])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3000


def test_filters_pass_over_batches(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"k{i:03d}", i / 7, "long" * 50) for i in range(100)], "i bigint, s string, x double, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    write_arrow(df.coalesce(1), f"{tmp_path}/f")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (path,) = [f"{tmp_path}/f/{f}" for f in os.listdir(f"{tmp_path}/f") if f.endswith(".arrow")]

    def batches(*filters):
        reader = ArrowReader([(path, 1)], ["i", "s"])
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(1 for p in reader.partitions() for _ in reader.read(p))

    total = batches()
    assert total >= 5
    assert batches(EqualTo(("i",), 42)) == 1 and batches(EqualTo(("i",), 1000)) == 0
    assert batches(GreaterThan(("i",), 89), LessThan(("s",), "k000")) == 0
    assert batches(In(("s",), ("k005", "k099"))) <= 2 and batches(LessThanOrEqual(("x",), 0.0)) == 1
    assert batches(GreaterThanOrEqual(("t",), "zzz")) == total  # no bounds of long strings
    assert batches(EqualTo(("i",), "42")) == total  # another type
    got = scan_arrow(spark, f"{tmp_path}/f").filter("i BETWEEN 20 AND 31 AND s <> 'k025'")
    assert sorted(r["i"] for r in got.select("i").collect()) == [i for i in range(20, 32) if i != 25]


def test_bounds_are_of_files_that_have_them(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan), (2, 5.0), (None, None)], "i bigint, x double").coalesce(1)
    write_arrow(df, f"{tmp_path}/f")
    write_file(f"{tmp_path}/f/plain.arrow", ipc.new_file, [pa.record_batch({"i": [7], "x": [1.0]})])
    assert scan_arrow(spark, f"{tmp_path}/f").filter("x > 100").count() == 1  # Spark puts NaN last
    assert sorted(r["i"] for r in scan_arrow(spark, f"{tmp_path}/f").filter("i >= 2").collect()) == [2, 7]


def test_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("molcorpus.sources.arrow_files.FILE_BYTES", 50)
    writer = ArrowWriter(f"{tmp_path}/f")
    done = writer.write(iter([pa.record_batch({"a": list(range(10))}) for _ in range(3)]))
    writer.commit([done, None])
    assert len(done.paths) == 3 and scan_arrow(spark, f"{tmp_path}/f").count() == 30
    writer.abort([writer.write(iter([pa.record_batch({"a": [1]})]))])
    assert len(os.listdir(f"{tmp_path}/f")) == 3


def test_arriving_arrow_files(spark, tmp_path):
    """Older times and names that come first do not matter; a restart goes on where it stopped."""
    folder, log = f"{tmp_path}/in", f"{tmp_path}/log"

    def arrive(name, start):
        write_file(f"{folder}/{name}.arrow", ipc.new_stream, [pa.record_batch({"i": [start, start + 1]})])
        os.utime(f"{folder}/{name}.arrow", (start, start))

    def work():
        query = corpus.write_available(stream_arrow(spark, folder, log, "i bigint"), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(r["i"] for r in spark.read.schema("i bigint").parquet(f"{tmp_path}/out").collect())

    arrive("m", 500)
    assert work() == [500, 501]
    arrive("a", 100)
    arrive("z", 900)
    assert work() == [100, 101, 500, 501, 900, 901]
    assert work() == [100, 101, 500, 501, 900, 901]


def test_an_offset_means_the_same_files(tmp_path):
    write_file(f"{tmp_path}/in/m.arrow", ipc.new_stream, [pa.record_batch({"i": [1]})])
    options = {"path": f"{tmp_path}/in", "log": f"{tmp_path}/log"}
    reader = ArrowFiles(options).streamReader(StructType.fromDDL("i bigint"))
    assert reader.initialOffset() == {"entries": 0}
    end = reader.latestOffset()
    write_file(f"{tmp_path}/in/a.arrow", ipc.new_stream, [pa.record_batch({"i": [2]})])
    again = ArrowFiles(options).streamReader(StructType.fromDDL("i bigint"))  # after a restart
    assert [p.path.endswith("m.arrow") for p in again.partitions({"entries": 0}, end)] == [True]
    later = again.latestOffset()
    assert [p.path.endswith("a.arrow") for p in again.partitions(end, later)] == [True]
    assert again.latestOffset() == later


def test_arrow_is_added_to(spark, tmp_path):
    for _ in range(2):
        write_arrow(spark.range(5).repartition(2), f"{tmp_path}/f")
    assert scan_arrow(spark, f"{tmp_path}/f").count() == 10
    assert not [p for p in os.listdir(f"{tmp_path}/f") if not p.endswith(".arrow")]


def test_arrow_without_files(spark, tmp_path):
    with pytest.raises(Exception, match="no "):
        scan_arrow(spark, str(tmp_path)).collect()


def test_labelled_csv_and_its_fallback(spark, tmp_path):
    path = tmp_path / "sample_coconut.csv"
    path.write_text('smiles,class,x\nCCO,"a ""b""",1\nC,,2\n')
    rows = files.scan_labelled(spark, str(tmp_path / "coconut.csv"), "smiles", "class", sample=str(path)).collect()
    assert [tuple(r) for r in rows] == [
        ("[START_SMILES]CCO[END_SMILES]", 'a "b"'), ("[START_SMILES]C[END_SMILES]", None),
    ]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.scan_labelled(spark, str(tmp_path / "coconut.csv"), "smiles", "class")


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([([{"role": "user", "content": "hi"}],)], files.MESSAGES)
    files.write_jsonl(df, f"{tmp_path}/chat")
    assert files.read_jsonl(spark, f"{tmp_path}/chat").collect() == df.collect()


def test_vocabulary_file(spark, tmp_path):
    vocab = spark.createDataFrame([("é\"", 1), ("[UNK]", 0), ("C", 2)], "token string, id bigint")
    files.save_vocab(vocab, f"{tmp_path}/v")
    part = next(p for p in os.listdir(f"{tmp_path}/v") if p.startswith("part"))
    with open(f"{tmp_path}/v/{part}", encoding="utf-8") as f:
        assert list(json.load(f).items()) == [("[UNK]", 0), ("é\"", 1), ("C", 2)]
    assert sorted(files.load_vocab(spark, f"{tmp_path}/v").collect()) == sorted(vocab.collect())


def test_vocabulary_file_of_any_size(spark, tmp_path, monkeypatch):
    """Written in parts: one JSON object in id order, with brackets and commas in the tokens."""
    monkeypatch.setattr(files, "LARGEST_VOCAB", 2)
    tokens = ["[UNK]", 'é"', "{", "}", ",", '"}', "a,\n", "\\", ""] + [f"t{i}" for i in range(200)]
    rows = [(t, 3 * i) for i, t in enumerate(tokens)]
    vocab = spark.createDataFrame(rows, "token string, id bigint").repartition(3)
    for _ in range(2):  # an older file is replaced
        files.save_vocab(vocab, f"{tmp_path}/v")
    with open(f"{tmp_path}/v/part-00000.txt", encoding="utf-8") as f:
        assert list(json.load(f).items()) == rows
    assert sorted(files.load_vocab(spark, f"{tmp_path}/v").collect()) == sorted(map(tuple, rows))
    text = open(f"{tmp_path}/v/part-00000.txt", encoding="utf-8").read()
    for broken in (text[:200].rsplit("\n", 1)[0], text[:-40], text.replace('"t7":', '"t7"')):
        with open(f"{tmp_path}/w.json", "w", encoding="utf-8") as f:
            f.write(broken)
        with pytest.raises(Exception):
            files.load_vocab(spark, f"{tmp_path}/w.json").collect()
    with open(f"{tmp_path}/pretty.json", "w", encoding="utf-8") as f:
        json.dump(dict(rows), f, indent=2)
    assert sorted(files.load_vocab(spark, f"{tmp_path}/pretty.json").collect()) == sorted(map(tuple, rows))


def test_corpus_schema_round_trip(spark, tmp_path):
    row = {f.name: None for f in files.CORPUS_SCHEMA} | {"text": "CCO", "text_annotated_v1": "a CCO"}
    df = annotate(spark.createDataFrame([row], files.CORPUS_SCHEMA), "text_annotated_v1")
    files.write_annotated(df, f"{tmp_path}/c")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert len(back.columns) == 22
    assert back.first()["text_reannotated"] == "a [START_SMILES]CCO[END_SMILES]"


def test_shards(spark):
    plan = shards.plan_shards(spark, int(30 * 2.15 * 1024**3 * 4), (0.2, 0.8), "sample/100BT")
    names = [r["file"] for r in plan.orderBy("shard").collect()]
    assert len(names) == 30
    assert names[0] == "sample/100BT/000_00000.parquet" and names[29] == "sample/100BT/002_00009.parquet"
    # Two and a half shards round to two.
    assert shards.plan_shards(spark, int(2.5 * 2**30), (0.5, 0.5), "p", shard_gb=1.0).count() == 2


def test_stream(spark, strings, tmp_path):
    texts = ["We saw CCO.", "plain", "[START_SMILES]CC[END_SMILES] c1ccccc1"]
    folder = f"{tmp_path}/in"
    strings(texts).repartition(3).write.parquet(folder)
    stream = corpus.read_files(spark, folder, "doc_id bigint, s string", files_per_batch=1)
    tagged = corpus.annotated_stream(stream, "s")
    tokens = corpus.token_stream(tagged, "doc_id", "text_reannotated", tok_element)
    windows = corpus.window_stream(tokens, "tokens", 4, 1)
    query = corpus.write_available(windows, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert len(query.recentProgress) >= 1 and query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out")
    rows = sorted((r["doc_id"], r["seg"], r["win"], "".join(r["tokens"])) for r in got.collect())
    assert rows == [
        (0, 0, 0, "CCO"), (2, 0, 0, "CC"), (2, 1, 0, "c1cc"), (2, 1, 1, "cccc"), (2, 1, 2, "c1"),
    ]


def test_patterns_match_paths_below_the_folder(spark, arrow_folder):
    assert scan_arrow(spark, arrow_folder, "b/**/*.arrow").count() == 9
    assert scan_arrow(spark, arrow_folder, "**/*.arrow").count() == 18
    assert scan_arrow(spark, arrow_folder, "*/one.arrow").count() == 9
    with pytest.raises(Exception, match="no train"):
        scan_arrow(spark, arrow_folder, "train/**/*.arrow").count()


def test_written_files_can_be_split(spark, tmp_path):
    write_arrow(spark.range(10).coalesce(1), f"{tmp_path}/out")
    (path,) = [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".arrow")]
    with open(f"{tmp_path}/out/{path}", "rb") as file:
        assert file.read(6) == b"ARROW1"


def test_a_missing_csv_is_an_error_unless_a_sample_is_named(spark, tmp_path):
    (tmp_path / "sample.csv").write_text('s,l\nCCO,a\n"C,C",NA\nNaN,b\nN,None\nO,nan\n')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_labelled(spark, f"{tmp_path}/all.csv", "s", "l")
    rows = files.scan_labelled(spark, f"{tmp_path}/all.csv", "s", "l", sample=f"{tmp_path}/sample.csv").collect()
    assert [r["label"] for r in rows] == ["a", None, "b", None, None]
    assert rows[2]["smiles"] is None and "C,C" in rows[1]["smiles"]


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "chat.jsonl").write_text('{"messages": []}\n{"messages": [\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/chat.jsonl").collect()
    (tmp_path / "vocab.json").write_text('{"C": 4, "N"')
    with pytest.raises(Exception):
        files.load_vocab(spark, f"{tmp_path}/vocab.json").collect()
