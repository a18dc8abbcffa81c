"""Readers and writers for the file formats of the corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molcorpus.operators.extract import wrap_tags

# Column types of the annotated web corpus.
CORPUS_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("text", "id", "dump", "url", "file_path", "language")]
    + [T.StructField("language_score", T.DoubleType()), T.StructField("token_count", T.LongType()),
       T.StructField("score", T.DoubleType()), T.StructField("int_score", T.LongType()),
       T.StructField("chemistry_score", T.DoubleType()), T.StructField("chemistry_id", T.LongType()),
       T.StructField("n_duplicates", T.LongType()), T.StructField("chemicals_positions", T.StringType()),
       T.StructField("n_chemicals", T.LongType()), T.StructField("text_annotated_v1", T.StringType()),
       T.StructField("text_annotated_v1_smiles_count", T.LongType()),
       T.StructField("text_annotated_v1_token_count", T.LongType()),
       T.StructField("text_annotated_v1tags", T.StringType()),
       T.StructField("text_annotated_v1tags_smiles_count", T.LongType())]
)

MESSAGES = "messages array<struct<role: string, content: string>>"
# Entries of the largest vocabulary that is written as one value.
LARGEST_VOCAB = 2_000_000


def scan_parquet(spark: SparkSession, files: list[str]) -> DataFrame:
    """The text column of an explicit list of files."""
    return spark.read.parquet(*files).select("text")


# Words that stand for a missing value in a CSV file.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def scan_labelled(
    spark: SparkSession, path: str, smiles_col: str, label_col: str, multi_line: bool = False, sample: str | None = None
) -> DataFrame:
    """Tagged SMILES and labels of a CSV file. Where that is missing ``sample``, if
    given, is read instead. Fields with line breaks need ``multi_line``, which makes
    each file one task. Words for a missing value are null."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    try:
        table = reader.csv(path)
    except AnalysisException as error:
        if sample is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = reader.csv(sample)
    known = lambda name: F.when(~F.col(name).isin(NULL_WORDS), F.col(name))
    return table.select(wrap_tags(known(smiles_col)).alias("smiles"), known(label_col).alias("label"))


def read_jsonl(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """A line that is no such object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; files appear only when the whole job commits."""
    df.write.mode("overwrite").json(path)


def write_annotated(df: DataFrame, path: str) -> None:
    """All source columns with the re-annotated text and its count."""
    df.write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    """One JSON object ``{token: id}``, in id order. A large vocabulary has one entry a line, and is
    written in parts that follow each other."""
    if vocab.count() > LARGEST_VOCAB:
        return _save_parts(vocab, path)
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("id", "token"))),
        lambda e: F.struct(e["token"].alias("key"), e["id"].alias("value")),
    )
    vocab.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)


def _save_parts(vocab: DataFrame, path: str) -> None:
    """Ranges of ids as parts, whose bytes are then strung together; no part is held in memory."""
    spark = vocab.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    files.delete(folder, True)
    entry = F.to_json(F.map_from_arrays(F.array("token"), F.array("id")))
    ordered = vocab.repartitionByRange("id").sortWithinPartitions("id", "token")
    lines = ordered.select(F.substr(entry, F.lit(2), F.length(entry) - 2).alias("value"))
    lines.write.option("lineSep", ",\n").text(f"{path}/_parts")
    found = [f for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts")) if f.getLen()]
    parts = sorted((f.getPath().getName(), f) for f in found if f.getPath().getName().startswith("part-"))
    waiting = jvm.org.apache.hadoop.fs.Path(f"{path}/_vocab.writing")
    out = files.create(waiting, True)
    out.write(bytearray(b"{"))
    for i, (_, part) in enumerate(parts):
        piece = files.open(part.getPath())
        size = part.getLen() - (2 if i + 1 == len(parts) else 0)  # no comma after the last entry
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.org.apache.commons.io.input.BoundedInputStream(piece, size), out, 1 << 20, False)
        piece.close()
    out.write(bytearray(b"}\n"))
    out.close()
    files.rename(waiting, jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000.txt"))
    files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts"), True)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of a JSON vocabulary file; a broken one is an error. A file with entries on
    lines of their own, as large ones are written, is read in splits."""
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.limit(2).collect()]
    if len(head) == 2 and head[0].startswith('{"') and head[0].endswith(",") and head[1].startswith('"'):
        begins, ends = lines.agg(F.count_if(F.col("value").startswith("{")), F.count_if(F.col("value").endswith("}"))).first()
        if (begins, ends) != (1, 1):
            raise ValueError(f"the vocabulary {path} is cut off")
        inner = F.regexp_replace("value", r"^\{|[,}]$", "")
        whole = lines.select(F.concat(F.lit("{"), inner, F.lit("}")).alias("value"))
    else:
        whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,bigint>", {"mode": "FAILFAST"})
    return whole.select(F.explode(entries).alias("token", "id"))
