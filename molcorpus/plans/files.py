"""Queries that go through files: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molcorpus.functions.tokenizers import tok_element
from molcorpus.operators import sql_functions
from molcorpus.operators.annotate import annotate
from molcorpus.plans.detection import ANNOTATED_WORDS, SEGMENTS_CTE
from molcorpus.plans.embedding import LABELLED, labelled
from molcorpus.plans.instruction import SCIENCE_CTE, science
from molcorpus.plans.registry import ORACLES, QUERIES, query
from molcorpus.plans.tokenization import SIMPLE_SQL
from molcorpus.plans.vocabulary import chem_vocab
from molcorpus.session import scratch_folder
from molcorpus.sources import files, resumable
from molcorpus.sources.arrow_files import scan_arrow, stream_arrow, write_arrow
from molcorpus.sources.samples import ANNOTATED_SQL, annotated, prose
from molcorpus.streaming import corpus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text, lang FROM documents")
def arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Arrow files; only three columns are decoded again."""
    folder = _folder(spark, "arrow")
    write_arrow(prose(spark, sf_dir), folder)
    return scan_arrow(spark, folder, columns=["doc_id", "text", "lang"])


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 AND doc_id < 900 AND n_chars > 200")
def arrow_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of documents: batches whose bounds lie outside are not decoded."""
    folder = _folder(spark, "arrow")
    write_arrow(documents(spark, sf_dir).select("doc_id", "n_chars").sortWithinPartitions("doc_id"), folder)
    return scan_arrow(spark, folder).filter("doc_id >= 100 AND doc_id < 900 AND n_chars > 200")


@query(f"WITH {LABELLED} SELECT concat('[START_SMILES]', smiles, '[END_SMILES]') AS smiles, label FROM labelled")
def labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "labelled")
    labelled(spark, sf_dir).write.option("header", True).option("escape", '"').csv(folder)
    return files.scan_labelled(spark, folder, "smiles", "label")


@query(
    f"""WITH {SCIENCE_CTE}
    SELECT 'user' AS role, user_text AS content, count(*) AS n FROM science GROUP BY user_text
    UNION ALL SELECT 'assistant', assistant_text, count(*) FROM science GROUP BY assistant_text"""
)
def chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "chat")
    files.write_jsonl(science(spark, sf_dir).select("messages"), folder)
    turns = files.read_jsonl(spark, folder).select(F.explode("messages").alias("m"))
    return turns.groupBy("m.role", "m.content").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{ANNOTATED_WORDS} SELECT a.*, r.text_reannotated, r.reannotated_smiles_count "
    "FROM annotated a JOIN reannotated r USING (doc_id)"
)
def annotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "annotated")
    files.write_annotated(annotate(annotated(spark, sf_dir), "text_raw"), folder)
    return spark.read.parquet(folder)


@query(ORACLES["vocab_first_seen"])
def vocab_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "vocab")
    files.save_vocab(chem_vocab(spark, sf_dir), path)
    return files.load_vocab(spark, path)


@query(ORACLES["fertility_registry"])
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = QUERIES["fertility_registry"](spark, sf_dir)
    path = _folder(spark, "metrics")
    files.write_metrics(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


@query(
    f"""WITH {ANNOTATED_SQL}, {SEGMENTS_CTE}
    SELECT doc_id, seg, smi, array_to_string({SIMPLE_SQL['element']}, ' ') AS tokens FROM segments"""
)
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and their tokens, from a stream over the files of a folder."""
    arriving, done = _folder(spark, "arriving"), _folder(spark, "tokens")
    texts = annotated(spark, sf_dir).select("doc_id", "text_tags")
    texts.write.parquet(arriving)
    stream = corpus.read_files(spark, arriving, texts.schema)
    tokens = corpus.token_stream(stream, "doc_id", "text_tags", tok_element)
    shown = tokens.select(
        "doc_id", F.col("seg").cast("bigint").alias("seg"), "smi", F.array_join("tokens", " ").alias("tokens")
    )
    corpus.write_available(shown, done, _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(done)


@query(f"{ANNOTATED_WORDS} SELECT doc_id, text_reannotated, reannotated_smiles_count FROM reannotated")
def stream_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts tagged on a stream over the files of a folder."""
    arriving, done = _folder(spark, "arriving"), _folder(spark, "tagged")
    texts = annotated(spark, sf_dir).select("doc_id", "text_raw")
    texts.write.parquet(arriving)
    stream = corpus.read_files(spark, arriving, texts.schema)
    tagged = corpus.annotated_stream(stream, "text_raw").drop("text_raw")
    corpus.write_available(tagged, done, _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(done)


@query(ORACLES["stream_annotate"])
def stream_annotate_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts tagged on a stream over arriving Arrow files; half of them arrive after a restart."""
    arriving, done, state, log = (_folder(spark, name) for name in ("arriving", "tagged", "state", "log"))
    texts = annotated(spark, sf_dir).select("doc_id", "text_raw")
    for half in (0, 1):
        write_arrow(texts.filter(F.pmod("doc_id", F.lit(2)) == half), arriving)
        tagged = corpus.annotated_stream(stream_arrow(spark, arriving, log, texts.schema), "text_raw").drop("text_raw")
        corpus.write_available(tagged, done, state).awaitTermination()
    return spark.read.parquet(done)


@query(f"{ANNOTATED_WORDS} SELECT doc_id, text_reannotated FROM reannotated")
def sql_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagging of texts written as SQL text alone."""
    sql_functions.register(spark)
    annotated(spark, sf_dir).createOrReplaceTempView("molcorpus_texts")
    return spark.sql("SELECT doc_id, annotate(text_raw) AS text_reannotated FROM molcorpus_texts")


@query(
    f"""WITH {ANNOTATED_SQL}, {SEGMENTS_CTE}
    SELECT doc_id, seg, len({SIMPLE_SQL['element']}) AS n_tokens FROM segments"""
)
def sql_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of texts and their tokens written as SQL text alone."""
    sql_functions.register(spark)
    annotated(spark, sf_dir).createOrReplaceTempView("molcorpus_texts")
    return spark.sql(
        """SELECT doc_id, CAST(s.seg AS BIGINT) AS seg, CAST(size(tokens_element(s.smiles)) AS BIGINT) AS n_tokens
        FROM molcorpus_texts, LATERAL segments(text_tags) AS s"""
    )


@query(f"{ANNOTATED_WORDS} SELECT doc_id, text_reannotated, reannotated_smiles_count FROM reannotated")
def resumed_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards tagged by a job that stops after some of them and one that does the rest."""
    shards, out = _folder(spark, "shards"), _folder(spark, "tagged")
    annotated(spark, sf_dir).select("doc_id", "text_raw").repartition(6, "doc_id").write.parquet(shards)
    for most in (1, None):
        resumable.project_shards(spark, shards, out, lambda df: annotate(df, "text_raw").drop("text_raw"), 2, most)
    return resumable.read_projected(spark, out)
