"""Ids against the tokenizer library, decoding as an exact round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from molcorpus.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def check(row, text, library):
    ids = library.encode_ordinary(text or "")
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == sha(",".join(map(str, ids)).encode())
    assert row["decoded_sha256"] == sha((text or "").encode())
    if "ids" in row:
        assert row["ids"] == ids


def test_equals_the_library(documents, ranks, library):
    draw = random.Random(2)
    own = ["".join(draw.choices("abcde ééß中\n\t 0123 !?'s\U0001f600\u00a0", k=draw.randint(0, 300))) for _ in range(200)]
    own += ["a" * 5000, " " * 700, "ab" * 900, "supercalifragilistic" * 20, "\n" * 90, "don't we'll I'm", "é" * 200]
    rows = bpe.encode(documents(own), ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(own)
    for r in rows:
        check(r.asDict(), own[r["doc_id"]], library)


def test_awkward_rows(awkward, no_rows, ranks, library):
    rows = bpe.encode(awkward, ranks, public_tokenizers.PATTERN, keep=["text", "score"]).collect()
    assert len(rows) == 12
    for r in rows:
        check(r.asDict(), r["text"], library)
        assert r["score"] == 0.5
    assert bpe.encode(no_rows, ranks, public_tokenizers.PATTERN).collect() == []


def test_higher_order_functions_give_the_same(spark, ranks, library):
    words = ["hello", " there", "Häuser", "ñandú", "zzzzzz", "the", "qwrtz", "\n\n", " 1234567"]
    rows = [(w.encode().decode("latin-1"), w) for w in words]
    df = spark.createDataFrame(rows, "w string, name string")
    for r in df.select("name", bpe.fold_column(F.col("w"), ranks).alias("ids")).collect():
        assert r["ids"] == library.encode_ordinary(r["name"])


def test_single_bytes_are_required(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))
