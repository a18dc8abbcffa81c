"""Document quality by pairwise ranking in the manner of Bradley and Terry.

Each document has a vector of features of its whole text: shares of byte classes, of pairs of
neighbouring classes and of repeated lines and words. Preference pairs of a good and a bad
document train one weight per feature by logistic loss on the difference of their features;
the probability that one document is better than another is the logistic function of the
difference of their scores. The threshold is the score at the quantile of the training scores
that separates the labels best; scores are put on 0 to 1 with the threshold at one half.

Fitted on a bounded sample of labelled rows (``sample``). Null and empty texts have the features
of an empty text; null or repeated ids keep their own row; with no label of one kind every score
is one half. Labels other than 0 and 1 are not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import chunks, split_words

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_CLASSES = 8
UPPER, LOWER, DIGIT, SPACE, LINE, MARK, HIGH, OTHER = range(N_CLASSES)
N_FEATURES = N_CLASSES * N_CLASSES + len(MARKS) + 5


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.int64)
    kinds[65:91], kinds[97:123], kinds[48:58] = UPPER, LOWER, DIGIT
    kinds[[9, 32]], kinds[[10, 13]], kinds[128:] = SPACE, LINE, HIGH
    kinds[list(MARKS)] = MARK
    return kinds


KINDS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts), "")
    flat = np.frombuffer(joined[0].as_buffer(), np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((n, N_FEATURES))
    kinds = KINDS.astype(np.uint8)[flat]
    for i in np.flatnonzero(sizes):
        a, b = start[i], start[i + 1]
        pairs = kinds[a : b - 1] * np.uint8(N_CLASSES) + kinds[a + 1 : b]
        out[i, : N_CLASSES * N_CLASSES] = np.bincount(pairs, minlength=N_CLASSES * N_CLASSES) / sizes[i]
        counts = np.bincount(flat[a:b], minlength=256)
        out[i, N_CLASSES * N_CLASSES : N_CLASSES * N_CLASSES + len(MARKS)] = counts[list(MARKS)] / sizes[i]
    words, ids, distinct = split_words(texts)
    lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(float)[ids] if len(ids) else np.empty(0)
    lines = texts.to_pylist()
    for i in range(n):
        a, b = words[i], words[i + 1]
        if b > a:
            own = lengths[a:b]
            out[i, -5] = len(np.unique(ids[a:b])) / (b - a)
            out[i, -4], out[i, -3] = own.mean() / 10, np.log1p(own.max()) / 10
        if sizes[i]:
            parts = lines[i].split("\n")
            out[i, -2] = len(set(parts)) / len(parts)
        out[i, -1] = np.log1p(sizes[i]) / 10
    # square roots spread small shares
    out[:, :-5] = np.sqrt(out[:, :-5])
    return out


def learn(x: np.ndarray, y: np.ndarray, rivals: int = 8, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4):
    """Centre, scale, weights, threshold and spread of the scores."""
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    n = rivals * max(len(good), len(bad))
    better, worse = draw.choice(good, n), draw.choice(bad, n)
    w = np.zeros(x.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        # a difference of features scores the difference of two scores, so pairs need no features
        scores = z @ w
        lost = 1 / (1 + np.exp(np.clip(scores[better] - scores[worse], -30, 30)))
        pull = np.bincount(better, lost, len(z)) - np.bincount(worse, lost, len(z))
        gradient = -(pull @ z) / n + decay * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    scores = z @ w
    # of all quantiles of the training scores the one with the best balanced accuracy
    cuts = np.quantile(scores, np.linspace(0.002, 0.998, 499))
    accuracy = np.array([(scores[good] >= c).mean() + (scores[bad] < c).mean() for c in cuts])
    best = cuts[accuracy >= accuracy.max() - 1e-12]
    return centre, scale, w, float((best[0] + best[-1]) / 2), float(scores.std() + 1e-9)


def rank_quality(
    docs: DataFrame,
    labelled: DataFrame,
    learn_from: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = 20_000,
    output: str = "score",
) -> DataFrame:
    """Every row of ``docs`` with the column ``output`` (which replaces one of that name): the probability
    that it is better than a document at the threshold. Learns from the rows of ``docs`` that ``learn_from`` marks and that
    ``labelled`` (key, label) has one label for."""
    if docs.schema[key].dataType != labelled.schema[key].dataType:
        labelled = labelled.withColumn(key, F.col(key).cast("string"))
        own = F.col(key).cast("string")
    else:
        own = F.col(key)
    marks = (
        labelled.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"), F.max(label).alias("_high"))
        .filter("_label = _high")
        .orderBy(F.xxhash64("_key"), "_key").limit(sample).select("_key", "_label")
    )
    wanted = docs.filter(learn_from).select(own.alias("_key"), F.col(text).alias("_text"))
    wanted = wanted.join(F.broadcast(marks), "_key").select("_label", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            x = features(part.column("_text"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("_label").cast(pa.int32()), rows], ["y", "x"])

    # a key may be there more than once: the bound holds for rows as well
    trained = wanted.mapInArrow(measure, "y int, x array<double>").limit(2 * sample).toArrow()
    y = trained.column("y").to_numpy()
    model = None
    if len(y) and 0 < y.sum() < len(y):
        x = trained.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
        order = np.lexsort((*x.T[::-1], y))  # the same model whatever the order of rows
        model = learn(x[order], y[order])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            if model is None:
                scores = np.full(part.num_rows, 0.5)
            else:
                centre, scale, w, cut, spread = model
                scores = 1 / (1 + np.exp(-np.clip(2 * (((features(part.column(text)) - centre) / scale) @ w - cut) / spread, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, output])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != output)
    return docs.drop(output).mapInArrow(score, f"{fields}, `{output}` double")
