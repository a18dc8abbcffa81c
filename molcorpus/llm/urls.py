"""URL filter: fixed rules, then logistic regression on hashed character n-grams.

``judge_urls`` cuts every url into host and path, gives the longest rule that fits, and asks
the model where none does. The model is fitted on a small table of labelled urls, a parameter; the
built-in one is made of ordinary words of unwanted and other sites. Every host
and path n-gram is hashed into one vector of weights. Null urls and urls without ``://`` have
an empty host and path and no n-gram: the model's intercept decides. Repeated rows keep their
own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import mix

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)

# The rules, as verdict, host and start of the path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

# Words of the small labelled url table: of unwanted sites, of others, and of both.
UNWANTED = """
    casino poker slots bets betting jackpot pills pharmacy viagra meds spam malware phishing ads adserver
    tracking tracker clickbait adult porn xxx escort warez crack
""".split()
WANTED = """
    university library museum school college hospital science history garden cooking travel weather
    sports music theatre nature forest river mountain bakery village council journal archive
""".split()
EITHER = "online best free win farm cheap world hub plus shop zone first".split()
LETTERS = "aaabcddeeeefghhiiiklllmnnnnooopqrrrrssstttttuuvwwyz"


def labelled_urls(unwanted: Sequence[str] = UNWANTED, wanted: Sequence[str] = WANTED) -> list[tuple[str, int]]:
    """Urls of sites named with these words, 1 for unwanted ones; of invented names, which say
    nothing and are wanted; with paths that say nothing either."""
    found: list[tuple[str, int]] = []
    for label, words in ((1, unwanted), (0, wanted)):
        for i, word in enumerate(words):
            other = EITHER[i % len(EITHER)]
            for name in (word, f"{word}-{other}", f"{other}-{word}", f"{other}{word}"):
                found.append((name, label))
    draw = np.random.default_rng(5)
    found += [("".join(draw.choice(list(LETTERS), draw.integers(4, 11))), 0) for _ in range(12 * len(wanted))]
    places, ends = ["www.", "", "m.", "blog."], ["/en/{}", "/es/{}.html", "/{}/", "/fr/{}", "/de/{}", "/{}"]
    return [
        (f"https://{places[i % 4]}{name}.example.{'org' if i % 3 else 'com'}{ends[i % 6].format(7 * i % 997)}", label)
        for i, (name, label) in enumerate(found)
    ]


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest fitting rule; null if none fits."""
    chosen = F
    for verdict, site, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        rule = F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = chosen.when(fits, rule)
    return chosen.otherwise(F.lit(None))


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram. A site's parts are marked, so that hosts and paths
    have n-grams of their own."""
    texts = [f"\x02{h}\x03{p}\x04".encode() for h, p in zip(hosts, paths)]
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    in_path = place > np.array([len(h.encode()) for h in hosts], np.int64)[row]
    found = []
    for n in GRAMS:
        if len(flat) < n:
            continue
        last = len(flat) - n + 1
        key = np.full(last, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(257) + flat[i : i + last]
        same = row[:last] == row[n - 1 :]
        key = mix(key * np.uint64(2) + in_path[:last].astype(np.uint64)) % np.uint64(BUCKETS)
        found.append((row[:last][same], key[same].astype(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([r for r, _ in found]), np.concatenate([k for _, k in found])


def margins(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    rows, keys = features(hosts, paths)
    counts = np.bincount(rows, minlength=len(hosts))
    sums = np.bincount(rows, weights[keys], minlength=len(hosts))
    return sums / np.sqrt(np.maximum(counts, 1)) + bias


def fit(labelled: Sequence[tuple[str, int]], rounds: int = 1000, rate: float = 0.5, decay: float = 1e-3):
    """Weights and intercept by gradient descent over the whole small table."""
    from urllib.parse import urlsplit

    parts = [urlsplit(url) for url, _ in labelled]
    hosts, paths = [p.netloc.lower() for p in parts], [p.path for p in parts]
    target = np.array([label for _, label in labelled], float)
    rows, keys = features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(hosts)), 1))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        margin = np.bincount(rows, weights[keys], minlength=len(hosts)) * scale + bias
        error = 1 / (1 + np.exp(-margin)) - target
        weights -= rate * (np.bincount(keys, (error * scale)[rows], minlength=BUCKETS) + decay * weights)
        bias -= rate * error.mean()
    return weights.astype(np.float32), float(bias)


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] | DataFrame | None = None,
    most: int = 10_000,
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, and the model's probability that the
    site is unwanted. Without a rule a page is blocked from a probability of one half on.
    ``labelled`` are urls with labels, as a list or a table (url, label) of which ``most`` are used;
    without them the built-in ones."""
    if isinstance(labelled, DataFrame):
        known = labelled.select(F.col("url"), F.col("label").cast("int")).filter("url IS NOT NULL AND label IN (0, 1)")
        labelled = [tuple(r) for r in known.orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()]
    weights, bias = fit(labelled_urls() if labelled is None else labelled)
    ruled = (
        pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
        .withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
        .select(key, "host", "path", "ruled.rule", "ruled.verdict")
    )
    kind = ruled.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            if not hosts:
                continue
            probability = 1 / (1 + np.exp(-margins(weights, bias, hosts, paths)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(probability, pa.float64())], [*batch.schema.names, "probability"]
            )

    schema = f"`{key}` {kind}, host string, path string, rule string, verdict string, probability double"
    return ruled.mapInArrow(score, schema).withColumn(
        "verdict",
        F.coalesce("verdict", F.when(F.col("probability") >= 0.5, "block").otherwise("allow")),
    )
