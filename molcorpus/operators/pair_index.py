"""An index from pairs to the words that hold them, kept up to date by what merges change.

Three tables are written when the index is built: the distinct words with numbers, the postings
(pair, word), and the count of every pair. A round asks the counts for the best pairs, the postings for
their words, and reads no other word but those changed since the index was built. Merges are
applied to these words only; the words they change and the differences of the pair counts are written
beside the tables. Once a share of the words has changed, the index is built anew.

A word is a string of private characters, one a symbol, whose order is the id order.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molcorpus.session import materialize, small_table

# Share of the words that may change before the index is built again.
CHANGED_SHARE = 0.25


def pairs_of(words: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per place of a pair."""
    places = F.sequence(F.lit(1), F.length(text) - 1)
    pairs = F.transform(places, lambda i: F.substr(text, i, F.lit(2)))
    return words.filter(F.length(text) > 1).select(*keep, F.explode(pairs).alias("pair"))


def next_merges(runs: list, bound) -> Iterator[tuple[str, int]]:
    """The next merges, one at a time, as single counting would find them: ties go to the smaller
    pair. ``runs`` (run, n) hold every place of the best pairs and of all that grow from
    them alone; any other pair comes after ``bound``. The caller sends the symbol that takes a
    pair's place."""
    texts, counts, where = [r["run"] for r in runs], Counter(), defaultdict(set)
    for i, text in enumerate(texts):
        for at in range(len(text) - 1):
            counts[text[at : at + 2]] += runs[i]["n"]
            where[text[at : at + 2]].add(i)
    queue = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(queue)
    while queue:
        n, pair = heapq.heappop(queue)
        if counts[pair] != -n or not n:
            continue  # counted again since
        if bound and (n, pair) > (-bound["n"], bound["pair"]):
            return
        fused = yield pair, -n
        touched = set()
        for i in where.pop(pair):
            before, weight = texts[i], runs[i]["n"]
            after = before.replace(pair, fused)
            if after == before:
                continue
            texts[i] = after
            for text, sign in ((before, -weight), (after, weight)):
                for at in range(len(text) - 1):
                    counts[text[at : at + 2]] += sign
                    touched.add(text[at : at + 2])
            for at in range(len(after) - 1):
                where[after[at : at + 2]].add(i)
        for p in touched:
            if counts[p] > 0:
                heapq.heappush(queue, (-counts[p], p))


class PairIndex:
    """``words`` (w, c): distinct words and how often each occurs."""

    def __init__(
        self, words: DataFrame, merge: Callable[[DataFrame, list], DataFrame], runs: Callable[[DataFrame, list[str]], DataFrame],
        pairs_limit: int, runs_limit: int,
    ):
        self.merge, self.runs = merge, runs
        self.pairs_limit, self.runs_limit, self.used = pairs_limit, runs_limit, pairs_limit
        self.read = 0  # words read by all rounds, for measuring
        self.build(words)

    def build(self, words: DataFrame) -> None:
        kept = words.filter(F.length("w") > 1).select("w", "c")
        self.words = materialize(kept.withColumn("id", F.monotonically_increasing_id()))
        placed = pairs_of(self.words, "w", "id", "c")
        # sorted by pair, so that a scan for some pairs skips the rest
        self.postings = materialize(placed.select("pair", "id").distinct().repartitionByRange("pair").sortWithinPartitions("pair"))
        self.counts = materialize(placed.groupBy("pair").agg(F.sum("c").alias("n")))
        self.size, self.n_changed = self.words.count(), 0
        self.changed: DataFrame | None = None  # id, w, c
        self.differences: DataFrame | None = None  # pair, n

    def touched(self, pairs: list[str]) -> DataFrame:
        """The words that hold one of some pairs, and all changed since the index was built."""
        wanted = F.broadcast(small_table(self.words.sparkSession, "pair string", [(p,) for p in pairs]))
        posted = self.postings.filter(F.col("pair").between(min(pairs), max(pairs)))
        ids = posted.join(wanted, "pair", "left_semi").select("id").distinct()
        if self.changed is not None:
            ids = ids.join(self.changed.select("id"), "id", "left_anti")
        found = self.words.join(ids, "id", "left_semi").select("id", "w", "c")
        return found.unionByName(self.changed) if self.changed is not None else found

    def round(self) -> Iterator[tuple[str, int]]:
        """The next merges that are certain."""
        counts = self.counts
        if self.differences is not None:
            counts = counts.unionByName(self.differences).groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")
        top = counts.orderBy(F.desc("n"), "pair").limit(self.pairs_limit + 1).collect()
        self.used = min(2 * self.used, self.pairs_limit)
        if not top:
            return iter(())
        self.found = materialize(self.touched([r["pair"] for r in top[: self.used]]))
        self.read += self.found.count()
        while True:
            runs = self.runs(self.found, [r["pair"] for r in top[: self.used]]).limit(self.runs_limit + 1).collect()
            if len(runs) <= self.runs_limit:
                return next_merges(runs, top[self.used] if len(top) > self.used else None)
            if self.used == 1:  # its merge needs no stretch
                return iter([(top[0]["pair"], top[0]["n"])])
            self.used //= 2

    def apply(self, merges: list[tuple[str, str]]) -> None:
        """Make merges of this round in the words it found."""
        after = self.merge(self.found.withColumn("before", F.col("w")), merges)
        new = materialize(after.filter("w <> before").select("id", "before", "w", "c"))
        lost = pairs_of(new, "before", (-F.col("c")).alias("n"))
        won = pairs_of(new, "w", F.col("c").alias("n"))
        change = lost.unionByName(won)
        if self.differences is not None:
            change = change.unionByName(self.differences.select("n", "pair"))
        self.differences = materialize(change.groupBy("pair").agg(F.sum("n").alias("n")).filter("n <> 0"))
        now = new.select("id", "w", "c")
        if self.changed is not None:
            now = now.unionByName(self.changed.join(new.select("id"), "id", "left_anti"))
        self.changed = materialize(now)
        self.n_changed = self.changed.count()
        if self.n_changed > CHANGED_SHARE * self.size:
            same = self.words.select("id", "w", "c").join(self.changed.select("id"), "id", "left_anti")
            self.build(same.unionByName(self.changed))
