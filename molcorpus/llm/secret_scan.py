"""Secret scan: fixed patterns, then a character convolutional network over every candidate.

The patterns find assignments, access keys and long hex strings. A candidate is any run of
``CANDIDATE`` letters, digits and key signs, or what the patterns leave of one. The network sees
the candidate and the characters around it: one convolution over character classes, its largest
values inside and around the candidate, and one logistic output. A candidate longer than the
network's window is seen by windows that overlap by half; one that none takes for a secret is cut
at its signs, and its parts are judged. Runs of one kind of letters or digits are judged too, but
classes hardly tell a random word from a long one. It is trained on labelled findings of a
bounded sample of documents (``sample`` texts, at most ``findings`` of each group). Secrets are the
pattern matches, and keys of many forms planted between the words of the texts, which no pattern
finds. No secrets are other candidates and plain words of the texts, and planted names, paths,
times and numbers that look a little like keys; candidates that look random have no label, since
they may be what the patterns miss. Half of the findings are shown without what surrounds them, so
that the characters themselves are learned. On a third of the findings, kept apart, the output is
calibrated by a logistic fit, and the threshold is the highest that still finds the share
``recall`` of the pattern matches and of the planted keys there, wherever that lies; ``report``
has the recalls and the precision there.

The method adds spans of kind ``model``; those of the patterns stay. Places are code points, the
end exclusive. Null and empty texts have no finding; with no labelled finding of one kind the
network adds nothing. Every row keeps its row; columns named as the results are replaced, others
stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molcorpus.llm.text import chunks

# The patterns by kind, in their order, and the smallest lengths.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
# a run is found whole, so that its smallest length can be part of the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALNUM = re.compile(r"[A-Za-z0-9]")
TURN = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
PART = re.compile(r"[A-Za-z0-9]{16,}")
BEFORE, INSIDE, AFTER = 16, 40, 12
LENGTH = BEFORE + INSIDE + AFTER
WIDTH, FILTERS, CLASSES = 4, 24, 44
# Groups of findings: pattern matches, candidates and words of the texts, planted keys and names.
GROUPS = MATCHED, SEEN, KEYS, NAMES = (0, 1, 2, 3)

ADDED = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

Span = tuple[int, int, int]  # start, place of the kind, end


def base_spans(text: str) -> list[Span]:
    """All pattern matches by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """All runs, or what the patterns leave of them, that hold a letter or digit."""
    found, first = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while first < len(base) and base[first][2] <= start:
            first += 1
        for s, _, e in base[first:]:
            if s >= end:
                break
            if s > start:
                found.append((start, s))
            start = max(start, e)
        if start < end:
            found.append((start, end))
    return [(a, b) for a, b in found if ALNUM.search(text, a, b)]


def looks_random(run: str) -> bool:
    """Whether letters of one case, of the other and digits take turns at one place in six or more."""
    return 6 * len(TURN.findall(run)) >= len(run)


HEXADECIMAL, DIGITS = "0123456789abcdef", "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
MIXED = SMALL + SMALL.upper() + DIGITS
SYLLABLES = "ta ri mon der ver las in co ser pa lo ne stu ment ing gra fe bau".split()


def planted_key(draw: random.Random) -> str:
    """A key of one of many forms, none of which a pattern finds."""
    letters, least, most = draw.choice([
        (HEXADECIMAL, 16, 31), (HEXADECIMAL.upper(), 16, 31), (MIXED, 16, 40), (MIXED + "+/", 20, 40), (MIXED + "-_", 20, 40),
        (SMALL + DIGITS, 16, 32), (SMALL.upper() + DIGITS, 16, 32),
    ])
    key = "".join(draw.choices(letters, k=draw.randint(least, most)))
    if not ALNUM.search(key) or len(TURN.findall(key)) < 3:
        return planted_key(draw)
    return key + draw.choice(["", "", "", "=", "=="]) if "+/" in letters else key


def planted_name(draw: random.Random) -> str:
    """What looks a little like a key and is none: names with numbers, paths, times, numbers."""

    def word(low: int = 2, high: int = 4) -> str:
        return "".join(draw.choices(SYLLABLES, k=draw.randint(low, high)))

    def number(low: int, high: int) -> str:
        return "".join(draw.choices(DIGITS, k=draw.randint(low, high)))

    found = draw.choice([
        lambda: number(16, 19),
        lambda: "-".join(number(4, 4) for _ in range(4)),
        lambda: f"{word()}{number(2, 6)}_{word()}-{number(1, 5)}_{word()}",
        lambda: f"{word()}_{word()}_{word()}_{number(1, 4)}",
        lambda: f"/{word()}/{word()}/{word()}{number(0, 2)}/{word()}-{number(1, 3)}",
        lambda: f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}-{number(2, 2)}-{number(2, 2)}",
        lambda: word(5, 9),
        lambda: "".join(word(1, 3).capitalize() for _ in range(draw.randint(3, 5))) + number(0, 2),
        lambda: f"{word().upper()}_{word().upper()}_{number(1, 3)}_{word().upper()}",
    ])()
    return found if len(found) >= 16 else f"{found}_{word(4, 6)}-{word()}"


def planted(text: str, piece: str) -> np.ndarray:
    """The window of a piece put between two words in the middle of a text."""
    at = text.find(" ", len(text) // 2)
    at = at if at >= 0 else len(text)
    before = text[max(0, at - BEFORE) : at] + " "
    return window(before + piece + " " + text[at + 1 : at + AFTER], len(before), len(before) + len(piece))


def _codes() -> np.ndarray:
    """Character classes: digits, a-f and other letters by case, single signs, the rest."""
    codes = np.full(128, 1, np.int64)
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            codes[c] = 2
        elif ch in "abcdef":
            codes[c] = 3
        elif ch.islower():
            codes[c] = 4
        elif ch in "ABCDEF":
            codes[c] = 5
        elif ch.isupper():
            codes[c] = 6
        elif ch.isspace():
            codes[c] = 7
        elif c > 32:
            codes[c] = 8 + len([d for d in range(33, c) if not chr(d).isalnum()])
    return codes


CODES = _codes()


def window(text: str, start: int, end: int, at: int | None = None) -> np.ndarray:
    """Classes of the candidate's characters from ``at`` (its first) and of those around it; 0 is
    beyond the text. Inside the candidate classes are shifted by ``CLASSES``."""
    at = start if at is None else at
    out = np.zeros(LENGTH, np.int64)

    def put(place: int, piece: str, shift: int) -> None:
        raw = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        out[place : place + len(raw)] = np.where(raw < 128, CODES[np.minimum(raw, 127)], 1) + shift

    around = text[max(0, start - BEFORE) : start]
    put(BEFORE - len(around), around, 0)
    put(BEFORE, text[at : min(end, at + INSIDE)], CLASSES)
    put(BEFORE + INSIDE, text[end : end + AFTER], 0)
    return out


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows over a candidate begin: each overlaps the next by half at least."""
    last = max(start, end - INSIDE)
    return [*range(start, last, INSIDE // 2), last]


class Network:
    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.conv = draw.normal(0, 0.3, (WIDTH, 2 * CLASSES, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = draw.normal(0, 0.3, 2 * FILTERS + 1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.report: dict[str, float] = {}

    def forward(self, x: np.ndarray):
        n = LENGTH - WIDTH + 1
        values = np.broadcast_to(self.bias, (len(x), n, FILTERS)).copy()
        for w in range(WIDTH):
            values += self.conv[w][x[:, w : w + n]]
        inside = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
        tops, places = [], []
        for part in (values[:, inside], values):
            at = part.argmax(1)
            places.append(at + (BEFORE if part.shape[1] < n else 0))
            tops.append(np.take_along_axis(part, at[:, None], 1)[:, 0])
        hidden = np.concatenate([np.maximum(t, 0) for t in tops], 1)
        return hidden @ self.out[:-1] + self.out[-1], hidden, places

    def probability(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]
        margin = np.concatenate(parts) if parts else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 800, rate: float = 0.01) -> None:
        draw = np.random.default_rng(11)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.conv, self.bias, self.out)]
        good, bad = np.flatnonzero(y), np.flatnonzero(~y)
        for step in range(1, steps + 1):
            rows = np.concatenate([draw.choice(good, 64), draw.choice(bad, 64)])
            part = x[rows]
            bare = draw.random(len(rows)) < 0.5
            part[bare, :BEFORE] = 0
            part[bare, BEFORE + INSIDE :] = 0
            margin, hidden, places = self.forward(part)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            g_out = np.concatenate([error @ hidden, [error.sum()]]) + 1e-4 * self.out
            back = (error[:, None] * self.out[None, :-1]) * (hidden > 0)
            g_conv, g_bias = 1e-4 * self.conv, np.zeros(FILTERS)
            each = np.arange(FILTERS)[None, :]
            for side, at in enumerate(places):
                own = back[:, side * FILTERS : (side + 1) * FILTERS]
                g_bias += own.sum(0)
                for w in range(WIDTH):
                    np.add.at(g_conv[w], (np.take_along_axis(part, at + w, 1), np.broadcast_to(each, at.shape)), own)
            for p, g, (m, v) in zip((self.conv, self.bias, self.out), (g_conv, g_bias, g_out), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, groups: np.ndarray | None = None) -> None:
        """``groups``: kinds of findings; the recall is kept within each kind of secrets."""
        margin = self.forward(x)[0]
        middle, spread = margin.mean(), margin.std() + 1e-9
        unit = (margin - middle) / spread
        # counts of one more keep the fit finite where the labels separate
        target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))

        def loss(fit: np.ndarray) -> float:
            z = fit[0] * unit + fit[1]
            return float((np.logaddexp(0, z) - target * z).sum())

        fit = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(fit[0] * unit + fit[1], -30, 30)))
            w = p * (1 - p)
            g = np.array([((p - target) * unit).sum(), (p - target).sum()])
            h = np.array([[(w * unit**2).sum(), (w * unit).sum()], [(w * unit).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            change = np.linalg.solve(h, g)
            # a whole step may overshoot where the labels separate
            while loss(fit - change) > loss(fit) and np.abs(change).max() > 1e-9:
                change = change / 2
            if np.abs(change).max() <= 1e-9:
                break
            fit = fit - change
        self.scale = float(fit[0] / spread)
        self.shift = float(fit[1] - fit[0] * middle / spread)
        groups = np.zeros(len(y)) if groups is None else groups
        found = self.probability(x)
        kinds = [np.sort(found[y & (groups == g)]) for g in np.unique(groups[y])]
        self.threshold = float(min(k[int(np.floor((1 - recall) * len(k)))] for k in kinds))


def train(docs: DataFrame, key: str, text: str, sample: int, findings: int, recall: float) -> Network | None:
    """A network from the findings of a sample of texts; None without both labels."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    total = docs.count()
    if total > sample:
        draw = F.pmod(F.xxhash64("k", F.lit("findings")), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.filter(draw < sample / total)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            found: list[tuple[int, list[int]]] = []
            for t in part.column("t").to_pylist():
                if not t:
                    continue
                known = base_spans(t)
                for start, kind, end in known:
                    if kind == 0:
                        m = ASSIGN.match(t, start)
                        start = m.start(2)
                    found.append((MATCHED, window(t, start, end).tolist()))
                for start, end in candidates(t, []):
                    if not looks_random(t[start:end]) and not any(s < end and start < e for s, _, e in known):
                        found.append((SEEN, window(t, start, end).tolist()))
                m = re.compile(r"[A-Za-z]{10,}").search(t, len(t) // 2)
                if m:
                    found.append((SEEN, window(t, *m.span()).tolist()))
                draw = random.Random(xxhash.xxh64_intdigest(t))
                found.append((KEYS, planted(t, planted_key(draw)).tolist()))
                found.append((NAMES, planted(t, planted_name(draw)).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["y", "x"]
            )

    seen = rows.mapInArrow(label, "y int, x array<bigint>").distinct()
    order = F.xxhash64("x")
    parts = [seen.filter(F.col("y") == group).orderBy(order, "x").limit(findings).toArrow() for group in GROUPS]
    x = [np.array(p.column("x").to_pylist(), np.int64).reshape(-1, LENGTH) for p in parts]
    # without findings in the texts themselves there is nothing to hold the planted ones against
    if min(len(x[MATCHED]), len(x[SEEN])) < 3:
        return None
    both, group = np.concatenate(x), np.repeat(GROUPS, [len(part) for part in x])
    y = np.isin(group, (MATCHED, KEYS))
    apart = np.concatenate([np.arange(len(part)) % 3 == 2 for part in x])
    network = Network()
    network.train(both[~apart], y[~apart])
    network.calibrate(both[apart], y[apart], recall, group[apart])
    hit = network.probability(both[apart]) >= network.threshold
    rate = lambda mask: float(hit[mask].mean()) if mask.any() else 1.0
    kept = group[apart]
    network.report = {
        "matched recall": rate(kept == MATCHED), "planted recall": rate(kept == KEYS),
        "planted precision": float((kept[hit] == KEYS).sum() / max(1, np.isin(kept[hit], (KEYS, NAMES)).sum())),
        "seen flagged": rate(kept == SEEN),
    }
    return network


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def secret(text: str, found: list[tuple[int, int]], network: Network) -> list[bool]:
    """Whether any window over each candidate is likely a secret."""
    hit, rows, owners = [False] * len(found), [], []

    def judge() -> None:
        if rows:
            for i in np.flatnonzero(network.probability(np.stack(rows)) >= network.threshold):
                hit[owners[i]] = True
        rows.clear()
        owners.clear()

    for i, (start, end) in enumerate(found):
        for at in window_starts(start, end):
            rows.append(window(text, start, end, at))
            owners.append(i)
            if len(rows) == 4096:
                judge()
    judge()
    return hit


def all_spans(text: str, base: list[Span], network: Network | None) -> list[Span]:
    if network is None:
        return base
    free = candidates(text, base)
    hit = secret(text, free, network)
    spans = [c for c, h in zip(free, hit) if h]
    parts = [m.span() for c, h in zip(free, hit) if not h for m in PART.finditer(text, *c) if m.span() != c]
    spans += [c for c, h in zip(parts, secret(text, parts, network)) if h]
    return sorted(base + [(s, 3, e) for s, e in spans])


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000, findings: int = 4_000,
    recall: float = 0.98, redact: str | None = None,
) -> DataFrame:
    """All columns of ``docs``, with n_assign, n_access, n_hex, base_sha256 and spans, which replace
    columns of those names; with ``redact`` instead the same columns, each finding in the text
    replaced by that string."""
    if redact is None:
        if {key, text} & {*ADDED}:
            raise ValueError("the key or text column has the name of a result")
        docs = docs.drop(*ADDED)
    network = train(docs, key, text, sample, findings, recall)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def replaced(t: str, spans: list[Span]) -> str:
        out, done = [], 0
        for start, _, end in spans:
            if end <= done:
                continue
            if start >= done:
                out += [t[done:start], redact]
            done = end
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for part in chunks(batches, text):
            texts = part.column(text).to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            spans = [all_spans(t, b, network) if t else [] for t, b in zip(texts, base)]
            if redact is not None:
                changed = [replaced(t, s) if s else t for t, s in zip(texts, spans)]
                at = part.schema.names.index(text)
                yield part.set_column(at, text, pa.array(changed, pa.string()))
                continue
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(3)]
            digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *counts, digest, pa.array([written(s) for s in spans], pa.string())],
                [*part.schema.names, *ADDED],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if redact is None:
        fields += ", n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.mapInArrow(run, fields)
