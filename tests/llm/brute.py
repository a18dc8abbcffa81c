"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, percent=85):
    """Smallest reachable id of each (id, text)."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d, _ in sets}


def without_repeats(texts, length):
    """n_bytes, n_removed, n_spans, digest of what is left of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def katz(train, texts, factor1, factor2, frequent=1000):
    """log10 probability and base score of texts. factor: discount by count (list from 1)."""
    def listed(t):
        return words(t) + [None]

    one = Counter(w for t in train for w in listed(t))
    total, kinds = sum(one.values()), len(one)
    two = Counter(p for t in train for p in zip(["", *listed(t)[:-1]], listed(t)))
    after, context = defaultdict(list), Counter()
    for (a, b), n in two.items():
        after[a].append((b, n))
        context[a] += n

    def keep(factors, n):
        return factors[n - 1] if n <= len(factors) else 1.0

    alone = {w: keep(factor1, n) * n / (total + 1) for w, n in one.items()}
    unknown = 1 - sum(alone.values())
    kept = {a: int(context[a] > frequent or all(n > len(factor2) for _, n in f)) for a, f in after.items()}

    def pair(a, n):
        return keep(factor2, n) * n / (context[a] + kept[a])

    weight = {
        a: (1 - sum(pair(a, n) for _, n in f)) / (1 - sum(alone[b] for b, _ in f)) for a, f in after.items()
    }
    scores = []
    for t in texts:
        score = base = 0.0
        for a, w in zip(["", *listed(t)[:-1]], listed(t)):
            base += math.log10((one[w] + 0.5) / (total + 0.5 * (kinds + 1)))
            if two[a, w]:
                score += math.log10(pair(a, two[a, w]))
            else:
                score += math.log10(weight.get(a, 1.0)) + math.log10(alone.get(w, unknown))
        scores.append((score, base))
    # every context's distribution, for checking that it sums to one
    sums = {}
    for a, f in after.items():
        seen = {b for b, _ in f}
        rest = unknown + sum(p for w, p in alone.items() if w not in seen)
        sums[a] = sum(pair(a, n) for _, n in f) + weight[a] * rest
    return scores, sums
