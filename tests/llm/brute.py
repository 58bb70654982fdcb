"""Plain Python versions of what the operators compute, with nothing of theirs."""

import math
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def weighted_shingles(texts):
    """Per text a dict from shingle to weight, by exact document frequencies."""
    counts = []
    for t in texts:
        w = words(t)
        counts.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(g for c in counts for g in c)
    n = len(texts)
    return [{g: k * (1 + math.log((n + 1) / (df[g] + 1)) / math.log(n + 1)) for g, k in c.items()} for c in counts]


def similar_pairs(texts, threshold=0.8):
    """Pairs (i < j) of texts at the threshold, equal texts among them."""
    vectors = weighted_shingles(texts)
    total = [sum(v.values()) for v in vectors]
    holders = defaultdict(list)
    for i, v in enumerate(vectors):
        for g in v:
            holders[g].append(i)
    pairs = set()
    for i, v in enumerate(vectors):
        shared = Counter()
        for g, w in v.items():
            for j in holders[g]:
                if j < i:
                    shared[j] += min(w, vectors[j][g])
        pairs |= {(j, i) for j, s in shared.items() if s >= (threshold - 1e-9) * (total[i] + total[j] - s)}
    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[t or ""].append(i)
    return pairs | {(group[0], i) for group in same.values() for i in group[1:]}


def classes(n, pairs):
    """The least member of each one's class."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]
