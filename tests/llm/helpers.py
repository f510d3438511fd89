"""Small tables with every awkward case, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def components(docs):
    """Smallest reachable id by brute force over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def awkward(seed=0, n=60):
    """Documents: near and exact copies, shared lines, nulls, empties, a long text, ties."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "straße", "日本", "it's", "x,"]
    docs = []

    def add(text, lang="en", source="a"):
        docs.append((len(docs), text, lang, source, len(text or "")))

    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        add(" ".join(w) + "\nShared Line \n" + " ".join(w[:4]), source=f"s{i % 3}")
        if i % 4 == 0:  # near copies at many similarities
            for _ in range(3):
                v = list(w)
                for _ in range(rng.randrange(1, 4)):
                    v[rng.randrange(len(v))] = rng.choice(vocabulary)
                add(" ".join(v) + "\nShared Line \n" + " ".join(w[:4]), source="s0")
        if i % 5 == 0:
            add(docs[-1][1])
            add("  " + docs[-1][1].replace(" ", "\t"))
    for text in (None, "", "", " \n\t ", "\n", "one", "ONE", "one two", "12 34 ...", "🙂", None):
        add(text, lang=None, source=None)
    add(" ".join(rng.choice(vocabulary) for _ in range(30_000)), source="s1")
    add("x" * 20_000 + " " + "ab" * 5_000, source="s1")
    return docs
