"""Fingerprints by locally consistent parsing, against a symbol-by-symbol version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findry.llm import phrases

MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def toss(before, symbol):
    if before is None:
        return symbol & 1
    differ = (before ^ symbol) | 1 << 63
    place = (differ & -differ).bit_length() - 1
    return 2 * place + (symbol >> place & 1)


def slow_names(symbols):
    """The phrase names of one text, symbol by symbol."""
    merged, i = [], 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j] == symbols[i]:
            j += 1
        one = symbols[i]
        merged.append(one if j - i == 1 else mix((one ^ (j - i) << 40) * 0x9E3779B97F4A7C15 & MASK))
        i = j
    labels = merged
    for _ in range(4):
        labels = [toss(labels[k - 1] if k else None, labels[k]) for k in range(len(labels))]
    assert set(labels) <= set(range(6))
    blocks = []
    for k, symbol in enumerate(merged):
        inside = 0 < k < len(merged) - 1
        if k == 0 or (inside and labels[k - 1] < labels[k] > labels[k + 1]):
            blocks.append([])
        blocks[-1].append(symbol)
    factor = 0x9E3779B97F4A7C15
    return [
        mix(sum(s * pow(factor, k, 1 << 64) for k, s in enumerate(b)) & MASK ^ len(b) << 56)
        for b in blocks
    ]


def fast_names(texts, level=1):
    x = np.array([ord(c) for t in texts for c in t], np.uint64)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    powers = phrases._Powers()
    for _ in range(level):
        x, starts = phrases.phrase_names(x, starts, powers)
    return [list(map(int, part)) for part in np.split(x, starts[1:])]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = ["".join(random.Random(i).choices("abcdefghiklmnoprstuv", k=2 + i % 8)) for i in range(500)]


def test_phrases_like_symbol_by_symbol():
    rng = random.Random(0)
    texts = ["a", "ab", "aa", "aaaaab", "abab" * 9, "日本語の🙂", "x" * 300, prose(rng, 200), "\n\n \t" * 7]
    expected = [[ord(c) for c in t] for t in texts]
    for level in (1, 2, 3, 4):
        expected = [slow_names(symbols) for symbols in expected]
        assert fast_names(texts, level) == expected


def test_equal_substrings_share_their_inner_phrases():
    rng = random.Random(1)
    passage = prose(rng, 300)
    own = set(fast_names([passage], 3)[0])
    for _ in range(20):
        around = prose(rng, rng.randrange(1, 50)) + passage + prose(rng, 30)
        assert len(own - set(fast_names([around], 3)[0])) <= 6
        assert len(own) > 60


def test_phrases_are_bounded():
    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(5000)) + prose(rng, 3000)
    merged = len([1 for a, b in zip(text, text[1:]) if a != b]) + 1
    assert merged / 6 < len(fast_names([text])[0]) < merged / 2


def test_likeness():
    rng = random.Random(3)
    a, b = prose(rng, 400), prose(rng, 400)
    moved = prose(rng, 7) + a
    one, two, three, empty = phrases.fingerprints([a, b, moved, ""])
    assert phrases.likeness(one, one) == 1.0 and phrases.likeness("", "") == 1.0
    assert phrases.likeness(one, two) < 0.1 and phrases.likeness(one, empty) == 0.0
    assert phrases.likeness(one, three) > 0.8
    assert phrases.fingerprints([b, a, a])[1:] == [one, one]  # neighbours in a slice do not matter


SCHEMA = "doc_id long, text string, h string"


def awkward():
    rng = random.Random(4)
    docs = [(3 * i, prose(rng, rng.choice([1, 2, 10, 100, 600]))) for i in range(80)]
    docs += [(3 * i + 1, docs[i][1]) for i in range(10)]  # copies follow
    docs += [(None, "no id"), (-5, None), (-4, ""), (500, "x"), (501, "é🙂" * 50), (502, prose(rng, 30_000))]
    docs += [(600, f"same id {i} " * 5) for i in range(40)] + [(601, "twice"), (601, "twice")]
    return docs


@pytest.mark.parametrize("slice_chars", [10, 500_000])
def test_documents_in_order(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(phrases, "SLICE_CHARS", slice_chars)
    docs = awkward()
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(5)
    order = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = order.withColumn("k", F.xxhash64("text")).collect()
    order = sorted(order, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["k"]))
    expected = []
    for i, r in enumerate(order):
        following = order[(i + 1) % len(order)]["text"]
        text = r["text"]
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + following[:quarter]
        a, b, c = phrases.fingerprints([text, changed, following])
        expected.append((
            r["doc_id"], len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b,
            phrases.likeness(a, b), phrases.likeness(a, c),
        ))
    found = [tuple(r) for r in phrases.fingerprint_documents(df).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "one two three", "")], SCHEMA)
    row = phrases.fingerprint_documents(one).first()
    changed = "one two three"[:10] + "one"
    assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    assert row["near_next"] == 1.0
    assert phrases.fingerprint_documents(one.limit(0)).collect() == []


def test_edited_texts_are_nearer_than_the_next(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars >= 100")
    rows = phrases.fingerprint_documents(docs).collect()
    near = sorted(r["near_edited"] for r in rows)
    assert near[len(near) // 20] > 0.35
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)
