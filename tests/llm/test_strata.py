"""Ranked search over strata against a plain Python version of the contract."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from findry.llm import strata

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x for _, _, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        uses = Counter(terms(text))
        found = []
        for d, c, length in counts:
            m = 25 + (75 * length * n) // total
            score = sum(
                u * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, u in uses.items() if t in c
            )
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(found[:k])]
    return sorted(out, key=repr)


def awkward():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "é", "日本語", "A1", "common"]
    docs = []
    for i in range(150):
        n = rng.choice([1, 2, 5, 5, 30, 90])
        sep = rng.choice([" ", "-", "\n", "\x7f", "_"])
        docs.append((i, sep.join(rng.choice(vocabulary) for _ in range(n)) + " Common"))
    docs += [(i, "w1 w2 w3 tie") for i in range(300, 330)] + [(7, "w5 w6"), (7, "w5 w6"), (None, "w1 tie")]
    docs += [(400, None), (401, ""), (402, " ,. "), (403, "w7 " * 20_000), (None, None)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12])))) for i in range(20)]
    items += [(50, "tie TIE w1"), (50, "tie TIE w1"), (51, None), (52, "!?"), (53, "absent"), (54, "common"),
              (55, "w7 w7 w7"), (50, "é"), (None, "w3 w4")]
    return docs, items


def ours(spark, docs, items, **extra):
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    i = spark.createDataFrame(items, ITEMS)
    for name in ("n", "terms", "m", "block"):
        d, i = d.withColumn(name, F.lit("x")), i.withColumn(name, F.lit("x"))
    found = strata.search_documents(d, i, **extra).collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_search_like_brute_force(spark):
    docs, items = awkward()
    assert ours(spark, docs, items) == brute(docs, items)


def test_search_in_small_blocks_of_all_terms(spark, monkeypatch):
    for name, value in (("BLOCK_DOCS", 3), ("ITEM_BLOCK", 9), ("SENT_TERMS", 2)):
        monkeypatch.setattr(strata, name, value)
    docs, items = awkward()
    assert ours(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_terms_like_the_pattern():
    text = "".join(map(chr, range(0x250))) + "日本 𝔘x İ ſ ß"
    assert [t.decode() for t in strata.terms_of(text)] == terms(text)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_search_of_nothing(spark, docs, items):
    assert ours(spark, docs, items) == []


def test_bounds_hold_and_rule_out_blocks(spark):
    docs, items = awkward()
    index = strata.build_index(spark.createDataFrame(docs, DOCS))
    wanted = [{t.encode(): 7 * u for t, u in Counter(terms(text)).items()} for _, text in items]
    block = strata._Items(list(range(len(items))), wanted)
    parts = index.blocks.toArrow().to_batches()
    blocks = [b for part in strata._blocks(iter(parts), block) for b in part]
    best = [0] * len(items)
    for b in blocks:
        for q, scores in enumerate(b.scores(b.bounds >= 0)[1]):
            assert scores.max(initial=0) <= b.bounds[q]
            best[q] = max(best[q], scores.max(initial=0))
    passed_over = sum(b.bounds[q] < best[q] for b in blocks for q in range(len(items)))
    assert passed_over > len(blocks) * len(items) / 4
