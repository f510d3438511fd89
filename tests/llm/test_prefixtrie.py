"""The prefix trie against a plain Python version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from findry.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract of op13, each node with all its members."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = defaultdict(list)
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seqs[c]) + 1):
            nodes[seqs[c][:d]].append(c)
    children = defaultdict(set)
    for node in nodes:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in members if seqs[c] == node))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
            len(children[node]), sum(not children[n] for n in below),
            sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def ours(df):
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    nodes = prefixtrie.trie_of(df, base=conv - conv % 5, heads=heads, most=8)
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def awkward():
    rng = random.Random(1)
    rows = []
    for c in range(60):
        for turn in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", ""])))
    for c in range(100, 130):  # copies and prefixes of one conversation
        rows += [(c, t, "user", "same ") for t in range(c % 4 + 1)]
    rows += [
        (-7, None, None, None), (-7, None, "user", "tie b"), (-7, None, "user", "tie a"),
        (-7, 3, "user", "x"), (-7, 3, "user", "x"), (None, 1, "user", "lost"), (201, 0, None, "only"),
        (2**62, 5, "tool", "x" * 5000), (300, 1, "a\nb", "c"), (301, 1, "a", "b\nc"),
    ]
    return rows


def test_trie_like_brute_force(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert ours(df) == brute(rows)


@pytest.mark.parametrize("column", ["pos", "_at"])
def test_trie_of_clashing_columns_and_few_rows(spark, column):
    rows = awkward()[:40]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(column, F.create_map(F.lit(1), F.lit("x")))
    assert ours(df) == brute(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ours(none) == []
    assert ours(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_trie_of_a_long_conversation_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN_TURNS", 8)
    monkeypatch.setattr(prefixtrie, "CHUNK_BYTES", 20)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(70)]
    rows += [(6, t, "user", f"t{t % 7}") for t in range(40)] + [(c, 0, "user", "hot") for c in range(10, 90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert ours(df) == brute(rows)
