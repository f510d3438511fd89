"""The prefix trie of conversations, by collapsing whole sequences.

Equal conversations become one weighted sequence with the list of those that
end there. A sequence that is a proper prefix of another one is no leaf; an
anti-join tells. Every sequence then gives its weight, its leaf and its bytes to
its prefixes, and the prefixes are added up: one row per node.

A prefix of ``d`` turns is named by ``d`` and 128 bits: the exclusive or of a
hash of each turn salted with its position. So names come out of running
aggregates, texts are hashed once where they lie, and no sequence is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findry.llm.common import hash_pair, tidy
from findry.operators.indexing import index_within
from findry.session import materialize

#: Turns of one run; a longer conversation is summed up run by run.
RUN_TURNS = 4096
#: Code points of a text that order turns which tie.
TIE_CHARS = 64
#: Bytes of joined ids in one row.
CHUNK_BYTES = 32_768

_NODE = ["depth", "a", "b"]


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, a, b, bytes)``: each conversation's turns, numbered from 0.

    Turns go by ``turn`` (null first); equal ones by role, by the first
    ``TIE_CHARS`` code points of the text, then by hash. ``a`` and ``b`` hash
    role and text, of which null counts as empty; ``bytes`` is the length of
    the text in UTF-8. Rows without ``conv_id`` are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b = hash_pair(role, text)
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("head"),
        a.alias("a"),
        b.alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = index_within(turns, "conv_id", ["turn", "role", "head", "a", "b"], "pos")
    return placed.select("conv_id", "pos", "a", "b", "bytes")


def rebuild(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with another one's first turns: ``(conversations, turns)``.

    ``turns`` is stored and numbered. A conversation gets the first ``heads``
    (at most ``most``) turns of conversation ``base``, all if there are fewer
    and none if it is absent, then its own turns after its first ``heads``.
    Both columns are expressions over ``conv_id``. ``conversations`` holds
    ``(conv_id, length)``, also of those left without turns.
    """
    turn = F.struct("pos", "a", "b", "bytes")
    first = F.array_sort(F.collect_list(F.when(F.col("pos") < most, turn)))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"), first.alias("first"))
    own = materialize(
        own.select("conv_id", "n", "first", base.alias("base"), heads.alias("heads")), "conversations"
    )
    opening = own.select(F.col("conv_id").alias("base"), F.col("first").alias("opening"))
    taken = F.filter("opening", lambda t: t["pos"] < F.col("heads"))
    plan = own.join(opening, "base", "left").select(
        "conv_id", "n", "heads", F.coalesce(taken, F.slice("first", 1, 0)).alias("opening")
    )
    plan = materialize(plan.withColumn("shift", F.size("opening") - F.col("heads")), "openings")
    length = F.size("opening") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))
    tail = turns.join(plan.select("conv_id", "heads", "shift"), "conv_id").where("pos >= heads")
    tail = tail.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "a", "b", "bytes")
    head = plan.select("conv_id", F.inline("opening"))
    return plan.select("conv_id", length.cast("long").alias("length")), head.unionByName(tail)


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, a, b, pa, pb, bytes, before)`` of turns ``(conv_id, pos, a, b, bytes)``.

    The node of the first ``depth`` turns and of the turns before, the bytes of
    the last text and of all texts before it. A conversation longer than
    ``RUN_TURNS`` is cut into runs, which many tasks sum up; their totals are
    added afterwards.
    """
    salted = (F.xxhash64(F.lit(seed), "pos", "a", "b") for seed in (1, 2))
    run = F.floor(F.col("pos") / RUN_TURNS)
    rows = turns.select("conv_id", "pos", run.alias("run"), "bytes", *(
        h.alias(c) for h, c in zip(salted, "xy", strict=True)
    ))
    along = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = materialize(
        rows.select(
            "conv_id", "run", "bytes", "x", "y",
            (F.col("pos") + 1).alias("depth"),
            F.bit_xor("x").over(along).alias("a"),
            F.bit_xor("y").over(along).alias("b"),
            (F.sum("bytes").over(along) - F.col("bytes")).alias("before"),
        ),
        "runs",
    )
    long = rows.where("run > 0").select("conv_id").distinct()
    totals = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "run").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("n")
    )
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "conv_id",
        "run",
        F.bit_xor("x").over(earlier).alias("ox"),
        F.bit_xor("y").over(earlier).alias("oy"),
        F.sum("n").over(earlier).alias("on"),
    )
    offsets = materialize(offsets.where("run > 0"), "run-offsets")
    more = rows.where("run > 0").join(offsets, ["conv_id", "run"]).withColumns(
        {
            "a": F.col("a").bitwiseXOR(F.col("ox")),
            "b": F.col("b").bitwiseXOR(F.col("oy")),
            "before": F.col("before") + F.col("on"),
        }
    )
    names = ["conv_id", "depth", "a", "b", "x", "y", "bytes", "before"]
    both = rows.where("run = 0").select(*names).unionByName(more.select(*names))
    return both.select(
        "conv_id", "depth", "a", "b",
        F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"),
        "bytes", "before",
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(depth, a, b, conv_id)`` as ``(depth, a, b, first, ids)``, ids joined by commas."""
    node, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        names = [*_NODE, "first", "ids"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )

    for batch in batches:
        for *own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (own != node or size >= CHUNK_BYTES):
                out.append((*node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = own, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield rows()
            out.clear()
    if ids:
        out.append((*node, first, ",".join(ids)))
        yield rows()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks as one digest per node; only the digest's state is held."""
    node, state = None, None
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_NODE, "ends_sha256"]
        )

    for batch in batches:
        for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield rows()
            out.clear()
    if node is not None:
        out.append((*node, state.hexdigest()))
        yield rows()


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)``: the digest of each node's own conversations.

    The ids of one node are sorted and joined by many tasks; SHA-256 itself
    runs over them in order, so one task reads a node's joined ids as a stream.
    """
    order = [*_NODE, "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    node = ", ".join(f"{c} long" for c in _NODE)
    chunks = rows.mapInArrow(tidy(_chunks), f"{node}, first long, ids string")
    order[-1] = "first"
    chunks = chunks.repartition(*_NODE).sortWithinPartitions(*order).drop("first")
    return chunks.mapInArrow(tidy(_digests), f"{node}, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``conversations`` holds ``(conv_id, length)``, each id once; ``turns`` holds
    ``(conv_id, pos, a, b, bytes)`` of each, numbered from 0. The result has
    ``conv_id`` (the smallest of those that start with the prefix), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (bytes that the subtree's texts would take
    beyond their first copy) and ``ends_sha256``. Without conversations there
    is no node.

    A node's smallest conversation owns it. The nodes that one conversation
    owns are one stretch down to its end, so the distinct bytes below a node
    add up from one number per sequence, and no node meets all its ancestors.
    """
    rows = materialize(prefixes(turns), "prefixes")
    last = conversations.join(
        rows.select("conv_id", F.col("depth").alias("length"), "a", "b",
                    (F.col("before") + F.col("bytes")).alias("total")),
        ["conv_id", "length"], "left",
    )
    zero = F.lit(0).cast("long")
    ends = materialize(
        last.select("conv_id", F.col("length").alias("depth"), *(
            F.coalesce(c, zero).alias(c) for c in ("a", "b", "total")
        )),
        "ends",
    )
    # whole-sequence collapse: the least conversation stands for all that are equal
    whole = ends.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("weight"),
        F.first("total").alias("total"),
    )
    whole = materialize(whole, "sequences")
    own = rows.join(whole.select("conv_id", F.col("depth").alias("end")), "conv_id")
    root = whole.select(
        "conv_id", *(zero.alias(c) for c in _NODE),
        *(F.lit(None).cast("long").alias(c) for c in ("pa", "pb")),
        zero.alias("bytes"), zero.alias("before"), F.col("depth").alias("end"),
    )
    own = materialize(own.unionByName(root), "sequence-prefixes")
    inner = own.where("depth < end").select(*_NODE).distinct()
    leaves = whole.join(inner, _NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owners = own.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.first("before").alias("b0"))
    stretch = owners.groupBy(F.col("owner").alias("conv_id")).agg(F.min("b0").alias("own_from"))
    sequences = whole.select("conv_id", "weight", "total").join(leaves, "conv_id", "left")
    sequences = materialize(sequences.join(stretch, "conv_id", "left"), "weighted-sequences")
    each = own.join(sequences, "conv_id")
    # all bytes from here on, less those that the sequence owns: the first copies
    below = F.col("weight") * (F.col("total") - F.col("before"))
    first = F.col("total") - F.greatest("before", "own_from")
    saved = below - F.when(F.col("own_from").isNull(), 0).otherwise(first)
    nodes = each.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.first("pa").alias("pa"),
        F.first("pb").alias("pb"),
        F.sum("weight").alias("n_convs"),
        F.count("leaf").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    nodes = materialize(nodes, "nodes")
    above = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(above, F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = children.agg(F.count("*").alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    out = nodes.join(children, _NODE, "left").join(end_digests(ends), _NODE, "left")
    out = out.join(parents, ["depth", "pa", "pb"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie_of(rows: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """:func:`prefix_nodes` of rebuilt conversations ``(conv_id, turn, role, text)``.

    Repeated rows are repeated turns; other columns are not read.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    turns = materialize(ordered_turns(rows), "turns")
    conversations, turns = rebuild(turns, base, heads, most)
    return prefix_nodes(conversations, turns)
