"""Connected components of a graph of binary node ids, by stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from findry.session import materialize

_EDGE = "u binary, v binary"


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node to the least of its local component."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            low, high = min(a, b), max(a, b)
            root[high] = low
            root.setdefault(low, low)
    found = [(x, find(x)) for x in list(root)]
    found = [(x, r) for x, r in found if x != r]
    for at in range(0, len(found), 50_000):
        part = found[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in part], pa.binary()), pa.array([r for _, r in part], pa.binary())],
            ["u", "v"],
        )


def stars(links: DataFrame) -> DataFrame:
    """``links`` ``(a, b)`` as edges ``(u, v)``, ``u > v``, with each partition's made stars."""
    edges = links.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    return materialize(edges.mapInArrow(_local_stars, _EDGE), "stars")


def contract(edges: DataFrame) -> tuple[DataFrame, bool]:
    """One round on stored edges ``(u, v)``, ``u > v``: the same components, nearer to stars.

    Large stars: each node hands its larger neighbours to the least one. Small
    stars: each node hands its smaller neighbours to the least one. Also tells
    whether the edges were stars already. The first least neighbours are stored
    before the join, so that adaptive execution can split a node with many
    larger neighbours.
    """
    if edges.isEmpty():
        return edges, True
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least.select("u", F.least("u", "m").alias("m")), "least")
    inner, several = Observation(), Observation()
    large = both.join(least, "u").where("v > u")
    large = large.observe(inner, F.count_if(F.col("m") != F.col("u")).alias("n"))
    large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = materialize(large.mapInArrow(_local_stars, _EDGE), "large-stars")
    # a node has at most one smaller neighbour from each partition by now
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    small = small.observe(several, F.count_if(F.col("v") != F.col("m")).alias("n"))
    small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = small.unionByName(least.withColumnRenamed("m", "v"))
    small = materialize(small.distinct(), "small-stars")
    return small, not inner.get["n"] and not several.get["n"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of the nodes of stored edges ``(u, v)``; ``comp`` is the least node.

    Rounds of :func:`contract` until the edges are stars, logarithmic in the
    number of nodes.
    """
    done = False
    while not done:
        edges, done = contract(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        roots.select("node", F.col("node").alias("comp"))
    )
