"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every tree of the forest is one order of the signatures: documents sorted by a
label of several signature values. Documents next to each other in that order
share the longest prefixes with each other, so a crowded region is compared at
a great depth and a sparse one at a small depth. Neighbours become candidates,
candidates are confirmed on the full shingle sets, and confirmed links make
components. Where more rows share a prefix than neighbours reach, those still
in different components are compared in whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findry.llm.common import WordHashes, mix64, tidy, words_of
from findry.llm.components import components, contract, stars
from findry.session import materialize

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 75
TREES, SPAN, DEPTH, LEAST = 20, 5, 8, 3
N_VALUES = TREES * SPAN
#: Rows on either side that are neighbours.
REACH = 6

_FACTORS = mix64(np.arange(1, N_VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | (
    np.uint64(1)
)
_PLACES = (np.arange(TREES)[:, None] * SPAN + np.arange(DEPTH)) % N_VALUES


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; no word, no shingle."""
    words = hashes(words_of(text))
    n = min(len(words), SHINGLE)
    if not n:
        return words
    width = len(words) - n + 1
    rolled = np.full(width, n, np.uint64)
    for i in range(n):
        rolled = mix64(rolled * np.uint64(0x2545F4914F6CDD1D) + words[i : i + width])
    return np.unique(rolled)


def node_of(grams: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set."""
    return xxhash.xxh128_digest(grams.tobytes())


def signature(grams: np.ndarray) -> bytes:
    """``N_VALUES`` MinHash values, 16 bits of each, big-endian."""
    least = np.full(N_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        part = grams[at : at + 1024, None] * _FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    return (mix64(least) >> np.uint64(48)).astype(">u2").tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, nodes, signatures = [], [], []
        for text in batch.column(1):
            grams = shingles(text.as_py() or "", hashes)
            sizes.append(len(grams))
            nodes.append(node_of(grams) if len(grams) else None)
            signatures.append(signature(grams) if len(grams) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
             pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "node", "signature"],
        )


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tree and node."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            values = np.frombuffer(b"".join(part.column(2).to_pylist()), ">u2")
            labels = values.reshape(-1, N_VALUES)[:, _PLACES].tobytes()
            width = 2 * DEPTH
            n = part.num_rows
            rows = np.repeat(np.arange(n), TREES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                    pa.array([labels[i : i + width] for i in range(0, len(labels), width)]),
                    part.column(0).take(pa.array(rows)),
                    part.column(1).take(pa.array(rows)),
                ],
                ["tree", "label", "node", "n_shingles"],
            )


def _similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values two rows of labels share."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near rows of one sorted partition, and the rows at its two ends.

    Ends have no ``b``; they meet the neighbouring partition's ends elsewhere.
    """
    names = ["tree", "label", "a", "n_shingles", "b", "depth"]
    tail: pa.RecordBatch | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([tail, batch] if tail else [batch]).combine_chunks()
        old = tail.num_rows if tail else 0
        trees = rows.column(0).to_numpy()
        sizes = rows.column(3).to_numpy()
        labels = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
        nodes = rows.column(2).to_pylist()
        left, right, depth = [], [], []
        for step in range(1, min(REACH, len(nodes) - 1) + 1):
            shared = _prefix(labels[:-step], labels[step:])
            near = (shared >= LEAST) & (trees[:-step] == trees[step:])
            near &= _similar_sizes(sizes[:-step], sizes[step:])
            near[: max(0, old - step)] = False  # both rows were there before
            at = np.flatnonzero(near)
            left += at.tolist()
            right += (at + step).tolist()
            depth += shared[at].tolist()
        if left:
            none = pa.nulls(len(left), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [none, pa.nulls(len(left), pa.binary()),
                 pa.array([nodes[i] for i in left], pa.binary()), pa.nulls(len(left), pa.int64()),
                 pa.array([nodes[i] for i in right], pa.binary()), pa.array(depth, pa.int32())],
                names,
            )
        if first:
            yield _ends(batch.slice(0, REACH), names)
            first = False
        tail = rows.slice(max(0, rows.num_rows - REACH)).to_batches()[0]
    if tail:
        yield _ends(tail, names)


def _ends(rows: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names
    )


def _tie(node: str) -> Column:
    """Orders rows of equal labels, in every tree otherwise."""
    return F.xxhash64("tree", node)


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """``(a, b, score)``: neighbours in some tree; the score adds up shared depths.

    ``classes`` holds ``(node, n_shingles, signature)``, one row per distinct
    set. Orders are range partitioned by the whole label, so a region of any
    size is spread over many tasks.
    """
    order = ["tree", "label", _tie("node"), "node"]
    rows = classes.select("node", "n_shingles", "signature").mapInArrow(
        tidy(_labels), "tree int, label binary, node binary, n_shingles long"
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "tree int, label binary, a binary, n_shingles long, b binary, depth int"
    found = materialize(rows.mapInArrow(tidy(_neighbours), schema), "neighbours")
    pairs = found.where("b is not null").select("a", "b", "depth")
    # a few rows per partition: pairs that lie across its borders
    ends = found.where("b is null").select("tree", "label", "a", "n_shingles").distinct()
    along = Window.partitionBy("tree").orderBy("label", _tie("a"), "a")
    row = F.struct("label", F.col("a").alias("b"), F.col("n_shingles").alias("m"))
    after = F.array(*(F.lead(row, step).over(along) for step in range(1, REACH + 1)))
    near = ends.withColumn("after", after).select(
        "label", "a", "n_shingles", F.inline(F.filter("after", lambda x: x.isNotNull()))
    )
    near = near.toDF("label", "a", "n", "other", "b", "m")
    same = (
        F.substring("label", 1, 2 * d) == F.substring("other", 1, 2 * d)
        for d in range(1, DEPTH + 1)
    )
    depth = sum((x.cast("int") for x in same), F.lit(0))
    sizes = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    near = near.withColumn("depth", depth).where(sizes & (F.col("depth") >= LEAST))
    pairs = pairs.unionByName(near.select("a", "b", "depth"))
    both = pairs.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "depth"
    )
    return both.groupBy("a", "b").agg(F.sum("depth").alias("score"))


#: Bits of the filter that picks the documents whose sets are read again: 4 MB.
_FILTER_BITS = 1 << 25


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash. Of fixed size: at most ``_FILTER_BITS / 64`` rows are collected."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("w"), (bit % 64).cast("int").alias("i"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("m"))
    out = np.zeros(_FILTER_BITS // 64, np.int64)
    found = words.toArrow()
    out[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, grams)`` of the documents whose id is in ``wanted``, and perhaps of a few more.

    The texts stay where they are: a filter of fixed size goes to them. Once
    the wanted ids outgrow it more documents pass, and none is lost.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter_words(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            places = batch.column(0).to_numpy()
            passed = (bits.value[places >> 6] >> (places & 63)) & 1
            nodes, sets, size = [], [], 0
            for i in np.flatnonzero(passed):
                grams = shingles(batch.column(1)[int(i)].as_py() or "", hashes)
                if len(grams):
                    nodes.append(node_of(grams))
                    sets.append(grams.astype("<u8").tobytes())
                    size += len(sets[-1])
                if size > 8 << 20:
                    yield _sets(nodes, sets)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield _sets(nodes, sets)

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS)).alias("bit")
    return docs.select(bit, "text").mapInArrow(tidy(run), "node binary, grams binary")


def _sets(nodes: list[bytes], sets: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "grams"]
    )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x = np.frombuffer(x.as_buffer(), "<u8")
            y = np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        part = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        yield part


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs`` ``(a, b)``."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(tidy(_confirm), "a binary, b binary")


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with the roots ``ca`` and ``cb`` of their ends, where these differ.

    ``roots`` holds ``(node, comp)``; a node without row is its own root.
    """
    a = roots.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = roots.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    joined = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    root_a, root_b = F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")
    return joined.select("a", "b", root_a, root_b).where("ca != cb")


def link_nodes(pairs: DataFrame, sets: DataFrame, first: int = 3) -> DataFrame:
    """``(node, comp)`` of the nodes that have links among ``pairs``.

    First each node's ``first`` best pairs are confirmed and contracted, which
    joins most copies; then every other pair whose ends may still be apart. A
    pair within a component cannot change the result, so no link is lost.
    """
    ends = pairs.select("a", "b", "score", F.explode(F.array("a", "b")).alias("node"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "a", "b")
    picked = ends.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    picked = materialize(picked.select("a", "b").distinct(), "best-pairs")
    links = materialize(confirm(picked, sets), "links")
    edges, _ = contract(stars(links))
    # nodes with one least neighbour are connected
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    rest = pairs.select("a", "b").join(picked, ["a", "b"], "left_anti")
    rest = materialize(_crossing(rest, roots).select("a", "b"), "crossing")
    more = materialize(confirm(rest, sets), "links")
    return materialize(components(edges.unionByName(stars(more))), "components")


def crowded_rows(classes: DataFrame) -> DataFrame:
    """``(run, node)`` of the runs that share ``LEAST`` values and outgrow ``REACH``.

    In any shorter run all rows are neighbours of each other.
    """
    labels = F.array(
        *(F.substring("signature", 2 * SPAN * t + 1, 2 * LEAST) for t in range(TREES))
    )
    rows = classes.select("node", F.posexplode(labels).alias("tree", "label"))
    rows = rows.select(F.xxhash64("tree", "label").alias("run"), "node")
    runs = rows.groupBy("run").count().where(F.col("count") > REACH + 1)
    runs = materialize(runs.select("run"), "crowded-runs")
    return materialize(rows.join(runs, "run"), "crowded-rows")


#: Rows and shingles of a block on the two sides of a comparison, on average.
_LEFT, _RIGHT, _BLOCK_GRAMS = 512, 1024, 300_000
#: Shingles that more rows of two blocks share are counted by a matrix product.
_COMMON = 64


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many elements the sets of ``x`` share with those of ``y``, for slices of ``x``."""
    n = np.array([len(g) for g in [*x, *y]], np.int64)
    code = np.unique(np.concatenate([*x, *y]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(n)), n)
    common = np.bincount(code) > _COMMON
    column = np.cumsum(common) - 1
    many = common[code]
    dense = np.zeros((len(n), int(common.sum())), np.float32)
    dense[row[many], column[code[many]]] = 1
    # postings of the others on the right, in the order of their codes
    right = ~many & (row >= len(x))
    order = np.argsort(code[right], kind="stable")
    holders = row[right][order] - len(x)
    start = np.concatenate(([0], np.cumsum(np.bincount(code[right], minlength=len(common)))))
    for first in range(0, len(x), 128):
        last = min(first + 128, len(x))
        both = (dense[first:last] @ dense[len(x) :].T).astype(np.int64)
        left = ~many & (row >= first) & (row < last)
        own, length = code[left], start[code[left] + 1] - start[code[left]]
        at = np.repeat(start[own] - np.cumsum(length) + length, length) + np.arange(length.sum())
        cell = np.repeat(row[left] - first, length) * len(y) + holders[at]
        both += np.bincount(cell, minlength=both.size).reshape(both.shape)
        yield first, both


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """The components that links between two blocks join, as edges to the least of each group."""
    sides = []
    for side in (left, right):
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in side.column("grams")]
        sides.append((sets, side.column("comp").to_pylist()))
    (x, of_x), (y, of_y) = sides
    names = sorted({*of_x, *of_y})
    at = {name: i for i, name in enumerate(names)}
    of_x, of_y = (np.array([at[c] for c in of], np.int64) for of in (of_x, of_y))
    low = np.arange(len(names))
    if x and y:
        n_x, n_y = (np.array([len(g) for g in sets], np.int64) for sets in (x, y))
        pairs = []
        for first, both in _shared(x, y):
            whole = n_x[first : first + len(both), None] + n_y - both
            i, j = np.nonzero(100 * both >= PERCENT * whole)
            pairs.append(np.unique(of_x[i + first] * len(names) + of_y[j]))
        a, b = np.divmod(np.unique(np.concatenate(pairs)), len(names))
        while (low[a] != low[b]).any():
            least = np.minimum(low[a], low[b])
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(names)))
    return pa.table({
        "a": pa.array([names[i] for i in moved], pa.binary()),
        "b": pa.array([names[i] for i in low[moved]], pa.binary()),
    })


def join_crowded(
    comps: DataFrame, crowded: DataFrame, classes: DataFrame, sets: DataFrame
) -> DataFrame:
    """``comps`` after every pair of a crowded run whose ends are apart has been compared.

    The largest component of a run is its head. Rows of the run outside the
    head are compared with all of the head and with each other, on full sets,
    in blocks of bounded size; pairs within a component cannot change the
    result. A head that several runs share is visited once.
    """
    own = crowded.join(comps, "node", "left").select(
        "run", "node", F.coalesce("comp", "node").alias("comp")
    )
    own = materialize(own, "crowded-comps")
    heads = own.groupBy("run", "comp").count().groupBy("run").agg(
        F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("n")
    )
    heads = heads.where("n > 1").select("run", F.col("top.comp").alias("head"))
    heads = materialize(heads, "crowded-heads")
    apart = own.join(heads, "run").where("comp != head").select("head", "node", "comp")
    apart = materialize(apart.distinct(), "crowded-apart")
    if apart.isEmpty():
        return comps
    head = apart.select("head").distinct()
    inside = comps.join(head, F.col("comp") == F.col("head")).select("head", "node", "comp")
    alone = head.select("head", F.col("head").alias("node"), F.col("head").alias("comp"))
    everyone = apart.unionByName(inside).unionByName(alone).distinct()
    size = classes.select("node", "n_shingles")

    def blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
        by_rows = F.ceil(F.count("*") / most)
        by_grams = F.ceil(F.sum("n_shingles") / _BLOCK_GRAMS)
        sized = rows.join(size, "node").groupBy("head")
        return sized.agg(F.greatest(by_rows, by_grams).cast("int").alias(name))

    everyone = materialize(everyone, "crowded-members")
    plan = blocks(apart, _LEFT, "n_left").join(blocks(everyone, _RIGHT, "n_right"), "head")
    plan = materialize(plan, "crowded-blocks")

    def dealt(rows: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        rows = rows.join(plan, "head")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("node"), mine).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
        rows = rows.join(sets, "node")
        return rows.select(*(F.col(c).alias(c) for c in ("head", "i", "j", "comp", "grams")))

    left = dealt(apart, "i", "n_left", "j", "n_right").groupBy("head", "i", "j")
    right = dealt(everyone, "j", "n_right", "i", "n_left").groupBy("head", "i", "j")
    found = stars(left.cogroup(right).applyInArrow(_compare, "a binary, b binary"))
    if found.isEmpty():
        return comps
    known = comps.where("node != comp").select(F.col("node").alias("u"), F.col("comp").alias("v"))
    return materialize(components(known.unionByName(found)), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row per row of ``docs``.

    A text's words are parted by white space, A-Z in lower case; its set holds
    its distinct shingles of five words, or its words as one shingle if they
    are fewer. A text without words (or null) has no shingle and no link.
    Documents are linked from a Jaccard similarity of 75 % on; confirmed on
    whole sets. ``component_id`` is the smallest doc_id that links lead to, its
    own at least; null ids do not count unless there is no other. ``kept``:
    the two are equal. Rows that repeat an id and a text are one document.

    Equal sets are one node, whatever their number, so a large group of copies
    costs nothing beyond its fingerprints. A pair at 75 % meets in at least one
    of the orders, at the least depth, with probability 0.9999; all pairs that
    do are decided, by neighbours or, in crowded runs, by :func:`join_crowded`.
    """
    own = docs.select("doc_id", "text")
    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("node", "binary")
    prints = own.mapInArrow(tidy(_fingerprints), schema.add("signature", "binary"))
    prints = materialize(prints, "prints")
    classes = prints.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
    )
    classes = materialize(classes, "classes")
    pairs = materialize(candidate_pairs(classes), "pairs")
    crowded = crowded_rows(classes)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    ends = ends.unionByName(crowded.select("node")).distinct()
    wanted = materialize(classes.join(ends, "node", "left_semi").select("doc_id", "node"), "wanted")
    # copies may pass the filter too; one set of each wanted node is enough
    sets = shingle_sets(own, wanted.select("doc_id")).join(
        wanted.select("node"), "node", "left_semi"
    )
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    comps = join_crowded(link_nodes(pairs, sets), crowded, classes, sets)
    linked = classes.select("node", "doc_id").join(comps, "node")
    least = linked.groupBy("comp").agg(F.min("doc_id").alias("low"))
    named = materialize(least, "component-ids")
    known = comps.join(named, "comp").select("node", "low")
    table = classes.select("node", "doc_id").join(known, "node", "left")
    table = materialize(
        table.select("node", F.coalesce("low", "doc_id").alias("component_id")), "node-components"
    )
    return (
        prints.select("doc_id", "n_shingles", "node")
        .join(table, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest id of each group of near copies.

    Rows that share an id stay together; of those that agree in every column
    one stays.
    """
    kept = near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__id"))
    kept = materialize(kept.agg(F.count("*").alias("__rows")), "kept-ids")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    joined = docs.join(kept.hint("shuffle_hash"), same)
    single = joined.where("__rows = 1").select(*docs.columns)
    return single.unionByName(joined.where("__rows > 1").select(*docs.columns).distinct())
