"""Ranked lexical search over a length-stratified index.

Documents of equal length normaliser ``m`` are one stratum. In a stratum a
term's score depends on its count ``tf`` alone, so postings are kept by term
and ``tf``, and an impact is computed once for each ``tf``. The highest ``tf``
of each term bounds what a stratum can give to an item; strata are visited by
falling bound, and one whose bound is below an item's k-th score is not visited.

A stratum is stored as blocks of bounded size, one row each: all postings of
its documents. So a score is complete within a task, and no row of item and
document is ever shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findry.llm.common import tidy
from findry.session import materialize

#: Documents and postings of a block, on average.
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 500_000
#: Items and their distinct terms that are searched in one go.
ITEM_BLOCK, TERM_BLOCK = 1024, 200_000
#: Terms that may be sent to the tokenising tasks; beyond it all terms are indexed.
SENT_TERMS = 500_000
#: Blocks visited first for each item.
SEEDS = 2

# a byte of a term in lower case, or a space
_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters, digits and all other characters; A-Z lower-cased.

    In UTF-8 a character beyond ASCII is bytes of 128 and more, so the text is
    cut byte by byte.
    """
    return (text or "").encode().translate(_KEEP).split()


def counted(rows: DataFrame, key: list[str], only: set[bytes] | None = None) -> DataFrame:
    """``key``, ``n`` (all terms with repeats), ``terms`` and ``tfs`` of ``rows`` ``(*key, text)``.

    With ``only``, the other terms count in ``n`` but are not listed.
    """
    sent = None if only is None else rows.sparkSession.sparkContext.broadcast(only)
    names = [*key, "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, ends, terms, tfs = [], [0], [], []
                for text in part.column(len(key)):
                    found = terms_of(text.as_py())
                    sizes.append(len(found))
                    counts = Counter(found)
                    for term in counts if wanted is None else counts.keys() & wanted:
                        terms.append(term)
                        tfs.append(counts[term])
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(key)],
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                    ],
                    names,
                )

    own = ", ".join(f"{c} {kind}" for c, kind in rows.select(*key).dtypes)
    schema = f"{own}, n long, terms array<binary>, tfs array<long>"
    return rows.select(*key, "text").mapInArrow(tidy(run), schema)


@dataclass(frozen=True)
class StrataIndex:
    """Blocks of strata, the documents that hold each term, and collection totals."""

    blocks: DataFrame
    document_counts: DataFrame
    n_docs: int
    n_terms: int


_BLOCK = (
    "m long, block long, doc_ids array<long>, terms array<binary>, term_ends array<int>,"
    " tfs array<long>, tf_ends array<int>, places array<int>"
)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks] or [np.zeros(0, np.int64)])


def _invert(rows: pa.Table) -> pa.Table:
    """The documents of one block as its postings by term and ``tf``."""
    order = pc.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_start")
    rows = rows.take(order)
    lists = rows["terms"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    coded = lists.flatten().dictionary_encode()
    term = coded.indices.to_numpy()
    tf = _flat(rows["tfs"])
    doc = pc.list_parent_indices(lists).to_numpy()
    by = np.lexsort((doc, tf, term))
    term, tf, doc = term[by], tf[by], doc[by]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    groups = np.flatnonzero(first)
    tf_ends = np.append(groups[1:], len(term))[: len(groups)]
    of = term[groups]
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    values = [
        rows["m"][0].as_py(), rows["block"][0].as_py(), rows["doc_id"].to_pylist(),
        coded.dictionary.to_pylist(), np.flatnonzero(last) + 1, tf[groups], tf_ends, doc,
    ]
    kinds = [pa.int64(), pa.int64(), *map(pa.list_, (
        pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()
    ))]
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def build_index(docs: DataFrame, only: DataFrame | None = None) -> StrataIndex:
    """The index of ``docs`` ``(doc_id, text)``; ``only`` ``(term)`` restricts it to those terms.

    Every row is a document of its own, also one that repeats an id or has
    none. Documents without terms are left out, also of the totals. Restricted
    terms are sent to the tasks while there are at most ``SENT_TERMS`` of them;
    beyond that all terms are indexed, which changes no result.
    """
    wanted = None
    if only is not None and only.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        wanted = {bytes(t) for t in only.toArrow().column("term").to_pylist()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(counted(rows, ["doc_id"], wanted).where("n > 0"), "counted-terms")
    totals = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = rows.where(F.size("terms") > 0).withColumn("m", m)
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    strata = rows.groupBy("m").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS)
        ).alias("blocks")
    )
    strata = materialize(strata, "strata")
    # rows are read from a stored table, so that their places are the same in every attempt
    dealt = rows.join(strata, "m").select(
        "m", F.pmod(F.xxhash64("place"), "blocks").alias("block"), "doc_id", "terms", "tfs"
    )
    dealt = dealt.repartitionByRange("m", "block")
    blocks = materialize(dealt.groupBy("m", "block").applyInArrow(_invert, _BLOCK), "strata-blocks")
    ends = F.transform("term_ends", lambda e: F.get("tf_ends", e - 1))
    begins = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    each = blocks.select(
        F.inline(F.arrays_zip("terms", F.zip_with(ends, begins, lambda e, b: e - b).alias("df")))
    )
    df = each.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))
    return StrataIndex(blocks, materialize(df, "document-counts"), n_docs, n_terms)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What a document of a stratum gets for a term, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Items:
    """A bounded block of items: their numbers, terms and weights."""

    def __init__(self, qids: list[int], weights: list[dict[bytes, int]]) -> None:
        self.qids = qids
        self.terms: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, own in enumerate(weights):
            for term, weight in own.items():
                self.terms[term].append((i, weight))

    def __len__(self) -> int:
        return len(self.qids)


class _Block:
    """One stored block, with what it can give to each item at most."""

    def __init__(self, row: dict, items: _Items) -> None:
        self.m, self.row = row["m"].as_py(), row
        self.found = [
            (i, items.terms[t])
            for i, t in enumerate(row["terms"].values.to_pylist())
            if t in items.terms
        ]
        ends = row["term_ends"].values.to_numpy()
        self.begins, self.ends = np.concatenate(([0], ends[:-1])), ends
        self.impacts = impact(row["tfs"].values.to_numpy(), self.m)
        self.bounds = np.zeros(len(items), np.int64)
        for i, users in self.found:
            most = self.impacts[self.ends[i] - 1]  # the highest tf is the last
            for q, weight in users:
                self.bounds[q] += weight * most

    def scores(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document ids in ascending order (null first), and scores by active item."""
        row = self.row
        tf_ends = row["tf_ends"].values.to_numpy()
        places = row["places"].values.to_numpy()
        line = np.cumsum(active) - 1
        out = np.zeros((int(active.sum()), len(row["doc_ids"].values)), np.int64)
        for i, users in self.found:
            users = [(line[q], weight) for q, weight in users if active[q]]
            if users:
                first, last = self.begins[i], self.ends[i]
                start = tf_ends[first - 1] if first else 0
                each = np.diff(tf_ends[first:last], prepend=start)
                value = np.repeat(self.impacts[first:last], each)
                at = places[start : tf_ends[last - 1]]
                for q, weight in users:
                    out[q, at] += weight * value
        return row["doc_ids"].values, out


def _blocks(batches: Iterator[pa.RecordBatch], items: _Items) -> Iterator[list[_Block]]:
    for batch in batches:
        yield [
            _Block({n: batch.column(n)[i] for n in batch.schema.names}, items)
            for i in range(batch.num_rows)
        ]


def _seed_blocks(blocks: DataFrame, items: _Items) -> list[tuple[int, int]]:
    """For each item the blocks ``(m, block)`` of the highest bounds."""
    sent = blocks.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        top: list[list[tuple]] = [[] for _ in range(len(items))]
        for part in _blocks(batches, items):
            for b in part:
                for q in np.flatnonzero(b.bounds):
                    top[q].append((-int(b.bounds[q]), b.m, b.row["block"].as_py()))
            top = [sorted(t)[:SEEDS] for t in top]
        rows = [(q, *x) for q, t in enumerate(top) for x in t]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list("qbmk"))

    narrow = blocks.select("m", "block", "terms", "term_ends", "tfs")
    found = narrow.mapInArrow(tidy(run), "q long, b long, m long, k long")
    best = Window.partitionBy("q").orderBy("b", "m", "k")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SEEDS)
    return [(r["m"], r["k"]) for r in found.select("m", "k").distinct().collect()]


_HITS = "q int, doc_id long, score long"


def _visit(blocks: DataFrame, items: _Items, floors: np.ndarray, k: int) -> DataFrame:
    """``(q, doc_id, score)``: at most ``k`` documents of each item and task.

    ``floors`` are scores that ``k`` documents of an item are known to reach.
    Blocks go by falling bound; an item passes over those below its floor.
    """
    sent = blocks.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = sent.value
        floors = np.maximum(floors, 1)
        ids: list[list] = [[] for _ in range(len(items))]
        best = [np.zeros(0, np.int64) for _ in range(len(items))]
        for part in _blocks(batches, items):
            for b in sorted(part, key=lambda b: -b.bounds.max(initial=0)):
                active = b.bounds >= floors
                if not active.any():
                    continue
                doc_ids, scores = b.scores(active)
                for line, q in enumerate(np.flatnonzero(active)):
                    at = np.flatnonzero(scores[line] >= floors[q])
                    if len(at) > k:
                        # equal scores at the cut: the smaller ids come first in a block
                        at = np.sort(at[np.argsort(-scores[line, at], kind="stable")[:k]])
                    if not len(at):
                        continue
                    ids[q] += doc_ids.take(pa.array(at)).to_pylist()
                    best[q] = np.concatenate((best[q], scores[line, at]))
                    if len(ids[q]) > k:
                        order = sorted(
                            range(len(ids[q])),
                            key=lambda i, q=q: (-best[q][i], ids[q][i] is not None, ids[q][i] or 0),
                        )[:k]
                        ids[q] = [ids[q][i] for i in order]
                        best[q] = best[q][order]
                    if len(ids[q]) == k:
                        floors[q] = max(floors[q], best[q].min())
        n = [len(x) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)),
                pa.array([d for own in ids for d in own], pa.int64()),
                pa.array(np.concatenate([*best, np.zeros(0, np.int64)])),
            ],
            ["q", "doc_id", "score"],
        )

    return blocks.mapInArrow(tidy(run), _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, index: StrataIndex, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item ``(item_id, text)``.

    Scores are above 0; equal ones go by ascending ``doc_id``, null first.
    Rows that repeat item and text are one item; rows that repeat only the id
    are ranked apart, each from 1. An item without terms, or with none that a
    document holds, has no result, and so has every item over an empty index.

    Items go in blocks of bounded size, each sent to all tasks. The blocks of
    strata with the highest bounds are visited first; the k-th score that they
    give rules out most of the others.
    """
    spark = items.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    own = materialize(counted(rows, ["item_id"]).where("n > 0"), "items")
    own = own.withColumn("place", F.monotonically_increasing_id())
    size = own.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("t")).first()
    parts = max(-(-size["n"] // ITEM_BLOCK), -(-(size["t"] or 0) // TERM_BLOCK))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1)))
    each = own.select("place", "item_id", F.inline(F.arrays_zip("terms", "tfs")))
    each = each.join(index.document_counts, F.col("terms") == F.col("term")).select(
        "place", "item_id", "term", (weight * F.col("tfs")).cast("long").alias("weight")
    )
    each = materialize(each, "item-terms")
    for part in range(parts):
        mine = each.where(F.pmod(F.xxhash64("place"), F.lit(parts)) == part).toArrow()
        weights: dict[tuple, dict[bytes, int]] = defaultdict(dict)
        for place, item, term, weight in zip(*(c.to_pylist() for c in mine.columns), strict=True):
            weights[place, item][term] = weight
        block = _Items([item for _, item in weights], list(weights.values()))
        seeds = _seed_blocks(index.blocks, block)
        if not seeds:
            continue
        picked = spark.createDataFrame(seeds, "m long, block long")
        among = index.blocks.where(F.col("m").isin(sorted({m for m, _ in seeds})))
        among = among.join(F.broadcast(picked), ["m", "block"], "left_semi")
        first = _ranked(_visit(among, block, np.zeros(len(block), np.int64), k), k)
        floors = np.zeros(len(block), np.int64)
        for r in first.where(F.col("rank") == k).select("q", "score").collect():
            floors[r["q"]] = r["score"]
        hits = _ranked(_visit(index.blocks, block, floors, k), k)
        names = spark.createDataFrame(list(enumerate(block.qids)), "q int, item_id long")
        out = out.unionByName(hits.join(names, "q").select("item_id", "rank", "doc_id", "score"))
    return out


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` over an index of ``docs`` that holds the items' terms only."""
    terms = counted(items.select("item_id", "text"), ["item_id"])
    only = materialize(terms.select(F.explode("terms").alias("term")).distinct(), "wanted-terms")
    return search(items, build_index(docs, only), k)
