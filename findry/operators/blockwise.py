"""Top-k of every query over a large table, without a join that emits all pairs.

Exact search has to score each query against each row. Scores are computed
block by block inside the tasks (one matrix product per Arrow batch) and only
the best k per query leave a task, so the shuffle carries
``queries x k x partitions`` rows however large the table is.

Two physical forms share one kernel:

* a query block within ``bound`` rows and the cell bound (both counted first)
  is broadcast and the table is scanned where it lies, with no shuffle of it;
* more queries: they are stored in chunks of that size, larger ones where
  there would be many, and each chunk is a scan of its own. The table is read
  once per chunk and never shuffled.

Ranking is by rounded score, ties by id, and is exact in both forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from findry.session import materialize

QUERY_BOUND = 2048
ITEM_BLOCK = 65_536
# array elements (vector places, terms) that one block of either side may hold
BLOCK_CELLS = 16_000_000
_SCORE_SCALE = 1e6  # scores are ranked after rounding to six decimals
# scores held at once by one task: query slice x item slice
_QUERY_SLICE = 512
_ITEM_SLICE = 8192
# columns of a group when looking for the best
_GROUP = 64
# scans that the queries are dealt over at most, as long as blocks stay bounded
_SCANS = 64
# scans that one plan holds; the driver keeps that many query blocks
_CHUNKS_PER_PLAN = 8


class Scorer(Protocol):
    """Scores a block of queries against a block of items."""

    query_columns: list[str]  # the first one is an array
    item_columns: list[str]
    array_column: str  # the largest array among the item columns

    def load(self, queries: pd.DataFrame) -> object:
        """Turn the query block into the state the scoring needs."""

    def score(self, state: object, rows: slice, items: pa.Table) -> np.ndarray:
        """Scores of the query rows in ``rows`` x items; NaN means "not a candidate"."""


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long float lists as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # an empty table keeps its chunked form
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _rank_key(scores: np.ndarray) -> np.ndarray:
    rounded = np.rint(scores * _SCORE_SCALE)
    return np.where(np.isnan(rounded), -np.inf, rounded)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best scores per row; earlier columns win ties."""
    n = scores.shape[1]
    key = _rank_key(scores)
    if n <= k:
        return np.argsort(-key, axis=1, kind="stable")
    # everything above the k-th score is in; ties at the k-th fill up in column order
    bar = -np.partition(-key, k - 1, axis=1)[:, k - 1 : k]
    above = key > bar
    room = k - above.sum(axis=1, keepdims=True)
    tied = key == bar
    keep = above | (tied & (np.cumsum(tied, axis=1) <= room))
    cols = np.nonzero(keep)[1].reshape(len(scores), k)
    order = np.argsort(-np.take_along_axis(key, cols, axis=1), axis=1, kind="stable")
    return np.take_along_axis(cols, order, axis=1)


def _candidates(scores: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what may be among the k best; ``kth``: keys that are to be reached.

    The k-th highest of the groups' best is a score that k columns reach, so
    only few scores are looked at twice.
    """
    n, groups = scores.shape[1], scores.shape[1] // _GROUP
    if groups <= k:
        cols = _best(scores, k)
        return np.repeat(np.arange(len(scores)), cols.shape[1]), cols.ravel()
    peaks = scores[:, : groups * _GROUP].reshape(len(scores), groups, _GROUP).max(axis=2)
    if np.isnan(scores[:, groups * _GROUP :]).any() or np.isnan(peaks).any():
        scores = np.where(np.isnan(scores), -np.inf, scores)
        peaks = scores[:, : groups * _GROUP].reshape(len(scores), groups, _GROUP).max(axis=2)
    bar = np.partition(peaks, groups - k, axis=1)[:, groups - k]
    # scores that are equal after rounding differ by less than one step
    bar = np.maximum(bar - 1.5 / _SCORE_SCALE, (kth - 1) / _SCORE_SCALE)
    return np.nonzero(scores >= bar[:, None])


class _Running:
    """The best k items of each query over the batches seen so far."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.id_type = object  # set by the first ids
        self.scores = np.full((n_queries, k), np.nan)
        self.ids = np.empty((n_queries, k), dtype=object)

    def add(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.id_type is object:
            self.id_type = str if isinstance(ids[0], str) else np.int64
        q, c = _candidates(scores, self.k, _rank_key(self.scores[rows]).min(axis=1))
        real = ~np.isnan(scores[q, c])
        q, c = q[real], c[real]
        if not len(q):
            return
        # all that changes is ranked at once, with what these queries had
        changed = np.unique(q)
        kept, kept_ids = self.scores[rows][changed], self.ids[rows][changed]
        old = np.nonzero(~np.isnan(kept))
        line = np.concatenate([changed[old[0]], q])
        score = np.concatenate([kept[old], scores[q, c]])
        pid = np.concatenate([kept_ids[old], ids[c]])
        order = np.lexsort((pid.astype(self.id_type), -_rank_key(score), line))
        line, score, pid = line[order], score[order], pid[order]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(line)) - np.repeat(first, np.diff(first, append=len(line)))
        top = place < self.k
        at = rows.start + line[top], place[top]
        self.scores[at], self.ids[at] = score[top], pid[top]

    def emit(self, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(~np.isnan(self.scores))
        scores = np.rint(self.scores[r, c] * _SCORE_SCALE) / _SCORE_SCALE
        return qids[r], self.ids[r, c], scores


def _slices(n: int, step: int) -> Iterator[slice]:
    for start in range(0, n, step):
        yield slice(start, min(n, start + step))


def _fold(scorer: Scorer, state, n_queries: int, running: _Running, items: pa.Table) -> None:
    if items.num_rows == 0:
        return
    for part in _slices(items.num_rows, _ITEM_SLICE):
        some = items.slice(part.start, part.stop - part.start)
        some = some.take(pc.sort_indices(some["pid"]))  # column order = tie order
        ids = some["pid"].to_numpy().astype(object)
        for rows in _slices(n_queries, _QUERY_SLICE):
            running.add(rows, scorer.score(state, rows, some), ids)


def hit_schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("pid", items.schema["pid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan_hits(
    queries: DataFrame, items: DataFrame, scorer: Scorer, k: int, schema: T.StructType
) -> DataFrame:
    block = queries.toPandas()  # at most the counted bound
    shared = items.sparkSession.sparkContext.broadcast(block)
    arrow = pa.schema(
        [(f.name, arrow_type(f.dataType)) for f in schema.fields]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        state = scorer.load(block)
        running = _Running(len(block), k)
        for batch in batches:
            _fold(scorer, state, len(block), running, pa.Table.from_batches([batch]))
        qids, pids, scores = running.emit(block["qid"].to_numpy(dtype=object))
        if len(qids):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(qids, arrow.field(0).type),
                    pa.array(pids, arrow.field(1).type),
                    pa.array(scores, arrow.field(2).type),
                ],
                schema=arrow,
            )

    return items.mapInArrow(search, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StringType):
        return pa.string()
    if isinstance(t, T.LongType):
        return pa.int64()
    if isinstance(t, T.IntegerType):
        return pa.int32()
    if isinstance(t, T.DoubleType):
        return pa.float64()
    raise TypeError(f"ids must be strings or integers, not {t.simpleString()}")


def _size(df: DataFrame, cells: str) -> tuple[int, int]:
    """Rows, and elements of the array column ``cells``."""
    total = df.agg(F.count("*").alias("n"), F.sum(F.size(cells)).alias("c")).first()
    return total["n"], max(total["c"] or 0, 0)


def fits_broadcast(queries: DataFrame, cells: str, bound: int) -> bool:
    """Whether the query block is small enough to be copied to every task.

    The limit keeps the check from reading a large table to its end.
    """
    n, c = _size(queries.limit(bound + 1), cells)
    return n <= bound and c <= BLOCK_CELLS


def query_chunks(queries: DataFrame, cells: str, bound: int) -> list[DataFrame]:
    """The queries in stored chunks, one for each scan of the items.

    A chunk has about ``bound`` queries. Where that would be more than
    ``_SCANS`` scans, chunks are larger, up to the bound on array elements:
    the cost of reading the items then grows with the items alone.
    """
    rows, elements = _size(queries, cells)
    n = max(1, min(-(-rows // bound), _SCANS), -(-elements // BLOCK_CELLS))
    chunk = F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int")
    stored = materialize(queries.withColumn("_chunk", chunk).repartition("_chunk"), "query-chunks")
    return [stored.where(F.col("_chunk") == c).drop("_chunk") for c in range(n)]


def paired_hits(
    q: DataFrame, i: DataFrame, keys: list[str], scorer: Scorer, k: int, schema: T.StructType
) -> DataFrame:
    """The best k items of each query among the items that share its keys."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pandas()
        running = _Running(len(block), k)
        if len(block):
            _fold(scorer, scorer.load(block), len(block), running, right)
        qids, pids, scores = running.emit(block["qid"].to_numpy(dtype=object))
        return pa.table(
            {
                "qid": pa.array(qids, arrow_type(schema["qid"].dataType)),
                "pid": pa.array(pids, arrow_type(schema["pid"].dataType)),
                "score": pa.array(scores, pa.float64()),
            }
        )

    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInArrow(search, schema)


def top_k(scores: DataFrame, k: int, per: list[str] | None = None) -> DataFrame:
    """The k best rows per query with their rank, by (score desc, pid).

    The rank filter sits right above the window, so Spark cuts each task's
    input to k rows per query before the shuffle.
    """
    w = W.partitionBy(*(per or ["qid"])).orderBy(F.desc("score"), F.asc("pid"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blockwise_topk(
    queries: DataFrame,
    items: DataFrame,
    scorer: Scorer,
    k: int,
    bound: int = QUERY_BOUND,
) -> DataFrame:
    """``(qid, pid, score, rank)``: the k best items of each query.

    ``queries`` has ``qid`` plus the scorer's query columns, ``items`` has
    ``pid`` plus its item columns; other columns are pruned.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = queries.select("qid", *scorer.query_columns)
    items = items.select("pid", *scorer.item_columns)
    schema = hit_schema(queries, items)
    if fits_broadcast(queries, scorer.query_columns[0], bound):
        return _ranked(_scan_hits(queries, items, scorer, k, schema), k)
    return _chunk_by_chunk(queries, items, scorer, k, schema, bound)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, k).select("qid", "pid", "score", "rank")


def _chunk_by_chunk(
    queries: DataFrame, items: DataFrame, scorer: Scorer, k: int, schema: T.StructType, bound: int
) -> DataFrame:
    """Many queries: each bounded chunk of them meets the items where these lie.

    The queries are stored once, dealt to chunks by a hash. A chunk is a
    map-only scan of the items, so the items are never shuffled; a task reads
    the next chunk when it is done with one. Chunks are stored in groups, so
    that plans stay small however many there are.
    """
    chunks = query_chunks(queries, scorer.query_columns[0], bound)
    done = []
    for first in range(0, len(chunks), _CHUNKS_PER_PLAN):
        hits = None
        for mine in chunks[first : first + _CHUNKS_PER_PLAN]:
            found = _scan_hits(mine, items, scorer, k, schema)
            hits = found if hits is None else hits.unionByName(found)
        done.append(_ranked(hits, k))
    if len(done) == 1:
        return done[0]
    stored_hits = [materialize(hits, "chunk-hits") for hits in done]
    out = stored_hits[0]
    for hits in stored_hits[1:]:
        out = out.unionByName(hits)
    return out
