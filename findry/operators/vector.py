"""Vector search: exact, cell-partitioned (IVF), product-quantised, rerank.

An index is a parquet table plus a small table of centroids or codebooks, so
it can be appended to, pruned by partition and read by any Spark job.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from findry.functions.vectors import NORM_FLOOR, dot
from findry.operators.blockwise import (
    BLOCK_CELLS,
    ITEM_BLOCK,
    QUERY_BOUND,
    blockwise_topk,
    hit_schema,
    paired_hits,
    top_k,
    vectors_of,
)
from findry.operators.joins import salted_join
from findry.session import materialize
from findry.sources.writers import spread_cells

# training a codebook needs some tens of points per centroid, not the whole table
_PARALLEL_FITS = 4
_ROWS_PER_FILE = 250_000
# blocks of a cell's queries and rows that are kept apart for the sake of more tasks
_CELL_BLOCKS = (8, 4)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR)


def _matrix(block: pd.DataFrame, column: str) -> np.ndarray:
    if not len(block):
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in block[column]])


@dataclass(frozen=True)
class DotScorer:
    """Inner product, or cosine when both sides are scaled to unit length."""

    cosine: bool = False
    query_columns = ["embedding"]
    item_columns = ["embedding"]
    array_column = "embedding"

    def load(self, queries: pd.DataFrame) -> np.ndarray:
        m = _matrix(queries, "embedding")
        return _unit(m) if self.cosine else m

    def score(self, state: np.ndarray, rows: slice, items: pa.Table) -> np.ndarray:
        m = vectors_of(items["embedding"])
        return state[rows] @ (_unit(m) if self.cosine else m).T


def knn_join(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str = "dot",
    bound: int = QUERY_BOUND,
) -> DataFrame:
    """Exact k nearest items of each query by inner product or cosine.

    ``queries(qid, embedding)`` x ``items(pid, embedding)``. Query batching is
    implied: up to ``bound`` queries share one scan of the items, more take a
    scan for each chunk of them. The items are never shuffled.
    """
    if metric not in ("dot", "cos"):
        raise ValueError("metric must be 'dot' or 'cos'")
    return blockwise_topk(queries, items, DotScorer(metric == "cos"), k, bound)


def fetch_vectors(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows of the given ids."""
    return items.join(ids.select("pid").distinct(), "pid", "left_semi")


def rerank(previous: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Rank the earlier hits of each query by a new query vector.

    ``previous(qid, pid)`` are the earlier hits and ``queries(qid, embedding)``
    the new questions. Only the pairs already found are scored.
    """
    pairs = previous.select("qid", "pid").distinct()
    scored = (
        salted_join(pairs, items.select("pid", "embedding"), "pid", "qid")
        .join(queries.select("qid", F.col("embedding").alias("_q")), "qid")
        .select("qid", "pid", F.round(dot(F.col("_q"), F.col("embedding")), 6).alias("score"))
    )
    return top_k(scored, k).select("qid", "pid", "score", "rank")


def _kmeans(train: DataFrame, vector, k: int, seed: int, rounds: int) -> np.ndarray:
    points = train.select(array_to_vector(vector).alias("v"))
    points.persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="v").fit(points)
        return np.array(model.clusterCenters())
    finally:
        points.unpersist()


def _centroid_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster_id int, centroid array<double>")


@dataclass(frozen=True)
class IvfIndex:
    """Vectors with the cell they fall in, and the cell centroids."""

    rows: DataFrame
    centroids: DataFrame

    def centers(self) -> np.ndarray:
        """The centroid matrix (nlist rows, fixed at build time)."""
        found = self.centroids.orderBy("cluster_id").collect()
        return np.array([r["centroid"] for r in found])


def _nearest_cell(centers: np.ndarray):
    """Cell assignment by Euclidean distance, as in the training."""
    norms = (centers**2).sum(axis=1)

    @F.pandas_udf("int")
    def assign(embeddings: pd.Series) -> pd.Series:
        m = _matrix(embeddings.to_frame("embedding"), "embedding")
        if not len(m):
            return pd.Series([], dtype="int32")
        return pd.Series((norms - 2.0 * (m @ centers.T)).argmin(axis=1).astype("int32"))

    return assign


def assign_cells(items: DataFrame, centers: np.ndarray) -> DataFrame:
    """Add the nearest cell of each vector."""
    return items.withColumn("cluster_id", _nearest_cell(centers)("embedding"))


def build_ivf(items: DataFrame, nlist: int = 1024, seed: int = 42, rounds: int = 10) -> IvfIndex:
    """Cut the vector space into ``nlist`` cells and assign every row to one."""
    centers = _kmeans(items, F.col("embedding"), nlist, seed, rounds)
    return IvfIndex(assign_cells(items, centers), _centroid_frame(items.sparkSession, centers))


def probe_cells(queries: DataFrame, centers: np.ndarray, nprobe: int) -> DataFrame:
    """The ``nprobe`` cells of highest inner product for each query."""

    @F.pandas_udf("array<int>")
    def probe(embeddings: pd.Series) -> pd.Series:
        m = _matrix(embeddings.to_frame("embedding"), "embedding")
        if not len(m):
            return pd.Series([], dtype=object)
        order = np.argsort(-(m @ centers.T), axis=1, kind="stable")[:, :nprobe]
        return pd.Series([row.astype("int32") for row in order])

    return queries.select("qid", "embedding", probe("embedding").alias("cells"))


def cell_pairs(
    probed: DataFrame, rows: DataFrame, bound: int, item_block: int
) -> tuple[DataFrame, DataFrame]:
    """Queries ``(qid, embedding, cells)`` and rows by ``(cluster_id, _qb, _ib)``.

    A query goes to the cells it probes and to no other. Cells are cut into
    blocks of ``item_block`` rows, their queries into blocks of ``bound``, so
    a crowded or much probed cell is dealt over many tasks. Each side is
    copied once for each block of the other: a cell has no more than
    ``_CELL_BLOCKS`` of them while a block's array elements stay bounded.
    """
    asked = probed.select("qid", "embedding", F.explode("cells").alias("cluster_id"))

    def blocks(side: DataFrame, size: int, most: int, name: str) -> DataFrame:
        n, elements = F.count("*"), F.sum(F.size("embedding").cast("long"))
        wanted = F.least(F.ceil(n / size), F.lit(most).cast("long"))
        least = F.ceil(elements / BLOCK_CELLS)
        return side.groupBy("cluster_id").agg(F.greatest(wanted, least).alias(name))

    n_q = blocks(asked, bound, _CELL_BLOCKS[0], "_n_q")
    n_i = blocks(rows, item_block, _CELL_BLOCKS[1], "_n_i")
    # one row per cell, so the broadcast is bounded by nlist
    sizes = F.broadcast(n_q.join(n_i, "cluster_id"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    q = asked.join(sizes, "cluster_id").select(
        "qid", "embedding", "cluster_id",
        F.pmod(F.xxhash64("qid"), "_n_q").alias("_qb"), every("_n_i").alias("_ib"),
    )
    i = rows.select("pid", "embedding", "cluster_id").join(sizes, "cluster_id").select(
        "pid", "embedding", "cluster_id",
        F.pmod(F.xxhash64("pid"), "_n_i").alias("_ib"), every("_n_q").alias("_qb"),
    )
    return q, i


def ivf_search(
    queries: DataFrame,
    index: IvfIndex,
    k: int = 5,
    nprobe: int = 16,
    bound: int = QUERY_BOUND,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Approximate top-k: a join of queries and rows by cell.

    Only the rows of the ``nprobe`` best cells of a query are scored with it.
    The probed cells are stored, and a table written by :func:`save_ivf` is
    pruned by them while it runs: no list of cells goes through the driver.
    ``bound`` queries meet ``item_block`` rows of a cell in a task.
    """
    probed = materialize(probe_cells(queries, index.centers(), nprobe), "probed")
    cells = probed.select(F.explode("cells").alias("cluster_id")).distinct()
    # a table of cells, so bounded by nlist; the filter makes it a reason to prune
    cells = materialize(cells, "probed-cells").where("cluster_id >= 0")
    rows = index.rows.join(F.broadcast(cells), "cluster_id", "left_semi")
    q, i = cell_pairs(probed, rows, bound, item_block)
    schema = hit_schema(queries, rows)
    hits = paired_hits(q, i, ["cluster_id", "_qb", "_ib"], DotScorer(), k, schema)
    return top_k(hits, k).select("qid", "pid", "score", "rank")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    where = os.path.join(path, "commits")
    files = spark._jvm.org.apache.hadoop.fs.Path(where)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    return spark.read.schema(_COMMIT).parquet(where) if there else None


_COMMIT = "version long, base string, loads array<string>, n_rows long"


def _last_commit(spark: SparkSession, path: str) -> Row:
    commits = _commits(spark, path)
    last = commits.orderBy(F.desc("version")).first() if commits is not None else None
    if last is None:
        raise ValueError(f"no index has been committed at {path}")
    return last


def _load_path(path: str, load: str) -> str:
    return os.path.join(path, "rows", f"load={load}")


def _write_load(spark: SparkSession, path: str, rows: DataFrame) -> tuple[str, int]:
    """Write rows under a name of their own; nobody reads them before they are committed."""
    load = uuid.uuid4().hex
    where = _load_path(path, load)
    rows = spread_cells(rows.select("pid", "embedding", "cluster_id"), _ROWS_PER_FILE)
    rows.write.partitionBy("cluster_id").parquet(where)
    return load, _read_loads(spark, path, [load]).count()


def _read_loads(spark: SparkSession, path: str, loads: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", os.path.join(path, "rows"))
    return rows.parquet(*(_load_path(path, load) for load in loads))


def _commit(
    spark: SparkSession, path: str, base: str, loads: list[str], n_rows: int
) -> None:
    """From now on readers go by these loads. One file, which appears as a whole."""
    commits = _commits(spark, path)
    last = commits.agg(F.max("version")).first()[0] if commits is not None else None
    frame = spark.createDataFrame([((last or 0) + 1, base, loads, n_rows)], _COMMIT)
    frame.coalesce(1).write.mode("append").parquet(os.path.join(path, "commits"))


def save_ivf(index: IvfIndex, path: str) -> None:
    """Write the index: rows by load and cell, centroids, then the commit that names them.

    An index that is there already stays readable until the commit. A crowded
    cell is spread over as many writers as its row count asks for. One writer
    at a time; rows are added by :func:`append_vectors`.
    """
    spark = index.rows.sparkSession
    base = uuid.uuid4().hex
    index.centroids.coalesce(1).write.parquet(os.path.join(path, "centroids", base))
    load, n = _write_load(spark, path, index.rows)
    _commit(spark, path, base, [load], n)


def _centroids(spark: SparkSession, path: str, base: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "centroids", base))


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    """The index as of its last commit; rows of an append that broke off are not seen."""
    last = _last_commit(spark, path)
    rows = _read_loads(spark, path, last["loads"])
    found = rows.count()
    if found != last["n_rows"]:
        raise ValueError(f"index at {path} holds {found} rows, expected {last['n_rows']}")
    return IvfIndex(rows.drop("load"), _centroids(spark, path, last["base"]))


def append_vectors(spark: SparkSession, path: str, items: DataFrame) -> None:
    """Add rows to a saved index under its existing centroids; only the new ones are counted."""
    last = _last_commit(spark, path)
    index = IvfIndex(items, _centroids(spark, path, last["base"]))
    load, n = _write_load(spark, path, assign_cells(items, index.centers()))
    _commit(spark, path, last["base"], [*last["loads"], load], last["n_rows"] + n)


def compact_ivf(spark: SparkSession, path: str, keep: Column | None = None) -> None:
    """Merge all loads into one: the latest row of each id, where ``keep`` is true.

    Rows of one load that share an id all stay. Files of the loads before are
    left for readers that have them open; they are no longer listed.
    """
    last = _last_commit(spark, path)
    order = {load: i for i, load in enumerate(last["loads"])}
    age = F.coalesce(*(F.when(F.col("load") == load, i) for load, i in order.items()))
    rows = _read_loads(spark, path, last["loads"]).withColumn("_age", age)
    latest = rows.groupBy("pid").agg(F.max("_age").alias("_age"))
    kept = rows.join(latest, ["pid", "_age"], "left_semi")
    kept = kept if keep is None else kept.where(keep)
    load, n = _write_load(spark, path, materialize(kept, "compacted"))
    _commit(spark, path, last["base"], [load], n)


def self_check(index: IvfIndex, n: int = 3, k: int = 5, nprobe: int = 16) -> DataFrame:
    """Search the first ``n`` stored vectors: each should find itself."""
    first = index.rows.orderBy("pid").limit(n)
    probes = first.select(F.col("pid").alias("qid"), "embedding")
    hits = ivf_search(probes, index, k, nprobe)
    return hits.withColumn("is_self", F.col("qid") == F.col("pid"))


@dataclass(frozen=True)
class PqIndex:
    """Code arrays and the codebook of each sub-space."""

    rows: DataFrame
    codebooks: np.ndarray  # m x 2^bits x sub-dimension


def _encode(codebooks: np.ndarray):
    m, _, width = codebooks.shape
    norms = (codebooks**2).sum(axis=2)

    @F.pandas_udf("array<int>")
    def codes(embeddings: pd.Series) -> pd.Series:
        v = _matrix(embeddings.to_frame("embedding"), "embedding")
        if not len(v):
            return pd.Series([], dtype=object)
        parts = v.reshape(len(v), m, width)
        out = np.stack(
            [
                (norms[j] - 2.0 * (parts[:, j] @ codebooks[j].T)).argmin(axis=1)
                for j in range(m)
            ],
            axis=1,
        )
        return pd.Series(list(out.astype("int32")))

    return codes


def build_pq(
    items: DataFrame,
    dim: int,
    n_subquantizers: int = 8,
    n_bits: int = 8,
    seed: int = 42,
    rounds: int = 10,
) -> PqIndex:
    """Quantise each of ``n_subquantizers`` slices of the vector to ``n_bits``."""
    if dim % n_subquantizers:
        raise ValueError("the dimension must be a multiple of n_subquantizers")
    width, size = dim // n_subquantizers, 1 << n_bits
    train = items.select("pid", "embedding").persist()

    def codebook(j: int) -> np.ndarray:
        part = F.slice("embedding", j * width + 1, width)
        centers = _kmeans(train, part, size, seed + j, rounds)
        # with fewer distinct points than codes the last centroid is repeated
        return np.vstack([centers, np.repeat(centers[-1:], size - len(centers), axis=0)])

    try:
        # the sub-spaces are independent, so their training jobs run side by side
        with ThreadPoolExecutor(_PARALLEL_FITS) as pool:
            codebooks = np.stack(list(pool.map(codebook, range(n_subquantizers))))
    finally:
        train.unpersist()
    rows = items.select("pid", _encode(codebooks)("embedding").alias("codes"))
    return PqIndex(rows, codebooks)


@dataclass(frozen=True)
class PqScorer:
    """Inner product of the query with the decoded vector; a block is decoded once."""

    codebooks: np.ndarray
    query_columns = ["embedding"]
    item_columns = ["codes"]
    array_column = "codes"

    def load(self, queries: pd.DataFrame) -> np.ndarray:
        return _matrix(queries, "embedding")

    def score(self, state: np.ndarray, rows: slice, items: pa.Table) -> np.ndarray:
        codes = vectors_of(items["codes"]).astype(int)
        decoded = self.codebooks[np.arange(codes.shape[1]), codes]
        return state[rows] @ decoded.reshape(len(codes), -1).T


def pq_search(queries: DataFrame, index: PqIndex, k: int, bound: int = QUERY_BOUND) -> DataFrame:
    """Top-k by the approximate inner product of the quantised vectors."""
    return blockwise_topk(queries, index.rows, PqScorer(index.codebooks), k, bound)


def pooled_hit_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select("qid", "pid", F.lit(1).alias("found"))
    return (
        exact.select("qid", "pid")
        .join(found, ["qid", "pid"], "left")
        .groupBy("qid")
        .agg(F.round(F.avg(F.coalesce("found", F.lit(0))), 6).alias("recall"))
    )
