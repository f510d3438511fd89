"""Training data: token chunks, sampling, batches, contrastive statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findry.functions.rand import hash_order, uniform, uniform_of
from findry.functions.text import let, normalize_text, passage_text
from findry.functions.tokens import add_bos_eos, augment, mask_to, pad_to, random_crop
from findry.operators.blockwise import (
    QUERY_BOUND,
    arrow_type,
    fits_broadcast,
    query_chunks,
    vectors_of,
)
from findry.operators.indexing import dense_index, prefix_sum
from findry.session import materialize

# scores held at once by a task that counts: queries x items
_QUERIES_AT_ONCE, _ITEMS_AT_ONCE = 512, 8192
# scans of the pool that one plan holds
_CHUNKS_AT_ONCE = 8


def chunk_tokens(
    df: DataFrame, length: int, offset: int = 0, order: Sequence[str] = ("ord",)
) -> DataFrame:
    """Cut the concatenation of all token lists into chunks of ``length``.

    ``df`` has the ``order`` columns and ``tokens``. The stream starts at
    ``offset``; a partial chunk at the end is dropped. Only slices travel:
    a list is cut at chunk borders where it lies, and a chunk is put together
    from at most ``length`` slices.
    """
    sized = df.select(*order, "tokens", F.size("tokens").alias("_n")).where(F.col("_n") > 0)
    placed = prefix_sum(sized, list(order), "_n", "_start")
    start, end = F.col("_start") - offset, F.col("_start") - offset + F.col("_n")
    first = F.greatest(F.floor(start / length), F.lit(0))
    last = F.floor((end - 1) / length)
    pieces = placed.where(end > 0).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    low = F.greatest(start, F.col("chunk_id") * length)
    high = F.least(end, (F.col("chunk_id") + 1) * length)
    cut = F.slice("tokens", (low - start + 1).cast("int"), (high - low).cast("int"))
    joined = (
        pieces.select("chunk_id", low.alias("_at"), cut.alias("_piece"))
        .groupBy("chunk_id")
        .agg(F.flatten(F.sort_array(F.collect_list(F.struct("_at", "_piece")))["_piece"]).alias("tokens"))
    )
    return joined.where(F.size("tokens") == length)




def _drawn(ctxs: Column, n: Column, seed: str, key: Column, first: int = 0) -> Column:
    """``n`` contexts in seeded random order, skipping the first ``first``."""
    marked = F.transform(
        ctxs,
        lambda c, i: F.struct(hash_order(seed, key, i).alias("h"), i.alias("i"), c.alias("c")),
    )
    kept = F.filter(marked, lambda m: m["i"] >= first)
    return F.slice(F.transform(F.array_sort(kept), lambda m: m["c"]), F.lit(1), n)


def sample_negatives(
    examples: DataFrame,
    n: int = 1,
    hard_ratio: float = 0.0,
    min_idx: int = 0,
    seed: int | str = 0,
    training: bool = True,
    key: str = "qid",
) -> DataFrame:
    """Pick one positive and up to ``n`` negatives per example: adds ``gold, negatives``.

    In training each of the ``n`` places is a hard one with probability
    ``hard_ratio``; hard ones come from index ``min_idx`` on, the others from
    the random negatives, and both are capped by what is there. In evaluation
    the first positive and the first negative are taken.
    """
    have = set(examples.columns)
    none = F.slice("positive_ctxs", 1, 0)
    neg = F.coalesce("negative_ctxs", none) if "negative_ctxs" in have else none
    hard = F.coalesce("hard_negative_ctxs", none) if "hard_negative_ctxs" in have else none
    if not training:
        return examples.withColumn("gold", F.get("positive_ctxs", F.lit(0))).withColumn(
            "negatives", F.slice(neg, 1, 1)
        )
    k = F.col(key)
    pick = F.floor(uniform(f"{seed}-gold", k) * F.size("positive_ctxs")).cast("int")
    trials = F.aggregate(
        F.slice(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), 1, n),
        F.lit(0),
        lambda acc, i: acc
        + (uniform_of(hash_order(f"{seed}-hard", k, i)) < hard_ratio).cast("int"),
    )
    n_hard = F.least(trials, F.greatest(F.size(hard) - min_idx, F.lit(0)))
    chosen = let(
        n_hard,
        lambda h: F.concat(
            _drawn(neg, F.lit(n) - h, f"{seed}-neg", k),
            _drawn(hard, h, f"{seed}-hardpick", k, min_idx),
        ),
    )
    return examples.withColumn("gold", F.get("positive_ctxs", pick)).withColumn(
        "negatives", chosen
    )


def example_texts(sampled: DataFrame, normalize: bool = True, key: str = "qid") -> DataFrame:
    """``(qid, query, gold, negatives)`` as the texts an encoder reads."""
    clean = normalize_text if normalize else (lambda c: c)

    def text(ctx: Column) -> Column:
        return clean(passage_text(ctx["title"], ctx["text"]))

    return sampled.select(
        key,
        clean(F.col("question")).alias("query"),
        text(F.col("gold")).alias("gold"),
        F.transform("negatives", text).alias("negatives"),
    )


def assign_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add ``batch`` and ``slot`` by position in ``order``; a batch has ``size`` rows.

    ``order`` identifies a row. Only its columns are sorted and numbered; the
    rows themselves move once, to meet their numbers.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    narrow = df.select(*(F.col(c).alias(key) for c, key in zip(order, keys, strict=True)))
    numbered = dense_index(narrow, keys, "_idx")
    same = [F.col(c).eqNullSafe(F.col(key)) for c, key in zip(order, keys, strict=True)]
    return (
        df.join(numbered, same)
        .withColumn("batch", F.floor(F.col("_idx") / size))
        .withColumn("slot", (F.col("_idx") % size).cast("int"))
        .drop("_idx", *keys)
    )


def collate(texts: DataFrame) -> DataFrame:
    """One row per batch: ``queries`` and ``passages`` (all golds, then all negatives).

    ``texts`` has ``batch, slot, query, gold, negatives``; a group is one
    batch of the fixed size.
    """
    rows = F.sort_array(F.collect_list(F.struct("slot", "query", "gold", "negatives")))
    return texts.groupBy("batch").agg(rows.alias("_r")).select(
        "batch",
        F.col("_r.query").alias("queries"),
        F.concat("_r.gold", F.flatten("_r.negatives")).alias("passages"),
        F.size("_r").alias("n_golds"),
    )


def pad_mask(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Pad ``tokens`` with zeros to the longest of the batch and add ``mask``."""
    longest = df.groupBy(batch).agg(F.max(F.size("tokens")).alias("_max"))
    joined = df.join(longest, batch)
    return joined.select(
        *[c for c in df.columns if c != "tokens"],
        pad_to(F.col("tokens"), F.col("_max")).alias("tokens"),
        mask_to(F.col("tokens"), F.col("_max")).alias("mask"),
    )


def contrastive_pairs(
    docs: DataFrame,
    order: list[str],
    length: int,
    batch_size: int,
    epoch: int,
    seed: str = "pairs",
    crop: tuple[float, float] = (0.125, 0.5),
    kind: str = "mask",
    share: float = 0.1,
    borders: tuple[int | None, int | None] = (101, 102),
    vocabulary: tuple[int, int] = (5, 99),
) -> DataFrame:
    """Two views of every chunk of a token stream, batched: an epoch of contrastive pairs.

    ``docs`` has ``tokens`` and the columns of ``order``. The stream is cut
    into chunks of ``length`` from an offset that the epoch draws. A chunk
    gives a query and a key: two random crops of it, augmented, with borders.
    The result has ``chunk_id``, ``side`` (0 query, 1 key), ``batch``, ``slot``,
    ``tokens`` padded to the longest of the side in its batch, and ``mask``.
    All draws depend on seed, epoch and chunk alone.
    """
    stored = materialize(docs, "pair-tokens")
    spark = docs.sparkSession
    drawn = F.floor(uniform(f"{seed}-offset", F.lit(epoch)) * length).cast("int")
    offset = spark.range(1).select(drawn).first()[0]
    chunks = materialize(chunk_tokens(stored, length, offset, order), "pair-chunks")
    numbered = assign_batches(chunks, ["chunk_id"], batch_size)

    def view(side: int) -> Column:
        name = f"{seed}-{epoch}-{side}"
        cut = random_crop(F.col("tokens"), *crop, name, F.col("chunk_id"))
        low, high = vocabulary
        changed = augment(cut, kind, share, name, F.col("chunk_id"), low=low, high=high)
        return add_bos_eos(changed, *borders)

    sides = [
        numbered.select(
            "chunk_id", F.lit(side).alias("side"), "batch", "slot", view(side).alias("tokens")
        )
        for side in (0, 1)
    ]
    views = sides[0].unionByName(sides[1]).withColumn("_group", F.struct("batch", "side"))
    # widths need the batch, so the views are stored before they are padded
    return pad_mask(materialize(views, "pair-views"), "_group").drop("_group")


def sample_mixture(
    df: DataFrame,
    weights: DataFrame,
    n: int,
    seed: int | str = 0,
    order: Sequence[str] = ("ord",),
) -> DataFrame:
    """``n`` rows with replacement: a dataset by its weight, then a uniform row of it.

    ``df`` has ``dataset`` and the ``order`` columns, ``weights`` one row per
    dataset with ``n`` and ``weight``. Adds ``draw``.
    """
    numbered = dense_index(df, ["dataset", *order], "_idx")
    # a row's place in its dataset is its global place less where the dataset starts
    starts = numbered.groupBy("dataset").agg(F.min("_idx").alias("_first"))
    table = weights.join(starts, "dataset").select("dataset", "n", "weight", "_first").collect()
    table.sort(key=lambda r: r["dataset"])
    bars = np.cumsum([r["weight"] for r in table])
    u = F.col("_u")
    place = F.lit(len(table) - 1)
    for i in reversed(range(len(table) - 1)):
        place = F.when(u < float(bars[i]), F.lit(i)).otherwise(place)

    def of(column: str) -> Column:
        return F.get(F.array(*[F.lit(r[column]) for r in table]), F.col("_d"))

    spark = df.sparkSession
    draws = (
        spark.range(n)
        .withColumnRenamed("id", "draw")
        .withColumn("_u", uniform(f"{seed}-set", F.col("draw")))
        .withColumn("_d", place)
        .withColumn("_v", uniform(f"{seed}-row", F.col("draw")))
        .select("draw", (of("_first") + F.floor(F.col("_v") * of("n"))).alias("_idx"))
    )
    return draws.join(numbered, "_idx").drop("_idx")


def contrastive_stats(
    pairs: DataFrame, temperature: float = 1.0, label_smoothing: float = 0.0
) -> DataFrame:
    """``(batch, n, loss, accuracy, stdq, stdk)`` of in-batch contrastive scoring.

    ``pairs(batch, slot, q, key_vectors)``: the first key vector of a row is
    its own positive, further ones are extra negatives. Every query of a
    batch is scored against every key of the batch: positives in slot order,
    then negatives. A group is one batch of fixed size.
    """

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        q = vectors_of(table["q"])
        rows = table["key_vectors"].to_pylist()
        first = [r[0] for r in rows]
        keys = np.array(first + [v for r in rows for v in r[1:]], dtype=float)
        scores = (q / temperature) @ keys.T
        top = scores.max(axis=1, keepdims=True)
        log_total = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        own = scores[np.arange(len(q)), np.arange(len(q))]
        smooth = label_smoothing * scores.mean(axis=1)
        loss = log_total - (1 - label_smoothing) * own - smooth
        right = scores.argmax(axis=1) == np.arange(len(q))

        def spread(m: np.ndarray) -> float | None:
            return float(m.std(axis=0, ddof=1).mean()) if len(m) > 1 else None

        return pa.table(
            {
                "batch": pa.array([table["batch"][0].as_py()], pa.int64()),
                "n": pa.array([len(q)], pa.int64()),
                "loss": pa.array([float(loss.mean())], pa.float64()),
                "accuracy": pa.array([100.0 * float(right.mean())], pa.float64()),
                "stdq": pa.array([spread(q)], pa.float64()),
                "stdk": pa.array([spread(keys)], pa.float64()),
            }
        )

    schema = "batch long, n long, loss double, accuracy double, stdq double, stdk double"
    needed = pairs.select(F.col("batch").cast("long").alias("batch"), "slot", "q", "key_vectors")
    return needed.groupBy("batch").applyInArrow(score, schema)


def _ahead(block: pd.DataFrame, items: pa.Table) -> np.ndarray:
    """How many of the items score above each query's gold."""
    vectors = vectors_of(items["embedding"])
    total = np.zeros(len(block), dtype=int)
    if not len(vectors) or not len(block):
        return total
    q = np.stack([np.asarray(v, dtype=float) for v in block["embedding"]])
    bar = np.rint(block["gold_score"].to_numpy() * 1e6)
    for at in range(0, len(vectors), _ITEMS_AT_ONCE):
        some = vectors[at : at + _ITEMS_AT_ONCE].T
        for lo in range(0, len(q), _QUERIES_AT_ONCE):
            hi = lo + _QUERIES_AT_ONCE
            scores = q[lo:hi] @ some
            scores *= 1e6
            above = np.rint(scores, out=scores) > bar[lo:hi, None]
            total[lo:hi] += np.count_nonzero(above, axis=1)
    return total


def pool_ranks(
    queries: DataFrame, pool: DataFrame, bound: int = QUERY_BOUND, item_block: int = _ITEMS_AT_ONCE
) -> DataFrame:
    """``(qid, rank)`` of each query's gold among all pool vectors.

    ``queries(qid, embedding, gold_score)``, ``pool(pid, embedding)``. Tasks
    only count the better ones, so one number per query leaves each task.
    More than ``bound`` queries take a scan of the stored pool for each chunk
    of them, as in exact search; the pool is never copied. A task scores up
    to ``item_block`` vectors of the pool at once.
    """
    q = queries.select("qid", "embedding", "gold_score")
    p = pool.select("pid", "embedding")
    qid_type = q.schema["qid"].dataType
    schema = f"qid {qid_type.simpleString()}, ahead long"
    arrow = pa.schema([("qid", arrow_type(qid_type)), ("ahead", pa.int64())])

    def counted(block: pd.DataFrame, ahead: np.ndarray) -> pa.Table:
        return pa.table(
            [pa.array(block["qid"].to_numpy(dtype=object), arrow.field(0).type), pa.array(ahead, pa.int64())],
            schema=arrow,
        )

    def counts_of(chunk: DataFrame) -> DataFrame:
        shared = p.sparkSession.sparkContext.broadcast(chunk.toPandas())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            total = np.zeros(len(block), dtype=int)
            for batch in batches:
                for at in range(0, batch.num_rows, item_block):
                    total += _ahead(block, pa.Table.from_batches([batch.slice(at, item_block)]))
            yield from counted(block, total).to_batches()

        return p.mapInArrow(scan, schema)

    if fits_broadcast(q, "embedding", bound):
        counts = counts_of(q)
    else:
        p = materialize(p, "pool")
        chunks = query_chunks(q, "embedding", bound)
        parts = []
        # plans stay small however many chunks there are
        for first in range(0, len(chunks), _CHUNKS_AT_ONCE):
            some = reduce(DataFrame.unionByName, map(counts_of, chunks[first : first + _CHUNKS_AT_ONCE]))
            some = some.groupBy("qid").agg(F.sum("ahead").alias("ahead"))
            parts.append(materialize(some, "pool-counts"))
        counts = reduce(DataFrame.unionByName, parts)
    return counts.groupBy("qid").agg((F.sum("ahead") + 1).alias("rank"))


def pool_eval(ranks: DataFrame) -> DataFrame:
    """``(n, accuracy, mrr)``: share of golds ranked first (in percent), mean 1/rank."""
    return ranks.agg(
        F.count("*").alias("n"),
        F.round(100.0 * F.avg((F.col("rank") == 1).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"),
    )
