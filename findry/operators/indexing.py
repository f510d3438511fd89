"""Global positions, exact splits, shards and samples without one-task windows.

A global ``row_number`` would pull every row into one task. Two ways around
it are used here. Where a dense position is needed, rows are range-sorted,
written once, numbered inside their partition, and shifted by the prefix sum
of the partition totals (one number per partition). Where only "the first n
rows in hash order" are needed, the cut-off hash is found from a histogram
of hash prefixes, and the data itself is never moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findry.functions.rand import hash_order
from findry.functions.text import make_id
from findry.operators.joins import salted_join
from findry.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
_PREFIX_DIGITS = 4
_LEAF_ROWS = 10_000


def prefix_sum(
    df: DataFrame,
    order: list[str],
    weight: str | None = None,
    out: str = "start",
    partitions: int | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over all rows before this one in ``order``.

    ``order`` must identify a row, so that range partitions stay even. Without
    ``weight`` the result is the zero-based position of the row.
    """
    # without a fixed number, adaptive execution merges small neighbouring ranges
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order)
    placed = materialize(
        ranged.sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    # one row per range partition, so this unpartitioned window is small
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        placed.groupBy("_part")
        .agg(F.sum(amount).alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    )
    if weight is None:
        inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    else:
        run = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(amount).over(run), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(totals), "_part")
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_at", "_part", "_inside", "_base")
    )


def dense_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Zero-based position of each row in ``order`` (which must be unique)."""
    return prefix_sum(df, order, None, out)


def index_within(
    df: DataFrame, key: str, order: list[str], out: str = "idx"
) -> DataFrame:
    """Zero-based position of each row among the rows of its key.

    The global position less the first one of the key: no window over a key,
    so one that holds a large share of the rows is sorted by many tasks.
    """
    numbered = dense_index(df, [key, *order], "_i")
    firsts = numbered.groupBy(key).agg(F.min("_i").alias("_first"))
    joined = salted_join(numbered, firsts, key, "_i")
    return joined.withColumn(out, F.col("_i") - F.col("_first")).drop("_i", "_first")


def assign_ids(df: DataFrame, key: str, ordinal: str, prefix: str, out: str = "id") -> DataFrame:
    """Dense first-seen ids: one row per distinct key with ``prefix`` + 0, 1, 2, ...

    ``ordinal`` numbers the source rows; a key is numbered by its first row.
    """
    firsts = df.groupBy(key).agg(F.min(ordinal).alias("first_ord"))
    return dense_index(firsts, ["first_ord"], "_n").select(
        make_id(prefix, F.col("_n")).alias(out), key, "first_ord"
    )


def hash_cuts(df: DataFrame, digest: Column, ranks: list[int]) -> list[str | None]:
    """The digest of the n-th row in digest order, for each n in ``ranks``.

    Histograms over four more hex digits per round (at most 65,536 rows
    reach the driver) narrow the search down to a leaf of a few thousand
    rows. None stands for "nothing" at n = 0 and for a rank past the end.
    """
    digests = df.select(digest.alias("h"))
    histograms: dict[str, list[tuple[str, int]]] = {}

    def histogram(prefix: str) -> list[tuple[str, int]]:
        if prefix not in histograms:
            width = len(prefix) + _PREFIX_DIGITS
            head = F.substring("h", 1, width).alias("p")
            counts = digests.where(F.col("h").startswith(prefix)).groupBy(head).count()
            histograms[prefix] = sorted((r["p"], r["count"]) for r in counts.collect())
        return histograms[prefix]

    def find(prefix: str, rank: int) -> str | None:
        width = len(prefix) + _PREFIX_DIGITS
        seen = 0
        for p, c in histogram(prefix):
            if seen + c < rank:
                seen += c
                continue
            if c > _LEAF_ROWS and width < 32:
                return find(p, rank - seen)
            leaf = digests.where(F.col("h").startswith(p)).orderBy("h").limit(rank - seen)
            return leaf.agg(F.max("h")).first()[0]
        return None

    return [find("", n) if n > 0 else None for n in ranks]


def split_rows(
    df: DataFrame, key: list[str], test: float, dev: float, seed: int | str, out: str = "split"
) -> DataFrame:
    """Exact-count random split into test, dev and train.

    ``ceil(n * test)`` rows become test, then ``ceil(rest * dev)`` of the
    others dev. ``key`` must be unique per row. Only hash histograms are
    aggregated; the rows themselves are labelled in place.
    """
    digest = hash_order(seed, *[F.col(c) for c in key])
    n = df.count()
    # rounding first keeps 0.3 * 10 from becoming 4
    n_test = math.ceil(round(n * test, 9))
    n_dev = math.ceil(round((n - n_test) * dev, 9))
    cut_test, cut_dev = hash_cuts(df, digest, [n_test, n_test + n_dev])
    label = F.lit("train")
    if n_dev and cut_dev is not None:
        label = F.when(F.col("_h") <= cut_dev, F.lit("dev")).otherwise(label)
    if n_test and cut_test is not None:
        label = F.when(F.col("_h") <= cut_test, F.lit("test")).otherwise(label)
    return df.withColumn("_h", digest).withColumn(out, label).drop("_h")


def sample_n(df: DataFrame, key: list[str], n: int, seed: int | str) -> DataFrame:
    """Exactly ``n`` random rows without replacement (all rows if there are fewer)."""
    digest = hash_order(seed, *[F.col(c) for c in key])
    if n < 1:
        return df.limit(0)
    cut = hash_cuts(df, digest, [n])[0]
    return df if cut is None else df.where(digest <= cut)


def shuffle_rows(df: DataFrame, key: list[str], seed: int | str, epoch: int = 0) -> DataFrame:
    """A seeded random order, different for each epoch."""
    return df.orderBy(hash_order(f"{seed}-{epoch}", *[F.col(c) for c in key]))


def assign_shard(
    df: DataFrame, order: list[str], n: int, mode: str = "contiguous", out: str = "shard"
) -> DataFrame:
    """Shard number of each row in ``order``.

    ``contiguous``: equal runs, the last one takes the remainder.
    ``even``: runs whose sizes differ by at most one, longer ones first.
    ``round_robin``: rows are counted from one and dealt out by remainder.
    """
    idx = F.col("_idx")
    numbered = dense_index(df, order, "_idx")
    if mode == "round_robin":
        return numbered.withColumn(out, F.pmod(idx + 1, F.lit(n)).cast("int")).drop("_idx")
    total = df.count()
    size, extra = divmod(total, n)
    if mode == "contiguous":
        shard = F.lit(n - 1) if size == 0 else F.least(F.floor(idx / size), F.lit(n - 1))
    elif mode == "even":
        long_rows = extra * (size + 1)
        tail = F.lit(n) if size == 0 else F.lit(extra) + F.floor((idx - long_rows) / size)
        shard = F.when(idx < long_rows, F.floor(idx / (size + 1))).otherwise(tail)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return numbered.withColumn(out, shard.cast("int")).drop("_idx")
