"""Equi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a key with fewer rows than this is never worth splitting
HOT_MIN_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_MIN_ROWS) -> list:
    """Keys that would overload one shuffle partition.

    A key is hot when it holds more than a fair partition's share of the
    table, so there are fewer hot keys than partitions. Counting combines
    map-side; only the hot keys reach the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total_rows = df.where(F.col(key).isNotNull())
    n = total_rows.count()
    if n <= min_rows:
        return []
    bar = max(min_rows, n // parts)
    rows = total_rows.groupBy(key).count().where(F.col("count") > bar).collect()
    return [r[key] for r in rows]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    salts: int = 32,
    min_rows: int | None = None,
) -> DataFrame:
    """Join on ``key``; adaptive execution splits a hot key's partition.

    With ``min_rows``, where the left side is stored and cheap to count, keys
    of more rows are spread over ``salts`` partitions beforehand.

    Left rows of a hot key get a salt from ``spread_by``; only the matching
    right rows are copied once per salt. Rows of other keys are untouched.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side is copied, so only left-preserving joins are allowed")
    # counting would run an unstored left side twice
    hot = hot_keys(left, key, min_rows) if min_rows is not None else []
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn(
        "_salt",
        F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0),
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("_salt", F.explode(copies))
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
