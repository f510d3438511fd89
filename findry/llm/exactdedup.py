"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by length; rows of shared lengths by the hash of a prefix;
rows that still share by the hash of the whole text. Only the last step reads
whole texts, and only those of surviving groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findry.llm.common import SPACES
from findry.session import materialize


def normalised(text: Column) -> Column:
    """A text without any white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows share; a hot key adds up before the shuffle."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return materialize(counts.where("n > 1").select(*keys), "shared-" + keys[-1])


def group_copies(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    prefix: int = 128,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``(key, keep_id, group_size, kept)`` and ``carry``: one row per row of ``docs``.

    Texts are equal when they agree after all white space is deleted. The row
    with the longest original text (code points) stays, then the one with the
    smallest key (null first). ``group_size`` counts rows. Null texts are
    empty; all empty texts are one group. Rows that repeat key and text are
    one document: they get the same answer. ``carry`` names further columns
    of the result, as small expressions over ``docs``. An empty table gives an
    empty result.

    Texts are compared by length, prefix hash and SHA-256. What is shuffled is
    a few numbers a row, and the texts of rows that share length and prefix
    with another. Groups are stored before they are joined, so that adaptive
    execution can split a hot group.
    """
    carry = carry or {}
    body = normalised(F.col(text))
    rows = docs.select(
        F.col(key).alias("key"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"),
        F.length(body).alias("size"),
        F.xxhash64(F.substring(body, 1, prefix)).alias("head"),
        body.alias("body"),
        F.struct(F.lit(0).alias("_"), *(c.alias(n) for n, c in carry.items())).alias("more"),
    )
    narrow = materialize(rows.drop("body"), "lengths")
    by_size = narrow.join(shared(narrow, ["size"]), "size", "left_semi")
    heads = shared(by_size, ["size", "head"]).withColumn("several", F.lit(True))
    flagged = materialize(narrow.join(heads, ["size", "head"], "left"), "prefixes")
    rest = flagged.where("several").select(
        F.col("key").alias("k"), F.col("size").alias("s"), F.col("head").alias("h")
    )
    # the texts of the survivors, and of no other row
    mine = F.col("key").eqNullSafe(F.col("k")) & (F.col("size") == F.col("s"))
    texts = rows.join(rest, mine & (F.col("head") == F.col("h")), "left_semi")
    whole = F.sha2(F.col("body"), 256).alias("whole")
    hashed = materialize(texts.select("key", "chars", "size", whole, "more"), "whole-hashes")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("key").alias("key")))
    groups = hashed.groupBy("size", "whole").agg(best.alias("best"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1"), "copy-groups")
    stays = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("chars") == -F.col("best.c"))
    single = F.col("n").isNull()
    copies = hashed.join(groups, ["size", "whole"], "left").select(
        "key",
        F.when(single, F.col("key")).otherwise(F.col("best.key")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, True).otherwise(stays).alias("kept"),
        *(F.col("more")[n].alias(n) for n in carry),
    )
    alone = flagged.where(F.col("several").isNull()).select(
        "key",
        F.col("key").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        *(F.col("more")[n].alias(n) for n in carry),
    )
    return copies.unionByName(alone)
