"""Removal of lines that many documents share, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findry.llm.common import SPACES, ascii_lower, hash_pair
from findry.session import materialize


def line_keys(text: Column) -> Column:
    """The normalised lines of a text: stripped at both ends, A-Z in lower case."""
    lines = F.split(ascii_lower(text), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """The hashes found in ``min_docs`` rows or more; a hot line combines before the shuffle."""
    once = lines.select(F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null")
    counts = once.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).count()
    return counts.where(F.col("count") >= min_docs).select("a", "b")


def without_positions(lines: Column, dropped: Column) -> Column:
    """``lines`` without the elements at the ascending 0-based positions ``dropped``.

    The runs between dropped positions are copied whole, so the work is linear.
    """
    begins = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(F.size(lines)))
    runs = F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b))
    return F.flatten(runs)


def drop_common_lines(
    docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """``docs`` with common lines taken out of ``text``; adds ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of white space at both ends with A-Z
    lower-cased. Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` rows lose all their lines; the others stay in place, joined by
    line feeds. Every row counts as a document of its own, also a repeated one.
    A null or empty text is one empty line; a null text stays null. A text all
    of whose lines go becomes empty. An empty table gives an empty result. Existing columns ``n_lines`` and
    ``n_dropped`` are replaced, all others pass through.

    Lines are compared by 128 bits of hash. Only hashes and positions are
    exploded; the texts themselves move once, to meet their dropped positions,
    and not at all while the planner can broadcast those.
    """
    own = docs.drop("n_lines", "n_dropped")
    body = F.coalesce(F.col(text), F.lit(""))
    a, b = hash_pair(body)

    def hashed(line: Column) -> Column:
        x, y = hash_pair(line)
        return F.when(F.length(line) >= max(min_chars, 1), F.struct(x.alias("a"), y.alias("b")))

    lines = materialize(
        own.select(
            a.alias("doc_a"), b.alias("doc_b"), F.transform(line_keys(body), hashed).alias("hashes")
        ),
        "lines",
    )
    common = materialize(common_lines(lines, min_docs), "common-lines")
    spots = lines.select("doc_a", "doc_b", F.posexplode("hashes").alias("pos", "h"))
    spots = spots.select("doc_a", "doc_b", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    found = spots.join(common, ["a", "b"], "left_semi")
    # equal texts lose the same positions, so the text's hash serves as the key
    dropped = materialize(
        found.groupBy("doc_a", "doc_b").agg(F.sort_array(F.collect_set("pos")).alias("__gone")),
        "dropped-lines",
    ).withColumnsRenamed({"doc_a": "__doc_a", "doc_b": "__doc_b"})
    joined = own.join(
        dropped.hint("shuffle_hash"),
        (a == F.col("__doc_a")) & (b == F.col("__doc_b")),
        "left",
    )
    parts = F.split(body, "\n", -1)
    kept = F.array_join(without_positions(parts, F.col("__gone")), "\n")
    return joined.withColumns(
        {
            "n_lines": F.size(parts).cast("long"),
            "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
            text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept),
        }
    ).drop("__gone", "__doc_a", "__doc_b")
