"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by hash. A block's place in its
source's permutation is its rank by another hash. The mix takes a whole number
of passes over a source plus the first blocks of its permutation, the last of
them in part; the room that is left goes to rows of later blocks. A binary tree over the output shards splits the number of blocks
of each source in two, again and again: a shard's quotas are an exact draw
without replacement, and its blocks are a run of each permutation that no other
shard has. Rows are shuffled inside their shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findry.llm.common import WORD
from findry.session import materialize

#: Weights by the place of a source in code point order, repeated. Fixed values.
WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(
    sizes: list[int], weights: list[float], total: float, max_repeat: float
) -> list[float]:
    """Shares of ``total`` by weight, none above ``max_repeat`` times its size.

    The excess of a source at its bound goes to the others by weight, until
    none is above. If all are at their bound the rest of ``total`` goes to none.
    """
    caps = [float(max_repeat * s) for s in sizes]
    target = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    rest = total
    while free:
        whole = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / whole for i in free}
        above = [i for i in free if share[i] > caps[i]]
        if not above:
            for i in free:
                target[i] = share[i]
            break
        for i in above:
            target[i] = caps[i]
            rest -= caps[i]
        free = [i for i in free if i not in set(above)]
    return target


@dataclass
class Mix:
    """A drawn mix: what each source and each block gives."""

    sources: DataFrame  # source, sid, n_blocks, source_size, target
    blocks: DataFrame  # sid, block, draws (pass, shard), last_pass, fitting, late, late_draw
    seed: int
    repeated: DataFrame | None = None  # source, key, size of which there are several rows


def split_quotas(units: list[int], shard: int, n_shards: int, seed: int) -> list[tuple[int, int]]:
    """``(first, n)`` of each source for one shard: its path from the root of the tree.

    Every node draws its left half's quotas from a generator seeded by the
    node, so shards agree on the nodes that they share.
    """
    here = np.array(units, np.int64)
    first = np.zeros(len(here), np.int64)
    lo, hi = 0, n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n_left = int(here.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi])
        left = draw.multivariate_hypergeometric(here, n_left, method="marginals")
        if shard < mid:
            here, hi = left, mid
        else:
            first, here, lo = first + left, here - left, mid
    return list(zip(first.tolist(), here.tolist(), strict=True))


def _dealt(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` of ``(key, source, size, copy, ...)`` with ``sid``, ``block`` and the row's hash ``h``.

    ``copy`` numbers the rows that repeat key and size, from 0.
    """
    named = sources.withColumnRenamed("source", "_name")
    first, other = (F.xxhash64(F.lit(seed), "key", "size", *c) for c in ((), ("copy",)))
    return (
        rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_name")))
        .withColumn("h", F.when(F.col("copy") == 0, first).otherwise(other))
        .withColumn("block", F.pmod(F.xxhash64("h"), "n_blocks"))
        .drop("_name", "copy")
    )


_SAME = ("source", "key", "size")


def _join_same(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``other`` on source, key and size, null equal to null."""
    other = other.withColumnsRenamed({c: f"_{c}" for c in _SAME})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAME]
    return rows.join(other, on, how).drop(*(f"_{c}" for c in _SAME))


def _repeats(sized: DataFrame) -> DataFrame | None:
    """``(source, key, size, n)`` of the rows that are there ``n > 1`` times; None without any."""
    groups = sized.groupBy(*_SAME).agg(F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "mix-repeats")
    return None if groups.isEmpty() else groups


def _listed(sized: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """``sized`` with ``copy``; rows that repeat each other are counted out, not windowed."""
    if repeats is None:
        return sized.withColumn("copy", F.lit(0).cast("long"))
    step = 10_000
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long")))
    runs = repeats.withColumn("first", starts)
    last = F.least(F.col("first") + step, F.col("n")) - 1
    copies = runs.withColumn("copy", F.explode(F.sequence("first", last))).select(*_SAME, "copy")
    single = _join_same(sized.select(*_SAME), repeats.select(*_SAME), "left_anti")
    return materialize(single.withColumn("copy", F.lit(0).cast("long")).unionByName(copies), "mix-rows")


def _numbered(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """``rows`` with ``copy``: a row's number among those that repeat its source, key and size.

    Repeated rows are stored with the partition they lie in, numbered there and
    moved up by the counts of the partitions before.
    """
    if repeats is None:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    names = repeats.select(*_SAME)
    single = _join_same(rows, names, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    part = F.spark_partition_id()
    several = materialize(
        _join_same(rows.withColumn("_part", part), names, "left_semi"), "mix-repeated"
    )
    upto = Window.partitionBy(*_SAME).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = several.groupBy(*_SAME, "_part").agg(F.count("*").alias("n"))
    counts = counts.select(
        *_SAME, F.col("_part").alias("_at"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("up")
    )
    inside = Window.partitionBy(*_SAME, "_part").orderBy(F.lit(0))
    several = several.withColumn("copy", F.row_number().over(inside) - 1)
    counts = counts.withColumnsRenamed({c: f"_{c}" for c in _SAME})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAME]
    placed = several.join(counts, [*on, F.col("_part") == F.col("_at")])
    placed = placed.withColumn("copy", F.col("copy") + F.col("up"))
    return single.unionByName(placed.select(*rows.columns, F.col("copy").cast("long")))


def _places(blocks: DataFrame, seed: int) -> DataFrame:
    """Each block's ``place`` in its source's permutation and the words ``before`` it.

    The permutation is cut into 4,096 parts whose sums are added up first, so
    no window holds a whole source.
    """
    blocks = blocks.withColumn("p", F.xxhash64(F.lit(seed + 1), "sid", "block"))
    blocks = blocks.withColumn("part", F.shiftright("p", 52))
    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("sid", "part").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    parts = parts.select(
        "sid",
        "part",
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    inside = Window.partitionBy("sid", "part").orderBy("p", "block")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    words = F.coalesce(F.sum("words").over(upto), F.lit(0))
    ranked = blocks.select(
        "sid", "part", "block", "words", words.alias("w"), F.row_number().over(inside).alias("n")
    )
    return ranked.join(parts, ["sid", "part"]).select(
        "sid",
        "block",
        "words",
        (F.col("w_before") + F.col("w")).alias("before"),
        (F.col("n_before") + F.col("n") - 1).alias("place"),
    )


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block that fit into ``room``: the largest that still does, again and again."""
    rows = rows.sort_values(["size", "h"], ascending=[False, True])
    room = float(rows["room"].iloc[0])
    taken = []
    for h, size in zip(rows["h"], rows["size"], strict=True):
        if size <= room:
            room -= size
            taken.append(h)
    first = rows.iloc[0]
    found = [(first["sid"], first["block"], first["place"], taken, room)]
    return pd.DataFrame(found, columns=["sid", "block", "place", "fitting", "room"])


_FIT = "sid int, block long, place long, fitting array<long>, room double"
_LATE = "sid int, block long, h long"


def _carry(dealt: DataFrame, placed: DataFrame, cuts: DataFrame, seed: int) -> DataFrame | None:
    """``(sid, block, h)``: rows beyond the last pass's edge that fill the room left there.

    Rows larger than the room are skipped. Each round takes the blocks of rows
    that fit, up to one that reaches the target, and fits that one; this halves
    the room at least, so the rounds are logarithmic in it. In the end no row
    that is left fits; the smallest is taken if that comes nearer to the target.
    """
    spark = dealt.sparkSession
    rows = dealt.select("sid", "block", "h", "size").join(
        placed.select("sid", "block", "place"), ["sid", "block"]
    )
    state = {r["sid"]: (r["room"], r["place"]) for r in cuts.drop("fitting").collect()}
    rooms, late = {i: room for i, (room, _) in state.items()}, None
    edge_of = {i: place for i, (_, place) in state.items()}
    while state := {i: x for i, x in state.items() if x[0] >= 1}:
        now = [(i, room, place) for i, (room, place) in state.items()]
        now = F.broadcast(spark.createDataFrame(now, "sid int, free double, after long"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("free"))
        small = rows.join(now, "sid").where(fits & (F.col("place") > F.col("after")))
        small = materialize(small, "mix-small")
        blocks = small.groupBy("sid", "block").agg(F.sum("size").alias("words"))
        at = materialize(_places(blocks, seed).drop("place"), "mix-small-places")
        at = at.join(now, "sid").drop("after")
        whole = at.where(F.col("before") + F.col("words") <= F.col("free"))
        edge = at.where((F.col("before") < F.col("free")) & (F.col("before") + F.col("words") > F.col("free")))
        edge = edge.select("sid", "block", (F.col("free") - F.col("before")).alias("room"))
        cut = small.join(edge, ["sid", "block"]).groupBy("sid", "block")
        cut = materialize(cut.applyInPandas(_fit, _FIT), "mix-late-cuts")
        taken = small.join(whole.select("sid", "block"), ["sid", "block"]).select("sid", "block", "h")
        taken = taken.unionByName(cut.select("sid", "block", F.explode("fitting").alias("h")))
        late = materialize(taken if late is None else late.unionByName(taken), "mix-late")
        for r in whole.groupBy("sid").agg(F.sum("words").alias("words")).collect():
            rooms[r["sid"]] -= r["words"]
        ends = {r["sid"]: (r["room"], r["place"]) for r in cut.drop("fitting").collect()}
        rooms |= {i: room for i, (room, _) in ends.items()}
        state = ends  # without an edge every row that fits is taken
    if open_ := [(i, room, edge_of[i]) for i, room in rooms.items() if room > 0.5]:
        now = F.broadcast(spark.createDataFrame(open_, "sid int, free double, after long"))
        near = (F.col("size") > F.col("free")) & (F.col("size") < 2 * F.col("free"))
        left = rows.join(now, "sid").where(near & (F.col("place") >= F.col("after")))
        used = cuts.select("sid", F.explode("fitting").alias("h"))
        if late is not None:
            used = used.unionByName(late.select("sid", "h"))
        left = left.join(used, ["sid", "h"], "left_anti").groupBy("sid")
        over = left.agg(F.min(F.struct("size", "h", "block")).alias("x")).select(
            "sid", "x.block", "x.h"
        )
        late = materialize(over if late is None else late.unionByName(over), "mix-late")
    return late


def plan_mix(
    sized: DataFrame,
    *,
    seed: int = 17,
    total_share: float = 1.5,
    max_repeat: int = 2,
    weights: tuple[float, ...] = WEIGHTS,
    block_words: int = 20_000,
    block_rows: int = 10_000,
    shard_words: int = 2_000_000,
    max_sources: int = 100_000,
) -> Mix:
    """Draw a mix of ``sized``, rows of ``(key, source, size)``.

    Sources in code point order (null last) weigh ``weights``, repeating, and
    share ``total_share`` of all sizes; none gets more than ``max_repeat``
    times its own. The recipe, one row per source, goes through the driver;
    more than ``max_sources`` raise an error. Blocks hold ``block_words`` words
    or ``block_rows`` rows on average, more where there would be over 500
    million. All choices are hashes of the seed, so a rerun draws the same. An
    empty table gives an empty mix.
    """
    spark = sized.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    stats = stats.orderBy(F.asc_nulls_last("source")).limit(max_sources + 1).collect()
    if len(stats) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes, counts = [r["words"] for r in stats], [r["n"] for r in stats]
    own = [weights[i % len(weights)] for i in range(len(stats))]
    targets = fill_targets(sizes, own, total_share * sum(sizes), max_repeat)
    passes = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    most = 250_000_000
    block_words = max(block_words, int(sum(targets)) // most)
    block_rows = max(block_rows, max_repeat * sum(counts) // most)
    recipe = spark.createDataFrame(
        [
            (r["source"], i, max(1, -(-w // block_words), -(-n // block_rows)), w, t, p, t - p * w)
            for i, (r, w, n, t, p) in enumerate(
                zip(stats, sizes, counts, targets, passes, strict=True)
            )
        ],
        "source string, sid int, n_blocks long, source_size long, target double, passes int, "
        "rest double",
    )
    repeats = _repeats(sized)
    listed = _listed(sized, repeats)
    dealt = _dealt(listed, recipe.select("source", "sid", "n_blocks", "rest"), seed)
    blocks = dealt.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    placed = materialize(_places(materialize(blocks, "mix-blocks"), seed), "mix-places")
    placed = placed.join(F.broadcast(recipe.select("sid", "passes", "rest")), "sid")
    last = F.col("before") < F.col("rest")
    numbers = {
        r["sid"]: (r["n"], r["extra"])
        for r in placed.groupBy("sid")
        .agg(F.count("*").alias("n"), F.count_if(last).alias("extra"))
        .collect()
    }
    units = [p * numbers[i][0] + numbers[i][1] for i, p in enumerate(passes)]
    n_shards = max(1, round(sum(targets) / shard_words))

    def shares(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                runs = split_quotas(units, int(shard), n_shards, seed)
                found = [(i, a, a + n - 1, shard) for i, (a, n) in enumerate(runs) if n]
                yield pd.DataFrame(found, columns=["sid", "a", "z", "shard"])

    runs = spark.range(n_shards).mapInPandas(shares, "sid int, a long, z long, shard long")
    runs = runs.select("sid", "shard", F.explode(F.sequence("a", "z")).alias("unit"))
    # unit number: all blocks of the first pass in their order, then the next; the last ends early
    n_of = spark.createDataFrame([(i, n) for i, (n, _) in numbers.items()], "sid int, n long")
    numbered = (
        placed.join(F.broadcast(n_of), "sid")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), "passes")))
        .where((F.col("pass") < F.col("passes")) | last)
        .withColumn("unit", F.col("pass") * F.col("n") + F.col("place"))
    )
    drawn = numbered.join(runs, ["sid", "unit"])
    # the last pass ends inside the block that reaches the target: of its rows, from the
    # largest down, those that still fit; a block is bounded, so one task can walk through it
    edge = placed.where(last & (F.col("before") + F.col("words") > F.col("rest")))
    edge = edge.select("sid", "block", "place", (F.col("rest") - F.col("before")).alias("room"))
    cuts = dealt.select("sid", "block", "h", "size").join(F.broadcast(edge), ["sid", "block"])
    cuts = materialize(cuts.groupBy("sid", "block").applyInPandas(_fit, _FIT), "mix-cuts")
    late = _carry(dealt, placed, cuts, seed)
    if late is None:
        late = spark.createDataFrame([], _LATE)
    draws = drawn.groupBy("sid", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws")
    )
    draws = materialize(draws, "mix-drawn")
    ends = cuts.join(F.broadcast(recipe.select("sid", "passes")), "sid")
    ends = ends.select("sid", "block", F.col("passes").alias("last_pass"), "fitting")
    # rows of later blocks go to the shard of the block where the last pass ends
    end_draw = F.element_at("draws", -1).alias("late_draw")
    to = draws.join(ends.select("sid", "block"), ["sid", "block"]).select("sid", end_draw)
    late = late.groupBy("sid", "block").agg(F.collect_list("h").alias("late"))
    late = late.join(F.broadcast(to), "sid")
    table = draws.join(ends, ["sid", "block"], "left").join(late, ["sid", "block"], "full")
    sources = recipe.select("source", "sid", "n_blocks", "source_size", "target")
    return Mix(sources, materialize(table, "mix-draws"), seed, repeats)


def draw_rows(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` of ``(key, source, size, ...)`` with ``source_size``, ``target`` and ``draws``.

    ``draws`` holds one ``(pass, shard)`` for each time that the mix takes the row.
    """
    numbered = _numbered(rows, mix.repeated)
    dealt = _dealt(numbered, mix.sources, mix.seed).join(mix.blocks, ["sid", "block"], "left")
    none = F.array().cast("array<struct<pass:int,shard:bigint>>")
    draws = F.filter(
        F.coalesce(F.col("draws"), none),
        lambda d: F.col("last_pass").isNull()
        | (d["pass"] < F.col("last_pass"))
        | F.array_contains("fitting", F.col("h")),
    )
    late = F.when(F.array_contains("late", F.col("h")), F.array("late_draw")).otherwise(none)
    gone = ("sid", "block", "n_blocks", "last_pass", "fitting", "late", "late_draw")
    return dealt.withColumn("draws", F.concat(draws, late)).drop(*gone)


def size_documents(docs: DataFrame) -> DataFrame:
    """``(key, source, size)`` of documents, with the whole row in ``row``.

    The size is the number of words; a null text has none.
    """
    return docs.select(
        F.col("doc_id").alias("key"),
        "source",
        n_words(F.col("text")).alias("size"),
        F.struct("*").alias("row"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, shard by shard.

    The columns are those of ``docs``. Each shard lies in one partition, its
    rows in an order drawn by hash. A document without words weighs nothing and
    comes along with its block. Rows that repeat key and size share their
    draws. A null source is a source of its own.
    """
    sized = size_documents(docs)
    mix = plan_mix(materialize(sized.drop("row"), "mix-sizes"), **options)
    drawn = draw_rows(sized, mix).withColumn("draw", F.explode("draws"))
    order = F.xxhash64(F.lit(mix.seed + 2), "draw.shard", "h", "draw.pass")
    placed = drawn.select("row", F.col("draw.shard").alias("shard"), order.alias("order"))
    return placed.repartition("shard").sortWithinPartitions("shard", "order").select("row.*")
