"""Hard-negative mining and judgement filters over ranked hits.

``hits`` are ``(qid, pid, score, rank)`` as the search operators return them,
``gold`` is ``(qid, gold)`` from :func:`findry.operators.dataset.first_gold`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findry.functions.text import overlap_score
from findry.operators.dataset import attach_passages
from findry.operators.indexing import sample_n
from findry.operators.joins import salted_join

PairScorer = Callable[[Column, Column], Column]

# Fixed value: the pair score from which a passage counts as relevant.
RELEVANT_SCORE = 0.9

# hits whose contexts one group of queries puts together; bytes of contexts in an Arrow batch
_GROUP_HITS = 20_000
_BATCH_BYTES = 1 << 25


def score_pairs(
    pairs: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    scorer: PairScorer = overlap_score,
    out: str = "pair_score",
) -> DataFrame:
    """Add the pair score of query text and passage body to ``(qid, pid)`` rows.

    ``scorer`` is any column function of two texts: the default is native,
    a pandas UDF around a cross-encoder fits the same place.
    """
    passages = corpus.select("pid", F.col("text").alias("_body"))
    asked = queries.select("qid", F.col("text").alias("_question"))
    joined = salted_join(pairs, passages, "pid", "qid").join(asked, "qid")
    score = F.round(scorer(F.col("_question"), F.col("_body")).cast("double"), 6)
    return joined.withColumn(out, score).drop("_body", "_question")


def filter_pairs(scored: DataFrame, min_score: float = RELEVANT_SCORE) -> DataFrame:
    """Pairs whose score reaches the bar."""
    return scored.where(F.col("pair_score") >= min_score)


def filter_report(scored: DataFrame, min_score: float = RELEVANT_SCORE) -> DataFrame:
    """How many pairs are kept and how many fall below the bar."""
    kept = F.col("pair_score") >= min_score
    return scored.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def gold_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Rank of each query's gold among its hits, null when absent."""
    at = hits.select("qid", F.col("pid").alias("gold"), F.col("rank").alias("gold_rank"))
    return gold.join(at, ["qid", "gold"], "left")


def split_by_lexical_hit(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Label queries ``high_lexical`` when lexical search finds the gold, else ``high_semantic``."""
    label = F.when(F.col("gold_rank").isNotNull(), "high_lexical").otherwise("high_semantic")
    return gold_ranks(gold, hits).withColumn("kind", label)


def strict_filter(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries none of whose hits is a passage other than the gold."""
    others = hits.join(gold, "qid").where(F.col("pid") != F.col("gold"))
    return gold.join(others.select("qid").distinct(), "qid", "left_anti")


def anti_sample(
    qrels: DataFrame, filtered: DataFrame, n: int = 10, seed: int | str = 0
) -> DataFrame:
    """Random judged queries that the filter left out."""
    judged = qrels.select("qid").distinct()
    return sample_n(judged.join(filtered.select("qid"), "qid", "left_anti"), ["qid"], n, seed)


def negative_hits(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that are not the gold of their query, with their rank."""
    return hits.join(gold, "qid").where(F.col("pid") != F.col("gold")).drop("gold")


def mine_negatives(
    gold: DataFrame,
    hits: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    scorer: PairScorer | None = None,
) -> DataFrame:
    """``(qid, question, negative_ctxs)``: all non-gold hits by rank.

    With a ``scorer`` each context also carries its pair score as
    ``ce_score``. A group holds at most the k hits of one query.

    A passage that many queries hit goes once to each group of queries, where
    the contexts are put together; it does not travel once for each hit.
    """
    pairs = negative_hits(gold, hits).select("qid", "pid", "rank")
    asked = queries.select("qid", F.col("text").alias("question"))
    fields = ["title", "text"]
    # equal ids are told apart by what they hold
    corpus = corpus.select("pid", *fields, F.xxhash64(*fields).alias("_key"))
    if scorer is not None:
        pairs = _scored(pairs, queries, corpus, ["_key"], scorer, "ce_score")
    parts = max(
        int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        hits.count() // _GROUP_HITS,
    )
    group = F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("_group")
    own = ["pid"] if scorer is None else ["pid", "_key"]
    pairs = pairs.select(group, F.lit(2).alias("_kind"), "*")
    needed = pairs.select("_group", "pid").distinct()
    bodies = attach_passages(needed, corpus, [*fields, "_key"])
    rows = bodies.withColumn("_kind", F.lit(0))
    rows = rows.unionByName(asked.select(group, F.lit(1).alias("_kind"), "*"), allowMissingColumns=True)
    rows = rows.unionByName(pairs, allowMissingColumns=True)
    rows = rows.repartition(parts, "_group").sortWithinPartitions("_group", "_kind", "qid", "rank")
    qid, text = asked.schema["qid"].dataType.simpleString(), "title string, text string".split(", ")
    ctx = ",".join(x.replace(" ", ":") for x in [*text, "ce_score double"][: 2 if scorer is None else 3])
    return rows.groupBy("_group").applyInArrow(
        _contexts(own, scorer is not None),
        f"qid {qid}, question string, negative_ctxs array<struct<{ctx}>>",
    )


def _contexts(own: list[str], scored: bool):
    """Puts the contexts of a group's queries together: passages, questions, then hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: [], 2: []}
        for batch in batches:
            kinds = batch.column("_kind").to_numpy()
            starts = np.flatnonzero(np.diff(kinds, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(kinds)]):
                held[int(kinds[start])].append(batch.slice(start, end - start))
        if not all(held.values()):
            return
        bodies, asked, hits = (pa.Table.from_batches(held[kind]) for kind in range(3))
        at: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(bodies[c].to_pylist() for c in own))):
            at.setdefault(key, []).append(i)
        size = sum(pc.fill_null(pc.binary_length(bodies[c]), 0).to_numpy() for c in ("title", "text"))

        def order(i: int) -> tuple:
            words = (bodies[c][i].as_py() for c in ("title", "text"))
            return tuple((w is not None, w or "") for w in words)

        questions: dict[object, list] = {}
        for qid, question in zip(asked["qid"].to_pylist(), asked["question"].to_pylist()):
            questions.setdefault(qid, []).append(question)
        columns = [hits[c].to_pylist() for c in ("qid", "rank", *own)]
        scores = hits["ce_score"].to_pylist() if scored else [None] * hits.num_rows
        found: dict[object, list] = {}
        for (qid, rank, *key), score in zip(zip(*columns), scores):
            # a scored hit names its passage; equal rows were scored one by one
            same = at[tuple(key)][: 1 if scored else None]
            found.setdefault(qid, []).extend((rank, i, score) for i in same)

        def batch_of(rows: list) -> pa.RecordBatch:
            takes = pa.array([i for *_, ctxs in rows for _, i, _ in ctxs], pa.int64())
            parts = [bodies[c].take(takes).combine_chunks() for c in ("title", "text")]
            parts = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in parts]
            names = ["title", "text"]
            if scored:
                parts.append(pa.array([s for *_, ctxs in rows for _, _, s in ctxs], pa.float64()))
                names.append("ce_score")
            ends = np.cumsum([0, *(len(ctxs) for *_, ctxs in rows)]).astype(np.int32)
            ctxs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names))
            qids = pa.array([qid for qid, *_ in rows], hits["qid"].type)
            asked = pa.array([question for _, question, _ in rows], pa.string())
            return pa.RecordBatch.from_arrays([qids, asked, ctxs], ["qid", "question", "negative_ctxs"])

        rows, room = [], _BATCH_BYTES
        for qid, ctxs in found.items():
            ranks = [rank for rank, *_ in ctxs]
            if len(set(ranks)) < len(ranks):
                ctxs.sort(key=lambda c: (c[0], order(c[1]), c[2] is not None, c[2] or 0.0))
            for question in questions.get(qid, ()):
                rows.append((qid, question, ctxs))
                room -= sum(int(size[i]) for _, i, _ in ctxs)
                if room <= 0:
                    yield batch_of(rows)
                    rows, room = [], _BATCH_BYTES
        if rows:
            yield batch_of(rows)

    return run


def hard_negatives(
    gold: DataFrame,
    hits: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    scorer: PairScorer = overlap_score,
    max_score: float = RELEVANT_SCORE,
) -> DataFrame:
    """``(qid, pid, pair_score)``: the best hit where it is not the gold and
    scores below the bar.

    The score guards against false negatives: a hit the pair scorer calls
    relevant is not used. No hit below the first is looked at.
    """
    full = _hard_passages(gold, hits, queries, corpus, scorer, max_score)
    return full.select("qid", "pid", "pair_score")


def _hard_passages(gold, hits, queries, corpus, scorer, max_score) -> DataFrame:
    """:func:`hard_negatives` with title and text, which are joined once."""
    top = negative_hits(gold, hits.where(F.col("rank") == 1)).select("qid", "pid")
    full = _scored(top, queries, corpus, ["title", "text"], scorer, "pair_score")
    return full.where(F.col("pair_score") < max_score)


def _scored(
    pairs: DataFrame, queries: DataFrame, corpus: DataFrame, fields: list[str], scorer: PairScorer, out: str
) -> DataFrame:
    """Pairs with fields of their passage and the pair score of its text and the query's.

    The questions travel to the passages, which are longer.
    """
    asked = queries.select("qid", F.col("text").alias("_q"))
    prepare = getattr(scorer, "prepare", None)
    if prepare is not None:  # what a scorer makes of a text is made once for each passage
        corpus, scorer = corpus.withColumn("_ready", prepare(F.col("text"))), scorer.score_prepared
    text = "text" if prepare is None else "_ready"
    held = [*fields, *({text} - set(fields))]
    full = attach_passages(pairs.join(asked, "qid"), corpus, held)
    score = F.round(scorer(F.col("_q"), F.col(text)).cast("double"), 6)
    return full.withColumn(out, score).drop("_q", *(set(held) - set(fields)))


def mine_hard_negative(
    gold: DataFrame,
    hits: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    scorer: PairScorer = overlap_score,
    max_score: float = RELEVANT_SCORE,
) -> DataFrame:
    """``(qid, question, hard_negative_ctxs)`` for every judged query.

    The list is empty where :func:`hard_negatives` finds none.
    """
    full = _hard_passages(gold, hits, queries, corpus, scorer, max_score)
    ctxs = full.select("qid", F.array(F.struct("title", "text")).alias("_c"))
    asked = queries.select("qid", F.col("text").alias("question"))
    empty = F.expr("cast(array() as array<struct<title:string,text:string>>)")
    return (
        gold.select("qid")
        .join(asked, "qid")
        .join(ctxs, "qid", "left")
        .select("qid", "question", F.coalesce("_c", empty).alias("hard_negative_ctxs"))
    )
