"""Retrieval metrics and vector statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from findry.functions.text import nfd, nfd_all
from findry.operators import dataset, lexical, metrics, stats, vector
from findry.operators.indexing import index_within
from findry.operators.rag import pack_ctxs
from findry.plans.registry import (
    bm25_sql,
    dot_sql,
    query,
    table,
    tokens_sql,
)
from findry.plans.search import LEXICAL_SQL, lexical_case, vectors
from findry.session import materialize

KS = (1, 3, 5, 10, 100)


def metrics_sql(ks=KS, by: str = "") -> str:
    """CTEs from ``run(qid, pid, score)`` and ``judged(qid, pid, rel)`` to ``result``."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"({b}qid)"
    rows, per = [], []
    for k in ks:
        per.append(f"""
  sum(CASE WHEN rank <= {k} THEN coalesce(rel, 0) / log2(rank + 1) ELSE 0 END) AS dcg_{k},
  sum(CASE WHEN rank <= {k} AND rel > 0 THEN nth / rank ELSE 0 END) AS ap_{k},
  sum(CASE WHEN rank <= {k} AND rel > 0 THEN 1 ELSE 0 END) AS found_{k},
  sum(CASE WHEN rank <= {k} AND NOT known THEN 1 ELSE 0 END) AS holes_{k}""")
        both = "seen AND asked"
        n = "count(*) FILTER (WHERE asked)"
        rows += [
            ("NDCG", k, f"avg(dcg_{k} / ideal_{k}) FILTER (WHERE {both})"),
            ("MAP", k, f"avg(ap_{k} / n_rel) FILTER (WHERE {both})"),
            ("Recall", k, f"avg(found_{k} / n_rel) FILTER (WHERE {both})"),
            ("P", k, f"avg(found_{k} / {k}) FILTER (WHERE {both})"),
            ("MRR", k, f"sum(CASE WHEN first <= {k} THEN 1 / first ELSE 0 END) FILTER (WHERE {both}) / {n}"),
            ("R_cap", k, f"sum(found_{k} / least(n_rel, {k})) FILTER (WHERE {both}) / {n}"),
            ("Hole", k, f"sum(holes_{k} / {k}) FILTER (WHERE seen) / {n}"),
        ]
    ideals = ", ".join(
        f"sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) ELSE 0 END) AS ideal_{k}" for k in ks
    )
    union = "\n  UNION ALL ".join(
        f"SELECT {b}'{m}' AS metric, {k} AS k, round(coalesce({e}, 0) * 100, 3) AS value FROM per_query {group}"
        for m, k, e in rows
    )
    return f"""
top_run AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {b}qid ORDER BY score DESC, pid) AS rank
    FROM run WHERE pid::VARCHAR <> qid::VARCHAR) WHERE rank <= {max(ks)}),
graded AS (
  SELECT t.*, j.rel, sum(CASE WHEN j.rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {b}qid ORDER BY rank) AS nth,
         a.pid IS NOT NULL AS known
  FROM top_run t LEFT JOIN judged j USING ({b}qid, pid)
       LEFT JOIN (SELECT DISTINCT {b}pid FROM judged) a USING ({b}pid)),
ran AS (
  SELECT {b}qid, true AS seen, min(CASE WHEN rel > 0 THEN rank END) AS first, {",".join(per)}
  FROM graded GROUP BY {b}qid),
best AS (
  SELECT {b}qid, true AS asked, count(*) FILTER (WHERE rel > 0) AS n_rel, {ideals}
  FROM (SELECT *, row_number() OVER (PARTITION BY {b}qid ORDER BY rel DESC, pid) AS r FROM judged)
  GROUP BY {b}qid),
per_query AS (SELECT * FROM ran FULL JOIN best USING {on}),
result AS (
  {union})"""


_TITLE_RUN_SQL = f"""WITH {LEXICAL_SQL},
run AS (SELECT qid, pid, score FROM hits),
judged AS (SELECT DISTINCT qid, pid, 1 AS rel FROM qrels)"""


@query("evaluate_bm25", f"{_TITLE_RUN_SQL}, {metrics_sql()} SELECT * FROM result")
def evaluate_bm25(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    return metrics.evaluate_run(hits.select("qid", "pid", "score"), qrels, KS)


_LABEL_RUN_SQL = f"""
dims AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
centre AS (SELECT label, d, avg(x) AS x FROM dims GROUP BY label, d),
centres AS (SELECT label AS qid, list(x ORDER BY d) AS embedding FROM centre GROUP BY label),
run AS (SELECT c.qid, 'V' || e.vec_id AS pid, round({dot_sql("c.embedding", "e.embedding")}, 6) AS score
        FROM centres c CROSS JOIN embeddings e)"""


def label_run(spark, sf, k=100):
    """The mean vector of each label searched over all vectors."""
    items = vectors(spark, sf).withColumn("pid", F.concat(F.lit("V"), F.col("pid")))
    tokens = items.select(
        F.col("label").alias("id"), F.col("pid").alias("pos"), "embedding", F.lit(1).alias("mask")
    )
    centres = stats.pool_vectors(tokens).select(
        F.col("id").alias("qid"), F.col("vector").alias("embedding")
    )
    hits = vector.knn_join(centres, items, k)
    qrels = items.select(
        F.col("label").alias("qid"), "pid", (1 + F.length("pid") % 3).alias("score")
    )
    return hits, qrels


_LABEL_JUDGED_SQL = """judged AS (
  SELECT label AS qid, 'V' || vec_id AS pid, 1 + length('V' || vec_id) % 3 AS rel FROM embeddings)"""


@query(
    "evaluate_knn_graded",
    f"WITH {_LABEL_RUN_SQL}, {_LABEL_JUDGED_SQL}, {metrics_sql()} SELECT * FROM result",
)
def _evaluate_knn(spark, sf):
    hits, qrels = label_run(spark, sf)
    return metrics.evaluate_run(hits, qrels, KS)


@query(
    "evaluate_partly_judged",
    f"""WITH {_LABEL_RUN_SQL},
judged AS (SELECT label AS qid, 'V' || vec_id AS pid, quality AS rel FROM embeddings JOIN labels ON doc_id = vec_id),
{metrics_sql((5, 20))} SELECT * FROM result""",
)
def _evaluate_partly(spark, sf):
    hits, _ = label_run(spark, sf)
    judged = table(spark, sf, "labels").join(vectors(spark, sf), F.col("doc_id") == F.col("pid"))
    qrels = judged.select(
        F.col("label").alias("qid"), F.concat(F.lit("V"), "pid").alias("pid"), F.col("quality").alias("score")
    )
    return metrics.evaluate_run(hits, qrels, (5, 20))


@query(
    "evaluate_one_query",
    f"""WITH {_LABEL_RUN_SQL.replace("FROM centres c CROSS", "FROM (SELECT * FROM centres WHERE qid = 2) c CROSS")},
judged AS (SELECT label AS qid, 'V' || vec_id AS pid, 1 AS rel FROM embeddings WHERE label = 2),
{metrics_sql((1, 10))} SELECT * FROM result""",
)
def _evaluate_one(spark, sf):
    hits, qrels = label_run(spark, sf)
    return metrics.evaluate_query(hits, qrels.withColumn("score", F.lit(1)), 2)


@query(
    "evaluate_many",
    f"""WITH {LEXICAL_SQL},
kinds AS (SELECT q.*, CASE WHEN h.rank IS NULL THEN 'titles/semantic' ELSE 'titles/lexical' END AS dataset
  FROM (SELECT DISTINCT qid, pid FROM qrels) q JOIN gold g USING (qid)
  LEFT JOIN hits h ON h.qid = g.qid AND h.pid = g.gold AND h.rank = 1),
variants AS (SELECT qid, pid, dataset FROM kinds UNION ALL SELECT DISTINCT qid, pid, 'titles/all' FROM qrels),
run AS (SELECT dataset, qid, pid, score FROM hits CROSS JOIN (SELECT DISTINCT dataset FROM variants)),
judged AS (SELECT dataset, qid, pid, 1 AS rel FROM variants),
{metrics_sql((1, 10), "dataset")} SELECT * FROM result""",
)
def _evaluate_many(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    gold = dataset.first_gold(qrels)
    first = hits.where(F.col("rank") == 1)
    found = gold.join(first, (gold.qid == first.qid) & (gold.gold == first.pid), "left_semi")
    pairs = qrels.select("qid", "pid", "score").distinct()
    variants = {
        "titles/all": pairs,
        "titles/lexical": pairs.join(found, "qid", "left_semi"),
        "titles/semantic": pairs.join(found, "qid", "left_anti"),
    }
    return metrics.evaluate_many({"titles": hits}, variants, (1, 10))


# -- answers in contexts ------------------------------------------------------

_FENCE = "' ' || array_to_string({}, ' ') || ' '"
_ANSWER_SQL = f"""WITH corpus AS (SELECT doc_id AS pid, text FROM documents),
queries AS (SELECT item_id AS qid, text FROM benchmark), {bm25_sql(20)},
answered AS (SELECT qid, list_slice(string_split(text, ' '), 2, 3) AS w FROM queries),
answer_hits AS (
  SELECT h.qid, h.rank, contains({_FENCE.format(tokens_sql("nfc_normalize(c.text)"))},
    {_FENCE.format(tokens_sql("nfc_normalize(array_to_string(a.w, ' '))"))}) AS hit
  FROM hits h JOIN corpus c USING (pid) JOIN answered a USING (qid))"""


def answered_results(spark, sf):
    """``(qid, answers, ctxs)``: BM25 top 20 and the second and third word as answer."""
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    hits = lexical.bm25_search(queries, lexical.build_index(corpus), 20)
    plain = corpus.select("pid", F.lit("").alias("title"), nfd(F.col("text")).alias("text"))
    ctxs = pack_ctxs(dataset.attach_passages(hits, plain))
    answer = F.array_join(F.slice(F.split("text", " "), 2, 2), " ")
    answers = queries.select("qid", nfd_all(F.array(answer)).alias("answers"))
    return materialize(ctxs.join(answers, "qid"))


@query("answer_hits", f"{_ANSWER_SQL} SELECT qid, rank::INT AS rank, hit FROM answer_hits")
def _answer_hits(spark, sf):
    return metrics.answer_hits(answered_results(spark, sf))


@query("has_answer_flags", f"{_ANSWER_SQL} SELECT qid, rank::INT AS rank, hit AS hasanswer FROM answer_hits")
def _flags(spark, sf):
    flagged = metrics.add_hasanswer(answered_results(spark, sf))
    rows = flagged.select("qid", F.posexplode("ctxs").alias("i", "c"))
    return rows.select("qid", (F.col("i") + 1).alias("rank"), F.col("c.hasanswer").alias("hasanswer"))


@query(
    "topk_hits",
    f"""{_ANSWER_SQL}, best AS (SELECT qid, min(rank) FILTER (WHERE hit) AS b FROM answer_hits GROUP BY qid)
SELECT k::INT AS k, count(*) FILTER (WHERE b <= k) AS hits FROM range(1, 21) r(k) CROSS JOIN best GROUP BY k""",
)
def _topk_hits(spark, sf):
    return metrics.topk_hits(metrics.answer_hits(answered_results(spark, sf)))


@query(
    "answer_recall",
    f"""{_ANSWER_SQL}, best AS (SELECT qid, min(rank) FILTER (WHERE hit) AS b FROM answer_hits GROUP BY qid)
SELECT k::INT AS k, round(100.0 * count(*) FILTER (WHERE b <= k) / count(*), 6) AS recall
FROM (VALUES (5), (10), (20)) r(k) CROSS JOIN best GROUP BY k""",
)
def _answer_recall(spark, sf):
    hits = materialize(metrics.answer_hits(answered_results(spark, sf)))
    return metrics.answer_recall(hits)


# -- order agreement ----------------------------------------------------------

_ORDER_SQL = """orders_of AS (
  SELECT user_id AS qid,
         row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS pos,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS gold_pos
  FROM events)"""


def two_orders(spark, sf):
    """Each user's events by value and by time."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("qid"), "value", "ts", "event_id")
    placed = index_within(events, "qid", ["value", "event_id"], "pos")
    return index_within(placed, "qid", ["ts", "event_id"], "gold_pos").select(
        "qid", "pos", "gold_pos"
    )


@query(
    "inversions",
    f"""WITH {_ORDER_SQL}
SELECT a.qid, count(*) FILTER (WHERE b.pos > a.pos AND a.gold_pos > b.gold_pos) AS inversions
FROM orders_of a JOIN orders_of b USING (qid) GROUP BY a.qid""",
)
def _inversions(spark, sf):
    return metrics.inversions(two_orders(spark, sf), block=16)


@query(
    "topk_agreement",
    f"""WITH {_ORDER_SQL}
SELECT qid, k, round(avg(CASE WHEN gold_pos < k THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos < k), 6) AS avg_topk,
       coalesce(max(pos + 1) FILTER (WHERE gold_pos < k), count(*)) AS idx_topk
FROM orders_of CROSS JOIN (VALUES (1), (2), (5), (10)) ks(k) GROUP BY qid, k""",
)
def _agreement(spark, sf):
    return metrics.topk_agreement(two_orders(spark, sf), (1, 2, 5, 10))


# -- statistics ---------------------------------------------------------------


@query(
    "weighted_stats",
    """SELECT event_type AS key, round(sum(value * user_id) / sum(user_id), 6) AS mean, sum(user_id)::BIGINT AS weight
FROM events GROUP BY event_type""",
)
def _weighted(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("key"), "value", F.col("user_id").alias("weight")
    )
    return stats.weighted_stats(rows).withColumn("mean", F.round("mean", 6))


@query(
    "pool_vectors",
    """WITH dims AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings)
SELECT label AS id, d::INT AS d, round(avg(x) FILTER (WHERE vec_id % 4 <> 0), 6) AS mean,
       round(arg_min(x, vec_id), 6) AS first FROM dims GROUP BY label, d""",
)
def _pool(spark, sf):
    tokens = vectors(spark, sf).select(
        F.col("label").alias("id"),
        F.col("pid").alias("pos"),
        "embedding",
        (F.col("pid") % 4 != 0).cast("int").alias("mask"),
    )
    mean = stats.pool_vectors(tokens).select("id", F.posexplode("vector").alias("d", "mean"))
    first = stats.pool_vectors(tokens, "cls").select("id", F.posexplode("vector").alias("d", "first"))
    return mean.join(first, ["id", "d"]).select(
        "id", "d", F.round("mean", 6).alias("mean"), F.round(F.col("first").cast("double"), 6).alias("first")
    )


@query(
    "embedding_spread",
    """WITH dims AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings)
SELECT (SELECT count(*) FROM embeddings) AS n, round(avg(s), 6) AS spread
FROM (SELECT stddev_samp(x) AS s FROM dims GROUP BY d)""",
)
def _spread(spark, sf):
    return stats.embedding_spread(vectors(spark, sf)).select("n", F.round("spread", 6).alias("spread"))
