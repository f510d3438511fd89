"""Lexical and vector search, mining and judgement filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from findry.functions.text import char_ngrams, coverage_score, overlap_score, simple_tokens
from findry.functions.vectors import l2_normalize
from findry.operators import dataset, lexical, mining, vector
from findry.operators.blockwise import top_k
from findry.operators.embed import embed
from findry.operators.stats import describe
from findry.plans.dataset import _describe_sql
from findry.plans.registry import (
    CORPUS_SQL,
    GOLD_SQL,
    bm25_sql,
    digest_sql,
    dot_sql,
    query,
    table,
    titled_dataset,
    tokens_sql,
)
from findry.plans.text import _answer_sql
from findry.session import materialize, scratch_path


def vectors(spark, sf, name="pid"):
    """``(pid, embedding, label)``."""
    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias(name), "embedding", "label")


def lexical_case(spark, sf):
    """Titles as queries over the bodies: corpus, queries, qrels and BM25 top 10."""
    corpus, queries, qrels = titled_dataset(spark, sf)
    index = lexical.build_index(corpus.select("pid", "text"))
    hits = materialize(lexical.bm25_search(queries.select("qid", "text"), index, 10))
    return corpus, queries, qrels, hits


LEXICAL_SQL = f"{CORPUS_SQL}, {GOLD_SQL}, {bm25_sql(10)}"


_BENCH_SQL = """corpus AS (SELECT doc_id AS pid, text FROM documents),
queries AS (SELECT item_id AS qid, text FROM benchmark)"""


def _bench(spark, sf):
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return corpus, queries


@query(
    "term_index",
    f"""WITH corpus AS (SELECT doc_id AS pid, text FROM documents), {bm25_sql().split("doc_freq")[0].strip().rstrip(",")}
SELECT p.pid, p.term, p.tf, l.dl::BIGINT AS dl FROM postings p JOIN doc_len l USING (pid)""",
)
def _term_index(spark, sf):
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    postings = lexical.build_index(corpus).postings()
    return postings.select(
        "pid", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl")
    )


@query(
    "term_lookup",
    f"""WITH corpus AS (SELECT doc_id AS pid, text FROM documents), {bm25_sql().split("doc_freq")[0].strip().rstrip(",")},
wanted AS (SELECT term FROM (SELECT DISTINCT item_id, unnest({tokens_sql("text")}) AS term FROM benchmark)
  GROUP BY term ORDER BY count(*) DESC, term LIMIT 20)
SELECT p.pid, p.term, p.tf, l.dl::BIGINT AS dl FROM postings p JOIN doc_len l USING (pid) JOIN wanted USING (term)""",
)
def _term_lookup(spark, sf):
    corpus, queries = _bench(spark, sf)
    words = queries.select("qid", F.explode(F.array_distinct(simple_tokens(F.col("text")))).alias("term"))
    common = words.groupBy("term").count().orderBy(F.desc("count"), "term").limit(20)
    found = lexical.build_index(corpus).lookup([r["term"] for r in common.collect()])
    return found.select(
        "pid", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl")
    )


@query(
    "bm25_search_two_passes",
    f"WITH {_BENCH_SQL}, {bm25_sql(10)} SELECT qid, pid, score, rank::INT AS rank FROM hits",
)
def _bm25_two_passes(spark, sf):
    corpus, queries = _bench(spark, sf)
    index = lexical.build_index(corpus)
    return lexical.bm25_search(queries, index, 10, direct_blocks=0)


@query(
    "term_frequencies",
    f"""SELECT term, count(*) AS df FROM (
  SELECT DISTINCT doc_id, unnest({tokens_sql("text")}) AS term FROM documents) GROUP BY term""",
)
def _vocabulary(spark, sf):
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    return lexical.build_index(corpus).vocabulary


@query(
    "bm25_search", f"WITH {_BENCH_SQL}, {bm25_sql(10)} SELECT qid, pid, score, rank::INT AS rank FROM hits"
)
def _bm25(spark, sf):
    corpus, queries = _bench(spark, sf)
    return lexical.bm25_search(queries, lexical.build_index(corpus), 10)


def _bigram_sql(expr: str) -> str:
    grams = "CASE WHEN length(t) <= 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END"
    return f"flatten(list_transform({tokens_sql(expr)}, lambda t: {grams}))"


@query(
    "bm25_search_bigrams",
    f"WITH {_BENCH_SQL}, {bm25_sql(5, _bigram_sql)} SELECT qid, pid, score, rank::INT AS rank FROM hits",
)
def _bm25_bigrams(spark, sf):
    corpus, queries = _bench(spark, sf)
    grams = char_ngrams(2)
    index = lexical.build_index(corpus, tokenizer=grams)
    return lexical.bm25_search(queries, index, 5, tokenizer=grams)


@query(
    "bm25_title_search", f"WITH {LEXICAL_SQL} SELECT qid, pid, score, rank::INT AS rank FROM hits"
)
def _bm25_titles(spark, sf):
    return lexical_case(spark, sf)[3]


@query(
    "bm25_hits_with_passages",
    f"""WITH {LEXICAL_SQL}
SELECT h.qid, h.rank::INT AS rank, h.pid, c.title, md5(c.text) AS digest
FROM hits h LEFT JOIN corpus c USING (pid)""",
)
def _hits_with_passages(spark, sf):
    corpus, _, _, hits = lexical_case(spark, sf)
    full = dataset.attach_passages(hits, corpus)
    return full.select("qid", "rank", "pid", "title", F.md5("text").alias("digest"))


@query(
    "stored_fields_of_hits",
    f"""WITH {LEXICAL_SQL}
SELECT h.qid, h.rank::INT AS rank, c.source FROM hits h JOIN corpus c USING (pid)""",
)
def _output_fields(spark, sf):
    corpus, _, _, hits = lexical_case(spark, sf)
    return dataset.attach_passages(hits, corpus, ["source"], on_missing="drop").select(
        "qid", "rank", "source"
    )


# -- judgement filters and mining -------------------------------------------


@query(
    "gold_rank",
    f"""WITH {LEXICAL_SQL}
SELECT g.qid, g.gold, h.rank::INT AS gold_rank,
       CASE WHEN h.rank IS NULL THEN 'high_semantic' ELSE 'high_lexical' END AS kind
FROM gold g LEFT JOIN hits h ON h.qid = g.qid AND h.pid = g.gold""",
)
def _split_by_hit(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    return mining.split_by_lexical_hit(dataset.first_gold(qrels), hits)


@query(
    "gold_rank_statistics",
    f"""WITH {LEXICAL_SQL},
ranks AS (SELECT h.rank FROM gold g JOIN hits h ON h.qid = g.qid AND h.pid = g.gold)
{_describe_sql("ranks", "rank")}""",
)
def _gold_rank_stats(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    ranks = mining.gold_ranks(dataset.first_gold(qrels), hits)
    return describe(ranks, "gold_rank").select("stat", F.round("value", 6).alias("value"))


@query(
    "strict_filter",
    f"""WITH {LEXICAL_SQL}
SELECT qid, gold FROM gold g WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = g.qid AND h.pid <> g.gold)""",
)
def _strict(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    return mining.strict_filter(dataset.first_gold(qrels), hits)


@query(
    "strict_filter_of_rare_words",
    f"""WITH corpus AS (SELECT doc_id AS pid, text FROM documents),
held AS (SELECT DISTINCT pid, unnest({tokens_sql("text")}) AS term FROM corpus),
counted AS (SELECT term, count(*) AS n FROM held GROUP BY term),
queries AS (SELECT pid AS qid, term AS text FROM (
  SELECT pid, term, row_number() OVER (PARTITION BY pid ORDER BY n, term) AS r FROM held JOIN counted USING (term))
  WHERE r = 1), {bm25_sql(10)}
SELECT qid, qid AS gold FROM queries q WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = q.qid AND h.pid <> q.qid)""",
)
def _strict_rare(spark, sf):
    # each document is asked for by its rarest word; copies find each other
    corpus, _ = _bench(spark, sf)
    index = lexical.build_index(corpus)
    words = index.postings().select("pid", "term").join(index.vocabulary, "term")
    rarest = words.groupBy("pid").agg(F.min(F.struct("df", "term")).alias("best"))
    queries = materialize(rarest.select(F.col("pid").alias("qid"), F.col("best.term").alias("text")))
    hits = lexical.bm25_search(queries, index, 10)
    return mining.strict_filter(queries.select("qid", F.col("qid").alias("gold")), hits)


@query(
    "strict_filter_on_first_hit",
    f"""WITH {LEXICAL_SQL}
SELECT qid, gold FROM gold g
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = g.qid AND h.rank = 1 AND h.pid <> g.gold)""",
)
def _strict_first(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    return mining.strict_filter(dataset.first_gold(qrels), hits.where(F.col("rank") == 1))


@query(
    "unfiltered_sample",
    f"""WITH {LEXICAL_SQL},
kept AS (SELECT qid FROM gold g
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = g.qid AND h.rank = 1 AND h.pid <> g.gold))
SELECT qid FROM (SELECT DISTINCT qid FROM qrels) WHERE qid NOT IN (SELECT qid FROM kept)
ORDER BY {digest_sql("11", "qid")} LIMIT 10""",
)
def _anti_sample(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    kept = mining.strict_filter(dataset.first_gold(qrels), hits.where(F.col("rank") == 1))
    return mining.anti_sample(qrels, kept, 10, 11)


def _coverage_sql(q: str, t: str) -> str:
    words = f"list_distinct({_answer_sql(q)})"
    return f"len(list_intersect({words}, {_answer_sql(t)}))::DOUBLE / greatest(len({words}), 1)"


_SCORED_SQL = f"""WITH {LEXICAL_SQL},
scored_pairs AS (
  SELECT g.qid, g.gold AS pid, round({_coverage_sql("q.text", "c.text")}, 6) AS pair_score
  FROM gold g JOIN queries q USING (qid) JOIN corpus c ON c.pid = g.gold)"""


def _scored_gold(spark, sf):
    corpus, queries, qrels = titled_dataset(spark, sf)
    gold = dataset.first_gold(qrels).select("qid", F.col("gold").alias("pid"))
    return mining.score_pairs(gold, queries, corpus, coverage_score)


@query(
    "filter_judged_pairs",
    f"{_SCORED_SQL} SELECT qid, pid, pair_score FROM scored_pairs WHERE pair_score >= 0.9",
)
def _filter_pairs(spark, sf):
    return mining.filter_pairs(_scored_gold(spark, sf)).select("qid", "pid", "pair_score")


@query(
    "filter_judged_pairs_report",
    f"""{_SCORED_SQL} SELECT count(*) FILTER (WHERE pair_score >= 0.9) AS kept,
 count(*) FILTER (WHERE NOT pair_score >= 0.9) AS dropped FROM scored_pairs""",
)
def _filter_report(spark, sf):
    return mining.filter_report(_scored_gold(spark, sf))


@query(
    "mine_negatives",
    f"""WITH {LEXICAL_SQL}
SELECT h.qid, q.text AS question, string_agg(md5(c.title || '|' || c.text), ',' ORDER BY h.rank) AS negatives
FROM hits h JOIN gold g ON g.qid = h.qid AND g.gold <> h.pid JOIN corpus c ON c.pid = h.pid
     JOIN queries q ON q.qid = h.qid GROUP BY h.qid, q.text""",
)
def _mine(spark, sf):
    corpus, queries, qrels, hits = lexical_case(spark, sf)
    mined = mining.mine_negatives(dataset.first_gold(qrels), hits, queries, corpus)
    digest = F.transform("negative_ctxs", lambda c: F.md5(F.concat(c["title"], F.lit("|"), c["text"])))
    return mined.select("qid", "question", F.array_join(digest, ",").alias("negatives"))


@query(
    "mine_scored_negatives",
    f"""WITH {LEXICAL_SQL}
SELECT h.qid, md5(c.title || '|' || c.text) AS digest, round({_coverage_sql("q.text", "c.text")}, 6) AS ce_score
FROM hits h JOIN gold g ON g.qid = h.qid AND g.gold <> h.pid JOIN corpus c ON c.pid = h.pid
     JOIN queries q ON q.qid = h.qid""",
)
def _mine_scored(spark, sf):
    corpus, queries, qrels, hits = lexical_case(spark, sf)
    mined = mining.mine_negatives(
        dataset.first_gold(qrels), hits, queries, corpus, coverage_score
    )
    return mined.select("qid", F.inline("negative_ctxs")).select(
        "qid", F.md5(F.concat("title", F.lit("|"), "text")).alias("digest"), "ce_score"
    )


_HARD_SQL = f"""WITH {LEXICAL_SQL},
hard AS (
  SELECT h.qid, h.pid, md5(c.title || '|' || c.text) AS digest,
         round({_coverage_sql("q.text", "c.text")}, 6) AS pair_score
  FROM hits h JOIN gold g ON g.qid = h.qid AND g.gold <> h.pid JOIN corpus c ON c.pid = h.pid
       JOIN queries q ON q.qid = h.qid WHERE h.rank = 1),
kept AS (SELECT * FROM hard WHERE pair_score < 0.9)"""


@query("hard_negatives", f"{_HARD_SQL} SELECT qid, pid, pair_score FROM kept")
def _hard(spark, sf):
    corpus, queries, qrels, hits = lexical_case(spark, sf)
    return mining.hard_negatives(
        dataset.first_gold(qrels), hits, queries, corpus, coverage_score
    )


@query(
    "mine_hard_negative",
    f"{_HARD_SQL} SELECT g.qid, coalesce(k.digest, '') AS hard FROM gold g LEFT JOIN kept k USING (qid)",
)
def _mine_hard(spark, sf):
    corpus, queries, qrels, hits = lexical_case(spark, sf)
    mined = mining.mine_hard_negative(
        dataset.first_gold(qrels), hits, queries, corpus, coverage_score
    )
    digest = F.transform(
        "hard_negative_ctxs", lambda c: F.md5(F.concat(c["title"], F.lit("|"), c["text"]))
    )
    return mined.select("qid", F.array_join(digest, ",").alias("hard"))


@query(
    "pair_overlap_score",
    f"""WITH {CORPUS_SQL}, {GOLD_SQL},
pair AS (SELECT g.qid, g.gold, {_answer_sql("q.text")} AS a, {_answer_sql("c.text")} AS b
         FROM gold g JOIN queries q USING (qid) JOIN corpus c ON c.pid = g.gold),
p AS (SELECT qid, w, count(*) AS c FROM (SELECT qid, unnest(a) AS w FROM pair) GROUP BY ALL),
t AS (SELECT qid, w, count(*) AS c FROM (SELECT qid, unnest(b) AS w FROM pair) GROUP BY ALL),
same AS (SELECT qid, sum(least(p.c, t.c)) AS s FROM p JOIN t USING (qid, w) GROUP BY qid)
SELECT qid, gold AS pid, round(coalesce(2 * (s / len(a)) * (s / len(b)) / (s / len(a) + s / len(b)), 0), 6) AS pair_score
FROM pair LEFT JOIN same USING (qid)""",
)
def _overlap(spark, sf):
    corpus, queries, qrels = titled_dataset(spark, sf)
    gold = dataset.first_gold(qrels).select("qid", F.col("gold").alias("pid"))
    scored = mining.score_pairs(gold, queries, corpus, overlap_score)
    return scored.select("qid", "pid", "pair_score")


@query(
    "attach_mined_negatives",
    f"""WITH {LEXICAL_SQL},
mined AS (SELECT h.qid, string_agg(md5(c.title || '|' || c.text), ',' ORDER BY h.rank) AS d
  FROM hits h JOIN gold g ON g.qid = h.qid AND g.gold <> h.pid JOIN corpus c ON c.pid = h.pid GROUP BY h.qid),
positives AS (SELECT r.qid, string_agg(md5(c.title || '|' || c.text), ',' ORDER BY r.ord, r.pid) AS d
  FROM qrels r JOIN corpus c ON c.pid = r.pid GROUP BY r.qid)
SELECT q.text AS question, p.d AS positives, coalesce(m.d, '') AS negatives
FROM queries q JOIN positives p USING (qid) LEFT JOIN mined m USING (qid)""",
)
def _attach_negatives(spark, sf):
    corpus, queries, qrels, hits = lexical_case(spark, sf)
    examples = dataset.nest_examples(dataset.build_examples(qrels, queries, corpus))
    mined = mining.mine_negatives(dataset.first_gold(qrels), hits, queries, corpus)
    full = dataset.attach_negatives(examples, mined)

    def digest(ctxs: str):
        each = F.transform(ctxs, lambda c: F.md5(F.concat(c["title"], F.lit("|"), c["text"])))
        return F.coalesce(F.array_join(each, ","), F.lit("")).alias(ctxs.split("_")[0] + "s")

    return full.select("question", digest("positive_ctxs"), digest("negative_ctxs"))


@query(
    "restrict_examples",
    f"""WITH {LEXICAL_SQL}
SELECT DISTINCT q.text AS question FROM gold g JOIN hits h ON h.qid = g.qid AND h.pid = g.gold
JOIN queries q ON q.qid = g.qid""",
)
def _restrict(spark, sf):
    corpus, queries, qrels, hits = lexical_case(spark, sf)
    split = mining.split_by_lexical_hit(dataset.first_gold(qrels), hits)
    easy = split.where(F.col("kind") == "high_lexical")
    kept = queries.join(easy, "qid", "left_semi")
    examples = dataset.build_examples(qrels, queries, corpus)
    return dataset.distinct_questions(dataset.restrict_examples(examples, kept))


# -- vector search -----------------------------------------------------------


def _knn_sql(k: int, score: str, where: str = "true") -> str:
    return f"""
SELECT qid, pid, score, rank::INT AS rank FROM (
  SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank
  FROM (SELECT q.vec_id AS qid, p.vec_id AS pid, round({score}, 6) AS score
        FROM embeddings q CROSS JOIN embeddings p WHERE {where}))
WHERE rank <= {k}"""


_DOT = dot_sql("q.embedding", "p.embedding")
_NORM = "sqrt({0}) * sqrt({1})".format(
    dot_sql("q.embedding", "q.embedding"), dot_sql("p.embedding", "p.embedding")
)


@query("knn_dot", _knn_sql(10, _DOT))
def _knn(spark, sf):
    return vector.knn_join(vectors(spark, sf, "qid"), vectors(spark, sf), 10)


@query("knn_cosine", _knn_sql(5, f"({_DOT}) / ({_NORM})"))
def _knn_cosine(spark, sf):
    return vector.knn_join(vectors(spark, sf, "qid"), vectors(spark, sf), 5, metric="cos")


@query("knn_dot_blocked", _knn_sql(10, _DOT))
def _knn_blocked(spark, sf):
    queries, items = vectors(spark, sf, "qid"), vectors(spark, sf)
    return vector.knn_join(queries, items, 10, bound=200)


@query(
    "l2_normalize",
    f"""SELECT vec_id, unnest(range(len(embedding)))::INT AS place, round(unnest(embedding)::DOUBLE /
  sqrt({dot_sql("embedding", "embedding")}), 6) AS x FROM embeddings""",
)
def _l2(spark, sf):
    unit = vectors(spark, sf).select("pid", l2_normalize(F.col("embedding")).alias("u"))
    places = unit.select(F.col("pid").alias("vec_id"), F.posexplode("u").alias("place", "x"))
    return places.withColumn("x", F.round("x", 6))


@query(
    "fetch_vectors",
    """SELECT vec_id AS pid, unnest(range(len(embedding)))::INT AS place, unnest(embedding)::DOUBLE AS value
FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _fetch(spark, sf):
    wanted = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("pid"))
    found = vector.fetch_vectors(vectors(spark, sf), wanted)
    places = found.select("pid", F.posexplode("embedding").alias("place", "value"))
    return places.withColumn("value", F.col("value").cast("double"))


@query(
    "rerank_hits",
    f"""WITH first AS ({_knn_sql(20, _DOT)}),
again AS (
  SELECT f.qid, f.pid, round({dot_sql("n.embedding", "p.embedding")}, 6) AS score
  FROM first f JOIN embeddings n ON n.vec_id = f.qid + 1 JOIN embeddings p ON p.vec_id = f.pid)
SELECT qid, pid, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM again)
WHERE rank <= 5""",
)
def _rerank(spark, sf):
    items = vectors(spark, sf)
    first = vector.knn_join(vectors(spark, sf, "qid"), items, 20)
    # the further question of query n is vector n + 1
    further = items.select((F.col("pid") - 1).alias("qid"), "embedding")
    return vector.rerank(first, further, items, 5)


@query("ivf_search_all_cells", _knn_sql(10, _DOT))
def _ivf_all(spark, sf):
    items = vectors(spark, sf)
    index = vector.build_ivf(items.select("pid", "embedding"), nlist=8, rounds=5)
    # small blocks: the form that many queries take
    queries = vectors(spark, sf, "qid")
    return vector.ivf_search(queries, index, 10, nprobe=8, bound=64, item_block=256)


@query("ivf_search_saved_and_appended", _knn_sql(10, _DOT))
def _ivf_saved(spark, sf):
    items, late = vectors(spark, sf), F.col("label") >= 5
    first, second = [items.where(c).select("pid", "embedding") for c in (~late, late)]
    path = scratch_path(spark, "ivf")
    vector.save_ivf(vector.build_ivf(first, nlist=8, rounds=5), path)
    vector.append_vectors(spark, path, second)
    index = vector.load_ivf(spark, path)
    return vector.ivf_search(vectors(spark, sf, "qid"), index, 10, nprobe=8)


@query("ivf_append_and_compact", _knn_sql(10, _DOT))
def _ivf_compacted(spark, sf):
    items, late = vectors(spark, sf).select("pid", "embedding", "label"), F.col("label") >= 5
    path = scratch_path(spark, "ivf")
    # some rows come twice: first with a vector that the later load replaces
    stale = items.where(late & (F.col("pid") % 3 == 0))
    stale = stale.withColumn("embedding", F.transform("embedding", lambda x: -x))
    first = items.where(~late).unionByName(stale).drop("label")
    vector.save_ivf(vector.build_ivf(first, nlist=8, rounds=5), path)
    vector.append_vectors(spark, path, items.where(late).drop("label"))
    vector.compact_ivf(spark, path)
    return vector.ivf_search(vectors(spark, sf, "qid"), vector.load_ivf(spark, path), 10, nprobe=8)


@query(
    "ivf_recall",
    """SELECT count(*) AS queries, true AS nine_in_ten
FROM embeddings WHERE embedding IS NOT NULL""",
)
def _ivf_recall(spark, sf):
    items, queries = vectors(spark, sf).select("pid", "embedding"), vectors(spark, sf, "qid")
    path = scratch_path(spark, "ivf")
    vector.save_ivf(vector.build_ivf(items, nlist=16, rounds=5), path)
    near = vector.ivf_search(queries, vector.load_ivf(spark, path), 10, nprobe=12)
    recall = vector.pooled_hit_recall(near, vector.knn_join(queries, items, 10))
    return near.agg(F.countDistinct("qid").alias("queries")).crossJoin(
        recall.agg((F.avg("recall") >= 0.9).alias("nine_in_ten"))
    )


@query(
    "fields_of_several_runs",
    """SELECT 'good' AS run, l.doc_id AS pid, d.source, md5(d.text) AS digest
FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1
UNION ALL SELECT 'toxic', l.doc_id, d.source, md5(d.text)
FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1""",
)
def _several_runs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "source", "text")
    stored = dataset.store_lookup(docs)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("pid"), "quality", "toxic")
    runs = [("good", "quality"), ("toxic", "toxic")]
    out = None
    for name, column in runs:
        run = labels.where(F.col(column) == 1).select(F.lit(name).alias("qid"), "pid")
        full = dataset.attach_passages(run, stored, ["source", "text"], on_missing="drop")
        full = full.select(F.col("qid").alias("run"), "pid", "source", F.md5("text").alias("digest"))
        out = full if out is None else out.unionByName(full)
    return out


@query(
    "ivf_self_check",
    "SELECT vec_id AS qid, true AS is_self FROM embeddings ORDER BY vec_id LIMIT 3",
)
def _self_check(spark, sf):
    items = vectors(spark, sf).select("pid", "embedding")
    hits = vector.self_check(vector.build_ivf(items, nlist=16, rounds=5), nprobe=16)
    return hits.where("is_self").select("qid", "is_self")


@query("pq_recall")
def _pq_recall(spark, sf):
    items, queries = vectors(spark, sf).select("pid", "embedding"), vectors(spark, sf, "qid")
    index = vector.build_pq(items, 64, n_subquantizers=16, n_bits=4, rounds=3)
    near = vector.pq_search(queries, index, 10)
    return vector.pooled_hit_recall(near, vector.knn_join(queries, items, 10))


_DIM = 64


def _embed_sql(source: str, key: str, dim: int = _DIM) -> str:
    return f"""
w AS (
  SELECT {key}, (('0x' || substr(md5(term), 1, 8))::UBIGINT % {dim})::INT AS slot, 1 + ln(count(*)) AS w
  FROM (SELECT {key}, unnest({tokens_sql("text")}) AS term FROM {source}) GROUP BY {key}, term),
place AS (SELECT {key}, slot, sum(w) AS w FROM w GROUP BY {key}, slot),
norm AS (SELECT {key}, sqrt(sum(w * w)) AS n FROM place GROUP BY {key})"""


@query(
    "embed_documents",
    f"""WITH {_embed_sql("documents", "doc_id")}
SELECT doc_id, string_agg(coalesce(w / n, 0)::DECIMAL(9,6)::VARCHAR, ',' ORDER BY slot) AS vector
FROM (SELECT doc_id, n, unnest(range({_DIM}))::INT AS slot FROM norm) LEFT JOIN place USING (doc_id, slot)
GROUP BY doc_id""",
)
def _embed(spark, sf):
    rows = embed(table(spark, sf, "documents"), "text", dim=_DIM)
    plain = F.transform("embedding", lambda v: v.cast("decimal(9,6)").cast("string"))
    return rows.select("doc_id", F.array_join(plain, ",").alias("vector"))


@query(
    "semantic_search",
    f"""WITH dv AS (WITH {_embed_sql("documents", "doc_id")}
  SELECT doc_id AS pid, slot, w / n AS v FROM place JOIN norm USING (doc_id)),
qv AS (WITH {_embed_sql("benchmark", "item_id")}
  SELECT item_id AS qid, slot, w / n AS v FROM place JOIN norm USING (item_id)),
s AS (SELECT qid, pid, round(sum(q.v * d.v), 6) AS score FROM qv q JOIN dv d USING (slot) GROUP BY qid, pid)
SELECT qid, pid, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s) WHERE rank <= 10""",
)
def _semantic(spark, sf):
    corpus, queries = _bench(spark, sf)
    items = embed(corpus, "text", dim=_DIM)
    return vector.knn_join(embed(queries, "text", dim=_DIM), items, 10)


def _toy_encoder(batches):
    """A stand-in model: character count and mean code point."""
    import pandas as pd

    for texts in batches:
        yield pd.Series(
            [np.array([len(t), np.mean([ord(c) for c in t])], dtype="float32") for t in texts]
        )


@query(
    "embed_with_plugged_encoder",
    "SELECT doc_id, length(text)::DOUBLE AS size FROM documents",
)
def _plugged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = embed(docs, "text", encoder=_toy_encoder, batch_size=64)
    return rows.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("size"))


@query(
    "rank_scores",
    """SELECT user_id AS qid, event_id AS pid, value AS score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
WHERE rank <= 3""",
)
def _rank(spark, sf):
    scores = table(spark, sf, "events").select(
        F.col("user_id").alias("qid"), F.col("event_id").alias("pid"), F.col("value").alias("score")
    )
    return top_k(scores, 3)
