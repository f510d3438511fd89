"""Dataset construction: corpus, queries, judgements, splits, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from findry.functions.text import parse_id
from findry.operators import dataset, indexing, stats
from findry.operators.training import sample_mixture
from findry.session import scratch_path
from findry.plans.registry import (
    CORPUS_SQL,
    GOLD_SQL,
    SOURCE_SQL,
    digest_sql,
    query,
    source_rows,
    table,
    titled_dataset,
    uniform_sql,
)


@query(
    "build_corpus",
    f"WITH {CORPUS_SQL} SELECT pid, title, md5(text) AS digest, source, ord FROM corpus",
)
def _corpus(spark, sf):
    corpus = dataset.build_corpus(source_rows(spark, sf))
    return corpus.select("pid", "title", F.md5("text").alias("digest"), "source", "ord")


@query("build_queries", f"WITH {CORPUS_SQL} SELECT qid, text, ord FROM queries")
def _queries(spark, sf):
    return dataset.build_queries(source_rows(spark, sf))


@query("build_qrels", f"WITH {CORPUS_SQL} SELECT qid, pid, score, ord FROM qrels")
def _qrels(spark, sf):
    return titled_dataset(spark, sf)[2]


@query(
    "build_distinct_qrels",
    f"WITH {CORPUS_SQL} SELECT qid, pid, min(ord) AS ord FROM qrels GROUP BY qid, pid",
)
def _distinct_qrels(spark, sf):
    src = source_rows(spark, sf)
    corpus, queries = dataset.build_corpus(src), dataset.build_queries(src)
    return dataset.build_qrels(src, queries, corpus, distinct=True).select("qid", "pid", "ord")


@query(
    "group_qrels",
    f"""WITH {CORPUS_SQL}
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord) - 1 AS place, pid FROM qrels""",
)
def _group_qrels(spark, sf):
    return dataset.drop_unjudged(dataset.group_qrels(titled_dataset(spark, sf)[2]))


@query("first_gold", f"WITH {CORPUS_SQL}, {GOLD_SQL} SELECT qid, gold FROM gold")
def _first_gold(spark, sf):
    return dataset.first_gold(titled_dataset(spark, sf)[2])


@query("passages_per_title", f"WITH {SOURCE_SQL} SELECT title, count(*) AS n FROM src GROUP BY title")
def _group_sizes(spark, sf):
    return dataset.group_sizes(source_rows(spark, sf), "title")


@query(
    "queries_per_passage",
    f"WITH {CORPUS_SQL} SELECT pid, count(*) AS n FROM (SELECT DISTINCT qid, pid FROM qrels) GROUP BY pid",
)
def _queries_per_passage(spark, sf):
    pairs = titled_dataset(spark, sf)[2].select("qid", "pid").distinct()
    return dataset.group_sizes(pairs, "pid")


def _describe_sql(source: str, column: str) -> str:
    stats_list = [
        ("count", f"count({column})::DOUBLE"),
        ("mean", f"avg({column})"),
        ("std", f"stddev_samp({column})"),
        ("min", f"min({column})::DOUBLE"),
        ("p25", f"quantile_cont({column}::DOUBLE, 0.25)"),
        ("p50", f"quantile_cont({column}::DOUBLE, 0.5)"),
        ("p75", f"quantile_cont({column}::DOUBLE, 0.75)"),
        ("max", f"max({column})::DOUBLE"),
    ]
    parts = [f"SELECT '{n}' AS stat, round({e}, 6) AS value FROM {source}" for n, e in stats_list]
    return "\nUNION ALL ".join(parts)


@query(
    "describe_group_sizes",
    f"WITH {SOURCE_SQL}, sizes AS (SELECT title, count(*) AS n FROM src GROUP BY title)\n"
    + _describe_sql("sizes", "n"),
)
def _describe_sizes(spark, sf):
    sizes = dataset.group_sizes(source_rows(spark, sf), "title")
    return stats.describe(sizes, "n").select("stat", F.round("value", 6).alias("value"))


@query("describe_lengths", _describe_sql("documents", "n_chars"))
def _describe_lengths(spark, sf):
    rows = stats.describe(table(spark, sf, "documents"), "n_chars")
    return rows.select("stat", F.round("value", 6).alias("value"))


def _split_sql(test: float, dev: float) -> str:
    return f"""
ranked AS (
  SELECT qid, pid, ord, row_number() OVER (ORDER BY {digest_sql("7", "ord")}) AS r,
         count(*) OVER () AS n FROM qrels),
cut AS (
  SELECT *, ceil(round(n * {test}, 9)) AS n_test,
         ceil(round((n - ceil(round(n * {test}, 9))) * {dev}, 9)) AS n_dev FROM ranked),
split AS (
  SELECT qid, pid, ord, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_dev THEN 'dev'
                        ELSE 'train' END AS split FROM cut)"""


@query(
    "split_pairs",
    f"WITH {CORPUS_SQL}, {_split_sql(0.3, 0.2)} SELECT qid, pid, ord, split FROM split",
)
def _split(spark, sf):
    qrels = titled_dataset(spark, sf)[2]
    split = indexing.split_rows(qrels, ["ord"], 0.3, 0.2, 7)
    return split.select("qid", "pid", "ord", "split")


@query(
    "dataset_card",
    f"""WITH {CORPUS_SQL}, {_split_sql(0.2, 0.2)}
SELECT 'corpus' AS name, count(*) AS n FROM corpus
UNION ALL SELECT 'queries', count(*) FROM queries
UNION ALL SELECT 'distinct_questions', count(DISTINCT text) FROM queries
UNION ALL SELECT 'pairs', count(*) FROM split
UNION ALL SELECT 'judged_queries', count(DISTINCT qid) FROM split
UNION ALL SELECT split || '_pairs', count(*) FROM split GROUP BY split
UNION ALL SELECT split || '_queries', count(DISTINCT qid) FROM split GROUP BY split""",
)
def _card(spark, sf):
    corpus, queries, qrels = titled_dataset(spark, sf)
    split = indexing.split_rows(qrels, ["ord"], 0.2, 0.2, 7)
    return dataset.dataset_card(corpus, queries, split, "split")


@query(
    "assign_shards",
    """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, least(i // (n // 7), 6)::INT AS contiguous,
  (CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1)
        ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS even,
  ((i + 1) % 7)::INT AS round_robin
FROM d""",
)
def _shards(spark, sf):
    out = table(spark, sf, "documents").select("doc_id")
    for mode in ("contiguous", "even", "round_robin"):
        out = indexing.assign_shard(out, ["doc_id"], 7, mode, mode)
    return out


@query(
    "build_examples",
    f"""WITH {CORPUS_SQL}
SELECT q.qid, md5(q.text) AS question, row_number() OVER (PARTITION BY q.qid ORDER BY r.ord) - 1 AS place,
  pid, md5(c.title || '|' || c.text) AS digest
FROM qrels r JOIN queries q USING (qid) JOIN corpus c USING (pid)""",
)
def _examples(spark, sf):
    corpus, queries, qrels = titled_dataset(spark, sf)
    examples = dataset.build_examples(qrels, queries, corpus)
    digest = F.md5(F.concat("title", F.lit("|"), "text")).alias("digest")
    return examples.select("qid", F.md5("question").alias("question"), "place", "pid", digest)


@query(
    "union_tables",
    """
SELECT item_id, NULL::BIGINT AS doc_id, NULL AS lang, md5(text) AS digest FROM benchmark
UNION ALL SELECT NULL, doc_id, lang, md5(text) FROM documents""",
)
def _union(spark, sf):
    items = table(spark, sf, "benchmark")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    union = dataset.union_tables(items, docs)
    return union.select("item_id", "doc_id", "lang", F.md5("text").alias("digest"))


@query(
    "sample_rows",
    f"SELECT doc_id FROM documents ORDER BY {digest_sql('3', 'doc_id')} LIMIT 25",
)
def _sample(spark, sf):
    return indexing.sample_n(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 25, 3)


@query(
    "shuffle_rows",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {digest_sql('5-2', 'doc_id')}) - 1 AS place
FROM documents""",
)
def _shuffle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    path = scratch_path(spark, "shuffled")
    indexing.shuffle_rows(docs, ["doc_id"], 5, epoch=2).write.parquet(path)
    # the order is that of the rows in the files
    stored = spark.read.parquet(path).select("doc_id", "_metadata.file_name", "_metadata.row_index")
    placed = indexing.dense_index(stored, ["file_name", "row_index"], "place")
    return placed.select("doc_id", "place")


@query(
    "order_by_numeric_id",
    f"""WITH {CORPUS_SQL}
SELECT qid, text, row_number() OVER (ORDER BY substring(qid, 2)::BIGINT) - 1 AS place FROM queries""",
)
def _order_by_id(spark, sf):
    queries = titled_dataset(spark, sf)[1]
    numbered = queries.withColumn("n", parse_id(F.col("qid")))
    return indexing.dense_index(numbered, ["n"], "place").select("qid", "text", "place")


@query(
    "mixture_weights",
    """
WITH s AS (SELECT lang AS dataset, count(*) AS n FROM documents GROUP BY lang),
p AS (SELECT dataset, n, pow(n / sum(n) OVER (), 0.5) AS p FROM s)
SELECT dataset, n, round(p / sum(p) OVER (), 6) AS weight FROM p""",
)
def _mixture_weights(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("dataset"))
    weights = stats.mixture_weights(docs, 0.5)
    return weights.select("dataset", "n", F.round("weight", 6).alias("weight"))


@query(
    "sample_mixture",
    f"""
WITH s AS (SELECT lang AS dataset, count(*) AS n FROM documents GROUP BY lang),
p AS (SELECT dataset, n, pow(n / sum(n) OVER (), 0.5) AS p FROM s),
w AS (SELECT dataset, n, sum(p) OVER (ORDER BY dataset) / sum(p) OVER () AS hi,
             (sum(p) OVER (ORDER BY dataset) - p) / sum(p) OVER () AS lo FROM p),
rows AS (SELECT lang AS dataset, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
nums AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS draw FROM documents),
draws AS (SELECT draw, {uniform_sql('9-set', 'draw')} AS u, {uniform_sql('9-row', 'draw')} AS v FROM nums)
SELECT d.draw, r.dataset, r.doc_id
FROM draws d JOIN w ON d.u >= w.lo AND d.u < w.hi JOIN rows r ON r.dataset = w.dataset AND r.i = floor(d.v * w.n)""",
)
def _sample_mixture(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("dataset"), "doc_id")
    weights = stats.mixture_weights(docs, 0.5)
    return sample_mixture(docs, weights, docs.count(), 9, ["doc_id"]).select("draw", "dataset", "doc_id")
