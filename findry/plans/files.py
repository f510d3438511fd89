"""Sources and sinks: tables written by a sink and read back by a source."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findry.operators import dataset, metrics
from findry.operators.indexing import split_rows
from findry.operators.rag import pack_ctxs
from findry.plans.dataset import _split_sql
from findry.plans.measures import _TITLE_RUN_SQL, metrics_sql
from findry.plans.prompts import _HITS_SQL, full_hits
from findry.plans.registry import (
    CORPUS_SQL,
    GOLD_SQL,
    SOURCE_SQL,
    bm25_sql,
    query,
    source_rows,
    table,
    titled_dataset,
)
from findry.plans.search import lexical_case, vectors
from findry.plans.training import TOKENS_SQL, example_rows, token_rows
from findry.session import scratch_path
from findry.sources import readers, writers


def _passages(spark, sf):
    mapping = {"id": "ord", "title": "title", "text": "text", "applicant": "source"}
    rows = dataset.patents_to_passages(source_rows(spark, sf), mapping, fill=".")
    return rows.withColumnRenamed("_id", "pid")


@query(
    "read_passages_jsonl",
    f"""WITH {SOURCE_SQL} SELECT ord::VARCHAR AS pid, title, md5(coalesce(text, '.')) AS digest,
'요약문' AS type, ord::VARCHAR AS patent_id, source AS applicant FROM src""",
)
def _jsonl(spark, sf):
    path = scratch_path(spark, "passages")
    writers.write_passages(_passages(spark, sf), path)
    rows = readers.read_passages(spark, path)
    known = [F.col("metadata")[c].alias(c) for c in ("type", "patent_id", "applicant")]
    return rows.select("pid", "title", F.md5("text").alias("digest"), *known)


@query(
    "read_passages_tsv",
    f"WITH {SOURCE_SQL} SELECT ord::VARCHAR AS pid, title, md5(coalesce(text, '.')) AS digest FROM src",
)
def _tsv(spark, sf):
    path = scratch_path(spark, "passages") + ".tsv"
    writers.write_passages(_passages(spark, sf), path, fmt="tsv")
    rows = readers.read_passages(spark, path, multiline=True)
    return rows.select("pid", "title", F.md5("text").alias("digest"))


@query("read_queries", f"WITH {CORPUS_SQL} SELECT qid, text FROM queries")
def _read_queries(spark, sf):
    path = scratch_path(spark, "queries")
    writers.write_queries(dataset.build_queries(source_rows(spark, sf)), path)
    return readers.read_queries(spark, path)


@query(
    "read_filtered_queries_tsv",
    f"""WITH {CORPUS_SQL}, {GOLD_SQL}, {bm25_sql(10)}
SELECT q.qid, q.text FROM queries q JOIN gold g USING (qid) JOIN hits h ON h.qid = g.qid AND h.pid = g.gold""",
)
def _filtered_queries(spark, sf):
    _, queries, qrels, hits = lexical_case(spark, sf)
    gold = dataset.first_gold(qrels)
    found = gold.join(hits, (gold.qid == hits.qid) & (gold.gold == hits.pid), "left_semi")
    path = scratch_path(spark, "queries")
    writers.write_queries(queries.join(found, "qid", "left_semi"), path, fmt="tsv")
    return spark.read.csv(path, sep="\t", quote='"', escape='"', schema="qid string, text string")


@query(
    "read_qrels_of_split",
    f"""WITH {CORPUS_SQL}, {_split_sql(0.3, 0.2)} SELECT qid, pid, 1 AS score, split FROM split""",
)
def _read_qrels(spark, sf):
    split = split_rows(titled_dataset(spark, sf)[2], ["ord"], 0.3, 0.2, 7)
    path = scratch_path(spark, "qrels")
    writers.write_qrels(split, path, "split")
    out = None
    for name in ("train", "dev", "test"):
        rows = readers.read_qrels(spark, os.path.join(path, f"split={name}"))
        rows = rows.withColumn("split", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("read_ordered_qrels", f"WITH {CORPUS_SQL}, {GOLD_SQL} SELECT qid, gold AS pid, 1 AS score FROM gold")
def _ordered_qrels(spark, sf):
    gold = dataset.first_gold(titled_dataset(spark, sf)[2])
    path = scratch_path(spark, "qrels")
    rows = gold.select("qid", F.col("gold").alias("pid"), F.lit(1).alias("score"))
    writers.write_qrels(rows, path, ordered=True)
    return readers.read_qrels(spark, path)


@query(
    "load_retrieval_dataset",
    f"""WITH {CORPUS_SQL}
SELECT 'corpus' AS name, count(*) AS n FROM corpus UNION ALL SELECT 'queries', count(*) FROM queries
UNION ALL SELECT 'distinct_questions', count(DISTINCT text) FROM queries
UNION ALL SELECT 'pairs', count(*) FROM qrels UNION ALL SELECT 'judged_queries', count(DISTINCT qid) FROM qrels""",
)
def _load(spark, sf):
    corpus, queries, qrels = titled_dataset(spark, sf)
    folder = scratch_path(spark, "dataset")
    writers.write_passages(corpus, f"{folder}/corpus.jsonl")
    writers.write_queries(queries, f"{folder}/queries.jsonl")
    writers.write_qrels(qrels, f"{folder}/qrels/test.tsv")
    loaded = readers.load_retrieval_dataset(spark, folder)
    return dataset.dataset_card(loaded.corpus, loaded.queries, loaded.qrels)


_EXAMPLE_COUNTS = """
SELECT split_part(text, chr(10), 1) AS question, count(*) AS n, 2 * count(*) AS positives
FROM (SELECT text FROM documents UNION ALL SELECT text FROM documents WHERE lang = 'en') GROUP BY 1"""


@query("read_examples", _EXAMPLE_COUNTS)
def _read_examples(spark, sf):
    examples = example_rows(spark, sf)
    english = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("qid"))
    first, second = scratch_path(spark, "train") + ".jsonl", scratch_path(spark, "more") + ".jsonl"
    writers.write_examples(examples, first)
    writers.write_examples(examples.join(english, "qid", "left_semi"), second)
    rows = readers.read_examples(spark, [first, second])
    return rows.groupBy("question").agg(
        F.count("*").alias("n"), F.sum(F.size("positive_ctxs")).alias("positives")
    )


@query("read_examples_up_to", "SELECT (count(*) * 2 // 3)::BIGINT AS n FROM documents")
def _read_examples_cap(spark, sf):
    path = scratch_path(spark, "train") + ".jsonl"
    examples = example_rows(spark, sf)
    writers.write_examples(examples, path)
    cap = examples.count() * 2 // 3
    return readers.read_examples(spark, [path, path], maxload=cap).agg(F.count("*").alias("n"))


_RECORDS = 500  # of a generation step's file; a reader holds a file as a whole


@query(
    "read_generations",
    """SELECT doc_id::VARCHAR AS doc_id, md5(text) AS input, md5('1. ' || text) AS content, 'summary' AS input_type
FROM documents""",
)
def _generations(spark, sf):
    path = scratch_path(spark, "generated")
    docs = table(spark, sf, "documents")
    records = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("text").alias("input"),
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("1. "), "text").alias("content")).alias("generated_text"),
        F.struct(F.lit("summary").alias("input_type"), F.lit("m").alias("model"), F.lit("").alias("response")).alias("metadata"),
    )
    writers.write_results(records, path, per_file=_RECORDS)
    # one JSON array per file, as the generation step writes it
    writers.write_arrays(spark, path, path + "-arrays")
    rows = readers.read_generations(spark, path + "-arrays")
    return rows.select(
        "doc_id",
        F.md5("input").alias("input"),
        F.md5("generated_text.content").alias("content"),
        F.col("metadata.input_type").alias("input_type"),
    )


@query(
    "read_embedding_shards",
    """SELECT vec_id::VARCHAR AS pid, len(embedding) AS dim,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""",
)
def _read_embeddings(spark, sf):
    path = scratch_path(spark, "vectors")
    rows = vectors(spark, sf).withColumn("pid", F.col("pid").cast("string"))
    writers.write_embeddings(rows, path, shards=4)
    stored = readers.read_embeddings(spark, os.path.join(path, "*.parquet"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored.select("pid", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"))


@query(
    "read_lines",
    """SELECT md5(replace(l, '.', '...')) AS line, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1""",
)
def _read_lines(spark, sf):
    path = scratch_path(spark, "lines")
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    lines.select(F.replace("value", F.lit("."), F.lit("…"))).write.text(path)
    rows = readers.read_lines(spark, path, normalize=True)
    return rows.groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n"))


@query(
    "read_mixture",
    f"""WITH {TOKENS_SQL}
SELECT lang AS dataset, count(*) AS n, sum(len(tokens))::BIGINT AS tokens FROM tok JOIN documents USING (doc_id) GROUP BY lang""",
)
def _read_mixture(spark, sf):
    root = scratch_path(spark, "mixture")
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = token_rows(spark, sf).join(langs, "doc_id")
    rows.withColumnRenamed("doc_id", "ord").write.partitionBy("lang").parquet(root)
    names = [r[0] for r in langs.select("lang").distinct().collect()]
    folders = {name: os.path.join(root, f"lang={name}") for name in names}
    mixed = readers.read_mixture(spark, folders)
    return mixed.groupBy("dataset").agg(
        F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens")
    )


def _some_of_mixture(spark, sf, *reads):
    """Token rows per language, stored in three files by ``ord`` modulo 3, read in some way."""
    root = scratch_path(spark, "mixture")
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = token_rows(spark, sf).join(langs, "doc_id").withColumnRenamed("doc_id", "ord")
    rows = rows.withColumn("third", F.col("ord") % 3).repartition("third")
    rows.write.partitionBy("lang", "third").parquet(root)
    names = [r[0] for r in langs.select("lang").distinct().collect()]
    folders = {name: os.path.join(root, f"lang={name}") for name in names}
    parts = [
        readers.read_mixture(spark, folders, **how).withColumn("part", F.lit(part))
        for part, how in enumerate(reads)
    ]
    return reduce(DataFrame.unionByName, parts).select(
        "part", "dataset", "ord", F.size("tokens").cast("long").alias("n")
    )


@query(
    "read_mixture_first_file",
    f"""WITH {TOKENS_SQL}
SELECT 0 AS part, lang AS dataset, doc_id AS ord, len(tokens)::BIGINT AS n
FROM tok JOIN documents USING (doc_id) WHERE doc_id % 3 = 0""",
)
def _mixture_single(spark, sf):
    return _some_of_mixture(spark, sf, {"mode": "single"})


@query(
    "read_mixture_split",
    f"""WITH {TOKENS_SQL}
SELECT (doc_id % 3)::INT AS part, lang AS dataset, doc_id AS ord, len(tokens)::BIGINT AS n
FROM tok JOIN documents USING (doc_id)""",
)
def _mixture_split(spark, sf):
    shards = ({"mode": "split", "shard": i, "shards": 3} for i in range(3))
    return _some_of_mixture(spark, sf, *shards)


@query(
    "read_saved_run",
    f"{_TITLE_RUN_SQL}, {metrics_sql((1, 5, 10))} SELECT * FROM result",
)
def _saved_run(spark, sf):
    _, _, qrels, hits = lexical_case(spark, sf)
    path = scratch_path(spark, "run")
    writers.write_run(hits, path)
    return metrics.evaluate_run(spark.read.parquet(path), qrels, (1, 5, 10))


@query(
    "read_nested_results",
    f"{_HITS_SQL} SELECT qid, pid::VARCHAR AS id, md5(title || '|' || text) AS digest, score FROM full_hits",
)
def _nested_results(spark, sf):
    path = scratch_path(spark, "results")
    writers.write_results(pack_ctxs(full_hits(spark, sf)[1]), path)
    rows = spark.read.json(path, schema="qid long, ctxs array<struct<id:string,title:string,text:string,score:string>>")
    each = rows.select("qid", F.inline("ctxs"))
    digest = F.md5(F.concat("title", F.lit("|"), "text")).alias("digest")
    return each.select("qid", "id", digest, F.col("score").cast("double").alias("score"))


_VECTOR_TABLE_SQL = """late AS (SELECT doc_id FROM labels),
stored AS (
  SELECT doc_id, 'old ' || lang AS title, text, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS inserted_at
  FROM documents
  UNION ALL
  SELECT doc_id, 'new ' || lang, text, TIMESTAMP '2024-01-02 00:00:00' + to_seconds(doc_id)
  FROM documents WHERE doc_id IN (SELECT doc_id FROM late))"""


def _vector_table(spark, sf):
    """Documents stored once, then the labelled ones again a day later."""
    docs = table(spark, sf, "documents")
    late = table(spark, sf, "labels").select("doc_id").distinct()

    def rows(source, age: str, start: str):
        passages = source.select(
            F.col("doc_id").cast("string").alias("pid"),
            F.concat(F.lit(age), F.lit(" "), "lang").alias("title"),
            "text",
            F.struct(F.col("doc_id").cast("string").alias("patent_id")).alias("metadata"),
            F.array(F.lit(0.0).cast("float")).alias("embedding"),
            (F.col("doc_id") % 4).cast("int").alias("cluster_id"),
            (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("at"),
        )
        return writers.vector_rows(passages, F.col("at"))

    path = scratch_path(spark, "vectors")
    writers.write_vector_table(rows(docs, "old", "2024-01-01 00:00:00"), path)
    again = rows(docs.join(late, "doc_id", "left_semi"), "new", "2024-01-02 00:00:00")
    writers.write_vector_table(again, path, "append")
    return path


@query(
    "vector_table_append",
    f"""WITH {_VECTOR_TABLE_SQL}
SELECT doc_id::VARCHAR AS pid, title, md5(substring(text, 1, 10000)) AS digest FROM stored""",
)
def _append(spark, sf):
    rows = writers.read_vector_table(spark, _vector_table(spark, sf))
    return rows.select("pid", "title", F.md5("summary").alias("digest"))


@query(
    "vector_table_replace",
    f"""WITH {_VECTOR_TABLE_SQL}
SELECT doc_id::VARCHAR AS pid, arg_max(title, inserted_at) AS title FROM stored GROUP BY doc_id""",
)
def _replace(spark, sf):
    path = _vector_table(spark, sf)
    return writers.read_vector_table(spark, path, on_conflict="replace").select("pid", "title")


@query(
    "vector_table_retention",
    f"""WITH {_VECTOR_TABLE_SQL}
SELECT doc_id::VARCHAR AS pid, title FROM stored
WHERE inserted_at > TIMESTAMP '2024-01-02 00:35:00' - INTERVAL 1800 SECOND""",
)
def _retention(spark, sf):
    path = _vector_table(spark, sf)
    now = F.lit("2024-01-02 00:35:00").cast("timestamp")
    return writers.read_vector_table(spark, path, ttl=1800, now=now).select("pid", "title")
