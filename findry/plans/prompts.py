"""Prompt rows and packed results."""

from __future__ import annotations

from pyspark.sql import functions as F

from findry.operators import dataset, lexical, rag
from findry.plans.registry import bm25_sql, query, table
from findry.session import materialize

_PROMPT = "Write search queries for this document."

_HITS_SQL = f"""WITH corpus AS (
  SELECT doc_id AS pid, split_part(text, chr(10), 1) AS title, text FROM documents),
queries AS (SELECT item_id AS qid, text FROM benchmark), {bm25_sql(10)},
full_hits AS (SELECT h.*, c.title, c.text FROM hits h JOIN corpus c USING (pid))"""


def full_hits(spark, sf):
    """BM25 top 10 of the benchmark items with titles and bodies."""
    corpus = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pid"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
    )
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    hits = materialize(lexical.bm25_search(queries, lexical.build_index(corpus), 10), "hits")
    return queries, materialize(dataset.attach_passages(hits, corpus))


@query(
    "llm_requests",
    f"""SELECT doc_id::BIGINT AS doc_id, unnest([0, 1])::INT AS turn, unnest(['system', 'user']) AS role,
  unnest([md5('{_PROMPT}'), md5(text)]) AS digest FROM documents""",
)
def _requests(spark, sf):
    rows = rag.llm_requests(table(spark, sf, "documents"), _PROMPT, "doc_id")
    long = rows.select("doc_id", F.posexplode("messages").alias("turn", "m"))
    return long.select("doc_id", "turn", F.col("m.role").alias("role"), F.md5("m.content").alias("digest"))


_CONTEXT_SQL = f"""{_HITS_SQL},
docs5 AS (SELECT qid, rank, '제목: ' || title || ', 요약문: ' || text AS d FROM full_hits WHERE rank <= 5),
contexts AS (
  SELECT qid, substring(string_agg(substring(d, 1, 500), ' ' || chr(10) ORDER BY rank), 1, 2000) AS context,
         string_agg(length(d)::VARCHAR, ',' ORDER BY rank) AS lengths FROM docs5 GROUP BY qid)"""


@query("rag_context", f"{_CONTEXT_SQL} SELECT qid, context, lengths FROM contexts")
def _context(spark, sf):
    rows = rag.rag_context(full_hits(spark, sf)[1])
    lengths = F.transform("full_lengths", lambda n: n.cast("string"))
    return rows.select("qid", "context", F.array_join(lengths, ",").alias("lengths"))


@query(
    "context_lengths",
    f"""{_CONTEXT_SQL} SELECT count(*) AS n, min(length(context)) AS shortest, max(length(context)) AS longest,
round(avg(length(context)), 6) AS mean FROM contexts""",
)
def _lengths(spark, sf):
    out = rag.context_lengths(rag.rag_context(full_hits(spark, sf)[1]))
    return out.select(
        "n", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"), "mean"
    )


_SYSTEM_SQL = "'" + rag.SYSTEM_PROMPT.replace("'", "''") + "'"


@query(
    "rag_messages",
    f"""{_CONTEXT_SQL},
asked AS (SELECT c.qid, q.text AS query, c.context FROM contexts c JOIN queries q USING (qid)),
messages AS (
  SELECT qid, 0 AS part, 0::BIGINT AS turn, 'system' AS role,
    {_SYSTEM_SQL} || '# 검색 질의: ' || query || '.' || chr(10) || '# 검색 결과: ' || context || chr(10) AS content FROM asked
  UNION ALL SELECT a.qid, 1, v.turn, v.role, v.text FROM asked a JOIN conversations v ON v.conv_id = a.qid
    WHERE v.role IN ('user', 'assistant')
  UNION ALL SELECT qid, 2, 0, 'user', query FROM asked)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY part, turn) - 1)::INT AS place, role, md5(content) AS digest
FROM messages""",
)
def _messages(spark, sf):
    queries, hits = full_hits(spark, sf)
    history = rag.chat_history(table(spark, sf, "conversations"))
    asked = rag.rag_context(hits).join(queries, "qid").select(
        "qid", F.col("text").alias("query"), "context", F.col("text").alias("message")
    )
    rows = rag.rag_messages(asked, history.withColumnRenamed("conv_id", "qid"))
    return rows.select("qid", F.col("place").cast("int"), "role", F.md5("content").alias("digest"))


@query(
    "chat_history",
    """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place, role, md5(text) AS digest
FROM conversations WHERE role IN ('user', 'assistant')""",
)
def _history(spark, sf):
    rows = rag.chat_history(table(spark, sf, "conversations"))
    digest = F.md5("content").alias("digest")
    return rows.select("conv_id", F.col("place").cast("int"), "role", digest)


@query(
    "pack_results",
    f"""{_HITS_SQL}
SELECT qid, 'retrieved' AS type, 10 AS topk, rank::INT AS rank, score, pid AS _id, md5(title || text) AS digest FROM full_hits""",
)
def _packed(spark, sf):
    rows = rag.pack_results(full_hits(spark, sf)[1])
    long = rows.select("qid", "type", "topk", F.explode("results").alias("r"))
    doc = F.col("r.doc_info")
    return long.select(
        "qid",
        "type",
        "topk",
        F.col("r.rank").alias("rank"),
        F.col("r.score").alias("score"),
        doc["_id"].alias("_id"),
        F.md5(F.concat(doc["title"], doc["text"])).alias("digest"),
    )


@query(
    "pack_ctxs",
    f"""{_HITS_SQL}
SELECT qid, (rank - 1)::INT AS place, pid::VARCHAR AS id, md5(title || text) AS digest, score FROM full_hits""",
)
def _ctxs(spark, sf):
    rows = rag.pack_ctxs(full_hits(spark, sf)[1])
    long = rows.select("qid", F.posexplode("ctxs").alias("place", "c"))
    return long.select(
        "qid",
        "place",
        F.col("c.id").alias("id"),
        F.md5(F.concat("c.title", "c.text")).alias("digest"),
        # the stored score is text; read back as a number for comparison
        F.col("c.score").cast("double").alias("score"),
    )
