"""The query registry and the fixtures derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findry.operators import dataset
from findry.session import materialize, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables; the texts are spread when they come in one split."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


# -- a titled source table out of `documents` -------------------------------
# title: the whole first line; body: the whole text, missing if it is blank.
# the benchmark items are titles without any body

ITEM_ORD = 1_000_000_000


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(ord, title, text, source)`` with repeated titles, repeated and missing bodies."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.trim("text") != "", F.col("text")).alias("text"),
        "source",
    )
    items = table(spark, sf, "benchmark").select(
        (F.col("item_id") + ITEM_ORD).alias("ord"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("text"),
        F.lit("items").alias("source"),
    )
    return docs.unionByName(items)


SOURCE_SQL = f"""src AS (
  SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title,
         CASE WHEN trim(text) <> '' THEN text END AS text, source
  FROM documents
  UNION ALL
  SELECT item_id + {ITEM_ORD}, split_part(text, chr(10), 1), NULL, 'items' FROM benchmark)"""

CORPUS_SQL = f"""{SOURCE_SQL},
filled AS (SELECT ord, title, coalesce(text, '.') AS text, source FROM src),
corpus AS (
  SELECT 'C' || (row_number() OVER (ORDER BY ord) - 1) AS pid, title, text, source, ord
  FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS rn FROM filled)
  WHERE rn = 1),
queries AS (
  SELECT 'Q' || (row_number() OVER (ORDER BY ord) - 1) AS qid, title AS text, ord
  FROM (SELECT title, min(ord) AS ord FROM src GROUP BY title)),
qrels AS (
  SELECT q.qid, c.pid, 1 AS score, f.ord
  FROM filled f JOIN queries q ON f.title = q.text JOIN corpus c ON c.text = f.text)"""


def titled_dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of the titled source table, as stored tables."""
    src = source_rows(spark, sf)
    corpus = materialize(dataset.build_corpus(src), "corpus")
    queries = materialize(dataset.build_queries(src), "queries")
    return corpus, queries, materialize(dataset.build_qrels(src, queries, corpus), "qrels")


def tokens_sql(expr: str) -> str:
    """SQL for the lowercased token list of a text."""
    pattern = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
    return f"list_transform(regexp_extract_all({expr}, '{pattern}'), lambda t: lower(t))"


def uniform_sql(seed: str, *keys: str) -> str:
    """SQL for the seeded uniform number of a row key."""
    return f"((('0x' || substr({digest_sql(seed, *keys)}, 1, 13))::UBIGINT)::DOUBLE / 4503599627370496.0)"


def digest_sql(seed: str, *keys: str) -> str:
    """SQL for the seeded order of a row key."""
    parts = ", ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"md5(concat_ws('|', {parts}))"


def bm25_sql(k: int = 10, tokens: Callable[[str], str] = tokens_sql) -> str:
    """CTEs that rank ``corpus(pid, text)`` for ``queries(qid, text)`` as ``hits``."""
    return f"""
postings AS (
  SELECT pid, term, count(*) AS tf
  FROM (SELECT pid, unnest({tokens("text")}) AS term FROM corpus) GROUP BY pid, term),
doc_len AS (SELECT pid, sum(tf) AS dl FROM postings GROUP BY pid),
totals AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM doc_len),
doc_freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
query_terms AS (
  SELECT qid, term, count(*) AS qtf
  FROM (SELECT qid, unnest({tokens("text")}) AS term FROM queries) GROUP BY qid, term),
scored AS (
  SELECT q.qid, p.pid, round(sum(
    q.qtf * ln(1 + (t.n - d.df + 0.5) / (d.df + 0.5))
      * p.tf / (p.tf + 0.9 * (1 - 0.4 + 0.4 * l.dl / t.avg_dl))), 6) AS score
  FROM query_terms q JOIN postings p USING (term) JOIN doc_freq d USING (term)
       JOIN doc_len l USING (pid) CROSS JOIN totals t
  GROUP BY q.qid, p.pid),
hits AS (
  SELECT * FROM (
    SELECT qid, pid, score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank
    FROM scored) WHERE rank <= {k})"""


GOLD_SQL = """
gold AS (SELECT qid, arg_min(pid, ord) AS gold FROM qrels GROUP BY qid)"""


def dot_sql(a: str, b: str) -> str:
    """SQL for the inner product of two float lists in double precision."""
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
