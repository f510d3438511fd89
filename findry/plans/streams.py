"""Structured Streaming jobs run to the end of the available data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from findry.operators.embed import embed
from findry.plans.registry import ORACLES, query, table
from findry.plans.search import _DIM
from findry.session import materialize, scratch_path
from findry.sources import writers
from findry.streaming.jobs import answer_stream, embed_and_place, ingest_stream


@query(
    "ingest_stream",
    """SELECT doc_id::VARCHAR AS pid, lang AS title, md5(substring(text, 1, 10000)) AS digest,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS inserted_at FROM documents""",
)
def _ingest(spark, sf):
    docs = table(spark, sf, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    passages = docs.select(
        F.col("doc_id").cast("string").alias("pid"),
        F.col("lang").alias("title"),
        "text",
        F.struct(
            F.lit("요약문").alias("type"),
            F.col("doc_id").cast("string").alias("patent_id"),
            F.col("source").alias("applicant"),
        ).alias("metadata"),
        (start + F.make_dt_interval(secs=F.col("doc_id"))).alias("ts"),
    )
    root = scratch_path(spark, "stream")
    # a load by batch, then a stream in two runs: the older half comes last, and everything twice
    centers = np.eye(4, _DIM)
    older = F.col("ts") < F.expr("timestamp'2024-01-01 00:05:00'")
    first = embed_and_place(passages.where(older).limit(10), centers, dim=_DIM)
    writers.write_vector_table(first, f"{root}/table")
    for part in (passages.where(~older), passages.where(older)):
        part.unionAll(part).write.mode("append").json(f"{root}/in")
        job = ingest_stream(
            spark, f"{root}/in", f"{root}/table", centers, f"{root}/checkpoint", dim=_DIM
        )
        job.awaitTermination()
    rows = writers.read_vector_table(spark, f"{root}/table", on_conflict="replace")
    return rows.select("pid", "title", F.md5("summary").alias("digest"), "inserted_at")


@query("answer_stream", ORACLES["semantic_search"])
def _answer(spark, sf):
    root = scratch_path(spark, "asked")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    asked.write.json(f"{root}/in")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    # each batch of queries reads the stored vectors
    items = materialize(embed(docs, "text", dim=_DIM).select("pid", "embedding"), "vectors")
    job = answer_stream(spark, f"{root}/in", items, f"{root}/hits", f"{root}/checkpoint", dim=_DIM)
    job.awaitTermination()
    hits = spark.read.parquet(f"{root}/hits")
    return hits.select(F.col("qid").cast("long").alias("qid"), "pid", "score", "rank")
