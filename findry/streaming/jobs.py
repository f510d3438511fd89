"""Incremental ingest into a vector table, and a stream of queries.

Both run as ``foreachBatch`` jobs, so the batch operators are used unchanged
and a restarted stream continues from its checkpoint.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findry.functions.text import fill_missing, passage_text
from findry.operators.embed import DEFAULT_DIM, Encoder, embed
from findry.operators.vector import assign_cells, knn_join
from findry.sources.writers import vector_rows, write_vector_table

STREAM_SCHEMA = (
    "pid string, title string, text string, "
    "metadata struct<type:string,patent_id:string,applicant:string>, ts timestamp"
)


def embed_and_place(
    passages: DataFrame, centers: np.ndarray, encoder: Encoder | None = None, dim: int = DEFAULT_DIM
) -> DataFrame:
    """Passages in stored form: text assembled, embedded and assigned to a cell."""
    filled = passages.withColumn("text", fill_missing(F.col("text"), "No text"))
    whole = passage_text(F.col("title"), F.col("text"), empty_title="keep")
    vectors = embed(filled.withColumn("_whole", whole), "_whole", encoder, dim).drop("_whole")
    return vector_rows(assign_cells(vectors, centers), F.col("ts"))


def ingest_stream(
    spark: SparkSession,
    source: str,
    table: str,
    centers: np.ndarray,
    checkpoint: str,
    encoder: Encoder | None = None,
    dim: int = DEFAULT_DIM,
    available_now: bool = True,
) -> StreamingQuery:
    """Append all passages that arrive in a folder of JSON lines to a vector table.

    Nothing is dropped, however late it comes; of an id stored more than once
    ``read_vector_table(on_conflict="replace")`` gives the latest row. Each
    batch is a load of its own that overwrites itself, so a retried batch
    leaves no duplicates.
    """
    arriving = spark.readStream.schema(STREAM_SCHEMA).json(source)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = embed_and_place(batch, centers, encoder, dim)
        write_vector_table(rows, table, "append", load=f"stream-{batch_id}")

    writer = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def answer_stream(
    spark: SparkSession,
    source: str,
    items: DataFrame,
    out: str,
    checkpoint: str,
    k: int = 10,
    dim: int = DEFAULT_DIM,
    encoder: Encoder | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Answer a folder of queries (JSON lines ``qid, text``) against a static corpus.

    ``items(pid, embedding)``; each batch of queries is embedded and searched
    exactly, and its hits are written to their own folder.
    """
    asked = spark.readStream.schema("qid string, text string").json(source)

    def answer(batch: DataFrame, batch_id: int) -> None:
        queries = embed(batch, "text", encoder, dim)
        hits = knn_join(queries, items, k)
        hits.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    writer = asked.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
