"""Writers. Every sink is a distributed write of a folder of part files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findry.functions.text import parse_id, truncate
from findry.session import materialize

BODY_LIMIT = 10_000
# bodies and vectors that one writer of a vector table takes
_BYTES_PER_FILE = 256 << 20

# texts keep their own leading and trailing blanks
_TSV = {
    "sep": "\t",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_passages(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """``(pid, title, text[, metadata])`` as JSON lines, or as TSV ``id, text, title``."""
    if fmt == "json":
        fields = [F.col("pid").alias("_id"), "text", "title"]
        if "metadata" in df.columns:
            fields.append("metadata")
        df.select(*fields).write.mode(mode).json(path)
    elif fmt == "tsv":
        rows = df.select(F.col("pid").alias("id"), "text", "title")
        rows.write.mode(mode).csv(path, header=True, **_TSV)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_queries(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """``(qid, text)`` as JSON lines, or as TSV without header in numeric id order."""
    if fmt == "json":
        df.select(F.col("qid").alias("_id"), "text").write.mode(mode).json(path)
    elif fmt == "tsv":
        ordered = df.select("qid", "text").orderBy(parse_id(F.col("qid")))
        ordered.write.mode(mode).csv(path, header=False, **_TSV)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_qrels(
    df: DataFrame, path: str, split: str | None = None, ordered: bool = False, mode: str = "overwrite"
) -> None:
    """Judgements as TSV with a ``qid, pid, score`` header, one folder per split."""
    columns = ["qid", "pid", "score"] + ([split] if split else [])
    rows = df.select(*columns)
    if ordered:
        rows = rows.orderBy(parse_id(F.col("qid")))
    writer = rows.write.mode(mode)
    if split:
        writer = writer.partitionBy(split)
    writer.csv(path, header=True, **_TSV)


def write_examples(
    df: DataFrame, path: str, mode: str = "overwrite", compression: str = "lz4"
) -> None:
    """Training examples as JSON lines; absent context lists are left out of the record.

    A passage stands in many records, so the files are compressed.
    """
    names = ("question", "answers", "positive_ctxs", "negative_ctxs", "hard_negative_ctxs")
    rows = df.select(*[c for c in names if c in df.columns])
    rows.write.mode(mode).json(path, compression=compression)


def write_results(
    df: DataFrame, path: str, mode: str = "overwrite", per_file: int | None = None
) -> None:
    """Nested retrieval results as JSON lines, on wish of up to ``per_file`` records a file."""
    writer = df.write.mode(mode)
    if per_file is not None:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.json(path)


def write_arrays(spark: SparkSession, lines: str, path: str) -> None:
    """A folder of JSON lines as JSON arrays, one array a file for each file of lines.

    A reader takes an array as a whole, as this does: the files of lines must
    be bounded.
    """
    records = F.split(F.trim(F.rtrim("value"), F.lit("\n")), "\n")
    array = F.concat(F.lit("["), F.array_join(records, ","), F.lit("]")).alias("value")
    arrays = spark.read.text(lines, wholetext=True).select(array)
    # a task reads several small files, and a file holds one array
    arrays.write.option("maxRecordsPerFile", 1).text(path)


def write_embeddings(df: DataFrame, path: str, shards: int, mode: str = "overwrite") -> None:
    """``(pid, embedding)`` as ``shards`` parquet files."""
    rows = df.select("pid", F.col("embedding").cast("array<float>").alias("embedding"))
    rows.repartition(shards, "pid").write.mode(mode).parquet(path)


def write_run(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A run ``(qid, pid, score)`` for later scoring."""
    df.select("qid", "pid", "score").write.mode(mode).parquet(path)


def vector_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The stored form of passages with vectors: body cut, insertion time added.

    Only the stored body is cut; the vector was made from the whole text.
    """
    return df.select(
        "pid",
        F.col("metadata.patent_id").alias("patent_id"),
        "title",
        truncate(F.col("text"), BODY_LIMIT).alias("summary"),
        "embedding",
        "cluster_id",
        (F.current_timestamp() if now is None else now).alias("inserted_at"),
    )


def spread_cells(
    rows: DataFrame, rows_per_file: int = 1_000_000, size: Column | None = None
) -> DataFrame:
    """Partition by cell, a cell of many rows, or of much ``size``, over several partitions."""
    files = F.ceil(F.count("*") / rows_per_file)
    if size is not None:
        files = F.greatest(files, F.ceil(F.sum(size) / _BYTES_PER_FILE))
    # one row per cell, so the broadcast is bounded by the number of cells
    per_cell = rows.groupBy("cluster_id").agg(files.alias("_files"))
    salted = rows.join(F.broadcast(per_cell), "cluster_id").withColumn(
        "_salt", F.pmod(F.xxhash64("pid"), F.col("_files"))
    )
    return salted.repartition("cluster_id", "_salt").drop("_files", "_salt")


def write_vector_table(
    df: DataFrame, path: str, mode: str = "overwrite", load: str | None = None
) -> None:
    """Rows of :func:`vector_rows`, partitioned by load and cell; ids are never checked.

    ``append`` adds a load, or replaces the one named ``load``; batch and
    stream write the same layout. A cell of a load is one file, more if it is
    crowded.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    # the rows are measured by cell and then written
    size = F.coalesce(F.octet_length("summary"), F.lit(0)) + 4 * F.greatest(F.size("embedding"), F.lit(0))
    cells = spread_cells(materialize(df, "load"), size=size).withColumn(
        "load", F.lit(load or uuid.uuid4().hex)
    )
    writer = cells.write.partitionBy("load", "cluster_id").mode("overwrite")
    kept = "static" if mode == "overwrite" else "dynamic"
    writer.option("partitionOverwriteMode", kept).parquet(path)


def apply_ttl(df: DataFrame, now: Column, seconds: int = 1800) -> DataFrame:
    """Rows not older than ``seconds`` at ``now``."""
    return df.where(F.col("inserted_at") > now - F.make_dt_interval(secs=F.lit(seconds)))


def read_vector_table(
    spark: SparkSession, path: str, on_conflict: str = "keep", ttl: int | None = None, now: Column | None = None
) -> DataFrame:
    """The vector table; ``replace`` keeps only the latest row of each id.

    Rows past the retention time are filtered out on read.
    """
    rows = spark.read.parquet(path).drop("load")
    if ttl is not None:
        rows = apply_ttl(rows, F.current_timestamp() if now is None else now, ttl)
    if on_conflict == "keep":
        return rows
    if on_conflict != "replace":
        raise ValueError("on_conflict must be 'keep' or 'replace'")
    # a rank filter of one keeps only one row per id and task before the shuffle
    # rows of one moment are told apart by their content
    content = F.xxhash64("patent_id", "title", "summary", "embedding")
    latest = W.partitionBy("pid").orderBy(F.desc("inserted_at"), content)
    return rows.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") == 1).drop("_r")
