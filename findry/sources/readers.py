"""Readers. Every path may be a file, a folder, a glob or a list of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findry.functions.text import normalize_text
from findry.sources import schemas

Paths = str | list[str]


def _as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _probed_id() -> Column:
    # an empty id also falls through to _id
    return F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("_id"))


def read_passages(spark: SparkSession, path: Paths, multiline: bool = False) -> DataFrame:
    """``(pid, title, text, metadata)`` from JSONL, or ``(pid, title, text)`` from TSV.

    A ``summary`` field stands in for a missing ``text``. TSV columns go by
    position (id, text, title) and a row whose id cell reads ``id`` is a
    header. ``multiline`` reads pretty-printed records, and TSV bodies with
    line breaks; without it large files are split between tasks.
    """
    paths = _as_list(path)
    if all(p.rstrip("/").endswith(".tsv") for p in paths):
        rows = spark.read.csv(
            paths, sep="\t", quote='"', escape='"', multiLine=multiline, schema=schemas.PASSAGE_TSV
        )
        # an empty id is an id
        body = rows.where(~F.col("id").eqNullSafe(F.lit("id")))
        return body.select(F.col("id").alias("pid"), "title", "text")
    rows = spark.read.json(paths, schema=schemas.PASSAGE, multiLine=multiline)
    return rows.select(
        _probed_id().alias("pid"), "title", F.coalesce("text", "summary").alias("text"), "metadata"
    )


def read_queries(spark: SparkSession, path: Paths) -> DataFrame:
    """``(qid, text)`` from JSONL."""
    rows = spark.read.json(_as_list(path), schema=schemas.QUERY)
    return rows.select(F.col("_id").alias("qid"), "text")


def read_qrels(spark: SparkSession, path: Paths) -> DataFrame:
    """``(qid, pid, score)`` from TSV; the first line of each file is skipped unseen."""
    return spark.read.csv(
        _as_list(path), sep="\t", header=True, schema=schemas.QREL, enforceSchema=True
    )


@dataclass(frozen=True)
class RetrievalDataset:
    """Corpus, queries and judgements of one dataset folder."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def load_retrieval_dataset(spark: SparkSession, folder: str, qrels: str = "test") -> RetrievalDataset:
    """``corpus.jsonl``, ``queries.jsonl`` and ``qrels/<name>.tsv`` of a folder.

    Queries are kept as they are; judgements decide which ones are evaluated.
    """
    return RetrievalDataset(
        read_passages(spark, f"{folder}/corpus.jsonl"),
        read_queries(spark, f"{folder}/queries.jsonl"),
        read_qrels(spark, f"{folder}/qrels/{qrels}.tsv"),
    )


def read_examples(
    spark: SparkSession, paths: Paths, maxload: int | None = None
) -> DataFrame:
    """Training examples from ``.json`` arrays and ``.jsonl`` lines, in path order.

    Contexts keep all their fields, as text. ``maxload`` caps the total number
    of rows: whole paths as long as they fit, then the first rows of the next
    one; later paths contribute nothing.
    """
    parts = []
    room = maxload
    for path in _as_list(paths):
        multiline = path.rstrip("/").endswith(".json")
        rows = spark.read.json(path, schema=schemas.EXAMPLE, multiLine=multiline)
        if room is not None and maxload:
            n = rows.count() if room else 0
            rows = rows if n <= room else first_rows(rows, room)
            rows = rows if room else rows.limit(0)
            room -= min(n, room)
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a file scan, in file order, without gathering them.

    Each task takes as many of its rows as the tasks before it leave room for.
    """
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per task of the scan
    sizes = {r["p"]: r["n"] for r in numbered.groupBy(part.alias("p")).agg(
        F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for p in sorted(sizes):
        if n <= 0:
            break
        mine = part == p
        keep = keep | (mine if sizes[p] <= n else mine & (place < n))
        n -= sizes[p]
    return numbered.where(keep).drop("_at")


def read_results(spark: SparkSession, path: Paths) -> DataFrame:
    """Retrieval results and answer files, one row per context.

    ``(qid, question, answers, rank, pid, title, text, score)`` from records
    with ``ctxs`` in rank order (from 1). A query without contexts keeps one
    row with null context fields.
    """
    rows = spark.read.json(_as_list(path), schema=schemas.RESULT)
    long = rows.select("qid", "question", "answers", F.posexplode_outer("ctxs").alias("at", "c"))
    return long.select(
        "qid",
        "question",
        "answers",
        (F.col("at") + 1).alias("rank"),
        F.col("c")["id"].alias("pid"),
        F.col("c")["title"].alias("title"),
        F.col("c")["text"].alias("text"),
        F.col("c")["score"].cast("double").alias("score"),
    )


def read_generations(spark: SparkSession, path: Paths) -> DataFrame:
    """Generation records from JSON arrays."""
    return spark.read.json(_as_list(path), schema=schemas.GENERATION, multiLine=True)


def read_embeddings(spark: SparkSession, path: Paths) -> DataFrame:
    """``(pid, embedding)`` from parquet shards."""
    return spark.read.schema(schemas.EMBEDDING).parquet(*_as_list(path))


def read_lines(spark: SparkSession, path: Paths, normalize: bool = False) -> DataFrame:
    """``(line)`` rows of text files."""
    rows = spark.read.text(_as_list(path))
    line = normalize_text(F.col("value")) if normalize else F.col("value")
    return rows.select(line.alias("line"))


def read_mixture(
    spark: SparkSession,
    folders: dict[str, str],
    mode: str = "full",
    shard: int = 0,
    shards: int = 1,
) -> DataFrame:
    """Token rows of several folders with their ``dataset`` name.

    ``full`` reads every file, ``single`` the first by name, ``split`` the
    files of one of ``shards`` even runs of the sorted file list. A folder
    without files contributes nothing.
    """
    parts = []
    for name, folder in folders.items():
        rows = spark.read.schema(schemas.TOKENS).parquet(folder)
        if mode != "full":
            rows = _some_files(rows, mode, shard, shards)
        parts.append(rows.select(F.lit(name).alias("dataset"), "ord", "tokens"))
    return reduce(DataFrame.unionByName, parts)


def _some_files(rows: DataFrame, mode: str, shard: int, shards: int) -> DataFrame:
    spark = rows.sparkSession
    files = sorted(rows.inputFiles())
    if mode == "single":
        chosen = files[:1]
    elif mode == "split":
        size, extra = divmod(len(files), shards)
        start = shard * size + min(shard, extra)
        chosen = files[start : start + size + (1 if shard < extra else 0)]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if not chosen:
        return rows.limit(0)
    return spark.read.schema(rows.schema).parquet(*chosen)
