"""Building a retrieval dataset: corpus, queries, judgements, examples.

Input rows carry an ordinal ``ord`` (unique, increasing in source order)
wherever "the first one" matters. Long texts are joined and grouped by a
fixed-width content key, never by the text itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findry.functions.text import GENERATED_MARKERS, content_key, fill_missing, make_id
from findry.operators.indexing import dense_index, index_within
from findry.operators.joins import salted_join
from findry.session import scratch_path


def patents_to_passages(
    df: DataFrame, mapping: dict[str, str], fill: str = "No text", kind: str = "요약문"
) -> DataFrame:
    """Passage records from a patent table.

    ``mapping`` names the source columns of ``id``, ``title``, ``text`` and
    ``applicant``. The id is the application number, kept also as metadata.
    """
    return df.select(
        F.col(mapping["id"]).cast("string").alias("_id"),
        F.col(mapping["title"]).alias("title"),
        fill_missing(F.col(mapping["text"]), fill).alias("text"),
        F.struct(
            F.lit(kind).alias("type"),
            F.col(mapping["id"]).cast("string").alias("patent_id"),
            F.col(mapping["applicant"]).alias("applicant"),
        ).alias("metadata"),
    )


def union_tables(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns sorted, missing ones null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def find_by_title(df: DataFrame, title: str) -> DataFrame:
    """Records with exactly this title."""
    return df.where(F.col("title") == title)


def store_by_title(df: DataFrame, path: str) -> None:
    """Write records in the order of their titles' hash, for :func:`find_stored_title`.

    A file and a row group then cover a narrow range of hashes. Records of one
    title may fill several files; ``ord`` tells them apart in the range sort.
    """
    keyed = df.withColumn("title_key", F.xxhash64("title"))
    ranged = keyed.repartitionByRange("title_key", "ord")
    ranged.sortWithinPartitions("title_key", "ord").write.parquet(path)


def find_stored_title(spark: SparkSession, path: str, title: str) -> DataFrame:
    """Records with exactly this title.

    The hash is a constant of the plan, so the scan skips all row groups whose
    range does not hold it; the title itself decides.
    """
    rows = spark.read.parquet(path)
    same = (F.col("title_key") == F.xxhash64(F.lit(title))) & (F.col("title") == title)
    return rows.where(same).drop("title_key")


def store_lookup(df: DataFrame, key: str = "pid", buckets: int | None = None) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``key``, for joins that leave it in place.

    Attaching fields to run after run then shuffles the runs alone. The table
    lies in the shared scratch folder; by default it has as many buckets as a
    shuffle has partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lookup_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    writer.option("path", scratch_path(spark, "lookup")).saveAsTable(name)
    return spark.table(name)


def build_corpus(df: DataFrame, fill: str = ".", prefix: str = "C") -> DataFrame:
    """Distinct bodies with dense ids: ``(pid, title, text, metadata..., text_key, ord)``.

    Rows with the same body collapse into the first one, whose title and
    further columns are kept. Only keys and ordinals are grouped and sorted;
    the bodies move once, in the join that picks the first rows.
    """
    filled = df.withColumn("text", fill_missing(F.col("text"), fill))
    firsts = (
        filled.select("ord", content_key(F.col("text")).alias("text_key"))
        .groupBy("text_key")
        .agg(F.min("ord").alias("ord"))
    )
    numbered = dense_index(firsts, ["ord"], "_n")
    kept = [c for c in df.columns if c != "ord"]
    return numbered.join(filled, "ord").select(
        make_id(prefix, F.col("_n")).alias("pid"), *kept, "text_key", "ord"
    )


def build_queries(df: DataFrame, text: str = "title", prefix: str = "Q") -> DataFrame:
    """Distinct query texts with dense first-seen ids: ``(qid, text, ord)``.

    Texts are grouped by their key; they move once, to the first row's number.
    """
    keyed = df.select("ord", content_key(F.col(text)).alias("_key"))
    firsts = keyed.groupBy("_key").agg(F.min("ord").alias("ord")).select("ord")
    numbered = dense_index(firsts, ["ord"], "_n").join(
        df.select("ord", F.col(text).alias("text")), "ord"
    )
    return numbered.select(make_id(prefix, F.col("_n")).alias("qid"), "text", "ord")


def build_qrels(
    df: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    title: str = "title",
    fill: str = ".",
    distinct: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """One judgement per source row: ``(qid, pid, score, ord)``.

    A pair occurring in several source rows is kept as often, unless
    ``distinct``. Only keys and ids travel; a title or body shared by a large
    share of the rows is salted.
    """
    rows = df.select(
        "ord",
        content_key(F.col(title)).alias("title_key"),
        content_key(fill_missing(F.col("text"), fill)).alias("text_key"),
    )
    q = queries.select("qid", content_key(F.col("text")).alias("title_key"))
    c = corpus.select("pid", "text_key")
    pairs = salted_join(rows, q, "title_key", "ord", min_rows=hot_rows)
    pairs = salted_join(pairs, c, "text_key", "ord", min_rows=hot_rows)
    if distinct:
        pairs = pairs.groupBy("qid", "pid").agg(F.min("ord").alias("ord"))
    return pairs.select("qid", "pid", F.lit(1).alias("score"), "ord")


def group_qrels(qrels: DataFrame) -> DataFrame:
    """Judged passages per query in source order: ``(qid, place, pid)``, places from 0.

    One row per judgement, whatever the size of a query's list, so no list is
    gathered in one task.
    """
    rows = qrels.select("qid", "ord", "pid")
    return index_within(rows, "qid", ["ord", "pid"], "place").select("qid", "place", "pid")


def drop_unjudged(grouped: DataFrame) -> DataFrame:
    """Leave out queries whose judgement list is empty: rows without passage."""
    return grouped.where(F.col("pid").isNotNull())


def first_gold(qrels: DataFrame) -> DataFrame:
    """The first judged passage of each query: ``(qid, gold)``."""
    return qrels.groupBy("qid").agg(F.min_by("pid", "ord").alias("gold"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def build_examples(
    qrels: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    hot_rows: int | None = None,
) -> DataFrame:
    """Training examples in long form: ``(qid, question, place, pid, title, text)``.

    One row per positive context, in judgement order. :func:`nest_examples`
    makes the records of a file.
    """
    places = group_qrels(qrels)
    passages = corpus.select("pid", "title", "text")
    positives = salted_join(places, passages, "pid", "qid", min_rows=hot_rows)
    asked = queries.select("qid", F.col("text").alias("question"))
    return positives.join(asked, "qid").select("qid", "question", "place", "pid", "title", "text")


def nest_examples(examples: DataFrame) -> DataFrame:
    """``(qid, question, positive_ctxs)``: one record per question, as files hold them.

    Only for writing: a record holds all of its question's contexts.
    """
    ctx = F.struct("place", "title", "text")
    nested = examples.groupBy("qid", "question").agg(F.sort_array(F.collect_list(ctx)).alias("_p"))
    ctxs = F.transform("_p", lambda p: F.struct(p["title"].alias("title"), p["text"].alias("text")))
    return nested.select("qid", "question", ctxs.alias("positive_ctxs"))


def attach_negatives(
    examples: DataFrame, mined: DataFrame, column: str = "negative_ctxs"
) -> DataFrame:
    """Add mined contexts to the records of the same question (null if none).

    Questions are matched by their content key, long texts do not travel as keys.
    """
    found = mined.select(content_key(F.col("question")).alias("_key"), column)
    keyed = examples.drop(column).withColumn("_key", content_key(F.col("question")))
    return keyed.join(found, "_key", "left").drop("_key")


def restrict_examples(examples: DataFrame, queries: DataFrame) -> DataFrame:
    """Examples whose question is one of the given query texts."""
    wanted = queries.select(content_key(F.col("text")).alias("_key")).distinct()
    return examples.join(wanted, content_key(F.col("question")) == F.col("_key"), "left_semi")


def distinct_questions(examples: DataFrame) -> DataFrame:
    """The distinct question texts."""
    by_key = examples.groupBy(content_key(F.col("question")).alias("_key"))
    return by_key.agg(F.first("question").alias("question")).select("question")


def clean_generated_queries(df: DataFrame) -> DataFrame:
    """Query lines in generated text: ``(ord, position, query, input)``.

    A line counts when it holds none of the marker strings and starts with a
    numbering token (one with a digit, dash or dot); the query is what
    follows the first space. ``df`` has ``ord``, ``input`` and ``content``.
    """
    lines = df.select("ord", "input", F.posexplode(F.split("content", "\n")).alias("position", "line"))
    line = F.col("line")
    clean: Column = F.lit(True)
    for marker in GENERATED_MARKERS:
        clean = clean & ~F.contains(line, F.lit(marker))
    cut = F.instr(line, " ")
    numbered = F.substring_index(line, " ", 1).rlike(r"[-.\p{Nd}]")
    return lines.where((cut > 0) & clean & numbered).select(
        "ord", "position", F.substr(line, cut + 1).alias("query"), "input"
    )


def link_generated(
    generated: DataFrame, corpus: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Attach the passage whose body is the generation input: adds ``pid``."""
    keyed = generated.withColumn("text_key", content_key(F.col("input")))
    passages = corpus.select("pid", "text_key")
    return salted_join(keyed, passages, "text_key", "query", min_rows=hot_rows).drop("text_key")


def attach_passages(
    hits: DataFrame,
    corpus: DataFrame,
    fields: list[str] | None = None,
    on_missing: str = "error",
    hot_rows: int | None = None,
) -> DataFrame:
    """Hits with the stored fields of their passage.

    ``on_missing`` says what an id without a passage does: ``error`` fails
    the job, ``drop`` leaves the hit out, ``null`` keeps it with null fields.
    Only the asked fields are read from the corpus.
    """
    if on_missing not in ("error", "drop", "null"):
        raise ValueError("on_missing must be 'error', 'drop' or 'null'")
    fields = fields or ["title", "text"]
    found = corpus.select("pid", *fields, F.lit(True).alias("_found"))
    how = "inner" if on_missing == "drop" else "left"
    joined = salted_join(hits, found, "pid", "qid", how, min_rows=hot_rows)
    if on_missing == "error":
        fail = F.raise_error(F.concat(F.lit("no passage with id "), F.col("pid").cast("string")))
        # a filter, unlike a column, is never pruned away
        joined = joined.where(F.when(F.col("_found"), True).otherwise(fail.cast("boolean")))
    return joined.drop("_found")


def dataset_card(
    corpus: DataFrame, queries: DataFrame, qrels: DataFrame, split: str | None = None
) -> DataFrame:
    """Counts of a dataset as ``(name, n)`` rows."""

    def count(df: DataFrame, name: str, what: Column) -> DataFrame:
        return df.agg(what.alias("n")).select(F.lit(name).alias("name"), "n")

    card = count(corpus, "corpus", F.count("*"))
    card = card.unionByName(count(queries, "queries", F.count("*")))
    card = card.unionByName(count(queries, "distinct_questions", F.countDistinct(content_key(F.col("text")))))
    card = card.unionByName(count(qrels, "pairs", F.count("*")))
    card = card.unionByName(count(qrels, "judged_queries", F.countDistinct("qid")))
    if split:
        per_split = qrels.groupBy(split).agg(
            F.count("*").alias("pairs"), F.countDistinct("qid").alias("queries")
        )
        for what in ("pairs", "queries"):
            name = F.concat(F.col(split), F.lit(f"_{what}")).alias("name")
            card = card.unionByName(per_split.select(name, F.col(what).alias("n")))
    return card
