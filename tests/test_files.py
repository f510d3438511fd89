"""Readers, writers, retention and streams on hand-made files."""

import glob
import json

from pyspark.sql import functions as F

from findry.operators.embed import embed
from findry.session import materialize
from findry.sources import readers, writers
from findry.streaming.jobs import ingest_stream


def test_ids_and_bodies_are_probed(spark, tmp_path):
    records = [
        {"id": "a", "_id": "x", "text": "t"},
        {"id": "", "_id": "b", "summary": "s", "title": "T"},
        {"_id": "c", "text": None, "metadata": {"type": "k", "patent_id": "1"}},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    got = readers.read_passages(spark, str(tmp_path / "p.jsonl")).orderBy("pid").collect()
    assert [(r["pid"], r["title"], r["text"]) for r in got] == [("a", None, "t"), ("b", "T", "s"), ("c", None, None)]
    (tmp_path / "pretty.json").write_text(json.dumps(records[0], indent=4))
    assert readers.read_passages(spark, str(tmp_path / "pretty.json"), multiline=True).count() == 1


def test_tsv_goes_by_position(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('id\ttitle\ttext\nC0\tbody\thead\nC1\t"two\nlines"\t\n')
    got = readers.read_passages(spark, str(tmp_path / "p.tsv"), multiline=True).orderBy("pid").collect()
    assert [(r["pid"], r["title"], r["text"]) for r in got] == [("C0", "head", "body"), ("C1", None, "two\nlines")]


def test_qrels_header_is_skipped_unseen(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("qid\tpid\\score\nQ1\tC1\t1\nQ2\tC2\t1\n")
    got = readers.read_qrels(spark, str(tmp_path / "q.tsv")).orderBy("qid").collect()
    assert [tuple(r) for r in got] == [("Q1", "C1", 1), ("Q2", "C2", 1)]


def test_example_files_and_cap(spark, tmp_path):
    record = {"question": "q", "positive_ctxs": [{"title": "t", "text": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps([record] * 3, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(record)] * 4))
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.jsonl")]
    assert readers.read_examples(spark, paths).count() == 7
    capped = readers.read_examples(spark, paths, maxload=5)
    assert capped.count() == 5 and capped.first()["negative_ctxs"] is None


def test_nothing_is_lost_on_read(spark, tmp_path):
    ctx = {"title": "t", "text": "x", "ce_score": 0.5}
    record = {"question": "q", "answers": ["a"], "negative_ctxs": [ctx]}
    (tmp_path / "n.jsonl").write_text(json.dumps(record))
    got = readers.read_examples(spark, str(tmp_path / "n.jsonl")).first()
    assert got["answers"] == ["a"] and got["negative_ctxs"][0]["ce_score"] == "0.5"
    passage = {"_id": "1", "text": "x", "metadata": {"application_number": "10-2", "type": "k"}}
    (tmp_path / "m.jsonl").write_text(json.dumps(passage))
    meta = readers.read_passages(spark, str(tmp_path / "m.jsonl")).first()["metadata"]
    assert meta == {"application_number": "10-2", "type": "k"}
    (tmp_path / "e.tsv").write_text("id\ttext\ttitle\n\tbody\thead\nC1\tb\th\n")
    assert readers.read_passages(spark, str(tmp_path / "e.tsv")).count() == 2


def test_rows_are_cut_in_file_order(spark, tmp_path):
    lines = [json.dumps({"question": f"q{i:04d}"}) for i in range(3000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.read_examples(spark, [str(tmp_path / "big.jsonl")] * 2, maxload=3777)
        assert rows.count() == 3777
        cut = readers.read_examples(spark, str(tmp_path / "big.jsonl"), maxload=777).collect()
        assert sorted(r["question"] for r in cut) == [f"q{i:04d}" for i in range(777)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ordered_files_are_in_numeric_order(spark, tmp_path):
    rows = spark.range(5000).selectExpr("concat('Q', id) as qid", "'C' as pid", "1 as score")
    writers.write_qrels(rows.repartition(7), str(tmp_path / "q"), ordered=True)
    writers.write_queries(rows.selectExpr("qid", "pid as text").repartition(7), str(tmp_path / "t"), fmt="tsv")
    for name, head in (("q", 1), ("t", 0)):
        seen = []
        for part in sorted((tmp_path / name).glob("part-*")):
            lines = part.read_text().splitlines()[head:]
            seen += [int(line.split("\t")[0][1:]) for line in lines]
        assert seen == list(range(5000))


def test_results_come_back(spark, tmp_path):
    record = {"qid": "1", "question": "q", "answers": ["a"], "ctxs": [
        {"id": "p", "title": "t", "text": "x", "score": "2.5"}, {"id": "r", "text": "y"}]}
    (tmp_path / "r.jsonl").write_text(json.dumps(record) + "\n" + json.dumps({"qid": "2"}))
    got = readers.read_results(spark, str(tmp_path / "r.jsonl")).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["rank"], r["pid"], r["score"]) for r in got] == [
        ("1", 1, "p", 2.5), ("1", 2, "r", None), ("2", None, None, None)]


def test_scratch_space_is_shared_on_a_cluster(monkeypatch):
    import pytest

    from findry import session

    class Conf:
        def __init__(self, **named):
            self.named = named

        def get(self, key, default=None):
            return self.named.get(key, default)

    class Fake:
        def __init__(self, named):
            self.conf = Conf(**named)

    with pytest.raises(ValueError, match="shared"):
        session.scratch_root(Fake({"spark.master": "spark://x:1"}))
    with pytest.raises(ValueError, match="shared"):
        session.scratch_root(Fake({"spark.master": "local-cluster[2,1,1024]"}))
    assert session.scratch_root(Fake({"spark.master": "local[4]"}))
    named = {"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///c"}
    assert session.scratch_root(Fake(named)) == "hdfs:///c"


def test_mixture_modes(spark, tmp_path):
    for name, n in (("one", 1), ("two", 3)):
        for i in range(n):
            rows = spark.createDataFrame([(i, [i])], "ord long, tokens array<int>")
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    folders = {name: str(tmp_path / name) for name in ("one", "two")}
    sizes = lambda df: {r["dataset"]: r["count"] for r in df.groupBy("dataset").count().collect()}
    assert sizes(readers.read_mixture(spark, folders)) == {"one": 1, "two": 3}
    assert sizes(readers.read_mixture(spark, folders, "single")) == {"one": 1, "two": 1}
    assert sizes(readers.read_mixture(spark, folders, "split", 0, 2)) == {"one": 1, "two": 2}
    assert sizes(readers.read_mixture(spark, folders, "split", 1, 2)) == {"two": 1}


def stored(spark, pid, at, text="x"):
    df = spark.createDataFrame([(pid, text, at)], "pid string, text string, at string")
    rows = df.select(
        "pid", F.lit("t").alias("title"), "text",
        F.struct(F.col("pid").alias("patent_id")).alias("metadata"),
        F.array(F.lit(1.0)).alias("embedding"), F.lit(0).alias("cluster_id"), F.col("at").cast("timestamp").alias("at"),
    )
    return writers.vector_rows(rows, F.col("at"))


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_vector_table(stored(spark, "a", "2024-01-01 00:00:00", "y" * 20_000), path)
    writers.write_vector_table(stored(spark, "a", "2024-01-01 01:00:00"), path, "append")
    assert readers_count(spark, path) == 2
    assert readers_count(spark, path, on_conflict="replace") == 1
    now = F.lit("2024-01-01 01:10:00").cast("timestamp")
    assert readers_count(spark, path, ttl=1800, now=now) == 1
    longest = writers.read_vector_table(spark, path).select(F.max(F.length("summary"))).first()[0]
    assert longest == 10_000


def readers_count(spark, path, **options):
    return writers.read_vector_table(spark, path, **options).count()


def test_blanks_survive_tsv(spark, tmp_path):
    df = spark.createDataFrame([("Q2", " b "), ("Q10", 'say "x"')], "qid string, text string")
    writers.write_queries(df, str(tmp_path / "q"), fmt="tsv")
    got = spark.read.csv(str(tmp_path / "q"), sep="\t", quote='"', escape='"', schema="qid string, text string")
    assert [tuple(r) for r in got.collect()] == [("Q2", " b "), ("Q10", 'say "x"')]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    import numpy as np

    from findry.functions.text import passage_text

    source = tmp_path / "in"
    source.mkdir()
    centers = np.eye(2, 8)

    def arrive(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))
        job = ingest_stream(spark, str(source), str(tmp_path / "table"), centers, str(tmp_path / "ck"), dim=8)
        job.awaitTermination()

    record = lambda pid, text: {"pid": pid, "title": "t", "text": text, "metadata": {"patent_id": pid}, "ts": "2024-01-01T00:00:00Z"}
    arrive("1.json", [record("a", "one two"), record("b", None), record("a", "one two")])
    arrive("2.json", [record("b", "again"), record("c", "three")])
    # older than anything before, and never seen
    arrive("3.json", [dict(record("d", "late"), ts="2020-01-01T00:00:00Z")])
    table = str(tmp_path / "table")
    assert writers.read_vector_table(spark, table).count() == 6
    rows = writers.read_vector_table(spark, table, on_conflict="replace")
    got = {r["pid"]: (r["summary"], r["embedding"]) for r in rows.collect()}
    assert rows.count() == 4 and got["d"][0] == "late"
    assert got["b"][0] in ("No text", "again")
    # a batch load goes to the same table
    first = writers.read_vector_table(spark, table).where("pid = 'a'").limit(1)
    writers.write_vector_table(materialize(first), table, "append")
    assert writers.read_vector_table(spark, table).count() == 7
    batch = spark.createDataFrame([("a", "t", "one two"), ("c", "t", "three")], "pid string, title string, text string")
    whole = batch.withColumn("w", passage_text(F.col("title"), F.col("text")))
    for r in embed(whole, "w", dim=8).collect():
        assert got[r["pid"]][1] == r["embedding"]


def test_arrays_stay_small_and_none_is_lost(spark, tmp_path):
    lines, arrays = str(tmp_path / "lines"), str(tmp_path / "arrays")
    rows = spark.range(0, 50, 1, 2).select(F.col("id").cast("string").alias("doc_id"), F.lit("a\n]").alias("input"))
    writers.write_results(rows, lines, per_file=10)
    writers.write_arrays(spark, lines, arrays)
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "arrays").glob("part-*")]
    assert sum(sizes) == 50 and max(sizes) <= 10
    got = readers.read_generations(spark, arrays)
    assert sorted(int(r["doc_id"]) for r in got.collect()) == list(range(50))
    assert got.first()["input"] == "a\n]"


def test_examples_are_stored_compressed(spark, tmp_path):
    text = "".join(chr(97 + i * i % 23) for i in range(2000))
    ctx = F.struct(F.lit("t").alias("title"), F.lit(text).alias("text"))
    rows = spark.range(40).select(F.lit("q").alias("question"), F.array(ctx, ctx).alias("positive_ctxs"))
    writers.write_examples(rows, str(tmp_path / "e.jsonl"))
    assert sum(p.stat().st_size for p in (tmp_path / "e.jsonl").iterdir()) < 40 * 2000 / 2
    got = readers.read_examples(spark, str(tmp_path / "e.jsonl"))
    assert got.count() == 40 and all(r["positive_ctxs"][1]["text"] == text for r in got.collect())


def test_a_cell_of_large_rows_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "_BYTES_PER_FILE", 10_000)
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("pid"), F.lit("t").alias("title"), F.repeat(F.lit("x"), F.lit(1000)).alias("text"),
        F.struct(F.lit("p").alias("patent_id")).alias("metadata"), F.array(F.lit(0.0)).alias("embedding"),
        F.lit(3).alias("cluster_id"),
    )
    path = str(tmp_path / "table")
    # adaptive execution would put pieces as small as these together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_vector_table(writers.vector_rows(rows), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{path}/load=*/cluster_id=3/part-*")) > 1
    assert writers.read_vector_table(spark, path).select("pid").distinct().count() == 40
