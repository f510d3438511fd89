"""Dataset construction quirks on hand-made rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from findry.functions.text import coverage_score
from findry.operators import dataset, indexing, joins, mining, stats

ROWS = [
    (10, "t1", "x", "A"),
    (11, "t2", None, "B"),
    (12, "t1", "x", "C"),  # the same pair again
    (13, "t3", "x", "D"),
    (14, "t3", None, "E"),
]


@pytest.fixture(scope="module")
def built(spark):
    src = spark.createDataFrame(ROWS, "ord long, title string, text string, applicant string")
    corpus, queries = dataset.build_corpus(src), dataset.build_queries(src)
    return src, corpus, queries, dataset.build_qrels(src, queries, corpus)


def test_first_row_wins(built):
    _, corpus, queries, _ = built
    got = {r["pid"]: (r["title"], r["text"], r["applicant"]) for r in corpus.collect()}
    assert got == {"C0": ("t1", "x", "A"), "C1": ("t2", ".", "B")}
    assert {r["qid"]: r["text"] for r in queries.collect()} == {"Q0": "t1", "Q1": "t2", "Q2": "t3"}


def test_qrels_keep_duplicates(built):
    src, corpus, queries, qrels = built
    pairs = sorted((r["qid"], r["pid"]) for r in qrels.collect())
    assert pairs == [("Q0", "C0"), ("Q0", "C0"), ("Q1", "C1"), ("Q2", "C0"), ("Q2", "C1")]
    once = dataset.build_qrels(src, queries, corpus, distinct=True)
    assert sorted((r["qid"], r["pid"]) for r in once.collect()) == sorted(set(pairs))
    assert {r["qid"]: r["gold"] for r in dataset.first_gold(qrels).collect()} == {
        "Q0": "C0",
        "Q1": "C1",
        "Q2": "C0",
    }


def test_salting_changes_nothing(built):
    src, corpus, queries, qrels = built
    salted = dataset.build_qrels(src, queries, corpus, hot_rows=1)
    key = lambda r: tuple(r)
    assert sorted(map(key, salted.collect())) == sorted(map(key, qrels.collect()))


def test_hot_keys_and_salted_join(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert joins.hot_keys(left, "k", min_rows=100) == [1]
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = joins.salted_join(left, right, "k", "id", how, salts=4, min_rows=100)
        assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    with pytest.raises(ValueError):
        joins.salted_join(left, right, "k", "id", "full")


def test_long_lists_keep_shape_and_order(built):
    _, corpus, queries, _ = built
    spark = corpus.sparkSession
    many = spark.range(500).select(
        F.lit("Q0").alias("qid"), F.lit("C0").alias("pid"), F.col("id").alias("ord")
    )
    few = many.where("ord < 3").withColumn("qid", F.lit("Q1"))
    qrels = many.unionByName(few)
    grouped = dataset.group_qrels(qrels).collect()
    assert sorted(r["place"] for r in grouped if r["qid"] == "Q0") == list(range(500))
    assert sorted(r["place"] for r in grouped if r["qid"] == "Q1") == [0, 1, 2]
    examples = dataset.build_examples(qrels, queries, corpus)
    assert examples.where("qid = 'Q0'").count() == 500
    nested = dataset.nest_examples(examples).where("qid = 'Q0'").collect()
    assert len(nested) == 1 and len(nested[0]["positive_ctxs"]) == 500


def test_missing_passage(built):
    _, corpus, _, _ = built
    spark = corpus.sparkSession
    hits = spark.createDataFrame([("Q0", "C0"), ("Q0", "C9")], "qid string, pid string")
    assert dataset.attach_passages(hits, corpus, on_missing="drop").count() == 1
    kept = dataset.attach_passages(hits, corpus, on_missing="null").orderBy("pid").collect()
    assert [r["title"] for r in kept] == ["t1", None]
    with pytest.raises(PySparkException, match="C9"):
        dataset.attach_passages(hits, corpus).count()


@pytest.mark.parametrize("n, test, dev, want", [(20000, 0.3, 0.2, (11200, 2800, 6000)), (12757, 0.2, 0.2, (8164, 2041, 2552))])
def test_recorded_split_counts(spark, n, test, dev, want):
    split = indexing.split_rows(spark.range(n), ["id"], test, dev, seed=1)
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert (got["train"], got["dev"], got["test"]) == want


def test_hash_cuts_go_down_to_the_leaf(spark, monkeypatch):
    monkeypatch.setattr(indexing, "_LEAF_ROWS", 3)
    monkeypatch.setattr(indexing, "_PREFIX_DIGITS", 1)
    rows = spark.range(500).select(indexing.hash_order(1, F.col("id")).alias("h"))
    ordered = sorted(r["h"] for r in rows.collect())
    got = indexing.hash_cuts(rows, F.col("h"), [0, 1, 250, 500, 501])
    assert got == [None, ordered[0], ordered[249], ordered[499], None]
    assert indexing.sample_n(spark.range(500), ["id"], 77, 5).distinct().count() == 77


def test_positions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("g"))
    got = indexing.dense_index(df.orderBy(F.rand(1)), ["k"]).collect()
    assert all(r["idx"] * 3 == r["k"] for r in got) and len(got) == 1000
    inside = indexing.index_within(df, "g", ["k"]).collect()
    assert all(r["idx"] == r["k"] // 15 for r in inside)
    weighted = indexing.prefix_sum(df, ["k"], "g").collect()
    assert {r["k"]: r["start"] for r in weighted}[30] == 20


def test_shards(spark):
    df = spark.range(10)
    want = {
        "contiguous": [0, 0, 0, 1, 1, 1, 2, 2, 2, 2],
        "even": [0, 0, 0, 0, 1, 1, 1, 2, 2, 2],
        "round_robin": [1, 2, 0, 1, 2, 0, 1, 2, 0, 1],
    }
    for mode, shards in want.items():
        got = indexing.assign_shard(df, ["id"], 3, mode).orderBy("id").collect()
        assert [r["shard"] for r in got] == shards


def test_describe_matches_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.0, 7.5, 9.0, 11.0]
    got = {r["stat"]: r["value"] for r in stats.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    want = pd.Series(values).describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert abs(got[ours] - want[theirs]) < 1e-9


def test_generated_lines(spark):
    content = "1. first query\n- second\nplain line\nword\n2) 3 third\n키워드 1. no\n4. summary: no\n5.\n6. "
    df = spark.createDataFrame([(0, "doc", content)], "ord long, input string, content string")
    got = dataset.clean_generated_queries(df).orderBy("position").collect()
    assert [(r["position"], r["query"]) for r in got] == [(0, "first query"), (1, "second"), (4, "3 third"), (8, "")]


def test_mining_rules(spark):
    queries = spark.createDataFrame([("Q0", "red car"), ("Q1", "blue car"), ("Q2", "green car")], "qid string, text string")
    corpus = spark.createDataFrame([("C0", "t0", "red car"), ("C1", "t1", "blue bike"), ("C2", "t2", "green car")], "pid string, title string, text string")
    gold = spark.createDataFrame([("Q0", "C0"), ("Q1", "C1"), ("Q2", "C1")], "qid string, gold string")
    hits = spark.createDataFrame(
        [("Q0", "C0", 1), ("Q0", "C1", 2), ("Q1", "C0", 1), ("Q1", "C1", 2), ("Q2", "C2", 1)],
        "qid string, pid string, rank int",
    )
    mined = {r["qid"]: [c["title"] for c in r["negative_ctxs"]] for r in mining.mine_negatives(gold, hits, queries, corpus).collect()}
    assert mined == {"Q0": ["t1"], "Q1": ["t0"], "Q2": ["t2"]}
    hard = {r["qid"]: [c["title"] for c in r["hard_negative_ctxs"]] for r in mining.mine_hard_negative(gold, hits, queries, corpus).collect()}
    # Q0's best hit is its gold; Q2's best hit scores as relevant
    assert hard == {"Q0": [], "Q1": ["t0"], "Q2": []}
    kinds = {r["qid"]: (r["kind"], r["gold_rank"]) for r in mining.split_by_lexical_hit(gold, hits).collect()}
    assert kinds == {"Q0": ("high_lexical", 1), "Q1": ("high_lexical", 2), "Q2": ("high_semantic", None)}
    alone = hits.where("NOT (qid = 'Q0' AND rank = 2)")
    assert [r["qid"] for r in mining.strict_filter(gold, alone).collect()] == ["Q0"]


def test_stored_titles_are_found_by_row_groups(spark, plan, tmp_path):
    rows = [(i, f"title {i % 50}", "x") for i in range(400)] + [(400, None, "x"), (401, "", "y")]
    df = spark.createDataFrame(rows, "ord long, title string, text string")
    path = str(tmp_path / "titles")
    dataset.store_by_title(df, path)
    found = dataset.find_stored_title(spark, path, "title 7")
    assert sorted(r["ord"] for r in found.collect()) == list(range(7, 400, 50))
    assert "EqualTo(title_key," in plan(found).split("PushedFilters:")[1]
    assert [r["ord"] for r in dataset.find_stored_title(spark, path, "").collect()] == [401]
    assert dataset.find_stored_title(spark, path, "no such title").count() == 0


def test_attaching_fields_leaves_a_stored_lookup_in_place(spark, plan):
    rows = [(i, f"t{i}", "body " * 50) for i in range(200)]
    corpus = dataset.store_lookup(spark.createDataFrame(rows, "pid long, title string, text string"))
    hits = spark.range(500).select((F.col("id") % 7).alias("qid"), (F.col("id") % 200).alias("pid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = dataset.attach_passages(hits, corpus)
        text = plan(joined)
        assert joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1 and "Bucketed: true" in text


@pytest.mark.parametrize("scored", [False, True])
def test_a_passage_goes_once_to_a_group_of_queries(spark, plan, monkeypatch, scored):
    monkeypatch.setattr(mining, "_GROUP_HITS", 40)
    monkeypatch.setattr(mining, "_BATCH_BYTES", 100)
    # p1 stands twice with different bodies; q7 comes twice, q8 has no text, q9 hits its gold alone
    corpus = spark.createDataFrame(
        [("p0", "t0", "red car"), ("p1", "t2", "blue car"), ("p1", "t1", None), ("g", "t", "x")],
        "pid string, title string, text string",
    )
    queries = spark.createDataFrame([(f"q{i}", "red car") for i in (*range(8), 7, 9)], "qid string, text string")
    hits = [(f"q{i}", p, 1.0, r) for i in range(9) for p, r in (("p1", 2), ("g", 1), ("p0", 3))] + [("q9", "g", 1.0, 1)]
    hits = spark.createDataFrame(hits, "qid string, pid string, score double, rank int")
    gold = spark.createDataFrame([(f"q{i}", "g") for i in range(10)], "qid string, gold string")
    scorer = coverage_score if scored else None
    mined = mining.mine_negatives(gold, hits, queries, corpus, scorer)
    # bodies are put together in groups of queries, they are not shuffled once for each hit
    text = plan(mined)
    assert "FlatMapGroupsInArrow" in text and "collect_list" not in text
    names = ["title", "text", "ce_score"][: 3 if scored else 2]
    one = [("t1", None, None), ("t2", "blue car", 0.5), ("t0", "red car", 1.0)]
    rows = sorted((r["qid"], r["question"], [tuple(c[n] for n in names) for c in r["negative_ctxs"]]) for r in mined.collect())
    twice = [one[0], one[0], one[1], one[1], one[2], one[2]]
    lists = {f"q{i}": one for i in range(7)} | {"q7": twice if scored else one}
    assert [r[0] for r in rows] == [f"q{i}" for i in (*range(8), 7)]
    assert all(r[1] == "red car" and [c[:2] for c in r[2]] == [c[:2] for c in lists[r[0]]] for r in rows)
    if scored:
        assert all(c[2] == w[2] for r in rows for c, w in zip(r[2], lists[r[0]]) if w[1])
    with pytest.raises(Exception, match="no passage with id p0"):
        mining.mine_negatives(gold, hits, queries, corpus.where("pid != 'p0'"), scorer).collect()


def test_a_prepared_score_is_the_score(spark):
    pairs = spark.createDataFrame([("The red, red car", "a car"), ("", "x"), ("x y", None), ("a", "the")], "q string, t string")
    got = pairs.select(
        coverage_score(F.col("q"), F.col("t")).alias("a"),
        coverage_score.score_prepared(F.col("q"), coverage_score.prepare(F.col("t"))).alias("b"),
    ).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == 0.5
