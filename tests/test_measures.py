"""Metrics against values worked out by hand, and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from findry.operators import metrics, training


def table_of(df):
    return {(r["metric"], r["k"]): r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def case(spark):
    run = spark.createDataFrame(
        [
            ("q1", "d1", 3.0), ("q1", "d2", 2.0), ("q1", "d3", 1.0), ("q1", "q1", 9.0),
            ("q2", "d9", 1.0), ("q2", "d1", 1.0),
            ("q4", "d1", 1.0),  # never judged
        ],
        "qid string, pid string, score double",
    )
    qrels = spark.createDataFrame(
        [("q1", "d2", 2), ("q1", "d3", 1), ("q1", "d7", 1), ("q1", "d2", 2), ("q2", "d1", 1), ("q3", "d5", 1), ("q2", "d8", 0)],
        "qid string, pid string, score int",
    )
    return run, qrels


def test_by_hand(case):
    got = table_of(metrics.evaluate_run(*case, ks=(1, 3)))
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    ideal = 2 + 1 / math.log2(3) + 1 / math.log2(4)
    want = {
        # the hit that is the query itself is dropped; ties go by id
        ("NDCG", 1): (0 + 1) / 2,
        ("NDCG", 3): (dcg / ideal + 1) / 2,
        ("MAP", 3): ((1 / 2 + 2 / 3) / 3 + 1) / 2,
        ("Recall", 3): (2 / 3 + 1) / 2,
        ("P", 3): (2 / 3 + 1 / 3) / 2,
        # these divide by all three judged queries
        ("MRR", 3): (1 / 2 + 1) / 3,
        ("R_cap", 1): (0 + 1) / 3,
        ("Hole", 1): 0.0,
        ("Hole", 3): (1 / 3) / 3,
    }
    for key, value in want.items():
        assert got[key] == pytest.approx(round(100 * value, 3)), key
    assert all(0 <= v <= 100 for v in got.values())


def test_identical_ids_can_be_kept(case):
    got = table_of(metrics.evaluate_run(*case, ks=(3,), ignore_identical=False))
    assert got[("Recall", 3)] == pytest.approx(66.667)


def test_answers(spark):
    ctx = "array<struct<id:string,title:string,text:string,score:string>>"
    rows = [
        (0, ["x"], [("a", "", "no", "1"), ("b", "", "an x here", "1")]),
        (1, ["y"], [("a", "", "no", "1"), ("b", "", None, "1")]),
        (2, ["no"], [("a", "", "no", "1"), ("b", "", "no", "1")]),
    ]
    df = spark.createDataFrame(rows, f"qid long, answers array<string>, ctxs {ctx}")
    hits = metrics.answer_hits(df)
    assert [(r["k"], r["hits"]) for r in metrics.topk_hits(hits).orderBy("k").collect()] == [(1, 1), (2, 2)]
    got = {r["k"]: r["recall"] for r in metrics.answer_recall(hits, (1, 2, 5)).collect()}
    assert got == {1: pytest.approx(33.333333), 2: pytest.approx(66.666667)}
    flags = [[c["hasanswer"] for c in r["ctxs"]] for r in metrics.add_hasanswer(df).orderBy("qid").collect()]
    assert flags == [[False, True], [False, False], [True, True]]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_inversions(spark, block):
    rng = random.Random(5)
    rows, want = [], {}
    for q, n in enumerate((1, 2, 40, 65)):
        order = rng.sample(range(n), n)
        rows += [(q, pos, gold) for pos, gold in enumerate(order)]
        want[q] = sum(order[i] > order[j] for i in range(n) for j in range(i + 1, n))
    df = spark.createDataFrame(rows, "qid long, pos long, gold_pos long")
    got = {r["qid"]: r["inversions"] for r in metrics.inversions(df, block).collect()}
    assert got == want


def test_topk_agreement(spark):
    df = spark.createDataFrame([(0, p, g) for p, g in enumerate([2, 0, 3, 1])], "qid long, pos long, gold_pos long")
    got = {r["k"]: (r["avg_topk"], r["idx_topk"]) for r in metrics.topk_agreement(df, (1, 2, 4)).collect()}
    assert got == {1: (0.0, 2), 2: (0.5, 4), 4: (1.0, 4)}


def test_pool_ranks_in_both_forms(spark):
    vec = lambda i: [math.cos(i), math.sin(i)]
    pool = spark.createDataFrame([(i, vec(i)) for i in range(60)], "pid long, embedding array<double>")
    queries = spark.createDataFrame([(i, vec(i), 1.0 if i % 2 else 0.5) for i in range(20)], "qid long, embedding array<double>, gold_score double")
    want = {}
    for i in range(20):
        bar = 1.0 if i % 2 else 0.5
        want[i] = 1 + sum(round(math.cos(i - j), 6) > bar for j in range(60))
    for bounds in ({}, {"bound": 6, "item_block": 20}):
        got = {r["qid"]: r["rank"] for r in training.pool_ranks(queries, pool, **bounds).collect()}
        assert got == want


def test_contrastive_stats(spark):
    rows = [(0, 0, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]), (0, 1, [0.0, 1.0], [[1.0, 1.0], [0.0, 3.0]])]
    df = spark.createDataFrame(rows, "batch long, slot long, q array<double>, key_vectors array<array<double>>")
    got = training.contrastive_stats(df, temperature=1.0).first()
    # keys in order: gold 0, gold 1, then the extra negatives of both rows
    losses = [
        math.log(sum(map(math.exp, [1, 1, 0, 0]))) - 1,
        math.log(sum(map(math.exp, [0, 1, 1, 3]))) - 1,
    ]
    assert got["loss"] == pytest.approx(sum(losses) / 2) and got["accuracy"] == 50.0 and got["n"] == 2


def test_chunks_across_lists(spark):
    lists = [[1, 2, 3], [], [4], [5, 6, 7, 8, 9, 10, 11], [12]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "ord long, tokens array<int>")
    got = {r["chunk_id"]: r["tokens"] for r in training.chunk_tokens(df, 4, 1).collect()}
    assert got == {0: [2, 3, 4, 5], 1: [6, 7, 8, 9]}
    whole = {r["chunk_id"]: r["tokens"] for r in training.chunk_tokens(df, 3).collect()}
    assert whole == {0: [1, 2, 3], 1: [4, 5, 6], 2: [7, 8, 9], 3: [10, 11, 12]}


def test_sampling_caps(spark):
    ctx = "array<struct<title:string,text:string>>"
    rows = [
        (0, "q", [("p", "p")], [("n", str(i)) for i in range(2)], [("h", str(i)) for i in range(3)]),
        (1, "q", [("p", "p")], None, None),
    ]
    df = spark.createDataFrame(rows, f"qid long, question string, positive_ctxs {ctx}, negative_ctxs {ctx}, hard_negative_ctxs {ctx}")
    hard = training.sample_negatives(df, 5, hard_ratio=1.0, min_idx=1).orderBy("qid").collect()
    assert sorted(c["text"] for c in hard[0]["negatives"] if c["title"] == "h") == ["1", "2"]
    assert sorted(c["text"] for c in hard[0]["negatives"] if c["title"] == "n") == ["0", "1"]
    assert hard[1]["negatives"] == []
    first = training.sample_negatives(df.drop("hard_negative_ctxs"), training=False).orderBy("qid").collect()
    assert [len(r["negatives"]) for r in first] == [1, 0]


def test_padding_and_collation(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [3]), (1, [])], "batch long, tokens array<int>")
    got = sorted((r["batch"], r["tokens"], r["mask"]) for r in training.pad_mask(df).collect())
    assert got == [(0, [1, 2], [1, 1]), (0, [3, 0], [1, 0]), (1, [], [])]
    texts = spark.createDataFrame(
        [(0, 1, "q1", "g1", ["n1", "n2"]), (0, 0, "q0", "g0", ["n0"])],
        "batch long, slot int, query string, gold string, negatives array<string>",
    )
    row = training.collate(texts).first()
    assert row["queries"] == ["q0", "q1"] and row["passages"] == ["g0", "g1", "n0", "n1", "n2"]


def test_shuffle_augmentation_permutes(spark):
    from findry.functions import tokens as tk

    df = spark.createDataFrame([(i, list(range(i))) for i in range(30)], "id int, t array<int>")
    got = df.select("t", tk.shuffle_tokens(F.col("t"), 0.5, 1, F.col("id")).alias("s")).collect()
    assert all(sorted(r["s"]) == r["t"] for r in got) and any(r["s"] != r["t"] for r in got)


def test_long_chats_keep_every_turn(spark):
    from findry.operators import rag

    turns = spark.range(1500).selectExpr(
        "1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
        "cast(id as string) as text",
    )
    history = rag.chat_history(turns).withColumnRenamed("conv_id", "qid")
    asked = spark.createDataFrame(
        [(1, "q", "c", "new"), (2, "q", "c", "alone")],
        "qid long, query string, context string, message string",
    )
    got = rag.rag_messages(asked, history).orderBy("qid", "place").collect()
    first = [r for r in got if r["qid"] == 1]
    assert [r["place"] for r in first] == list(range(1502))
    assert [r["content"] for r in first[1:-1]] == [str(i) for i in range(1500)]
    assert first[-1]["content"] == "new"
    assert [(r["role"], r["place"]) for r in got if r["qid"] == 2] == [("system", 0), ("user", 1)]


def test_no_negatives_asked_for(spark):
    from findry.operators import training

    ctx = "array<struct<title:string,text:string>>"
    df = spark.createDataFrame(
        [(1, [("a", "b")], [("c", "d")], [("e", "f")])],
        f"qid long, positive_ctxs {ctx}, negative_ctxs {ctx}, hard_negative_ctxs {ctx}",
    )
    assert training.sample_negatives(df, n=0, hard_ratio=0.5).first()["negatives"] == []
