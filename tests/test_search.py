"""Search operators against brute force, with ties and in both physical forms."""

import math
import os
import shutil

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findry.operators import blockwise
from findry.operators import embed as emb
from findry.operators import lexical, vector
from findry.operators.blockwise import _best


def hits_of(df):
    return sorted((r["qid"], r["rank"], r["pid"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def crowd(spark):
    """Vectors of which a third are one and the same."""
    rng = np.random.default_rng(3)
    rows = [(f"P{i:03d}", [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).round(3).tolist()) for i in range(300)]
    items = spark.createDataFrame(rows, "pid string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, rng.normal(size=3).round(3).tolist()) for i in range(9)], "qid long, embedding array<float>")
    return queries, items


def brute(queries, items, k):
    q = queries.orderBy("qid").collect()
    p = sorted(items.collect(), key=lambda r: r["pid"])
    m = np.array([r["embedding"] for r in p], dtype=float)
    out = []
    for r in q:
        s = np.round(m @ np.array(r["embedding"], dtype=float), 6)
        order = sorted(range(len(p)), key=lambda i: (-s[i], p[i]["pid"]))[:k]
        out += [(r["qid"], j + 1, p[i]["pid"], float(s[i])) for j, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 150, 400])
def test_knn_ties_in_both_forms(crowd, k):
    queries, items = crowd
    want = brute(queries, items, k)
    for df in (vector.knn_join(queries, items, k), vector.knn_join(queries, items, k, bound=4)):
        got = hits_of(df)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_best_fills_ties_in_order():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [np.nan, 1.0, np.nan, 1.0, 1.0]])
    assert _best(scores, 2).tolist() == [[1, 2], [1, 3]]


def test_cosine_of_zero_vector(spark):
    items = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "pid long, embedding array<float>")
    queries = spark.createDataFrame([(0, [30.0, 40.0])], "qid long, embedding array<float>")
    assert hits_of(vector.knn_join(queries, items, 2, "cos")) == [(0, 1, 1, 1.0), (0, 2, 0, 0.0)]


def test_ivf_crowded_cell(crowd):
    queries, items = crowd
    index = vector.build_ivf(items, nlist=4, rounds=3)
    exact = hits_of(vector.knn_join(queries, items, 20))
    assert hits_of(vector.ivf_search(queries, index, 20, nprobe=4)) == exact
    assert hits_of(vector.ivf_search(queries, index, 20, nprobe=4, bound=4, item_block=50)) == exact
    # rows of cells that nobody probes meet no query
    probed = vector.probe_cells(queries, index.centers(), 1)
    q, i = vector.cell_pairs(probed, index.rows, 4, 50)
    keys = ["cluster_id", "_qb", "_ib"]
    asked = {r["cluster_id"] for r in q.select("cluster_id").distinct().collect()}
    assert {r["cluster_id"] for r in i.select("cluster_id").distinct().collect()} <= asked
    assert i.join(q.select(*keys).distinct(), keys, "left_anti").groupBy("cluster_id").count().count() <= len(asked)
    few = vector.ivf_search(queries, index, 20, nprobe=1)
    cells = {r["pid"]: r["cluster_id"] for r in index.rows.collect()}
    assert few.count() > 0
    assert all(len({cells[p] for q2, _, p, _ in hits_of(few) if q2 == q}) == 1 for q in range(9))


def test_many_queries_leave_the_items_where_they_are(crowd, plan, monkeypatch):
    queries, items = crowd
    stored = items.sparkSession.createDataFrame(items.collect(), items.schema)
    text = plan(vector.knn_join(queries, stored, 5, bound=4))
    # what is shuffled are hits, by query
    assert text.count("Exchange") == text.count("Exchange hashpartitioning(qid")
    assert text.count("MapInArrow") >= 3
    monkeypatch.setattr(blockwise, "_CHUNKS_PER_PLAN", 2)
    assert hits_of(vector.knn_join(queries, stored, 5, bound=2)) == hits_of(vector.knn_join(queries, stored, 5))


def test_saved_index_prunes_by_probed_cells(spark, crowd, plan, tmp_path):
    queries, items = crowd
    path = str(tmp_path / "ivf")
    vector.save_ivf(vector.build_ivf(items, nlist=4, rounds=3), path)
    index = vector.load_ivf(spark, path)
    pruned = plan(index.rows.where("cluster_id IN (1, 2)")).split("PartitionFilters: [")[1]
    assert pruned.startswith("cluster_id") and " IN (1,2)]" in pruned
    text = plan(vector.ivf_search(queries, index, 5, nprobe=1))
    assert "dynamicpruningexpression(cluster_id" in text


def test_append_that_breaks_off_leaves_the_index_readable(spark, crowd, tmp_path, monkeypatch):
    queries, items = crowd
    path = str(tmp_path / "ivf")
    with pytest.raises(ValueError, match="no index"):
        vector.load_ivf(spark, path)
    vector.save_ivf(vector.build_ivf(items, nlist=4, rounds=3), path)
    extra = items.limit(1).withColumn("pid", F.lit("new"))
    vector.append_vectors(spark, path, extra)
    with monkeypatch.context() as broken:
        broken.setattr(vector, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        for job in (
            lambda: vector.append_vectors(spark, path, extra),
            lambda: vector.compact_ivf(spark, path),
            lambda: vector.save_ivf(vector.load_ivf(spark, path), path),
        ):
            with pytest.raises(OSError):
                job()
    assert vector.load_ivf(spark, path).rows.count() == 301
    gone = vector._last_commit(spark, path)["loads"][-1]
    shutil.rmtree(vector._load_path(path, gone) + "/" + sorted(x for x in os.listdir(vector._load_path(path, gone)) if "=" in x)[0])
    with pytest.raises(Exception, match="expected 301|infer schema|UNABLE_TO_INFER"):
        vector.load_ivf(spark, path)


def test_compaction_keeps_the_latest_rows(spark, crowd, tmp_path):
    queries, items = crowd
    path = str(tmp_path / "ivf")
    old = items.withColumn("embedding", F.transform("embedding", lambda x: x * 0.5))
    vector.save_ivf(vector.build_ivf(old, nlist=3, rounds=2), path)
    for part in range(3):
        vector.append_vectors(spark, path, items.where(F.substring("pid", -1, 1) % 3 == part))
    files = lambda: len(vector.load_ivf(spark, path).rows.inputFiles())
    before = files()
    vector.compact_ivf(spark, path, keep=F.col("pid") != "P000")
    index = vector.load_ivf(spark, path)
    assert files() < before and index.rows.count() == 299
    assert hits_of(vector.ivf_search(queries, index, 9, nprobe=3)) == hits_of(
        vector.knn_join(queries, items.where("pid != 'P000'"), 9)
    )


def test_pq_is_exact_with_enough_codes(spark):
    points = [(i, [float(i % 4), float(i // 4)]) for i in range(16)]
    items = spark.createDataFrame(points, "pid long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.1])], "qid long, embedding array<float>")
    index = vector.build_pq(items, 2, n_subquantizers=2, n_bits=3, rounds=20)
    assert hits_of(vector.pq_search(queries, index, 16)) == hits_of(vector.knn_join(queries, items, 16))


def test_rerank_stays_inside_the_hits(spark, crowd):
    queries, items = crowd
    first = vector.knn_join(queries, items, 5)
    again = vector.rerank(first, queries, items, 10)
    assert hits_of(again) == hits_of(first)
    assert vector.fetch_vectors(items, first).count() == first.select("pid").distinct().count()


def test_bm25_formula(spark):
    docs = [("a", "red red car"), ("b", "blue car"), ("c", "…"), ("d", "")]
    corpus = spark.createDataFrame(docs, "pid string, text string")
    index = lexical.build_index(corpus)
    assert (index.n_docs, index.avg_dl) == (3, 2.0)  # a text without tokens does not count
    queries = spark.createDataFrame([("q", "Red car red"), ("none", "zzz")], "qid string, text string")
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    tf = lambda f, dl: f / (f + 0.9 * (0.6 + 0.4 * dl / 2.0))
    a = 2 * idf(1) * tf(2, 3) + idf(2) * tf(1, 3)
    b = idf(2) * tf(1, 2)
    assert hits_of(lexical.bm25_search(queries, index, 10)) == [("q", 1, "a", round(a, 6)), ("q", 2, "b", round(b, 6))]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "_DOC_BITS", 4)
    monkeypatch.setattr(lexical, "_QUERY_BITS", 2)


def test_bm25_common_term_in_both_forms(spark, small_blocks):
    rows = [(i, "the " + " ".join(f"w{(i * j) % 11}" for j in range(1, 4))) for i in range(200)]
    corpus = spark.createDataFrame(rows, "pid long, text string").repartition(4)
    queries = spark.createDataFrame([(i, f"the w{i}") for i in range(11)], "qid long, text string")
    index = lexical.build_index(corpus)
    one = hits_of(lexical.bm25_search(queries, index, 15))
    assert len(one) == 11 * 15
    assert one == hits_of(lexical.bm25_search(queries, index, 15, direct_blocks=0))


def test_bm25_second_pass_leaves_blocks_out(spark, small_blocks, monkeypatch):
    rows = [(i, "the and " + ("rare " * 3 if i < 6 else f"x{i} y{i}")) for i in range(320)]
    corpus = spark.createDataFrame(rows, "pid long, text string").coalesce(1)
    queries = spark.createDataFrame([("q", "the rare and")], "qid string, text string")
    index = lexical.build_index(corpus)
    asked = []
    products = lexical._products

    def counted(lists, wanted, keys, k):
        asked.append(wanted.select("block").distinct().count())
        return products(lists, wanted, keys, k)

    monkeypatch.setattr(lexical, "_products", counted)
    hits = hits_of(lexical.bm25_search(queries, index, 5, direct_blocks=0))
    assert [h[2] for h in hits] == [0, 1, 2, 3, 4]
    assert asked == [1, 0]  # no block of common words alone is joined


def test_bm25_is_a_join_on_terms(spark, plan):
    corpus = spark.createDataFrame([(0, "a b"), (1, "b c")], "pid long, text string")
    queries = spark.createDataFrame([(0, "b")], "qid long, text string")
    index = lexical.build_index(corpus)
    text = plan(lexical.bm25_search(queries, index, 2))
    assert "Join [term#" in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_lookup_reads_the_parts_of_its_terms(spark, plan):
    rows = [(i, f"w{i % 40} all") for i in range(100)]
    index = lexical.build_index(spark.createDataFrame(rows, "pid long, text string"))
    found = index.lookup(["w3"])
    assert sorted(r["pid"] for r in found.collect()) == [3, 43, 83]
    text = plan(found)
    assert "PartitionFilters: [part#" in text and "In(term" in text or "EqualTo(term" in text
    assert len({r["part"] for r in index.lists.select("part").distinct().collect()}) > 8
    assert index.lookup(["absent"]).count() == 0


def test_index_is_built_without_a_shuffle(spark, plan):
    docs = spark.range(10).select(F.col("id").alias("pid"), F.lit("a b a").alias("text"))
    counted = docs.select("pid", lexical.term_counts(F.split("text", " ")).alias("t"))
    assert "Exchange" not in plan(counted)
    assert counted.first()["t"]["terms"] == [("a", 2), ("b", 1)]


def test_plans_have_no_cartesian_product(spark, crowd, plan):
    queries, items = crowd
    text = plan(vector.knn_join(queries, items, 5))
    assert "WindowGroupLimit" in text and "MapInArrow" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_default_encoder(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "")], "i int, text string")
    rows = emb.embed(df, "text", dim=8).orderBy("i").collect()
    assert abs(np.linalg.norm(rows[0]["embedding"]) - 1) < 1e-9
    assert rows[1]["embedding"] == [0.0] * 8
    capped = emb.embed(df, "text", dim=8, max_tokens=1).orderBy("i").first()["embedding"]
    assert sorted(capped) == [0.0] * 7 + [1.0]


def test_plugged_encoder_keeps_rows_in_order(spark):
    seen = []

    def encoder(batches):
        for texts in batches:
            assert len(texts) <= 3
            yield pd.Series([[float(len(t))] for t in texts])

    df = spark.range(50).select("id", F.expr("repeat('x', cast(id as int))").alias("text"))
    rows = emb.embed(df, "text", encoder=encoder, batch_size=3).collect()
    assert all(r["embedding"] == [float(r["id"])] for r in rows) and len(rows) == 50


@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_bm25_sums_in_all_forms(spark, monkeypatch, cells):
    # 64: queries of few products are sorted, the others take rows of places
    monkeypatch.setattr(lexical, "_CELLS", cells)
    monkeypatch.setattr(lexical, "_GROUP", 4)
    monkeypatch.setattr(lexical, "_HEAVY", 2)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.3, 12) % 60) for _ in range(150)]
    asked = [" ".join(t.split()[:n]) for n, t in zip([1, 2, 3, 9] * 10, texts)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "pid long, text string").repartition(2)
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    bags = [t.split() for t in texts]
    df = {w: sum(w in b for b in bags) for b in bags for w in b}
    want = []
    for q, text in enumerate(asked):
        score = {}
        for p, bag in enumerate(bags):
            parts = [
                math.log(1 + (150 - df[w] + 0.5) / (df[w] + 0.5)) * bag.count(w) / (bag.count(w) + 0.9)
                for w in text.split()
            ]
            if sum(parts):
                score[p] = round(sum(parts), 6)
        best = sorted(score, key=lambda p: (-score[p], p))[:7]
        want += [(q, i + 1, p, score[p]) for i, p in enumerate(best)]
    got = hits_of(lexical.bm25_search(queries, lexical.build_index(corpus), 7))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_a_task_inverts_its_blocks():
    terms = [[("b", 1), ("a", 2)], [("a", 1)], [("c", 3)]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([2, 3, 4]), pa.array([3, 1, 3], pa.int32()),
         pa.array([[{"term": t, "tf": n} for t, n in row] for row in terms])],
        ["doc", "dl", "terms"],
    )
    # blocks of four places; a block that goes on in the next batch is one block
    made = [r for x in lexical._inverted(2)(iter([batch.slice(0, 1), batch.slice(1, 2)])) for r in x.to_pylist()]
    assert sorted((r["term"], r["block"], r["places"], r["lengths"], r["counts"]) for r in made) == [
        ("a", 0, [2, 3], [3, 1], [2, 1]),
        ("b", 0, [2], [3], [1]),
        ("c", 1, [0], [3], [3]),
    ]


def test_scans_and_copies_do_not_grow_with_the_queries(spark, crowd, monkeypatch):
    queries, items = crowd
    monkeypatch.setattr(blockwise, "_SCANS", 2)
    chunks = blockwise.query_chunks(queries, "embedding", 1)
    assert len(chunks) == 2 and sum(c.count() for c in chunks) == queries.count()
    index = vector.build_ivf(items, nlist=2, rounds=1)
    q, i = vector.cell_pairs(vector.probe_cells(queries, index.centers(), 1), index.rows, 1, 1)
    assert q.count() <= 4 * queries.count() and i.count() <= 8 * items.count()


def test_running_best_over_wide_parts():
    draw = np.random.default_rng(3)
    scores = np.round(draw.normal(size=(6, 1500)), 2)
    scores[0, :1490] = np.nan
    scores[1] = np.nan
    running = blockwise._Running(6, 4)
    ids = np.arange(1500).astype(object)
    for at in range(0, 1500, 500):
        running.add(slice(0, 6), scores[:, at : at + 500], ids[at : at + 500])
    qids, pids, got = running.emit(np.arange(6))
    for q in range(6):
        real = [p for p in range(1500) if not np.isnan(scores[q, p])]
        want = sorted(real, key=lambda p: (-scores[q, p], p))[:4]
        assert list(pids[qids == q]) == want
        assert np.allclose(got[qids == q], scores[q, want])


def test_bm25_query_that_comes_twice_asks_once(spark):
    corpus = spark.createDataFrame([(0, "a b"), (1, "b c")], "pid long, text string")
    index = lexical.build_index(corpus)
    queries = spark.createDataFrame([(0, "b c"), (1, "a")], "qid long, text string")
    once = hits_of(lexical.bm25_search(queries, index, 2))
    assert hits_of(lexical.bm25_search(queries.unionAll(queries), index, 2)) == once


def test_blocks_of_documents_do_not_follow_the_splits(spark):
    # a list travels once for each block of queries, a query once for each block of documents
    corpus = spark.range(0, 400, 1, 40).select(F.col("id").alias("pid"), F.lit("a b a").alias("text"))
    index = lexical.build_index(corpus)
    assert index.docs.select(F.shiftright("doc", lexical._DOC_BITS)).distinct().count() <= 4
    assert sorted(r["pid"] for r in index.docs.collect()) == list(range(400))
    assert {(r["term"], r["tf"], r["dl"]) for r in index.postings().collect()} == {("a", 2, 3), ("b", 1, 3)}


def test_a_task_cuts_a_block_of_many_tokens(monkeypatch):
    monkeypatch.setattr(lexical, "_TOKENS", 1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1, 2]), pa.array(["x", None, "z"]), pa.array([["b", "a", "b"], [], ["a"]])],
        ["doc", "pid", "tokens"],
    )
    made = [r for x in lexical._inverted(2)(iter([batch.slice(i, 1) for i in range(3)])) for r in x.to_pylist()]
    docs = [r for r in made if r["pids"] is not None]
    assert [(p, n, i) for r in docs for p, n, i in zip(r["places"], r["lengths"], r["pids"])] == [(0, 3, "x"), (2, 1, "z")]
    lists = [(r["term"], r["block"], r["places"], r["counts"]) for r in made if r["pids"] is None]
    assert sorted(lists) == [("a", 0, [0], [1]), ("a", 0, [2], [1]), ("b", 0, [0], [2])]


@pytest.mark.parametrize("k", [1, 3])
def test_bm25_documents_beyond_the_long_ones(spark, monkeypatch, k):
    # short documents are looked at only where they can reach the k-th score; both are best at times
    monkeypatch.setattr(lexical, "_CELLS", 64)
    monkeypatch.setattr(lexical, "_GROUP", 2)
    monkeypatch.setattr(lexical, "_HEAVY", 3)
    draw = np.random.default_rng(7)
    bags = [[f"w{int(x)}" for x in draw.zipf(1.3, int(n)) % 40] for n in draw.integers(1, 60, 300)]
    corpus = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bags)], "pid long, text string")
    asked = [" ".join(b[:12]) for b in bags[::5]]
    index = lexical.build_index(corpus.coalesce(1))
    got = hits_of(lexical.bm25_search(spark.createDataFrame(list(enumerate(asked)), "qid long, text string"), index, k))
    df = {w: sum(w in b for b in bags) for w in {w for b in bags for w in b}}
    mean = sum(map(len, bags)) / 300
    want = []
    for q, text in enumerate(asked):
        score = {}
        for p, bag in enumerate(bags):
            damped = 0.9 * (0.6 + 0.4 * len(bag) / mean)
            score[p] = round(sum(
                math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * bag.count(w) / (bag.count(w) + damped)
                for w in text.split()
            ), 6)
        best = sorted((p for p in score if score[p] > 0), key=lambda p: (-score[p], p))[:k]
        want += [(q, i + 1, p, score[p]) for i, p in enumerate(best)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
