import hashlib
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402
from oracle import differences  # noqa: E402

from findry.llm import (  # noqa: E402
    bpe,
    chat,
    exactdedup,
    interpolation,
    langid,
    linededup,
    lshforest,
    mixing,
    mtree,
    quality,
    queries,
)
from findry.llm.components import components, stars  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return H.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, H.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], H.SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


# -- 1: chat -------------------------------------------------------------------


def chat_rows():
    texts = [
        "plain", "", None, "\\### Assistant: </turn> ok", "### User: hi", "a </turn>", "</turn>\n",
        "\\", "\\\\</turn>", "x\\", "### Role FF: ", "### Role : </turn>\n### User: x\n</turn>\n",
        "two\nlines\n", "$1 \\1", "z" * 50_000,
    ]
    rng = random.Random(1)
    out = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "User", "odd: role\n", None])
            out.append((conv, turn, role, rng.choice(texts)))
    out += [(100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "user", "a"),
            (100, None, "assistant", "first"), (None, 0, "user", "x")]
    return out


def test_chat_reads_back_every_turn(spark):
    rows = chat_rows()
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumn("formatted", F.lit(1))
    out = chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted")))
    seen = {r["conv_id"]: r for r in out.collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert seen.keys() == by.keys()
    for conv, turns in by.items():
        expected = [(role, text) for _, _, role, text in sorted(turns)]
        r = seen[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == expected
        # the loss mask covers the assistant's texts as they are written
        at, spoken = 0, []
        for run in r["loss_runs"]:
            if run["loss"]:
                spoken.append(r["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert at == len(r["formatted"])
        shown = spark.createDataFrame([(s,) for s in spoken], "s string")
        plain = [x[0] for x in shown.select(chat.unescape(F.col("s"))).collect()]
        assert plain == [text for role, text in expected if role == "assistant"]


def test_chat_loss_is_read_from_under_the_mask(spark, sf, monkeypatch):
    rows = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows)
    turns = chat.read_turns(F.col("formatted"))
    said = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])
    under = chat.loss_texts(F.col("formatted"), F.col("loss_runs"))
    assert out.where(~under.eqNullSafe(said)).count() == 0
    assert out.where(F.size(said) > 0).count() > 0
    # a mask that is one code point off must not pass the query's SQL
    right = chat.format_conversations

    def shifted(rows):
        more = F.transform(
            "loss_runs",
            lambda r, i: F.struct((r["chars"] + F.when(i == 0, 1).otherwise(0)).alias("chars"), r["loss"].alias("loss")),
        )
        return right(rows).withColumn("loss_runs", more)

    monkeypatch.setattr(chat, "format_conversations", shifted)
    name = "op1_chat_formatting"
    assert differences(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).count() == 0


def test_chat_uses_no_python(spark, plan):
    df = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    assert "Python" not in plan(chat.format_conversations(df))


# -- 2: byte BPE ---------------------------------------------------------------


def test_bpe_like_tiktoken(docs, rows, ranks):
    pattern = public_tokenizers.PATTERN
    reference = tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )
    ids = bpe.encode(docs.withColumn("ids", F.lit(5)), ranks, pattern)
    out = bpe.decode(ids, ranks, pattern).withColumn("n", bpe.n_tokens()).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(out) == len(rows)
    for r in out:
        expected = reference.encode_ordinary(text[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected
        assert r["n"] == len(expected) and bytes(r["decoded"]) == text[r["doc_id"]].encode()


def test_bpe_of_odd_strings(ranks):
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    coder = bpe.Bpe(ranks, public_tokenizers.PATTERN, room=50)
    rng = random.Random(2)
    for _ in range(200):
        n = rng.choice([1, 10, 100, 1500])
        s = "".join(rng.choice("abcstré \n\t\x1c\x85\xa0 '0٣日🙂") for _ in range(n))
        made = coder.encode([s, "ab" * n])
        assert np.frombuffer(made[0], "<u4").tolist() == reference.encode_ordinary(s)
        assert coder.decode(made[0]) == s.encode()
        assert np.frombuffer(made[1], "<u4").tolist() == reference.encode_ordinary("ab" * n)


def test_bpe_of_nothing(none, ranks):
    ids = bpe.encode(none, ranks, public_tokenizers.PATTERN)
    assert bpe.decode(ids, ranks, public_tokenizers.PATTERN).count() == 0


# -- 3: quality ----------------------------------------------------------------


def test_quality_on_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    out = quality.score_quality(docs, fit)
    assert out.count() == docs.count()
    seen = out.join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in seen)
    assert len(seen) > 20 and right / len(seen) >= 0.95


def test_quality_like_plain_python(spark, rows):
    rng = random.Random(5)
    docs = [(i, t, l, s) for i, t, l, s, _ in rows] + [(3, "again", "en", "s1"), (3, "Again!", "de", None)]
    labels = [(i, rng.randrange(2)) for i in range(0, 60)] + [(3, 1), (3, 0), (None, 1), (5, None), (9999, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = quality.score_quality(
        frame.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    ).collect()
    marks = {}
    for i, q in labels:
        if i is not None and q is not None:
            marks.setdefault(i, []).append(q)
    own = {}
    for i, t, _, _ in docs:
        if i in marks:
            own[i] = min(own.get(i, [np.inf]), quality.features(t))
    ids = sorted(own)
    good = np.array([float(np.mean(marks[i]) >= 0.5) for i in ids])
    model = quality.Logistic(np.array([own[i] for i in ids]), good)
    evidence = [float(model(np.array([quality.features(t)]))[0]) for _, t, _, _ in docs]

    def sums(key):
        found = {}
        for (_, _, lang, source), e in zip(docs, evidence, strict=True):
            n, s = found.get(key(source, lang), (0, 0.0))
            found[key(source, lang)] = (n + 1, s + e)
        return found

    def strength(groups, above):
        between = sum(n * ((s / n - above[k]) ** 2 - above[k] * (1 - above[k]) / n) for k, (n, s) in groups.items())
        whole = sum(n * above[k] * (1 - above[k]) for k, (n, _) in groups.items())
        return 1 / max(1e-4, min(0.5, between / whole)) - 1

    mean = sum(evidence) / len(evidence)
    hosts = sums(lambda source, lang: source)
    weight = strength(hosts, dict.fromkeys(hosts, mean))
    host = {k: (s + weight * mean) / (n + weight) for k, (n, s) in hosts.items()}
    paths = sums(lambda source, lang: (source, lang))
    weight = strength(paths, {k: host[k[0]] for k in paths})
    path = {k: (s + weight * host[k[0]]) / (n + weight) for k, (n, s) in paths.items()}
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    expected = []
    for (i, _, lang, source), e in zip(docs, evidence, strict=True):
        p = path[source, lang]
        expected.append((i, e, host[source], p, 1 / (1 + np.exp(-(logit(e) + logit(p) - logit(mean))))))
    found = sorted((tuple(r)[:5] for r in out), key=lambda r: (r[0], r[1]))
    expected.sort(key=lambda r: (r[0], r[1]))
    assert [r[0] for r in found] == [r[0] for r in expected]
    assert np.allclose([r[1:] for r in found], [r[1:] for r in expected], atol=1e-6)
    assert all(r["kept"] == (r["score"] >= 0.5) for r in out)


def test_quality_posteriors_shrink_by_size(spark):
    rows = [("big", "x", 0.2)] * 400 + [("small", "x", 0.2)] * 2 + [("rest", "y", 0.9)] * 400
    rows += [(None, None, 0.9)] * 3
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    sites, mean = quality.site_posteriors(df, 0.5)
    assert abs(mean - sum(r[2] for r in rows) / len(rows)) < 1e-9
    by = {r["host"]: r for r in sites.collect()}
    assert len(by) == 4
    # both show the same; the sparse one stays nearer to the global mean
    assert 0.2 <= by["big"]["host_posterior"] < by["small"]["host_posterior"] < mean
    assert mean < by[None]["host_posterior"] < by["rest"]["host_posterior"] <= 0.9


def test_quality_without_labels_texts_or_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score_quality(docs.withColumn("evidence", F.lit("x")), labels).collect()
    assert len(out) == len(rows) and all(abs(r["evidence"] - 0.5) < 1e-9 for r in out)
    assert quality.score_quality(none, labels).count() == 0
    one = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, one).count() == len(rows)


# -- 4: deleted interpolation ---------------------------------------------------


def brute_scores(rows, weights_of=None):
    import zlib
    from collections import Counter
    from math import log10

    part = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 for r in rows}
    tokens = {r[0]: H.words(r[1]) + [None] for r in rows}
    learned = Counter(t for i, ts in tokens.items() if part[i] != 1 for t in ts)
    n, v = sum(learned.values()), len(learned)
    base = {
        i: sum(log10((learned[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        for i, ts in tokens.items()
    }
    known = {i: sum(learned[t] > 0 for t in ts) for i, ts in tokens.items()}
    return part, tokens, n, v, base, known


@pytest.mark.parametrize("chunk_tokens", [50, 1 << 20])
def test_lm_base_counts_and_probabilities(docs, rows, chunk_tokens):
    out = interpolation.score_documents(
        docs.withColumn("score", F.lit("x")), chunk_tokens=chunk_tokens
    ).collect()
    part, tokens, n, v, base, known = brute_scores(rows)
    assert sorted(r["doc_id"] for r in out) == sorted(part)
    for r in out:
        i = r["doc_id"]
        assert r["held_out"] == (part[i] == 1) and r["n_tokens"] == len(tokens[i])
        assert r["n_known"] == known[i] and r["train_tokens"] == n
        assert abs(r["base_score"] - base[i]) < 1e-6 * max(1, abs(base[i]))
        assert r["score"] < 0


def test_lm_score_is_the_mixture(rows, docs, monkeypatch):
    """With weights fixed, scores equal a plain bigram mixture."""
    from collections import Counter
    from math import log10

    fixed = np.tile([0.3, 0.6, 0.1], (interpolation.BUCKETS, 1))
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a, **k: fixed)
    out = {r["doc_id"]: r["score"] for r in interpolation.score_documents(docs).collect()}
    part, tokens, n, v, _, _ = brute_scores(rows)
    one, two = Counter(), Counter()
    for i, ts in tokens.items():
        if part[i] != 1:
            one.update(ts)
            two.update(zip(["start", *ts], ts, strict=False))
    starts = sum(part[i] != 1 for i in tokens)
    for i, ts in tokens.items():
        total = 0.0
        for a, b in zip(["start", *ts], ts, strict=False):
            context = starts if a == "start" else one[a]
            p2 = two[(a, b)] / context if context else 0.0
            total += log10(0.3 * one[b] / n + 0.6 * p2 + 0.1 / (v + 1))
        assert abs(out[i] - total) < 1e-6 * max(1, abs(total))


def test_lm_weights_raise_the_likelihood():
    rng = np.random.default_rng(0)
    cells = np.column_stack([
        rng.integers(0, 4, 200), rng.integers(0, 40, 200),
        np.where(rng.random(200) < 0.3, 255, rng.integers(0, 20, 200)), rng.integers(1, 9, 200),
    ])
    p = np.where(cells[:, 1:3] == 255, 0, np.exp2(-cells[:, 1:3] / interpolation.GRAIN))
    p = np.column_stack([p, np.full(200, 1e-3)])

    def likelihood(w):
        return (cells[:, -1] * np.log((p * w[cells[:, 0]]).sum(axis=1))).sum()

    before = interpolation.learn_weights(cells, 2, 1e-3, rounds=0)
    after = interpolation.learn_weights(cells, 2, 1e-3)
    assert likelihood(after) > likelihood(before)
    assert np.allclose(after.sum(axis=1), 1) and (after > 0).all()


def test_lm_higher_order_and_held_out_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = interpolation.score_documents(docs, order=3).where("held_out")
    row = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]


def test_lm_without_rows_or_training(spark, none):
    assert interpolation.score_documents(none).count() == 0
    import zlib

    unseen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(unseen, "a b"), (None, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in interpolation.score_documents(df).collect()}
    assert out[unseen]["train_tokens"] == 1 and out[unseen]["n_known"] == 1
    only = interpolation.score_documents(df.where("doc_id is not null")).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and np.isfinite(only["score"])


# -- 5: M-tree -------------------------------------------------------------------


def brute_top(rows, k=5, every=50):
    from math import floor, isfinite

    fine = [
        (i, [floor(256 * float(x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    ]
    out = set()
    for q, v in fine:
        if q % every == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q
            )
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("tree_rows", [40, 8192])
def test_mtree_is_exact(spark, tree_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = (centres[rng.integers(0, 6, 900)] + 0.2 * rng.normal(size=(900, 8))).astype("float32")
    rows = [(i - 100, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[0].tolist()) for i in range(300)]  # ties
    rows += [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 8), (None, [1.0] * 8),
             (5150, [float("inf")] * 8), (5200, [3.0, 2.0]), (5250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumn("score", F.lit(1)).repartition(3)
    fine = mtree.valid_vectors(df, "vec_id", "embedding").select(
        "vec_id", mtree.floor_scaled(F.col("embedding")).alias("v")
    )
    index = mtree.MTreeIndex(fine, tree_rows=tree_rows)
    asked = fine.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "v as q")
    out = index.search(asked, 5, block_rows=7).collect()
    assert {tuple(r) for r in out} == brute_top(rows) and len(out) == len(brute_top(rows))
    if tree_rows == 8192:
        assert {tuple(r) for r in mtree.top_products(df).collect()} == brute_top(rows)


def test_mtree_passes_over_rows(monkeypatch):
    """The stored bounds save most products on clustered data."""
    rng = np.random.default_rng(5)
    centres = 300 * rng.normal(size=(30, 6))
    rows = np.rint(centres[rng.integers(0, 30, 6000)] + 5 * rng.normal(size=(6000, 6))).astype(int)
    space = mtree.Space(int((rows * rows).sum(axis=1).max()))
    tree = mtree.Tree.build(np.arange(6000), rows, space)
    seen = []
    plain = mtree._products
    monkeypatch.setattr(mtree, "_products", lambda a, b: seen.append(len(a)) or plain(a, b))
    best = int((rows * rows).sum(axis=1).argmax())
    ids, products = tree.search(rows[best], best, 5, float("-inf"), space)
    expected = np.delete(rows @ rows[best], best)
    assert sorted(products.tolist()) == sorted(expected.tolist())[-5:]
    assert sum(seen) < 3000


def test_mtree_query_blocks_are_even():
    for n, blocks in ((4_097, 2), (40_000, 10), (204_800, 50)):
        counts = np.bincount(mtree.block_of(np.arange(0, 50 * n, 50), blocks), minlength=blocks)
        assert len(counts) == blocks and counts.min() > 0.9 * n / blocks


def test_mtree_queries_go_down_together(monkeypatch):
    """Without clusters nothing is ruled out: a page meets its queries in one product, not in one each."""
    rng = np.random.default_rng(7)
    rows = np.rint(100 * rng.normal(size=(6000, 32))).astype(int)
    space = mtree.Space(int((rows * rows).sum(axis=1).max()))
    ids = np.arange(6000) // 2  # each id twice
    tree = mtree.Tree.build(ids, rows, space)
    calls = []
    plain = mtree._products
    monkeypatch.setattr(mtree, "_products", lambda a, b: calls.append(len(b)) or plain(a, b))
    places = np.arange(0, 6000, 20)
    best = mtree.Best(np.full(len(places), -np.inf), 5)
    tree.search_all(rows[places], ids[places], np.arange(len(places)), best, space)
    who, found, products = best.settle()
    assert len(calls) <= 2 * len(tree.nodes) + 1
    for i, place in enumerate(places):
        others = np.flatnonzero(ids != ids[place])
        scores = rows[others] @ rows[place]
        top = np.lexsort((ids[others], -scores))[:5]
        assert found[who == i].tolist() == ids[others][top].tolist()
        assert products[who == i].tolist() == scores[top].tolist()


@pytest.mark.parametrize("most", [90, 40_000, 2**29])
def test_mtree_shelves(spark, monkeypatch, most):
    """A query goes to a shelf of trees once; trees and queries of every width, exact on all shelves."""
    rng = np.random.default_rng(most)
    vectors = rng.integers(-most, most, (600, 4))
    vectors[400:450] = vectors[0]  # ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    points = spark.createDataFrame(rows, "vec_id long, v array<long>")
    sent = []
    plain = mtree.materialize

    def spy(df, name="stage"):
        out = plain(df, name)
        if name == "mtree-pairs":
            sent.append(out.count())
        return out

    monkeypatch.setattr(mtree, "materialize", spy)
    index = mtree.MTreeIndex(points, tree_rows=5)
    asked = points.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "v as q")
    out = {tuple(r) for r in index.search(asked, 5, block_rows=7).collect()}
    expected = set()
    for q in range(0, 600, 50):
        scores = vectors @ vectors[q]
        top = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:5]
        expected |= {(q, n + 1, int(i), int(scores[i])) for n, i in enumerate(top)}
    trees = index.trees.count()
    assert out == expected and trees > 100
    assert len(sent) == 2 and sent[1] <= 12 * 64 < 12 * trees


def test_mtree_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_products(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.5])], schema)
    out = {tuple(r) for r in mtree.top_products(two).collect()}
    assert out == brute_top([(0, [1.0, 2.0]), (50, [0.5, 0.5])])
    same = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [1.0]), (7, [1.0])], schema)
    got = sorted(tuple(r) for r in mtree.top_products(same).collect())
    assert got == [(0, 1, 7, 65536), (0, 2, 7, 65536)]


# -- 6: lines --------------------------------------------------------------------


def brute_lines(rows, min_docs=10):
    from collections import Counter

    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.translate(table).strip(H.SPACE)
    found = Counter()
    for r in rows:
        found.update({key(line) for line in (r[1] or "").split("\n")})
    gone = {k for k, n in found.items() if n >= min_docs and k}
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out[r[0]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_like_brute_force(docs, rows):
    clashing = docs.withColumn("n_lines", F.lit("x")).withColumn("pos", F.lit(1))
    out = linededup.drop_common_lines(clashing).collect()
    expected = brute_lines(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_lines"], r["n_dropped"], r["text"] or "") == expected[r["doc_id"]]
        assert r["pos"] == 1
    assert sum(n for _, n, _ in expected.values()) > 50


def test_lines_repeated_rows_count_each(spark):
    rows = [(1, "Same\n keep %d" % (i % 2)) for i in range(12)] + [(2, None), (3, "same ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.drop_common_lines(df).collect()
    assert sorted((r["text"] or "-", r["n_dropped"]) for r in out) == sorted(
        [(" keep 0", 1)] * 6 + [(" keep 1", 1)] * 6 + [("-", 0), ("-", 1)]
    )
    assert linededup.drop_common_lines(df.limit(0)).count() == 0


def test_lines_use_no_python(docs, plan):
    assert "Python" not in plan(linededup.drop_common_lines(docs))


# -- 7: exact copies -------------------------------------------------------------


def test_exact_copies_like_brute_force(docs, rows):
    out = exactdedup.group_copies(docs.withColumn("size", F.lit("x"))).collect()
    body = {r[0]: "".join(c for c in r[1] or "" if c not in H.SPACE) for r in rows}
    groups = {}
    for r in rows:
        groups.setdefault(body[r[0]], []).append((-len(r[1] or ""), r[0]))
    assert len(out) == len(rows)
    for r in out:
        group = groups[body[r["key"]]]
        keep = min(group)[1]
        assert (r["keep_id"], r["group_size"]) == (keep, len(group))
        assert r["kept"] == (r["key"] == keep)


def test_exact_copies_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (1, "ab"), (1, "ab"), (None, "alone"), (2, "q" * 300 + "1"),
            (3, "q" * 300 + "2"), (4, None), (5, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, exactdedup.group_copies(df).collect()), key=str)
    assert out == sorted(
        [(None, None, 3, True), (1, None, 3, False), (1, None, 3, False), (None, None, 1, True),
         (2, 2, 1, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True)], key=str,
    )
    assert exactdedup.group_copies(df.limit(0)).count() == 0


# -- 8: mixing -------------------------------------------------------------------


def test_targets_fill_up_to_the_bound():
    sizes, weights = [100, 1000, 0, 50], [3, 1, 2, 3]
    target = mixing.fill_targets(sizes, weights, 1.5 * sum(sizes), 2)
    assert abs(sum(target) - 1725) < 1e-6
    assert target[0] == 200 and target[2] == 0 and target[3] == 100
    assert abs(target[1] - 1425) < 1e-6
    assert mixing.fill_targets([], [], 0, 2) == []


def test_quotas_are_exact_and_disjoint():
    units = [7, 0, 113, 40]
    shares = [mixing.split_quotas(units, s, 9, 5) for s in range(9)]
    for source, n in enumerate(units):
        spans = sorted(x[source] for x in shares)
        at = 0
        for first, count in sorted(spans, key=lambda x: (x[0], x[1])):
            assert first == at or count == 0
            at = max(at, first + count)
        assert at == n and sum(c for _, c in spans) == n
    sizes = [sum(c for _, c in x) for x in shares]
    assert max(sizes) - min(sizes) <= 4


def mixed(docs, **options):
    sized = mixing.size_documents(docs).drop("row")
    mix = mixing.plan_mix(sized, **options)
    return mixing.draw_rows(sized, mix).selectExpr(
        "key", "source", "size", "source_size", "target", "size(draws) as times", "draws"
    ).collect()


@pytest.mark.parametrize("options", [{}, {"block_words": 50, "shard_words": 300}])
def test_mix_comes_near_its_targets(docs, rows, options):
    out = mixed(docs, **options)
    assert len(out) == len(rows)
    sizes = {r[0]: len(H.words(r[1])) for r in rows}
    by = {}
    for r in out:
        assert r["size"] == sizes[r["key"]] and 0 <= r["times"] <= 2
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    own = [sum(r["size"] for r in by[s]) for s in names]
    target = mixing.fill_targets(own, [(3, 1, 2)[i % 3] for i in range(len(names))],
                                 1.5 * sum(own), 2)
    for s, t, w in zip(names, target, own, strict=True):
        taken = sum(r["size"] * r["times"] for r in by[s])
        assert by[s][0]["target"] == pytest.approx(t) and by[s][0]["source_size"] == w
        assert abs(taken - t) <= max(r["size"] for r in by[s]) / 2 + 1
    assert out and {tuple(map(str, r)) for r in out} == {
        tuple(map(str, r)) for r in mixed(docs, **options)
    }


def test_mix_rows_shard_by_shard(docs, none):
    clashing = docs.withColumn("sid", F.lit("x")).withColumn("shard", F.lit("y"))
    rows = mixing.mix_documents(clashing, block_words=50, shard_words=2_000)
    assert rows.columns == clashing.columns
    counts = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    expected = {r["key"]: r["times"] for r in mixed(docs, block_words=50, shard_words=2_000)}
    assert counts == {k: n for k, n in expected.items() if n}
    assert mixing.mix_documents(none).count() == 0


def test_mix_fills_the_room_beside_a_long_document(spark):
    """One source, half a pass: a text longer than the target must not leave it empty."""
    rows = [(i, "a", 500) for i in range(300)] + [(300, "a", 100_000)]
    df = spark.createDataFrame(rows, "key long, source string, size long")
    for seed in range(2):
        mix = mixing.plan_mix(df, seed=seed, total_share=0.39)
        out = mixing.draw_rows(df, mix).collect()
        assert len(out) == 301
        taken = sum(r["size"] * len(r["draws"]) for r in out)
        assert abs(taken - 0.39 * 250_000) <= 250
        assert all(len(r["draws"]) <= 1 for r in out)


def test_mix_splits_rows_that_repeat_key_and_size(spark):
    rows = [(7, "a", 30)] * 300 + [(None, "a", 30)] * 50 + [(100 + i, "a", 30) for i in range(550)]
    df = spark.createDataFrame(rows, "key long, source string, size long").repartition(4)
    mix = mixing.plan_mix(df, total_share=0.4, block_words=900, shard_words=3_000)
    out = mixing.draw_rows(df, mix).collect()
    assert len(out) == 900 and sum(30 * len(r["draws"]) for r in out) == 10_800
    taken = [len(r["draws"]) for r in out if r["key"] == 7]
    assert len(taken) == 300 and 80 <= sum(taken) <= 160
    assert len({d["shard"] for r in out if r["key"] == 7 for d in r["draws"]}) > 1


def test_mix_refuses_too_many_sources(docs):
    with pytest.raises(ValueError, match="sources"):
        mixed(docs, max_sources=2)


# -- 9: near copies --------------------------------------------------------------


def test_near_copies_like_brute_force(docs, rows):
    out = lshforest.near_duplicates(docs.withColumn("node", F.lit("x"))).collect()
    expected = H.components([(r[0], r[1]) for r in rows])
    sizes = {r[0]: len(H.shingles(r[1])) for r in rows}
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    for r in out:
        assert r["n_shingles"] == sizes[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len(set(expected.values())) < len(rows) - 20


def test_near_copies_in_a_crowded_region(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, f"u{i} " + " ".join(f"x{i}y{j}" for j in range(40))) for i in range(100)]
    for i in range(100, 500):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r["component_id"] for r in lshforest.near_duplicates(df).collect()}
    assert out == H.components(rows)


def brute_components(sets):
    """The least place that links lead to, by all pairs."""
    holders = {}
    for i, own in enumerate(sets):
        for g in own:
            holders.setdefault(g, []).append(i)
    n = np.array([len(own) for own in sets])
    common = [rows for rows in holders.values() if len(rows) > 100]
    dense = np.zeros((len(n), len(common)), np.float32)
    for i, rows in enumerate(common):
        dense[rows, i] = 1
    both = dense @ dense.T
    for rows in holders.values():
        if 1 < len(rows) <= 100:
            both[np.ix_(rows, rows)] += 1
    low = np.arange(len(n))
    pairs = [(i, np.flatnonzero(100 * both[i] >= 75 * (n[i] + n - both[i]))) for i in range(len(n))]
    before = None
    while before is None or (before != low).any():
        before = low.copy()
        for i, linked in pairs:
            low[i] = min(low[linked].min(), low[i])
            low[linked] = np.minimum(low[linked], low[i])
    return low


def test_near_copies_of_a_template_with_ten_thousand_edits(spark):
    rng = random.Random(5)
    rows = []
    for i in range(10_000):
        w = [f"b{j}" for j in range(150)]
        for place in rng.sample(range(150), rng.randrange(1, 5)):
            w[place] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in lshforest.near_duplicates(df).collect()}
    expected = brute_components([H.shingles(text) for _, text in rows])
    assert [found[i] for i in range(10_000)] == expected.tolist()


def test_near_copies_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(5, text), (None, text.upper()), (5, text), (9, text + " "), (7, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("low", F.lit(1))
    out = sorted(map(tuple, lshforest.near_duplicates(df).collect()), key=str)
    assert out == sorted([(5, 3, 5, True), (None, 3, 5, False), (5, 3, 5, True), (9, 3, 5, False),
                          (7, 0, 7, True), (7, 0, 7, True)], key=str)
    kept = lshforest.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [
        (5, text), (7, ""), (7, "")
    ]
    assert lshforest.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    out = {bytes(r["node"]): bytes(r["comp"]) for r in components(stars(df.repartition(7))).collect()}
    chain, star = [name(i) for i in range(61)], [name(1000 + i) for i in range(50)]
    assert out == {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(star, min(star))}
    assert components(stars(df.limit(0))).count() == 0


# -- 10: language ----------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id")
    seen = out.where("held_out").collect()
    assert len(seen) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in seen) / len(seen) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in seen)


def test_language_like_brute_force(spark):
    from collections import Counter

    def grams(text):
        import re

        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    def code(gram):
        n = 0
        for c in gram:
            n = (n << 21) | (1 if c == " " else ord(c))
        return n

    def ranked(counts, size):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    texts = {"en": "the cat sat on the mat and the hat", "de": "der hund und die katze, das ist",
             "fr": "le chat est sur la table et la"}
    df = spark.createDataFrame([(t, k) for k, t in texts.items()] + [("x", None), (None, "zz")],
                               "text string, lang string")
    size = 30
    profiles = langid.learn_profiles(df, size=size)
    lists = {k: ranked(grams(t), size) for k, t in texts.items()}
    got = {}
    for r in profiles.orderBy("place").collect():
        got.setdefault(r["lang"], []).append(r["gram"])
    assert got == {k: [code(g) for g in v] for k, v in lists.items()}
    asked = ["the dog and the cat", "das katze", "la chat", "", None, "12 .. !", "Ω"]
    out = langid.identify(
        spark.createDataFrame([(t, 1) for t in asked], "text string, score int"), profiles,
        size=size,
    ).collect()
    assert {r["text"] for r in out} == set(asked)
    for r in out:
        own = ranked(grams(r["text"] or ""), size)
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        apart = {
            k: sum(abs(i - v.index(g)) if g in v else abs(size - i) for i, g in enumerate(own))
            for k, v in lists.items()
        }
        best = min(sorted(apart), key=apart.get)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 - apart[best] / (size * len(own)))


def test_unlearned_languages_reject_only_texts_without_letters(spark):
    rows = [(1, "some words", None), (2, "12 ...", None), (3, None, None), (4, "Ä", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.reject_unknown(df).collect()} == {1, 4}
    named = df.withColumn("lang", F.lit("und")).unionByName(df.withColumn("doc_id", F.col("doc_id") + 10))
    assert {r["doc_id"] for r in langid.reject_unknown(named).collect()} == {1, 4, 11, 14}


def test_rejection_follows_the_profiles(spark):
    words = {"en": "the of and to in that it was for on", "el": "και το να του η της με που την από"}
    docs = [(i, " ".join(random.Random(i).choices(words[lang].split(), k=30)), lang)
            for i in range(40) for lang in ["en" if i % 2 else "el"]]
    schema = "doc_id long, text string, lang string"
    both = spark.createDataFrame(docs, schema)
    assert langid.reject_unknown(both).count() == 40
    # with profiles of English alone, the Greek texts are in no known language
    unlabelled = [(i, t, lang if lang == "en" else None) for i, t, lang in docs]
    kept = langid.reject_unknown(spark.createDataFrame(unlabelled, schema)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(1, 40, 2))
    with pytest.raises(ValueError):
        langid.reject_unknown(both, least_score=0)


def test_language_without_training_or_rows(spark, none, docs, rows):
    out = langid.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in out.collect()} == {"und"}
    assert langid.identify_documents(none).count() == 0
    kept = langid.reject_unknown(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {
        r[0] for r in rows if any(c.isalpha() for c in r[1] or "")
    }


# -- registered queries ----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert differences(spark, sf, queries.QUERIES[name], queries.ORACLES[name]) == []
