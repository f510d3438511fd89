"""Training-data functions: chunks, crops, augmentation, negatives, batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findry.functions import tokens as tk
from findry.functions.rand import hash_order
from findry.functions.text import simple_tokens
from findry.functions.vectors import dot
from findry.operators import training
from findry.plans.registry import (
    digest_sql,
    dot_sql,
    query,
    table,
    tokens_sql,
    uniform_sql,
)
from findry.plans.search import vectors
from findry.session import materialize

# token ids stand in for a subword vocabulary: hash of the token, 1..30000
_VOCAB = 30_000


def token_rows(spark, sf):
    """``(doc_id, tokens array<int>)`` of the documents."""

    def number(token: Column) -> Column:
        head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
        return (head % _VOCAB + 1).cast("int")

    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.transform(simple_tokens(F.col("text")), number).alias("tokens"))


TOKENS_SQL = f"""tok AS (
  SELECT doc_id, list_transform({tokens_sql("text")},
    lambda t: (('0x' || substr(md5(t), 1, 8))::UBIGINT % {_VOCAB} + 1)::INT) AS tokens FROM documents)"""


def _digest(column: str):
    return F.md5(F.array_join(F.transform(column, lambda t: t.cast("string")), ","))


def _digest_sql(column: str) -> str:
    return f"md5(array_to_string({column}, ','))"


@query(
    "chunk_tokens",
    f"""WITH {TOKENS_SQL},
flat AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tok),
stream AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 - 17 AS pos FROM flat)
SELECT pos // 256 AS chunk_id, md5(string_agg(t, ',' ORDER BY pos)) AS digest
FROM stream WHERE pos >= 0 GROUP BY pos // 256 HAVING count(*) = 256""",
)
def _chunks(spark, sf):
    stored = materialize(token_rows(spark, sf), "tokens")
    rows = training.chunk_tokens(stored, 256, 17, ["doc_id"])
    return rows.select("chunk_id", _digest("tokens").alias("digest"))


def _crop_sql(seed: str, lo: float, hi: float) -> str:
    """SQL for one crop: start (zero-based) and length over ``n`` tokens."""
    length = f"floor(n * ({lo}::DOUBLE + {hi - lo}::DOUBLE * {uniform_sql(seed + '-ratio', 'doc_id')}))::INT"
    start = f"floor((n - {length} + 1) * {uniform_sql(seed + '-start', 'doc_id')})::INT"
    return f"tokens[{start} + 1 : {start} + {length}]"


@query(
    "random_crop_pairs",
    f"""WITH {TOKENS_SQL}, sized AS (SELECT *, len(tokens) AS n FROM tok)
SELECT doc_id, {_digest_sql(_crop_sql("q", 0.125, 0.5))} AS q, {_digest_sql(_crop_sql("k", 0.125, 0.5))} AS k
FROM sized""",
)
def _crops(spark, sf):
    crops = token_rows(spark, sf).select(
        "doc_id",
        tk.random_crop(F.col("tokens"), 0.125, 0.5, "q", F.col("doc_id")).alias("q"),
        tk.random_crop(F.col("tokens"), 0.125, 0.5, "k", F.col("doc_id")).alias("k"),
    )
    return crops.select("doc_id", _digest("q").alias("q"), _digest("k").alias("k"))


_AUG_SQL = f"""WITH {TOKENS_SQL},
flat AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tok),
drawn AS (SELECT *, {uniform_sql("s", "doc_id", "i")} AS u FROM flat)"""


def _augmented(spark, sf, kind):
    rows = token_rows(spark, sf)
    out = tk.augment(F.col("tokens"), kind, 0.2, "s", F.col("doc_id"), low=5, high=99)
    return rows.select("doc_id", out.alias("tokens"))


def _register_augmentation(kind: str, value: str, where: str = "true") -> None:
    sql = f"""{_AUG_SQL}
SELECT doc_id, md5(coalesce(string_agg({value}, ',' ORDER BY i) FILTER (WHERE {where}), '')) AS digest
FROM drawn GROUP BY doc_id"""

    @query(f"augment_{kind}", sql)
    def _run(spark, sf):
        return _augmented(spark, sf, kind).select("doc_id", _digest("tokens").alias("digest"))


_register_augmentation("mask", "CASE WHEN u > 0.2 THEN t ELSE 103 END")
_register_augmentation(
    "replace",
    f"CASE WHEN u > 0.2 THEN t ELSE 5 + floor({uniform_sql('s-pick', 'doc_id', 'i')} * 95)::INT END",
)
_register_augmentation("delete", "t", "u > 0.2")


@query(
    "augment_shuffle",
    f"""{_AUG_SQL},
moving AS (
  SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place,
         row_number() OVER (PARTITION BY doc_id ORDER BY {digest_sql("s-order", "doc_id", "i")}) AS turn
  FROM drawn WHERE u < 0.2),
moved AS (SELECT a.doc_id, a.i, b.t FROM moving a JOIN moving b ON a.doc_id = b.doc_id AND a.place = b.turn)
SELECT doc_id, md5(string_agg(coalesce(m.t, d.t), ',' ORDER BY i)) AS digest
FROM drawn d LEFT JOIN moved m USING (doc_id, i) GROUP BY doc_id""",
)
def _shuffled(spark, sf):
    return _augmented(spark, sf, "shuffle").select("doc_id", _digest("tokens").alias("digest"))


@query(
    "add_bos_eos",
    f"""WITH {TOKENS_SQL}
SELECT doc_id, {_digest_sql("list_concat([101], tokens, [102])")} AS both_ends,
       {_digest_sql("list_concat(tokens, [102])")} AS only_end, {_digest_sql("tokens")} AS neither FROM tok""",
)
def _borders(spark, sf):
    t = F.col("tokens")
    rows = token_rows(spark, sf).select(
        "doc_id",
        tk.add_bos_eos(t, 101, 102).alias("b"),
        tk.add_bos_eos(t, None, 102).alias("e"),
        tk.add_bos_eos(t, None, None).alias("n"),
    )
    return rows.select(
        "doc_id", _digest("b").alias("both_ends"), _digest("e").alias("only_end"), _digest("n").alias("neither")
    )


@query(
    "pad_and_mask",
    f"""WITH {TOKENS_SQL},
cut AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch, tokens FROM tok),
longest AS (SELECT batch, max(len(tokens)) AS m FROM cut GROUP BY batch)
SELECT doc_id, batch::BIGINT AS batch,
  {_digest_sql("list_concat(tokens, list_transform(range(m - len(tokens)), lambda x: 0))")} AS tokens,
  len(tokens) AS ones, m AS width
FROM cut JOIN longest USING (batch)""",
)
def _padded(spark, sf):
    batched = training.assign_batches(token_rows(spark, sf), ["doc_id"], 16)
    padded = training.pad_mask(batched)
    return padded.select(
        "doc_id",
        "batch",
        _digest("tokens").alias("tokens"),
        F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"),
        F.size("mask").cast("long").alias("width"),
    )


_PAIR_SQL = " UNION ALL ".join(
    f"""SELECT chunk_id, {side} AS side, i, CASE WHEN {uniform_sql(f"pairs-3-{side}", "chunk_id", "i")} > 0.1
      THEN t ELSE 103 END AS t
    FROM (SELECT chunk_id, unnest(c) AS t, unnest(range(len(c))) AS i
      FROM (SELECT chunk_id, {_crop_sql(f"pairs-3-{side}", 0.125, 0.5).replace("doc_id", "chunk_id")} AS c FROM sized))"""
    for side in (0, 1)
)


@query(
    "contrastive_pairs",
    f"""WITH {TOKENS_SQL},
flat AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tok),
stream AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 - floor({uniform_sql("pairs-offset", "3")} * 256)::INT AS pos
  FROM flat),
sized AS (SELECT (pos // 256)::BIGINT AS chunk_id, list(t ORDER BY pos) AS tokens, 256 AS n
  FROM stream WHERE pos >= 0 GROUP BY pos // 256 HAVING count(*) = 256),
views AS (SELECT chunk_id, side, list_concat([101], list(t ORDER BY i), [102]) AS tokens
  FROM ({_PAIR_SQL}) GROUP BY ALL),
batched AS (SELECT *, (row_number() OVER (PARTITION BY side ORDER BY chunk_id) - 1) // 16 AS batch FROM views),
longest AS (SELECT batch, side, max(len(tokens)) AS m FROM batched GROUP BY ALL)
SELECT chunk_id, side, batch::BIGINT AS batch, ((row_number() OVER (PARTITION BY side ORDER BY chunk_id) - 1) % 16)::INT AS slot,
  {_digest_sql("list_concat(tokens, list_transform(range(m - len(tokens)), lambda x: 0))")} AS tokens,
  len(tokens) AS ones, m AS width
FROM batched JOIN longest USING (batch, side)""",
)
def _pairs(spark, sf):
    views = training.contrastive_pairs(token_rows(spark, sf), ["doc_id"], 256, 16, epoch=3)
    return views.select(
        "chunk_id",
        "side",
        "batch",
        "slot",
        _digest("tokens").alias("tokens"),
        F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"),
        F.size("mask").cast("long").alias("width"),
    )


# -- examples: positives are a title's bodies, negatives hash neighbours -----
# 64 neighbouring documents form a pool; the pool rows that follow a document
# in hash order serve as its random and hard negatives

_NEG, _HARD = 6, 4


def example_rows(spark, sf):
    """``(qid, question, positive_ctxs, negative_ctxs, hard_negative_ctxs)``."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("qid"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
    )
    ctx = F.struct("title", "text")
    after = W.partitionBy(F.floor(F.col("qid") / 64)).orderBy(hash_order("pool", F.col("qid")))

    def following(first: int, n: int):
        rows = [F.lead(ctx, first + i).over(after) for i in range(n)]
        return F.filter(F.array(*rows), lambda c: c.isNotNull())

    return docs.select(
        "qid",
        F.col("title").alias("question"),
        F.array(ctx, F.struct(F.lit("").alias("title"), "text")).alias("positive_ctxs"),
        following(1, _NEG).alias("negative_ctxs"),
        following(1 + _NEG, _HARD).alias("hard_negative_ctxs"),
    )


def _lead_list(first: int, n: int) -> str:
    leads = ", ".join(
        f"lead(md5(title || '|' || text), {first + i}) OVER pool" for i in range(n)
    )
    return f"list_filter([{leads}], lambda c: c IS NOT NULL)"


EXAMPLES_SQL = f"""docs AS (
  SELECT doc_id AS qid, split_part(text, chr(10), 1) AS title,
         text FROM documents),
examples AS (
  SELECT qid, title AS question, [md5(title || '|' || text), md5('|' || text)] AS pos,
         {_lead_list(1, _NEG)} AS neg, {_lead_list(1 + _NEG, _HARD)} AS hard
  FROM docs WINDOW pool AS (PARTITION BY qid // 64 ORDER BY {digest_sql("pool", "qid")}))"""

_N, _RATIO, _MIN = 5, 0.4, 1

SAMPLED_SQL = f"""{EXAMPLES_SQL},
trials AS (
  SELECT qid, count(*) FILTER (WHERE {uniform_sql("e-hard", "qid", "i")} < {_RATIO}) AS t
  FROM examples CROSS JOIN range({_N}) r(i) GROUP BY qid),
quota AS (SELECT e.*, least(t, greatest(len(hard) - {_MIN}, 0)) AS n_hard FROM examples e JOIN trials USING (qid)),
picked AS (
  SELECT qid, 0 AS kind, c, row_number() OVER (PARTITION BY qid ORDER BY {digest_sql("e-neg", "qid", "i")}) AS r, {_N} - n_hard AS room
  FROM (SELECT qid, n_hard, unnest(neg) AS c, unnest(range(len(neg))) AS i FROM quota)
  UNION ALL
  SELECT qid, 1, c, row_number() OVER (PARTITION BY qid ORDER BY {digest_sql("e-hardpick", "qid", "i")}), n_hard
  FROM (SELECT qid, n_hard, unnest(hard) AS c, unnest(range(len(hard))) AS i FROM quota) WHERE i >= {_MIN}),
negatives AS (SELECT qid, string_agg(c, ',' ORDER BY kind, r) AS negatives FROM picked WHERE r <= room GROUP BY qid),
golds AS (SELECT qid, pos[1 + floor({uniform_sql("e-gold", "qid")} * len(pos))::INT] AS gold FROM examples)"""


def _ctx_digest(c):
    return F.md5(F.concat(c["title"], F.lit("|"), c["text"]))


@query(
    "sample_negatives",
    f"""WITH {SAMPLED_SQL}
SELECT qid, gold, coalesce(negatives, '') AS negatives FROM golds LEFT JOIN negatives USING (qid)""",
)
def _sampled(spark, sf):
    rows = training.sample_negatives(example_rows(spark, sf), _N, _RATIO, _MIN, "e")
    return rows.select(
        "qid",
        _ctx_digest(F.col("gold")).alias("gold"),
        F.array_join(F.transform("negatives", _ctx_digest), ",").alias("negatives"),
    )


@query(
    "first_gold_and_negative",
    f"WITH {EXAMPLES_SQL} SELECT qid, pos[1] AS gold, coalesce(neg[1], '') AS negatives FROM examples",
)
def _eval_sampled(spark, sf):
    rows = training.sample_negatives(example_rows(spark, sf), training=False)
    return rows.select(
        "qid",
        _ctx_digest(F.col("gold")).alias("gold"),
        F.array_join(F.transform("negatives", _ctx_digest), ",").alias("negatives"),
    )


_TEXTS_SQL = f"""docs AS (
  SELECT doc_id AS qid, split_part(text, chr(10), 1) AS title,
         text FROM documents),
texts AS (
  SELECT qid, title AS query, title || ' ' || text AS gold,
         lead(title || ' ' || text) OVER (PARTITION BY qid // 64 ORDER BY {digest_sql("pool", "qid")}) AS negative
  FROM docs)"""


def _example_texts(spark, sf):
    rows = training.sample_negatives(example_rows(spark, sf), training=False)
    return training.example_texts(rows)


@query(
    "example_texts",
    f"""WITH {_TEXTS_SQL}
SELECT qid, query, md5(gold) AS gold, coalesce(md5(negative), '') AS negative FROM texts""",
)
def _texts(spark, sf):
    return _example_texts(spark, sf).select(
        "qid",
        "query",
        F.md5("gold").alias("gold"),
        F.array_join(F.transform("negatives", F.md5), ",").alias("negative"),
    )


@query(
    "collate_batches",
    f"""WITH {_TEXTS_SQL},
placed AS (SELECT *, (row_number() OVER (ORDER BY qid) - 1) AS i FROM texts)
SELECT (i // 24)::BIGINT AS batch, md5(string_agg(query, '|' ORDER BY i)) AS queries, count(*) AS n_golds,
  md5(string_agg(gold, '|' ORDER BY i) || coalesce('|' || string_agg(negative, '|' ORDER BY i), '')) AS passages
FROM placed GROUP BY i // 24""",
)
def _collated(spark, sf):
    batched = training.assign_batches(_example_texts(spark, sf), ["qid"], 24)
    return training.collate(batched).select(
        "batch",
        F.md5(F.array_join("queries", "|")).alias("queries"),
        F.col("n_golds").cast("long").alias("n_golds"),
        F.md5(F.array_join("passages", "|")).alias("passages"),
    )


# -- scoring of given vectors -------------------------------------------------
# query n is vector n, its gold is vector n + 1, its extra negative vector n + 2

_TRIPLES_SQL = """triples AS (
  SELECT q.vec_id AS qid, q.embedding AS q, g.embedding AS g, n.embedding AS n
  FROM embeddings q JOIN embeddings g ON g.vec_id = q.vec_id + 1 JOIN embeddings n ON n.vec_id = q.vec_id + 2)"""


def triples(spark, sf):
    """``(qid, q, g, n)``: query, gold and negative vectors."""
    rows = vectors(spark, sf)
    gold = rows.select((F.col("pid") - 1).alias("qid"), F.col("embedding").alias("g"))
    neg = rows.select((F.col("pid") - 2).alias("qid"), F.col("embedding").alias("n"))
    asked = rows.select(F.col("pid").alias("qid"), F.col("embedding").alias("q"))
    return asked.join(gold, "qid").join(neg, "qid")


@query(
    "contrastive_stats",
    f"""WITH {_TRIPLES_SQL},
b AS (SELECT *, qid // 24 AS batch FROM triples),
keys AS (SELECT batch, 0 AS kind, qid, g AS v FROM b UNION ALL SELECT batch, 1, qid, n FROM b),
s AS (
  SELECT b.batch, b.qid, k.kind, k.qid AS kid, {dot_sql("b.q", "k.v")} / 0.05 AS s
  FROM b JOIN keys k USING (batch)),
per AS (
  SELECT batch, qid, ln(sum(exp(s))) - 0.9 * max(s) FILTER (WHERE kind = 0 AND kid = qid) - 0.1 * avg(s) AS loss,
         max(s) = max(s) FILTER (WHERE kind = 0 AND kid = qid) AS hit
  FROM s GROUP BY batch, qid),
spread AS (
  SELECT batch, which, avg(sd) AS spread FROM (
    SELECT batch, which, d, stddev_samp(x) AS sd FROM (
      SELECT batch, 'q' AS which, unnest(q)::DOUBLE AS x, unnest(range(len(q))) AS d FROM b
      UNION ALL
      SELECT batch, 'k', unnest(v)::DOUBLE, unnest(range(len(v))) FROM keys) GROUP BY ALL) GROUP BY ALL)
SELECT batch::BIGINT AS batch, count(*) AS n, round(avg(loss), 6) AS loss,
  round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS accuracy,
  round(max(q.spread), 6) AS stdq, round(max(k.spread), 6) AS stdk
FROM per JOIN (SELECT * FROM spread WHERE which = 'q') q USING (batch)
     JOIN (SELECT * FROM spread WHERE which = 'k') k USING (batch) GROUP BY batch""",
)
def _contrastive(spark, sf):
    rows = triples(spark, sf).select(
        F.floor(F.col("qid") / 24).alias("batch"),
        F.col("qid").alias("slot"),
        "q",
        F.array("g", "n").alias("key_vectors"),
    )
    out = training.contrastive_stats(rows, temperature=0.05, label_smoothing=0.1)
    rounded = [F.round(c, 6).alias(c) for c in ("loss", "accuracy", "stdq", "stdk")]
    return out.select("batch", "n", *rounded)


_POOL_SQL = f"""{_TRIPLES_SQL},
pool AS (SELECT qid, g AS v FROM triples UNION ALL SELECT qid, n FROM triples),
own AS (SELECT qid, q, round({dot_sql("q", "g")}, 6) AS gold_score FROM triples),
ranks AS (
  SELECT o.qid, 1 + count(*) FILTER (WHERE round({dot_sql("o.q", "p.v")}, 6) > o.gold_score) AS rank
  FROM own o CROSS JOIN pool p GROUP BY o.qid)"""


def _pool_ranks(spark, sf, **bounds):
    rows = triples(spark, sf)
    queries = rows.select(
        "qid", F.col("q").alias("embedding"), F.round(dot(F.col("q"), F.col("g")), 6).alias("gold_score")
    )
    golds = rows.select(F.col("qid").alias("pid"), F.col("g").alias("embedding"))
    negatives = rows.select((-1 - F.col("qid")).alias("pid"), F.col("n").alias("embedding"))
    return training.pool_ranks(queries, golds.unionByName(negatives), **bounds)


@query("pool_ranks", f"WITH {_POOL_SQL} SELECT qid, rank FROM ranks")
def _pool(spark, sf):
    return _pool_ranks(spark, sf)


@query(
    "pool_eval",
    f"""WITH {_POOL_SQL} SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE rank = 1) / count(*), 6) AS accuracy,
round(avg(1.0 / rank), 6) AS mrr FROM ranks""",
)
def _pool_eval(spark, sf):
    return training.pool_eval(_pool_ranks(spark, sf, bound=150, item_block=300))
