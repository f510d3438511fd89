"""The queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findry.llm import (
    bpe,
    chat,
    exactdedup,
    interpolation,
    langid,
    linededup,
    lshforest,
    mixing,
    mtree,
    phrases,
    prefixtrie,
    quality,
    strata,
)
from findry.llm.common import table


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one that speaks in control strings, read back from the output."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(rows.unionByName(own))
    read = formatted.withColumn("turns", chat.read_turns(F.col("formatted")))
    read = read.withColumn(
        "loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_runs")), "")
    )
    loss = F.col("loss")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha256(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
m AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
                 ELSE 5 + 2 * strlen(role) END AS name_chars,
    length(regexp_replace(text,
      '(\\*(?:### (?:System|User|Assistant|Tool|Role [0-9A-F]*): |</turn>))',
      '\\\1', 'g')) AS shown_chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(name_chars + shown_chars + 15)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of all documents and the bytes that they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        bpe.n_tokens().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality of all documents, by their texts, sources and languages."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return quality.score_quality(table(spark, sf, "documents"), labels)


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Log probabilities of all documents by a bigram model with interpolated counts."""
    return interpolation.score_documents(table(spark, sf, "documents"), order=2)


def op5_mtree_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five highest inner products of every fiftieth embedding with all others."""
    return mtree.top_products(table(spark, sf, "embeddings"))


OP5_SQL = """
WITH f AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each document without the lines that ten or more share."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = linededup.drop_common_lines(docs, min_docs=10, min_chars=1)
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(text).alias("kept_sha256"))


_SQL_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, str_split(text, chr(10)) AS parts FROM d),
l AS (SELECT r, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM s),
k AS (SELECT r, pos, line, trim(translate(line, {_SQL_LOWER}), {_SQL_SPACES}) AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
f AS (SELECT k.r, k.pos, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
      FROM f GROUP BY r)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d ON d.r = g.r"""


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Which document stays for each, over texts without white space."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    digest = sha256(exactdedup.normalised(F.col("text")))
    groups = exactdedup.group_copies(docs, carry={"text_sha256": digest})
    return groups.withColumnRenamed("key", "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (
  SELECT body, count(*) AS n, min({'c': -chars, 'k': doc_id}) AS best FROM d GROUP BY body)
SELECT d.doc_id, best.k AS keep_id, n AS group_size,
  d.doc_id IS NOT DISTINCT FROM best.k AND d.chars = -best.c AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body"""


def op8_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of each document the mix takes."""
    sized = mixing.size_documents(table(spark, sf, "documents")).drop("row")
    mix = mixing.plan_mix(mixing.materialize(sized, "mix-sizes"))
    return mixing.draw_rows(sized, mix).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).alias("taken"),
    )


def op9_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return lshforest.near_duplicates(table(spark, sf, "documents"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document by rank-order profiles."""
    return langid.identify_documents(table(spark, sf, "documents"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return strata.search_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_SQL_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), "
    f"{_SQL_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS terms FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM f, c),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, c WHERE len(terms) > 0),
i AS (SELECT item, item_id, term, count(*) AS uses FROM (
        SELECT row_number() OVER () AS item, item_id, unnest({_SQL_TERMS}) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item, item_id, doc_id, r,
        sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (
        PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


def op12_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return phrases.fingerprint_documents(table(spark, sf, "documents"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt upon the first of its five."""
    rows = table(spark, sf, "conversations")
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefixtrie.trie_of(rows, base=conv - conv % 5, heads=heads, most=8)


OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY conv_id),
b AS (SELECT conv_id, own, flatten(list_transform(regexp_extract_all(conv_id::VARCHAR, '.'),
        lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM c),
h AS (SELECT conv_id, own, xor(4294967295, list_reduce(steps, lambda s, x:
        CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END,
        4294967295::BIGINT)) % 9 AS h FROM b),
r AS (SELECT h.conv_id, list_concat(coalesce(c.own[1:h.h], []), h.own[h.h + 1:]) AS seq
      FROM h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
n AS (
  SELECT depth, seq[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')
      AS ends
  FROM p GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children
      FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
        CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.node[n.depth].text) END AS saved
      FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
u AS (SELECT m.node, m.saved, m.n_children, unnest(range(0, m.depth + 1)) AS depth FROM m),
s AS (SELECT depth, node[1:depth] AS node, sum(saved)::BIGINT AS saved_tokens,
        count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM u GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children,
  s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.node = m.node
  LEFT JOIN n q ON q.depth = m.depth - 1 AND q.node = m.node[1:m.depth - 1]"""


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality": op3_quality,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mtree_search": op5_mtree_search,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_chat_formatting": OP1_SQL,
    "op5_mtree_search": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
