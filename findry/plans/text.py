"""Text and id functions over the documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findry.functions import text as tx
from findry.operators import dataset
from findry.operators.lexical import term_counts
from findry.plans.registry import (
    CORPUS_SQL,
    SOURCE_SQL,
    query,
    source_rows,
    table,
    titled_dataset,
    tokens_sql,
)
from findry.session import scratch_path

# swap plain punctuation for variants, so that every class of the normaliser occurs
_PLAIN = '.,!%&*$|#"'
_VARIANT = "…–“″­\u0001′⁄‴`"


def _md5(col: Column, name: str) -> Column:
    return F.md5(col).alias(name)


@query(
    "normalize_text",
    rf"""
WITH seeded AS (
  SELECT doc_id, translate(text, '{_PLAIN}', '{_VARIANT}') || ' . . . ' || text AS s FROM documents),
a AS (SELECT doc_id, regexp_replace(s, '[\x01-\x08\x0E\x0F\x11-\x1B\x{{AD}}]', '', 'g') AS s FROM seeded),
b AS (SELECT doc_id, regexp_replace(s, '[\x0B\x0C\x{{85}}]', ' ', 'g') AS s FROM a),
c AS (SELECT doc_id, regexp_replace(s, '[\x{{2010}}-\x{{2015}}\x{{2043}}\x{{2212}}\x{{FF0D}}\x{{207B}}]', '-', 'g') AS s FROM b),
d AS (SELECT doc_id, regexp_replace(s, '[\x{{201C}}-\x{{201F}}]', '"', 'g') AS s FROM c),
e AS (SELECT doc_id, regexp_replace(s, '[\x{{2018}}-\x{{201B}}\x{{55A}}\x{{A78B}}\x{{A78C}}\x{{FF07}}`\x{{B4}}\x{{2032}}\x{{2035}}]', '''', 'g') AS s FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s,
        '[\x{{2033}}\x{{2036}}]', '''''', 'g'), '[\x{{2034}}\x{{2037}}]', '''''''', 'g'),
        '\x{{2057}}', '''''''''', 'g') AS s FROM e),
g AS (SELECT doc_id, regexp_replace(replace(replace(s, '…', '...'), ' . . . ', ' ... '),
        '[\x{{2044}}\x{{2215}}]', '/', 'g') AS s FROM f)
SELECT doc_id, md5(s) AS digest, length(s) AS n FROM g""",
)
def _normalize(spark, sf):
    seeded = F.concat(F.translate("text", _PLAIN, _VARIANT), F.lit(" . . . "), F.col("text"))
    out = table(spark, sf, "documents").select("doc_id", tx.normalize_text(seeded).alias("s"))
    return out.select("doc_id", _md5(F.col("s"), "digest"), F.length("s").cast("long").alias("n"))


@query(
    "passage_text",
    f"""
WITH {SOURCE_SQL},
t AS (SELECT ord, CASE source WHEN 'src1' THEN NULL WHEN 'src2' THEN '' ELSE title END AS title,
             coalesce(text, '.') AS text FROM src)
SELECT ord,
  md5(CASE WHEN title IS NULL OR title = '' THEN text ELSE title || ' ' || text END) AS dropped,
  md5(CASE WHEN title IS NULL THEN text ELSE title || ' ' || text END) AS kept,
  md5(text) AS bare
FROM t""",
)
def _passage_text(spark, sf):
    src = source_rows(spark, sf)
    title = F.when(F.col("source") == "src2", "").when(F.col("source") != "src1", F.col("title"))
    body = tx.fill_missing(F.col("text"))
    return src.select(
        "ord",
        _md5(tx.passage_text(title, body), "dropped"),
        _md5(tx.passage_text(title, body, empty_title="keep"), "kept"),
        _md5(tx.passage_text(title, body, use_title=False), "bare"),
    )


@query("lower_text", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def _lower(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", _md5(tx.prepare_text(F.col("text"), lower=True), "digest"))


@query(
    "fill_missing",
    f"WITH {SOURCE_SQL} SELECT ord, md5(coalesce(text, 'No text')) AS digest FROM src",
)
def _fill(spark, sf):
    src = source_rows(spark, sf)
    return src.select("ord", _md5(tx.fill_missing(F.col("text"), "No text"), "digest"))


@query(
    "truncate_text",
    """SELECT doc_id, md5(substring(text, 1, 500)) AS t500, md5(substring(text, 1, 2000)) AS t2000,
       md5(substring(text, 1, 10000)) AS t10000 FROM documents""",
)
def _truncate(spark, sf):
    text = F.col("text")
    cuts = [_md5(tx.truncate(text, n), f"t{n}") for n in (500, 2000, 10000)]
    return table(spark, sf, "documents").select("doc_id", *cuts)


@query(
    "simple_tokens",
    rf"""
SELECT doc_id, len(toks) AS n, md5(array_to_string(toks, ' ')) AS uncased,
       md5(array_to_string(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]'), ' ')) AS cased
FROM (SELECT doc_id, text, {tokens_sql("text")} AS toks FROM documents)""",
)
def _tokens(spark, sf):
    docs = table(spark, sf, "documents")
    cased = tx.simple_tokens(F.col("text"), uncased=False)
    rows = docs.select("doc_id", tx.simple_tokens(F.col("text")).alias("t"), cased.alias("c"))
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n"),
        _md5(F.array_join("t", " "), "uncased"),
        _md5(F.array_join("c", " "), "cased"),
    )


@query(
    "bigram_tokens",
    rf"""
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]')) AS t FROM documents),
low AS (SELECT doc_id, lower(t) AS t FROM toks),
grams AS (
  SELECT doc_id, t AS g FROM low WHERE length(t) <= 2
  UNION ALL
  SELECT doc_id, substring(t, i, 2) AS g
  FROM (SELECT doc_id, t, unnest(range(1, length(t))) AS i FROM low WHERE length(t) > 2))
SELECT doc_id, g AS gram, count(*) AS n FROM grams GROUP BY doc_id, g""",
)
def _bigrams(spark, sf):
    docs = table(spark, sf, "documents")
    counts = term_counts(tx.char_ngrams(2)(F.col("text")))["terms"]
    return docs.select("doc_id", F.inline(counts).alias("gram", "n")).select(
        "doc_id", "gram", F.col("n").cast("long").alias("n")
    )


@query("decompose_unicode", "SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def _nfd(spark, sf):
    docs = table(spark, sf, "documents")
    bare = F.regexp_replace(tx.nfd(F.col("text")), r"\p{Mn}", "")
    return docs.select("doc_id", _md5(bare, "bare"))


_FENCE = """' ' || array_to_string({}, ' ') || ' '"""


@query(
    "has_answer",
    f"""
WITH {SOURCE_SQL},
pairs AS (
  SELECT a.ord, a.text, [split_part(b.title, ' ', 1) || ' ' || split_part(b.title, ' ', 2), 'Le la!', ''] AS answers,
  FROM src a JOIN src b ON b.ord = a.ord + 1),
long AS (SELECT ord, text, unnest(answers[1:2]) AS answer FROM pairs),
hit AS (
  SELECT ord, coalesce(bool_or(len({tokens_sql("nfc_normalize(answer)")}) = 0 OR contains(
           {_FENCE.format(tokens_sql("nfc_normalize(text)"))},
           {_FENCE.format(tokens_sql("nfc_normalize(answer)"))})), false) AND bool_and(text IS NOT NULL) AS found
  FROM long GROUP BY ord)
SELECT ord, found, text IS NOT NULL AS found_empty FROM hit JOIN src USING (ord)""",
)
def _has_answer(spark, sf):
    src = source_rows(spark, sf)
    words = F.concat_ws(
        " ", *[F.split_part("title", F.lit(" "), F.lit(i)) for i in (1, 2)]
    )
    following = src.select((F.col("ord") - 1).alias("ord"), words.alias("wanted"))
    pairs = src.join(following, "ord")
    answers = F.array("wanted", F.lit("Le la!"))
    plain = pairs.select(
        "ord", tx.nfd(F.col("text")).alias("text"), tx.nfd_all(answers).alias("answers")
    )
    text = F.col("text")
    return plain.select(
        "ord",
        tx.has_answer(text, F.col("answers")).alias("found"),
        tx.has_answer(text, F.array(F.lit(""))).alias("found_empty"),
    )


# articles go when no word character touches them; twice, for neighbours
def _answer_sql(expr: str) -> str:
    bare = f"""translate(lower({expr}), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"""
    drop = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}\p{{M}}])(a|an|the)($|[^\p{{L}}\p{{N}}\p{{M}}])', '\1 \3', 'g')"
    out = drop.format(drop.format(bare))
    return f"list_filter(regexp_split_to_array({out}, '[\\s]+'), lambda w: w <> '')"


@query(
    "normalize_answer",
    f"SELECT doc_id, md5(array_to_string({_answer_sql('text')}, ' ')) AS digest FROM documents",
)
def _normalize_answer(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", _md5(tx.normalize_answer(F.col("text")), "digest"))


_PAIRED_SQL = f"""
WITH {SOURCE_SQL},
pairs AS (SELECT a.ord, a.title AS pred, b.title AS g1, 'The ' || lower(a.title) || '!' AS g2, b.title || ' ' || a.title AS g3
          FROM src a JOIN src b ON b.ord = a.ord + 1)"""


def _paired(spark, sf):
    src = source_rows(spark, sf)
    following = src.select((F.col("ord") - 1).alias("ord"), F.col("title").alias("g1"))
    shout = F.concat(F.lit("The "), F.lower("title"), F.lit("!"))
    both = F.concat("g1", F.lit(" "), "title")
    return src.join(following, "ord").select(
        "ord", F.col("title").alias("pred"), "g1", shout.alias("g2"), both.alias("g3")
    )


@query(
    "exact_match",
    f"""{_PAIRED_SQL}
SELECT ord, {_answer_sql('pred')} = {_answer_sql('g1')} AS em_one,
       {_answer_sql('pred')} = {_answer_sql('g1')} OR {_answer_sql('pred')} = {_answer_sql('g2')} AS em_any
FROM pairs""",
)
def _exact_match(spark, sf):
    pred = F.col("pred")
    return _paired(spark, sf).select(
        "ord",
        tx.exact_match(pred, F.array("g1")).alias("em_one"),
        tx.exact_match(pred, F.array("g1", "g2")).alias("em_any"),
    )


@query(
    "token_f1",
    f"""{_PAIRED_SQL},
golds AS (SELECT ord, pred, unnest([g1, g3]) AS gold, unnest([1, 2]) AS j FROM pairs),
p AS (SELECT ord, j, w, count(*) AS c FROM (SELECT ord, j, unnest({_answer_sql('pred')}) AS w FROM golds) GROUP BY ALL),
g AS (SELECT ord, j, w, count(*) AS c FROM (SELECT ord, j, unnest({_answer_sql('gold')}) AS w FROM golds) GROUP BY ALL),
same AS (SELECT ord, j, sum(least(p.c, g.c)) AS s FROM p JOIN g USING (ord, j, w) GROUP BY ALL),
sizes AS (SELECT ord, j, len({_answer_sql('pred')}) AS np, len({_answer_sql('gold')}) AS ng FROM golds),
f AS (SELECT ord, coalesce(2 * (s / np) * (s / ng) / (s / np + s / ng), 0) AS f1
      FROM sizes LEFT JOIN same USING (ord, j))
SELECT ord, round(max(f1), 6) AS f1 FROM f GROUP BY ord""",
)
def _token_f1(spark, sf):
    f1 = tx.token_f1(F.col("pred"), F.array("g1", "g3"))
    return _paired(spark, sf).select("ord", F.round(f1, 6).alias("f1"))


_GENERATED_SQL = f"""
WITH {CORPUS_SQL},
lines AS (
  SELECT ord, text AS input, unnest(string_split(text, chr(10))) AS l,
         unnest(range(len(string_split(text, chr(10))))) AS i FROM filled),
raw AS (
  SELECT ord, input, i, CASE i % 4 WHEN 0 THEN i || '. ' || l WHEN 1 THEN '- ' || l
                        WHEN 2 THEN l ELSE i || '. 키워드 ' || l END AS line FROM lines),
cleaned AS (
  SELECT ord, i AS position, substr(line, instr(line, ' ') + 1) AS query, input
  FROM raw
  WHERE instr(line, ' ') > 0 AND regexp_matches(split_part(line, ' ', 1), '[-.\\p{{Nd}}]')
    AND NOT regexp_matches(line, 'generated_text|summary:|키워드|유의어 변경|# 출력|입력 ?문서:'))"""


def generated_rows(spark, sf):
    """``(ord, input, content)``: numbered, dashed, plain and marked lines per document."""
    src = source_rows(spark, sf).select("ord", tx.fill_missing(F.col("text")).alias("input"))

    def dress(line: Column, i: Column) -> Column:
        number = F.concat(i.cast("string"), F.lit(". "))
        return (
            F.when(i % 4 == 0, F.concat(number, line))
            .when(i % 4 == 1, F.concat(F.lit("- "), line))
            .when(i % 4 == 2, line)
            .otherwise(F.concat(number, F.lit("키워드 "), line))
        )

    content = F.array_join(F.transform(F.split("input", "\n"), dress), "\n")
    return src.select("ord", "input", content.alias("content"))


@query(
    "clean_generated_queries",
    f"{_GENERATED_SQL} SELECT ord, position, md5(query) AS digest FROM cleaned",
)
def _clean_generated(spark, sf):
    cleaned = dataset.clean_generated_queries(generated_rows(spark, sf))
    return cleaned.select("ord", F.col("position").cast("long").alias("position"), _md5(F.col("query"), "digest"))


@query(
    "link_generated_queries",
    f"""{_GENERATED_SQL}
SELECT g.ord, g.position, md5(g.query) AS digest, c.pid FROM cleaned g JOIN corpus c ON c.text = g.input""",
)
def _link_generated(spark, sf):
    corpus, _, _ = titled_dataset(spark, sf)
    cleaned = dataset.clean_generated_queries(generated_rows(spark, sf))
    linked = dataset.link_generated(cleaned, corpus)
    return linked.select(
        "ord", F.col("position").cast("long").alias("position"), _md5(F.col("query"), "digest"), "pid"
    )


@query(
    "parse_and_make_ids",
    f"""WITH {CORPUS_SQL}
SELECT pid, substring(pid, 2)::BIGINT AS number, 'Q' || substring(pid, 2) AS qid FROM corpus""",
)
def _ids(spark, sf):
    corpus, _, _ = titled_dataset(spark, sf)
    number = tx.parse_id(F.col("pid"))
    return corpus.select("pid", number.alias("number"), tx.make_id("Q", number).alias("qid"))


@query(
    "patents_to_passages",
    f"""WITH {SOURCE_SQL}
SELECT ord::VARCHAR AS _id, title, md5(coalesce(text, 'No text')) AS digest, '요약문' AS type,
       ord::VARCHAR AS patent_id, source AS applicant FROM src""",
)
def _patents(spark, sf):
    mapping = {"id": "ord", "title": "title", "text": "text", "applicant": "source"}
    rows = dataset.patents_to_passages(source_rows(spark, sf), mapping)
    return rows.select("_id", "title", _md5(F.col("text"), "digest"), "metadata.*")


_TITLE_SQL = f"""WITH {SOURCE_SQL},
wanted AS (SELECT title, count(*) AS n FROM src GROUP BY title ORDER BY n DESC, title LIMIT 1)
SELECT ord, title FROM src WHERE title = (SELECT title FROM wanted)"""


@query("find_stored_title", _TITLE_SQL)
def _find_stored_title(spark, sf):
    src = source_rows(spark, sf)
    common = src.groupBy("title").count().orderBy(F.desc("count"), "title").first()
    path = scratch_path(spark, "titles")
    dataset.store_by_title(src, path)
    return dataset.find_stored_title(spark, path, common["title"]).select("ord", "title")


@query(
    "find_by_title",
    _TITLE_SQL,
)
def _find_by_title(spark, sf):
    src = source_rows(spark, sf)
    common = src.groupBy("title").count().orderBy(F.desc("count"), "title").first()
    return dataset.find_by_title(src, common["title"]).select("ord", "title")
