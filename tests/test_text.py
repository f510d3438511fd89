"""Text functions on hand-made rows."""

import unicodedata

from pyspark.sql import functions as F

from findry.functions import text as tx


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normaliser_classes(spark):
    cases = {
        "a\u0001b\u001bc": "abc",
        "a\u0010b": "a\u0010b",  # not in the deleted set
        "a\u000bb\u000cc\u0085d": "a b c d",
        "soft­hyphen": "softhyphen",
        "a‐b–c—d−e－f⁻g⁃h": "a-b-c-d-e-f-g-h",
        "“a” „b‟": '"a" "b"',
        "‘a’ ‚b‛ ՚c Ꞌd ＇e `f ´g": "'a' 'b' 'c 'd 'e 'f 'g",
        "′ ‵ ″ ‶ ‴ ‷ ⁗": "' ' '' '' ''' ''' ''''",
        "wait… what . . . no": "wait... what ... no",
        "1⁄2 ∕": "1/2 /",
        "~˜ +＋ tab\tstays\n": "~˜ +＋ tab\tstays\n",
    }
    assert column(spark, list(cases), tx.normalize_text) == list(cases.values())


def test_passage_text_titles(spark):
    rows = [("t", "b"), ("", "b"), (None, "b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, b string")
    t, b = F.col("t"), F.col("b")
    got = df.orderBy("i").select(
        tx.passage_text(t, b),
        tx.passage_text(t, b, empty_title="keep"),
        tx.passage_text(t, b, use_title=False),
    )
    assert [tuple(r) for r in got.collect()] == [
        ("t b", "t b", "b"),
        ("b", " b", "b"),
        ("b", "b", "b"),
    ]


def test_tokens_and_bigrams(spark):
    assert column(spark, ["Don't 3.5 été éx!"], tx.simple_tokens) == [
        ["don", "'", "t", "3", ".", "5", "été", "éx", "!"]
    ]
    assert column(spark, ["특허청 a"], tx.char_ngrams(2)) == [["특허", "허청", "a"]]


def test_nfd(spark):
    texts = ["plain", "é", "한글", None, ""]
    want = [t if t is None else unicodedata.normalize("NFD", t) for t in texts]
    assert column(spark, texts, tx.nfd) == want
    lists = [["é", "a"], ["b"], None]
    got = column(spark, lists, tx.nfd_all, "array<string>")
    assert got == [[unicodedata.normalize("NFD", "é"), "a"], ["b"], None]


def test_has_answer(spark):
    df = spark.createDataFrame(
        [
            (0, "The Café is open.", ["café IS"]),
            (1, "The cafes are open", ["cafe"]),  # a token must match whole
            (2, "anything", [""]),  # no token: matches every text
            (3, None, [""]),
            (4, "a b c", ["c d", "b c"]),
        ],
        "i int, text string, answers array<string>",
    )
    plain = df.select("i", tx.nfd(F.col("text")).alias("text"), tx.nfd_all(F.col("answers")).alias("answers"))
    got = plain.orderBy("i").select(tx.has_answer(F.col("text"), F.col("answers")))
    assert [r[0] for r in got.collect()] == [True, False, True, False, True]


def test_answer_forms(spark):
    texts = ["The  Cat's, a hat!", "an éa the–end theme", "", "A an THE"]
    assert column(spark, texts, tx.normalize_answer) == ["cats hat", "éa –end theme", "", ""]
    df = spark.createDataFrame([("the b b c", ["b c d", "x"], ["B b, C."])], "p string, g array<string>, h array<string>")
    p = F.col("p")
    f1, em_no, em_yes = df.select(
        tx.token_f1(p, F.col("g")), tx.exact_match(p, F.col("g")), tx.exact_match(p, F.col("h"))
    ).first()
    assert abs(f1 - 2 / 3) < 1e-12 and em_no is False and em_yes is True


def test_ids(spark):
    assert column(spark, ["C12", "Q0"], tx.parse_id) == [12, 0]
    assert column(spark, [3], lambda c: tx.make_id("Q", c), "int") == ["Q3"]
