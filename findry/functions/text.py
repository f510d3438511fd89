"""Text and id expressions. All run in the JVM except Unicode decomposition."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character classes of the text normaliser.
CONTROLS = (
    "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011"
    "\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
)
SOFT_HYPHEN = "­"
SPACE_LIKE = "\u000b\u000c\u0085"
DASHES = "‐‑⁃‒–—―−－⁻"
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "’՚Ꞌꞌ＇‘‚‛`´′‵"
SLASHES = "⁄∕"
DOUBLE_PRIMES = "″‶"
TRIPLE_PRIMES = "‴‷"
QUADRUPLE_PRIME = "⁗"
ELLIPSIS = "…"

# Markers that disqualify a generated line as a query.
GENERATED_MARKERS = (
    "generated_text",
    "summary:",
    "키워드",
    "유의어 변경",
    "# 출력",
    "입력 문서:",
    "입력문서:",
)

# Token pattern, ASCII punctuation, English articles.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES_PATTERN = r"(?U)\b(a|an|the)\b"
WHITESPACE_PATTERN = r"(?U)[\s\x1c-\x1f]+"

Tokenizer = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``.

    A column mentioned inside a lambda is evaluated again for every element;
    passing it through a one-element array evaluates it once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_to_one() -> tuple[str, str]:
    pairs = (
        (SPACE_LIKE, " "),
        (DASHES, "-"),
        (DOUBLE_QUOTES, '"'),
        (SINGLE_QUOTES, "'"),
        (SLASHES, "/"),
    )
    source = "".join(chars for chars, _ in pairs)
    target = "".join(to * len(chars) for chars, to in pairs)
    # characters past the end of the target are deleted by translate
    return source + CONTROLS + SOFT_HYPHEN, target


def normalize_text(col: Column) -> Column:
    """Unify punctuation variants and drop control characters (tab, newline stay)."""
    out = F.translate(col, *_one_to_one())
    for chars, quotes in ((DOUBLE_PRIMES, 2), (TRIPLE_PRIMES, 3), (QUADRUPLE_PRIME, 4)):
        for ch in chars:
            out = F.replace(out, F.lit(ch), F.lit("'" * quotes))
    out = F.replace(out, F.lit(ELLIPSIS), F.lit("..."))
    return F.replace(out, F.lit(" . . . "), F.lit(" ... "))


def prepare_text(col: Column, normalize: bool = False, lower: bool = False) -> Column:
    """Optional normalisation, then optional lowercasing, in this order."""
    out = normalize_text(col) if normalize else col
    return F.lower(out) if lower else out


def passage_text(
    title: Column, text: Column, use_title: bool = True, empty_title: str = "drop"
) -> Column:
    """Title, a space and the body; a missing title leaves the body alone.

    ``empty_title='keep'`` keeps the leading space of an empty title (index
    side), ``'drop'`` leaves it out (evaluation and training side).
    """
    if empty_title not in ("keep", "drop"):
        raise ValueError("empty_title must be 'keep' or 'drop'")
    if not use_title:
        return text
    bare = title.isNull()
    if empty_title == "drop":
        bare = bare | (title == "")
    return F.when(bare, text).otherwise(F.concat(title, F.lit(" "), text))


def fill_missing(col: Column, value: str = ".") -> Column:
    """Replace a missing body by a filler text."""
    return F.coalesce(col, F.lit(value))


def truncate(col: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(col, 1, n)


def simple_tokens(col: Column, uncased: bool = True) -> Column:
    """Runs of letters, digits and marks, or single visible characters."""
    tokens = F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(tokens, F.lower) if uncased else tokens


def char_ngrams(n: int = 2) -> Tokenizer:
    """A tokenizer that cuts each token into character n-grams.

    Suits languages written without spaces, or with particles glued to the
    word; tokens shorter than ``n`` stay whole.
    """

    def grams(token: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.length(token) - (n - 1)),
            lambda i: F.substring(token, i, F.lit(n)),
        )
        return F.when(F.length(token) <= n, F.array(token)).otherwise(windows)

    return lambda col: F.flatten(F.transform(simple_tokens(col), grams))


@F.pandas_udf(T.StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def nfd(col: Column) -> Column:
    """Canonical decomposition; pure ASCII text never leaves the JVM."""
    ascii_only = col.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(ascii_only, col), _decompose(F.when(~ascii_only, col)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decompose_all(lists: pd.Series) -> pd.Series:
    return lists.map(
        lambda ts: [t if t is None else unicodedata.normalize("NFD", t) for t in ts],
        na_action="ignore",
    )


def nfd_all(col: Column) -> Column:
    """Canonical decomposition of every string of an array."""
    ascii_only = F.array_join(col, "").rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(ascii_only, col), _decompose_all(F.when(~ascii_only, col)))


def _fenced(tokens: Column) -> Column:
    # tokens hold no space, so a space on both sides marks token borders
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def has_answer(text: Column, answers: Column) -> Column:
    """True when the tokens of any answer occur as a run in the text.

    Both sides should be columns made by :func:`nfd` in an earlier select, so
    that composed and decomposed accents match; Spark allows no Python
    function inside the lambdas used here. An answer without tokens matches every
    text; a missing text matches nothing.
    """

    def found(haystack: Column, answer: Column) -> Column:
        needle = _fenced(simple_tokens(answer))
        return (needle == "  ") | F.contains(haystack, needle)

    hit = let(
        _fenced(simple_tokens(text)), lambda hay: F.exists(answers, lambda a: found(hay, a))
    )
    return text.isNotNull() & F.coalesce(hit, F.lit(False))


def answer_tokens(col: Column) -> Column:
    """Lowercased words without ASCII punctuation and English articles."""
    bare = F.translate(F.lower(col), ASCII_PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, ARTICLES_PATTERN, " ")
    return F.filter(F.split(no_articles, WHITESPACE_PATTERN), lambda w: w != "")


def normalize_answer(col: Column) -> Column:
    """The answer form compared by exact match and token F1."""
    return F.array_join(answer_tokens(col), " ")


def exact_match(prediction: Column, golds: Column) -> Column:
    """True when the prediction equals any of the ground truths."""
    return let(
        normalize_answer(prediction),
        lambda wanted: F.exists(golds, lambda g: normalize_answer(g) == wanted),
    )


def _numbered(tokens: Column) -> Column:
    """Each token with its number among its equals, so that a multiset becomes a set."""
    from findry.operators.lexical import term_counts

    return F.flatten(
        F.transform(
            term_counts(tokens)["terms"],
            lambda t: F.transform(
                F.sequence(F.lit(1), t["tf"].cast("int")),
                lambda i: F.concat(t["term"], F.lit(" "), i.cast("string")),
            ),
        )
    )


def _f1_of_tokens(pred: Column, gold: Column) -> Column:
    def combine(same: Column) -> Column:
        precision = same / F.size(pred)
        recall = same / F.size(gold)
        return F.when(same == 0, F.lit(0.0)).otherwise(
            2 * precision * recall / (precision + recall)
        )

    same = F.size(F.array_intersect(_numbered(pred), _numbered(gold)))
    return let(same.cast("double"), combine)


def token_f1(prediction: Column, golds: Column) -> Column:
    """Best token F1 (multiset overlap) of the prediction over the ground truths."""
    return let(
        answer_tokens(prediction),
        lambda pred: F.array_max(
            F.transform(golds, lambda g: let(answer_tokens(g), lambda t: _f1_of_tokens(pred, t)))
        ),
    )


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair scorer in [0, 1]: token F1 of query and text."""
    return let(
        answer_tokens(query),
        lambda q: let(answer_tokens(text), lambda t: _f1_of_tokens(q, t)),
    )


def coverage_score(query: Column, text: Column) -> Column:
    """Pair scorer in [0, 1]: share of the query's distinct tokens found in the text."""
    return _coverage_of_tokens(query, answer_tokens(text))


def _coverage_of_tokens(query: Column, tokens: Column) -> Column:
    def share(wanted: Column) -> Column:
        # the right side is put into a set, for each pair: the few wanted ones
        found = F.size(F.array_intersect(tokens, wanted)).cast("double")
        return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(found / F.size(wanted))

    return let(F.array_distinct(answer_tokens(query)), share)


# a text's distinct tokens can be made once and scored against many queries
coverage_score.prepare = lambda text: F.array_distinct(answer_tokens(text))
coverage_score.score_prepared = _coverage_of_tokens


def content_key(col: Column) -> Column:
    """A fixed-width key for a long text, so that joins and groupings on
    bodies shuffle 64 characters instead of the body itself."""
    return F.sha2(col, 256)


def parse_id(col: Column) -> Column:
    """Numeric part of a prefixed id: ``C12`` becomes 12."""
    return F.substring(col, 2, 20).cast("long")


def make_id(prefix: str, number: Column) -> Column:
    """Prefix and number to an id: ``Q`` and 3 become ``Q3``."""
    return F.concat(F.lit(prefix), number.cast("string"))
