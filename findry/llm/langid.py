"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, most
frequent first. A document is given the language whose profile its own list
lies closest to: the sum, over the document's n-grams, of how many places each
is away from its place in the profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from findry.llm.common import fold, text_slices, tidy
from findry.session import materialize

UNKNOWN = "und"
_BLANK = 1  # stands for a word border; not a letter
_BITS = 21  # of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_codes(text: str) -> np.ndarray:
    """The letter n-grams of orders 1 to 3, each packed into one number.

    Words are lower-cased runs of letters with one blank on either side;
    n-grams do not reach over a blank. No letter: an empty array.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, _BLANK).astype(np.int64)
    points = np.concatenate(([_BLANK], points, [_BLANK]))
    blank = points == _BLANK
    points = points[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    if len(points) < 3:
        return np.empty(0, np.int64)
    inner = points[1:-1] != _BLANK
    pairs = (points[:-1] << _BITS) | points[1:]
    triples = ((pairs[:-1] << _BITS) | points[2:])[inner]
    return np.concatenate((points[points != _BLANK], pairs, triples))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: how often each language has each n-gram."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, list[str]] = {}
    size: dict[str, int] = {}

    def add(lang: str) -> None:
        texts = waiting.pop(lang, [])
        size.pop(lang, None)
        if texts:
            held.setdefault(lang, []).append(
                np.unique(gram_codes("\n".join(texts)), return_counts=True)
            )
        if len(held.get(lang, ())) >= 16:
            held[lang] = [merged(held[lang])]

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n for _, n in parts]), len(codes))
        return codes, counts.astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= 1 << 18:
                add(lang)
    for lang in list(waiting):
        add(lang)
    for lang, parts in held.items():
        codes, counts = merged(parts)
        for at in range(0, len(codes), 100_000):
            part = codes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part), pa.array(counts[at : at + 100_000])],
                ["lang", "gram", "n"],
            )


def learn_profiles(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = 400
) -> DataFrame:
    """``(lang, place, gram)``: each language's ``size`` most frequent n-grams.

    Counts cover every row whose text and language are there; equal counts are
    ordered by n-gram. A row without either teaches nothing; a table without
    such rows gives an empty result. Counting adds up inside each partition
    before the shuffle, so a language with most of the rows is no hot key.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = (
        rows.where("lang is not null and text is not null")
        .mapInArrow(tidy(_count_grams), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return ranked.select("lang", "place", "gram")


class Profiles:
    """Profiles as one table of places: a row per n-gram, a column per language."""

    def __init__(self, rows: list, size: int) -> None:
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.places = np.full((len(self.grams), len(self.langs)), size, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for r in rows:
            self.places[np.searchsorted(self.grams, r["gram"]), at[r["lang"]]] = r["place"] - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        grams, counts = np.unique(codes, return_counts=True)
        top = grams[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        places = self.places[at]
        places[self.grams[at] != top] = self.size
        apart = np.abs(places - np.arange(len(top), dtype=np.int32)[:, None]).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(top))


def identify(
    docs: DataFrame, profiles: DataFrame, *, text: str = "text", size: int = 400,
    max_languages: int = 2_000,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, 1: the profile itself).

    A text that is null or has no letter gets ``und`` and 0; so does every
    text if no language was learned. Equal distances go to the language that
    comes first in code point order. Columns of ``docs`` named like the two
    new ones are replaced. The profiles shipped to the tasks hold at most
    ``max_languages * size`` rows; more languages raise an error. A very long
    text is counted as a whole, within its task; an empty table stays empty.
    """
    rows = profiles.limit(max_languages * size + 1).collect()
    if len(rows) > max_languages * size:
        raise ValueError(f"more than {max_languages} languages of {size} n-grams")
    model = Profiles(rows, size)
    own = docs.drop("lang_pred", "score")
    schema = own.schema.jsonValue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for start, texts in text_slices(batch.column(place)):
                found = [model.predict(x) for x in texts]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x for x, _ in found], pa.string()),
                     pa.array([x for _, x in found], pa.float64())],
                    [*part.schema.names, "lang_pred", "score"],
                )

    out = type(own.schema).fromJson(schema).add("lang_pred", "string").add("score", "double")
    return own.mapInArrow(tidy(run), out)


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: ``crc32`` of the id, modulo 4, is 2; false without an id."""
    return docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of the documents, predict the language of all.

    ``(doc_id, held_out, lang_pred, score)``; the documents held out teach nothing.
    """
    rows = held_out(docs.select("doc_id", "text", "lang"))
    profiles = materialize(learn_profiles(rows.where("not held_out")), "profiles")
    return identify(rows.drop("lang"), profiles).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@F.pandas_udf(BooleanType())
def _has_letter(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: len(gram_codes(text or "")) > 0).astype(bool)


#: The least score of a text whose language counts as known.
LEAST_SCORE = 0.25


def reject_unknown(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the documents in which no language can be made out.

    These are the texts that are null or have no letter (score 0), and those
    whose n-grams lie out of place in every profile: the score of the nearest
    one, the predicted language, is below ``least_score`` (above 0). Texts of
    a learned language score 0.5 and more, also short ones; an unlearned
    script has no n-gram in common with any profile and scores 0. If no
    language was learned (no labelled document outside the held-out fold), all
    texts with letters stay. An empty table stays empty.
    """
    if least_score <= 0:
        raise ValueError("least_score must be above 0")
    rows = held_out(docs.select("doc_id", "text", "lang"))
    profiles = materialize(learn_profiles(rows.where("not held_out")), "profiles")
    if profiles.isEmpty():
        return docs.where(_has_letter("text"))
    aside = {c: f"__{c}" for c in docs.columns if c in ("lang_pred", "score")}
    found = identify(docs.withColumnsRenamed(aside), profiles)
    kept = found.where(F.col("score") >= least_score).drop("lang_pred", "score")
    return kept.withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)
