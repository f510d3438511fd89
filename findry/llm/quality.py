"""Document quality by hierarchical empirical Bayes.

A classifier gives each document its own evidence. Sites are judged by what
their documents show: a host's posterior is its mean evidence shrunk toward the
global one, a path's is its mean shrunk toward its host. How strongly is
estimated from the spread between sites, so a sparse site says little and a
large one speaks for itself. The path's posterior then replaces the global
prior in the document's odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findry.llm.common import tidy
from findry.session import materialize

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _POINT, _SIGN, _HIGH = range(8)
_PLAIN = b".,;:!?'\"()-"


def _classes() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    for i in range(256):
        c = bytes([i])
        if i >= 128:
            out[i] = _HIGH
        elif c.isalpha():
            out[i] = _LOWER if c.islower() else _UPPER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c == b"\n":
            out[i] = _LINE
        elif c.isspace():
            out[i] = _SPACE
        elif c in _PLAIN:
            out[i] = _POINT
    return out


CLASS = _classes()
N_FEATURES = 15


def features(text: str | None) -> list[float]:
    """What the classifier sees of a whole text; a null text is empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    share = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = raw.split()
    lines = raw.split(b"\n")
    m = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    ended = sum(len(w) > 2 and CLASS[w[-1]] == _SIGN for w in words) / m
    doubled = sum(len(w) > 2 and w[-1] == w[-2] and not w[-1:].isalnum() for w in words) / m
    return [
        *share.tolist(),
        again,
        ended,
        doubled,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        float(np.log1p(len(raw) / m)),
        float(np.log1p(m)),
    ]


class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean = rows.mean(axis=0) if len(rows) else np.zeros(N_FEATURES)
        spread = rows.std(axis=0) if len(rows) else np.ones(N_FEATURES)
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        x = self._design(rows) if len(rows) else np.zeros((0, N_FEATURES + 1))
        self.weights = np.zeros(N_FEATURES + 1)
        # half a document of either kind keeps the odds finite
        self.prior = (good.sum() + 0.5) / (len(good) + 1.0)
        penalty = np.full(N_FEATURES + 1, ridge)
        penalty[0] = 1e-3
        for _ in range(steps if len(rows) else 0):
            p = self._squash(x @ self.weights)
            slope = x.T @ (good - p) - penalty * self.weights
            bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            self.weights = self.weights + np.linalg.solve(bend, slope)

    def _design(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.spread, -8, 8)
        return np.column_stack((np.ones(len(rows)), scaled))

    @staticmethod
    def _squash(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self._squash(self._design(rows) @ self.weights)


def fit_classifier(
    docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, key: str = "doc_id",
    text: str = "text", label: str = "quality",
) -> Logistic:
    """A classifier from at most ``max_labelled`` labelled documents, drawn by hash of the id.

    A document labelled more than once counts with its mean label, half and
    above as good. Of rows that repeat a labelled id the one with the least
    features (in order) counts, so reruns agree. Without any label every
    document gets one half.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("id")).agg(F.avg(label).alias("good"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    drawn = materialize(drawn, "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(rows, pa.list_(pa.float64()))], ["id", "good", "x"]
            )

    # at most max_labelled ids, one row of each
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(drawn), "id").select(F.xxhash64("id").alias("id"), "good", "text")
    found = rows.mapInArrow(run, "id long, good double, x array<double>")
    found = found.groupBy("id").agg(F.first("good").alias("good"), F.min("x").alias("x"))
    found = found.orderBy("id").toArrow()
    matrix = np.array(found.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    return Logistic(matrix, (found.column("good").to_numpy() >= 0.5).astype(float))


def add_evidence(docs: DataFrame, model: Logistic, *, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``evidence``: the classifier's probability."""
    own = docs.drop("evidence")
    names = [c for c in own.columns if c != text]
    schema = own.select(*names).schema.add("evidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            rows = np.array([features(x.as_py()) for x in column]).reshape(-1, N_FEATURES)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(model(rows))], [*names, "evidence"]
            )

    return own.mapInArrow(tidy(run), schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, above: Column) -> float:
    """How many documents' worth the level above is, by the method of moments.

    Between-group variance is the spread of group means around the level above
    less what sampling explains, each group weighted by its size.
    """
    away = (mean - above) * (mean - above)
    noise = above * (1 - above) / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * (away - noise)).alias("between"),
        F.sum(F.col("n") * above * (1 - above)).alias("whole"),
    ).first()
    if not row["whole"]:
        return 1.0
    share = max(1e-4, min(0.5, (row["between"] or 0.0) / row["whole"]))
    return 1 / share - 1


def site_posteriors(rows: DataFrame, prior: float) -> tuple[DataFrame, float]:
    """``(host, path, host_posterior, path_posterior)`` and the global mean.

    ``rows`` holds ``(host, path, evidence)``. Sums are combined before the
    shuffle, so a host with most of the documents is no hot key.
    """
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("evidence").alias("s")
    )
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else prior
    above = F.lit(float(mean))
    strength = _strength(hosts, F.col("s") / F.col("n"), above)
    posterior = (F.col("s") + strength * above) / (F.col("n") + strength)
    hosts = hosts.select(F.col("host").alias("h"), posterior.alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    up = F.col("host_posterior")
    strength = _strength(paths, F.col("s") / F.col("n"), up)
    posterior = (F.col("s") + strength * up) / (F.col("n") + strength)
    table = paths.select("host", "path", "host_posterior", posterior.alias("path_posterior"))
    return materialize(table, "site-posteriors"), mean


def score_quality(
    docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang",
    max_labelled: int = 20_000, threshold: float = 0.5,
) -> DataFrame:
    """``(doc_id, evidence, host_posterior, path_posterior, score, kept)``: one row per document.

    The classifier is fitted on at most ``max_labelled`` labelled documents;
    evidence, sites and scores cover all whole texts. ``host`` and ``path`` are
    columns; null is a site of its own. ``score`` is the probability that the
    document is good: its own odds times the odds of its path over the global
    odds. ``kept`` from ``threshold`` on. A null or empty text is judged by its
    empty features, a very long one as a whole. Repeated rows are judged alike
    and count each. An empty table gives an empty result.
    """
    model = fit_classifier(docs, labels, max_labelled=max_labelled)
    rows = docs.select(
        "doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text"
    )
    rows = materialize(add_evidence(rows, model), "evidence")
    sites, mean = site_posteriors(rows, float(model.prior))
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(float(mean)))
    score = 1 / (1 + F.exp(-odds))
    return rows.join(sites, same).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", score.alias("score"),
        (score >= threshold).alias("kept"),
    )
