"""The pipeline against plain Python, stage by stage and as a whole."""

import os
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402
from test_llm import brute_lines  # noqa: E402

import corpus_pipeline  # noqa: E402
from findry.llm import bpe, mixing  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(H.awkward(7), H.SCHEMA).repartition(2)
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def expected_kept():
    """Language, lines and near copies in plain Python: ``{doc_id: text}``."""
    rows = [r for r in H.awkward(7) if any(c.isalpha() for c in r[1] or "")]
    texts = {i: text for i, (_, _, text) in brute_lines(rows).items()}
    comps = H.components(list(texts.items()))
    return {i: t for i, t in texts.items() if comps[i] == i}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        assert docs.columns == COLUMNS
    assert docs.count() > 0


def test_pipeline_like_brute_force(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    kept = expected_kept()
    source = {r[0]: r[3] for r in H.awkward(7)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= set(kept) and max(times.values()) <= 2
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == reference.encode_ordinary(kept[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["source"] == source[r["doc_id"]]
    sizes = {i: len(H.words(t)) for i, t in kept.items()}
    names = sorted({s for i, s in source.items() if i in kept and s is not None})
    names += [None] if any(source[i] is None for i in kept) else []
    own = [sum(n for i, n in sizes.items() if source[i] == s) for s in names]
    weights = [(3, 1, 2)[i % 3] for i in range(len(names))]
    for s, t in zip(names, mixing.fill_targets(own, weights, 1.5 * sum(own), 2), strict=True):
        taken = sum(sizes[i] * n for i, n in times.items() if source[i] == s)
        assert abs(taken - t) <= max(n for i, n in sizes.items() if source[i] == s) / 2 + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], H.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
