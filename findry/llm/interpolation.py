"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of all n-gram
orders and a uniform one. The weights depend on how often the token's context
was seen (by powers of two) and are learned by expectation-maximisation on a
part of the training documents that was left out of the counts for this.

Documents are cut into chunks. A chunk sends each n-gram it holds, once, to the
shard that the n-gram's hash names; a shard adds up what all chunks sent and
answers each chunk. So counting and looking up are one shuffle, a frequent
n-gram costs one entry per chunk, and no task holds more than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findry.llm.common import fold, mix64, tidy
from findry.session import materialize

#: A space is part of no word, so these name none.
END = xxhash.xxh64_intdigest(b" end")
START = np.uint64(xxhash.xxh64_intdigest(b" start"))

#: Parts of the documents: counted for all models, left for the weights, not learned from.
MAIN, WEIGHTS, UNSEEN = 0, 1, 2

BUCKETS = 40
#: Steps per octave in which estimates are summed up for the weights.
GRAIN = 4
_FLOOR = 255  # stands for an estimate of 0


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def chunk_documents(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """``(doc_id, part, text)`` as chunks of about ``chunk_tokens`` tokens, each of one part.

    A chunk holds its distinct words as hashes and its tokens as places among
    them. Every document ends in one end token; a null text is only that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_: dict[int, tuple[list, list, list, dict[bytes, int]]] = {}
        held: dict[int, int] = {}

        def close(part: int) -> pa.RecordBatch:
            nonlocal made
            ids, sizes, tokens, words = open_.pop(part)
            hashes = np.array([END if w is None else xxhash.xxh64_intdigest(w) for w in words],
                              np.uint64)
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) | made], pa.int64()),
                    pa.array([part], pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([pack(np.array(sizes, np.uint32))]),
                    pa.array([pack(np.concatenate(tokens))]),
                    pa.array([pack(hashes)]),
                    pa.array([sum(sizes)], pa.int64()),
                ],
                ["chunk", "part", "doc_ids", "sizes", "tokens", "words", "n"],
            )

        for batch in batches:
            for key, part, text in zip(*batch.columns, strict=True):
                part = part.as_py()
                ids, sizes, tokens, words = open_.setdefault(part, ([], [], [], {}))
                found = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                found.append(None)
                place = words.setdefault
                tokens.append(np.array([place(w, len(words)) for w in found], np.uint32))
                ids.append(key.as_py())
                sizes.append(len(found))
                held[part] = held.get(part, 0) + len(found)
                if held[part] >= chunk_tokens:
                    held[part] = 0
                    yield close(part)
        for part in list(open_):
            yield close(part)

    schema = (
        "chunk long, part int, doc_ids array<long>, sizes binary, tokens binary, words binary, "
        "n long"
    )
    return docs.select("doc_id", "part", "text").mapInArrow(tidy(run), schema)


class Chunk:
    """A chunk's tokens with the distinct n-grams of each order."""

    def __init__(self, sizes: bytes, tokens: bytes, words: bytes, order: int) -> None:
        self.sizes = unpack(sizes, np.uint32)
        self.first = np.concatenate(([0], np.cumsum(self.sizes[:-1]))).astype(np.int64)
        hashes = unpack(words, np.uint64)[unpack(tokens, np.uint32)]
        #: by order: the sorted keys, and each token's place among them
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        grams = hashes
        for k in range(order):
            if k:
                # the n-gram of the token before, one order down, and the token
                before = np.empty_like(grams)
                before[1:] = grams[:-1]
                before[self.first] = START ^ np.uint64(k)
                grams = mix64(mix64(before + np.uint64(k)) * np.uint64(0x2545F4914F6CDD1D) ^ hashes)
            keys, places = np.unique(grams, return_inverse=True)
            self.keys.append(keys)
            self.places.append(places)


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin among sorted keys."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _requests(chunks: DataFrame, order: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, part, sizes, tokens, words = (c[row].as_py() for c in batch.columns)
                held = Chunk(sizes, tokens, words, order)
                for k in range(order):
                    keys = held.keys[k]
                    counts = np.bincount(held.places[k], minlength=len(keys)).astype(np.uint32)
                    cuts = _cuts(keys, shards)
                    full = np.flatnonzero(np.diff(cuts))
                    keys_of = [keys[cuts[s] : cuts[s + 1]] for s in full]
                    n_of = [counts[cuts[s] : cuts[s + 1]] for s in full]
                    n = len(full)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            pa.array([chunk] * n, pa.int64()),
                            pa.array([k] * n, pa.int32()),
                            pa.array([part] * n, pa.int32()),
                            pa.array([pack(np.diff(x, prepend=np.uint64(0))) for x in keys_of],
                                     pa.binary()),
                            pa.array([pack(x) if part != UNSEEN else None for x in n_of],
                                     pa.binary()),
                        ],
                        ["shard", "chunk", "k", "part", "keys", "counts"],
                    )

    schema = "shard int, chunk long, k int, part int, keys binary, counts binary"
    return chunks.select("chunk", "part", "sizes", "tokens", "words").mapInArrow(tidy(run), schema)


_ANSWER = "chunk long, k int, shard int, main binary, learned binary, n_distinct long"


def _answer(rows: pa.Table) -> pa.Table:
    """One shard: add up what the chunks sent, answer each with the counts of its n-grams."""
    rows = rows.combine_chunks()
    shard = rows.column("shard")[0].as_py()
    orders = rows.column("k").to_numpy()
    out = []
    for k in np.unique(orders):
        own = rows.take(np.flatnonzero(orders == k))
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64)
                for x in own.column("keys").to_pylist()]
        parts = own.column("part").to_numpy()
        ends = np.cumsum([len(x) for x in keys])
        distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
        main, learned = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        slots = np.split(places, ends[:-1])
        for slot, part, counts in zip(slots, parts, own.column("counts").to_pylist(), strict=True):
            if part != UNSEEN:
                n = unpack(counts, np.uint32)  # the keys of one chunk are distinct
                learned[slot] += n
                if part == MAIN:
                    main[slot] += n
        seen = [int((learned > 0).sum())] + [0] * (len(keys) - 1)
        for chunk, slot, n in zip(own.column("chunk").to_pylist(), slots, seen, strict=True):
            out.append((chunk, int(k), shard, pack(main[slot]), pack(learned[slot]), n))
    names = ["chunk", "k", "shard", "main", "learned", "n_distinct"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _counts(answers: pa.Table, k: int, name: str, chunk: Chunk) -> np.ndarray:
    """The counts of a chunk's distinct n-grams of one order."""
    own = answers.filter(pc.equal(answers.column("k"), k)).sort_by("shard")
    parts = [unpack(x, np.int64) for x in own.column(name).to_pylist()]
    counts = np.concatenate(parts)
    if len(counts) != len(chunk.keys[k]):
        raise ValueError("a chunk's answers are not complete")
    return counts


class Estimates:
    """Maximum-likelihood estimates of a chunk's tokens by order, and their contexts' counts."""

    def __init__(self, chunk: Chunk, answers: pa.Table, name: str, n_docs: int, n_tokens: int):
        order = len(chunk.keys)
        self.counts = [_counts(answers, k, name, chunk)[chunk.places[k]] for k in range(order)]
        self.by_order = [self.counts[0] / max(1, n_tokens)]
        context = np.full(len(self.counts[0]), n_tokens)
        for k in range(1, order):
            context = np.empty(len(self.counts[0]), np.int64)
            context[1:] = self.counts[k - 1][:-1]
            context[chunk.first] = n_docs  # each document begins in the same context
            self.by_order.append(self.counts[k] / np.maximum(1, context))
        self.bucket = np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def learn_weights(cells: np.ndarray, order: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket, by expectation-maximisation on summed-up held-out tokens.

    ``cells`` holds rows of bucket, grained estimates by order, and count. One
    token of each component is added to every bucket, so no weight is 0.
    """
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    if not len(cells):
        return weights
    bucket, grained, n = cells[:, 0], cells[:, 1 : order + 1], cells[:, -1].astype(float)
    p = np.where(grained == _FLOOR, 0.0, np.exp2(-grained / GRAIN))
    p = np.column_stack((p, np.full(len(p), uniform)))
    for _ in range(rounds):
        mixed = p * weights[bucket]
        share = mixed / mixed.sum(axis=1, keepdims=True) * n[:, None]
        total = np.ones((BUCKETS, order + 1))
        np.add.at(total, bucket, share)
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def score_documents(
    docs: DataFrame, *, order: int = 2, folds: int = 5, unseen_fold: int = 1,
    weights_fold: int = 4, chunk_tokens: int = 1 << 20, shard_entries: int = 2_000_000,
) -> DataFrame:
    """Scores of all whole texts of ``docs`` ``(doc_id, text)``.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.
    Documents in ``unseen_fold`` (crc32 of the id as text, modulo ``folds``)
    are held out; all others are counted, those in ``weights_fold`` also serve
    to learn the weights, from counts without them. A null id is in no fold and
    is counted. A null or empty text is one end token. ``base_score`` is the
    log10 probability by add-half unigrams, ``score`` by the mixture. Repeated
    rows are documents of their own. Without training documents every token is
    unknown. An empty table gives an empty result. Other columns are not read.

    Counts grow with the corpus and stay in the shards; the driver holds the
    totals and at most one row for each bucket and pair of grained estimates.
    """
    spark = docs.sparkSession
    number = fold(F.col("doc_id"), folds)
    part = F.when(number == unseen_fold, UNSEEN).when(number == weights_fold, WEIGHTS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       part.otherwise(MAIN).alias("part"), "text")
    chunks = materialize(chunk_documents(rows, chunk_tokens), "chunks")
    totals = {
        r["part"]: (r["n"] or 0, r["docs"] or 0)
        for r in chunks.groupBy("part")
        .agg(F.sum("n").alias("n"), F.sum(F.size("doc_ids")).alias("docs"))
        .collect()
    }
    n_all = sum(n for n, _ in totals.values())
    n_main, d_main = totals.get(MAIN, (0, 0))
    n_learned = n_main + totals.get(WEIGHTS, (0, 0))[0]
    d_learned = d_main + totals.get(WEIGHTS, (0, 0))[1]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(2 * partitions, -(-order * n_all // shard_entries))
    answers = _requests(chunks, order, shards).groupBy("shard").applyInArrow(_answer, _ANSWER)
    answers = materialize(answers, "ngram-counts")
    n_words = answers.where("k = 0").agg(F.sum("n_distinct")).first()[0] or 0
    uniform = 1.0 / (n_words + 1)
    replies = answers.select("chunk", "k", "shard", "main", "learned")

    def held(left: pa.Table) -> tuple[dict, Chunk]:
        row = left.to_pylist()[0]
        return row, Chunk(row["sizes"], row["tokens"], row["words"], order)

    def grain(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([[]] * 2, pa.schema([("cell", pa.binary()), ("n", pa.int64())]))
        _, chunk = held(left)
        found = Estimates(chunk, right, "main", d_main, n_main)
        columns = [found.bucket.astype(np.uint8)]
        for p in found.by_order:
            with np.errstate(divide="ignore"):
                steps = np.rint(-GRAIN * np.log2(p))
            columns.append(np.where(p > 0, np.clip(steps, 0, _FLOOR - 1), _FLOOR).astype(np.uint8))
        cells, n = np.unique(np.column_stack(columns), axis=0, return_counts=True)
        return pa.table([pa.array([c.tobytes() for c in cells], pa.binary()),
                         pa.array(n, pa.int64())], ["cell", "n"])

    def paired(some: DataFrame):
        return some.groupBy("chunk").cogroup(replies.groupBy("chunk"))

    cells = paired(chunks.where(F.col("part") == WEIGHTS)).applyInArrow(grain, "cell binary, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.frombuffer(b"".join(cells.column("cell").to_pylist()), np.uint8)
    table = table.reshape(-1, order + 1).astype(np.int64)
    counts = cells.column("n").to_numpy()
    weights = learn_weights(np.column_stack((table, counts)), order, uniform)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, chunk = held(left)
        found = Estimates(chunk, right, "learned", d_learned, n_learned)
        own = weights[found.bucket]
        mixed = own[:, order] * uniform
        for k, p in enumerate(found.by_order):
            mixed += own[:, k] * p
        known = found.counts[0]
        base = np.log10((known + 0.5) / (n_learned + 0.5 * (n_words + 1)))
        total = lambda x: np.add.reduceat(x, chunk.first)
        n = len(chunk.sizes)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array([row["part"] == UNSEEN] * n, pa.bool_()),
                "n_tokens": pa.array(chunk.sizes.astype(np.int64)),
                "n_known": pa.array(total((known > 0).astype(np.int64))),
                "train_tokens": pa.array([n_learned] * n, pa.int64()),
                "base_score": pa.array(total(base)),
                "score": pa.array(total(np.log10(mixed))),
            }
        )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return paired(chunks).applyInArrow(score, schema)
