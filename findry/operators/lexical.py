"""Inverted term index and BM25 search as a join on postings.

The index has one row per term and block of documents: the term's postings
there. It is stored by a hash of the term, so a lookup reads the files of its
terms only, and a common term is spread over as many rows as there are blocks.

A search joins the terms of its queries with those lists and groups what meets
by block of queries and block of documents, where the products add up. Where
there are many blocks of documents, a first pass over each query's best block
gives a score that the k best must reach; blocks whose highest possible score
is below it are not joined again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findry.functions.text import Tokenizer, let, simple_tokens
from findry.operators.blockwise import top_k
from findry.session import materialize, scratch_path

# Default BM25 parameters.
K1 = 0.9
B = 0.4

# hash parts of the stored postings; a lookup of one term reads one of them
PARTS = 16
# the part of the rows that hold a block's documents and their lengths
_DOCS = -1
# places of a block of documents or queries; a task adds up one block of either.
# lists travel once for each block of queries, queries once for each block of documents
_DOC_BITS, _QUERY_BITS = 15, 17
# the arrays of a list, side by side; rows of lists in an Arrow batch
_LISTS = ("places", "lengths", "counts")
_ROWS = 20_000
# tokens of a block that a task counts at once
_TOKENS = 8_000_000
# scores held at once by one task, and places of one group when looking for the best
_CELLS = 1 << 21
_GROUP = 64
# lists of a block that are held with all its places; lists so short are added up together
_HEAVY = 48
_SHORT = 64
# shuffle partitions for each usual one, and tasks for each core, that add up pairs of blocks
_SPREAD, _WAVES = 8, 3
# blocks of documents up to which all of them are joined at once
DIRECT_BLOCKS = 64
# terms of queries times blocks up to which a first pass is worth its table of bounds
_BOUNDS = 50_000_000
_SCORE_SCALE = 1e6  # scores are ranked after rounding to six decimals
_MARGIN = 1e-5


def run_ends(s: Column) -> Column:
    """One-based places where a run of equal elements ends, in a sorted array."""
    return F.filter(
        F.transform(s, lambda _, i: i + 1), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i))
    )


def term_counts(tokens: Column) -> Column:
    """``struct(dl, terms array<struct(term, tf)>)`` of a token array.

    Sorting the tokens puts equal ones side by side; the places where a run
    ends then give each distinct term and its count in one pass.
    """

    def runs(s: Column, e: Column) -> Column:
        return F.transform(
            e,
            lambda end, j: F.struct(
                F.get(s, end - 1).alias("term"),
                (end - F.coalesce(F.get(e, j - 1), F.lit(0))).alias("tf"),
            ),
        )

    return let(
        F.sort_array(tokens),
        lambda s: F.struct(
            F.size(s).alias("dl"), let(run_ends(s), lambda e: runs(s, e)).alias("terms")
        ),
    )


@dataclass(frozen=True)
class TermIndex:
    """Postings by term and block, document frequencies and collection totals."""

    docs: DataFrame  # doc, pid, dl
    lists: DataFrame  # part, term, block, and by posting: places, lengths, counts
    vocabulary: DataFrame  # term, df
    n_docs: int
    avg_dl: float
    parts: int

    def postings(self) -> DataFrame:
        """The long form ``(term, pid, dl, tf)``."""
        return self._long(self.lists)

    def lookup(self, terms: list[str]) -> DataFrame:
        """The postings of a few terms; only the files of their parts are read."""
        spark = self.lists.sparkSession
        asked = spark.createDataFrame([(t,) for t in terms], "term string")
        asked = asked.select(_part_of(F.col("term"), self.parts).alias("part")).distinct()
        parts = [r["part"] for r in asked.collect()]
        among = F.col("part").isin(parts) & F.col("term").isin(list(terms))
        return self._long(self.lists.where(among))

    def _long(self, lists: DataFrame) -> DataFrame:
        doc = F.shiftleft("block", _DOC_BITS) + F.col("place")
        entry = F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(_LISTS, ("place", "dl", "tf"))))
        each = lists.select("term", "block", F.inline(entry))
        each = each.select("term", doc.alias("doc"), "dl", "tf")
        return each.join(self.docs.select("doc", "pid"), "doc").select("term", "pid", "dl", "tf")


def _part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _inverted(bits: int):
    """Turns a task's documents into lists by term, block after block.

    Documents are ``(doc, pid, tokens)`` or, counted before, ``(doc, dl, terms)``.
    Where ids are given, a row without a term holds those of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            blocks = batch.column("doc").to_numpy() >> bits
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(blocks)]):
                if held and (blocks[start] != held.block or held.tokens > _TOKENS):
                    yield from held.rows()
                    held = None
                held = held or _Counted(int(blocks[start]), bits)
                held.add(batch.slice(start, end - start))
        if held:
            yield from held.rows()

    return run


class _Counted:
    """The words of one block's documents so far, and their counts by document."""

    def __init__(self, block: int, bits: int) -> None:
        self.block, self.bits, self.tokens = block, bits, 0
        self.words, self.parts, self.docs, self.known = [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        place = (batch.column("doc").to_numpy() & ((1 << self.bits) - 1)).astype(np.int32)
        ready = "terms" in batch.schema.names
        lists = batch.column("terms" if ready else "tokens")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if ready:
            word, tf = lists.flatten().flatten()
            dl, row = batch.column("dl").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            word, tf = word.dictionary_encode(null_encoding="encode"), tf.to_numpy()
            code = word.indices.to_numpy()
        else:
            some = sizes > 0  # a text without tokens does not count
            self.docs.append((batch.column("pid").filter(pa.array(some)), place[some], sizes[some]))
            word, dl = lists.flatten().dictionary_encode(null_encoding="encode"), sizes
            cells = np.repeat(np.arange(len(sizes)) * max(1, len(word.dictionary)), sizes)
            cells += word.indices.to_numpy()
            cells.sort()
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            row, code = np.divmod(cells[first], max(1, len(word.dictionary)))
            tf = np.diff(first, append=len(cells))
        columns = (code + self.known, place[row], dl[row], tf)
        self.parts.append([c.astype(np.int32) for c in columns])
        self.words.append(word.dictionary)
        self.known += len(word.dictionary)
        self.tokens += len(code)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each term; first the one of the documents."""
        words = pa.concat_arrays(self.words).dictionary_encode(null_encoding="encode")
        code, *columns = (np.concatenate(c) for c in zip(*self.parts))
        code = words.indices.to_numpy()[code]
        lists = _list_rows(words.dictionary, code, columns, self.block)
        if not self.docs:
            yield from lists
            return
        pids, place, size = zip(*self.docs)
        pids, names = pa.concat_arrays(pids), ["term", "block", *_LISTS, "pids"]
        whole = pa.array([0, len(pids)], pa.int32())
        ints = [pa.array(np.concatenate(c).astype(np.int32)) for c in (place, size)]
        held = [pa.ListArray.from_arrays(whole, c) for c in (*ints, pids)]
        none = pa.nulls(1, held[0].type)
        block = pa.array([self.block], pa.int64())
        term = pa.nulls(1, words.dictionary.type)
        yield pa.RecordBatch.from_arrays([term, block, *held[:2], none, held[2]], names)
        for batch in lists:
            none = pa.nulls(batch.num_rows, held[2].type)
            yield pa.RecordBatch.from_arrays([*batch.columns, none], names)


def _list_rows(
    words: pa.Array, code: np.ndarray, columns: tuple[np.ndarray, ...], block: int
) -> Iterator[pa.RecordBatch]:
    """Postings with the codes of their words, put side by side by word."""
    order = np.argsort(code, kind="stable")  # documents of a term stay in order
    columns = [np.ascontiguousarray(c[order], dtype=np.int32) for c in columns]
    ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words)))])
    for at in range(0, len(words), _ROWS):
        cut = ends[at : at + _ROWS + 1]
        offsets = pa.array(cut - cut[0], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[cut[0] : cut[-1]])) for c in columns]
        n = len(cut) - 1
        yield pa.RecordBatch.from_arrays(
            [words.slice(at, n), pa.array(np.full(n, block), pa.int64()), *lists],
            ["term", "block", *_LISTS],
        )


def build_index(
    corpus: DataFrame,
    path: str | None = None,
    tokenizer: Tokenizer = simple_tokens,
    parts: int = PARTS,
) -> TermIndex:
    """Index ``corpus(pid, text)`` and write it to ``path`` (or scratch space).

    Documents without tokens are left out, also of the totals. Texts are cut
    into tokens where they lie and numbered in blocks of up to 32,768. A block
    lies in one file, so its task counts the tokens and puts the postings of a
    term together: nothing is shuffled, and no text or token is stored. A block
    of many tokens has several lists of a term.
    """
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "terms")
    kind = corpus.schema["pid"].dataType.simpleString()
    # tasks of about a block each, unless that leaves cores idle
    blocks = 1 + corpus.count() // int(0.8 * (1 << _DOC_BITS))
    corpus = corpus.coalesce(max(blocks, spark.sparkContext.defaultParallelism))
    tokens = corpus.select(
        F.monotonically_increasing_id().alias("doc"), "pid", tokenizer(F.col("text")).alias("tokens")
    )
    made = tokens.mapInArrow(
        _inverted(_DOC_BITS),
        "term string, block long, places array<int>, lengths array<int>, counts array<int>, "
        f"pids array<{kind}>",
    )
    made = made.withColumn("part", F.when(F.col("pids").isNotNull(), _DOCS).otherwise(_part_of(F.col("term"), parts)))
    made = made.sortWithinPartitions("part", "term")
    made.write.partitionBy("part").parquet(os.path.join(path, f"postings-{parts}"))
    stored = spark.read.schema(made.schema).parquet(os.path.join(path, f"postings-{parts}"))
    each = F.arrays_zip(F.col("places").alias("place"), F.col("lengths").alias("dl"), F.col("pids").alias("pid"))
    docs = stored.where(F.col("part") == _DOCS).select("block", F.inline(each))
    docs = docs.select((F.shiftleft("block", _DOC_BITS) + F.col("place")).alias("doc"), "pid", "dl")
    docs.write.parquet(os.path.join(path, "docs"))
    lists = stored.where(F.col("part") != _DOCS)
    vocabulary = lists.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    vocabulary.write.parquet(os.path.join(path, "vocabulary"))
    return load_index(spark, path, parts)


def load_index(spark: SparkSession, path: str, parts: int = PARTS) -> TermIndex:
    """Open an index written by :func:`build_index` with as many ``parts``."""
    docs = spark.read.parquet(os.path.join(path, "docs"))
    totals = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    lists = spark.read.parquet(os.path.join(path, f"postings-{parts}"))
    lists = lists.where(F.col("part") != _DOCS).select("part", "term", "block", *_LISTS)
    vocabulary = spark.read.parquet(os.path.join(path, "vocabulary"))
    return TermIndex(docs, lists, vocabulary, totals["n"], totals["avg"] or 0.0, parts)


def query_weights(
    queries: DataFrame, index: TermIndex, tokenizer: Tokenizer = simple_tokens
) -> DataFrame:
    """``(qid, term, tf, idf)``: the weight of a term is its count in the query x idf.

    Terms the collection does not hold drop out, and so does a query with
    none left.
    """
    counted = queries.select(
        "qid", F.inline(term_counts(tokenizer(F.col("text")))["terms"])
    )
    idf = F.log1p((F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = counted.join(index.vocabulary, "term")
    return weighted.select("qid", "term", "tf", idf.alias("idf"))


@dataclass(frozen=True)
class _Ranking:
    """What a search keeps of each block, and the saturation of a count."""

    k: int
    k1: float
    b: float
    avg_dl: float
    query_blocks: tuple[int, ...] = ()
    turns: int = 1

    def damped(self, dl):
        return self.k1 * (1 - self.b + self.b * dl / (self.avg_dl or 1.0))

    def saturated(self, tf, dl):
        return tf / (tf + self.damped(dl))


def _k_best(line: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """Of each line the ``k`` highest rounded scores, and ties."""
    score = np.rint(score * _SCORE_SCALE)
    order = np.lexsort((-score, line))
    order = order[score[order] >= 1]
    line, place, score = line[order], place[order], score[order]
    first = np.flatnonzero(np.diff(line, prepend=-1))
    sizes = np.diff(first, append=len(line))
    kth = score[first + np.minimum(sizes, k) - 1]
    keep = score >= np.repeat(kth, sizes)
    return line[keep], place[keep], score[keep] / _SCORE_SCALE


class _Block:
    """The lists of a block of documents, its longest documents first."""

    def __init__(self, how: _Ranking, places, counts, sizes, docs, lengths) -> None:
        self.width = width = max(how.k, int(docs.max()) + 1)
        dl = np.zeros(width, np.int64)
        dl[docs] = lengths
        self.doc = np.argsort(-dl, kind="stable")
        seat = np.empty(width, np.intp)
        seat[self.doc] = np.arange(width)
        damped = how.damped(dl[self.doc].astype(np.float64))
        self.size, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.place, self.give = np.empty(len(places), np.intp), np.empty(len(places))
        # places of a list in order: sums then go through a row from its beginning to its end
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + _CELLS // 4, "right")) - 1)
            own = slice(self.starts[at], self.starts[to])
            cell = np.repeat(np.arange(to - at) * width, sizes[at:to]) + seat[places[own]]
            order = np.argsort(cell)
            self.place[own], tf = cell[order] % width, counts[own][order]
            self.give[own] = tf / (tf + damped[self.place[own]])
            at = to
        # the longest lists are also held with all places, and the most they give beyond `long`
        common = np.argsort(-sizes, kind="stable")[: int(min(_HEAVY, (sizes > width // 24).sum()))]
        self.slot = np.full(len(sizes), -1)
        self.slot[common] = np.arange(len(common))
        self.products = np.zeros((len(common), width))
        for row, x in zip(self.products, common.tolist()):
            self.add(row, x, 1.0)
        self.long = min(width, max(width // 4, how.k * _GROUP))
        self.peaks = self.products[:, self.long :].max(axis=1, initial=0.0)

    def add(self, row: np.ndarray, x: int, weight: float) -> None:
        """Add a list's products to the places of a row."""
        own = slice(self.starts[x], self.starts[x + 1])
        np.add.at(row, self.place[own], weight * self.give[own])

    def at(self, rows: np.ndarray, weight: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The sums of some common lists at some places beyond the long documents."""
        sums = np.zeros(len(places))
        for row, w in zip(rows.tolist(), weight.tolist()):
            sums += w * self.products[row, self.long :].take(places)
        return sums


class _Rows:
    """The lists of one block and who asks for them, as they come in."""

    def __init__(self) -> None:
        self.lists, self.docs = [], []

    def add(self, batch: pa.RecordBatch) -> None:
        named = batch.column("asking").is_valid()
        for keep, held in ((named, self.lists), (pc.invert(named), self.docs)):
            rows = batch.filter(keep)
            columns = ("places", "counts", "asking", "times")[: 4 if held is self.lists else 2]
            got = [rows.column(c).flatten().to_numpy().copy() for c in columns]
            got += [pc.list_value_length(rows.column(c)).to_numpy() for c in columns[::2]]
            if rows.num_rows:
                held.append((*got, rows.column("idf").to_numpy(zero_copy_only=False)))

    def whole(self) -> list[np.ndarray] | None:
        if not self.lists or not self.docs:
            return None
        lists = [np.concatenate(c) for c in zip(*self.lists)]
        lists += [np.concatenate(c) for c in list(zip(*self.docs))[:2]]
        self.lists, self.docs = [], []
        return lists


def _summed(how: _Ranking, doc_bits: int, query_bits: int):
    """Adds up the products of a block of queries, one block of documents after the other.

    Of all these documents the ``k`` best of a query are kept, and ties. The
    ``k``-th score so far is what a later document must reach.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_block = int(key[1].as_py())
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        floor = np.zeros(1 << query_bits)

        def merge(block: int, rows: _Rows) -> None:
            held = rows.whole()
            if held is None:
                return
            found = [best, *_of_block(how, held, floor)]
            q, d, score = (np.concatenate(c) for c in zip(*found))
            d[len(best[1]) :] += block << doc_bits
            best[:] = _k_best(q, d, score, how.k)
            # of the k best and ties of a query, the last one is the k-th
            first = np.flatnonzero(np.diff(best[0], prepend=-1))
            last = np.append(first[1:], len(best[0])) - 1
            enough = last - first + 1 >= how.k
            floor[best[0][first[enough]]] = best[2][last[enough]]

        block, rows = None, _Rows()
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(blocks)]):
                if block is not None and blocks[start] != block:
                    if blocks[start] < block:
                        raise ValueError("the rows of a block must lie side by side")
                    merge(block, rows)
                block = int(blocks[start])
                rows.add(batch.slice(start, end - start))
        if block is not None:
            merge(block, rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array((query_block << query_bits) + best[0]), pa.array(best[1]), pa.array(best[2])],
            ["q", "doc", "score"],
        )

    return run


def _of_block(how: _Ranking, held: list[np.ndarray], floor: np.ndarray) -> Iterator[tuple]:
    """Query, place and score of what a block holds among the best."""
    places, counts, who, times, sizes, asked, idf, docs, lengths = held
    at = _Block(how, places, counts, sizes, docs, lengths)
    # a query's lists side by side, queries of much work together
    of = np.repeat(np.arange(len(asked), dtype=np.int32), asked)
    asking = np.flatnonzero(np.bincount(who))
    work = np.bincount(who, sizes[of])[asking]
    turn = np.argsort(work, kind="stable")
    asking = asking[turn]
    seat = np.empty(asking.max() + 1, np.int32)
    seat[asking] = np.arange(len(asking))
    line = seat[who]
    order = np.argsort(line, kind="stable")
    # a query that comes twice asks once
    line, of = line[order], of[order]
    once = np.append(True, (np.diff(line) != 0) | (np.diff(of) != 0))
    order, line, of = order[once], line[once], of[once]
    weight = times[order] * idf[of]
    ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(asking)))])
    total = np.concatenate([[0], np.cumsum(work[turn])])
    step, first = max(1, _CELLS // at.width), 0
    # fresh memory for each turn would cost more than the sums
    room = np.empty((min(step, len(asking)), at.width)), np.empty((min(step, len(asking)), at.long))
    while first < len(asking):
        # few products of many queries are sorted; many are added up in rows of places
        to = int(np.searchsorted(total, total[first] + _CELLS // 4, "right")) - 1
        if to - first > step:
            lots, by = of[ends[first] : ends[to]], weight[ends[first] : ends[to]]
            lines = np.repeat(np.arange(to - first), np.diff(ends[first : to + 1]))
            cell, product = _spelled(at, lines, lots, by)
            cells, same = np.unique(cell, return_inverse=True)
            sums = np.bincount(same, product)
            q, d = np.divmod(cells, at.width)
            q, d, sums = _k_best(q, d, sums, how.k)
        else:
            to = min(len(asking), first + step)
            part = slice(ends[first], ends[to])
            cut = ends[first : to + 1] - ends[first]
            q, d, sums = _best_rows(at, cut, of[part], weight[part], how.k, room, floor[asking[first:to]])
        yield asking[first + q], at.doc[d], sums
        first = to


def _spelled(at: _Block, lines: np.ndarray, lots: np.ndarray, by: np.ndarray) -> tuple:
    """Cell and product of each posting of some lists, a line for each query."""
    size = at.size[lots]
    flat = np.repeat(at.starts[lots] - (np.cumsum(size) - size), size)
    flat += np.arange(len(flat))
    cell = np.repeat(lines * at.width, size)
    cell += at.place[flat]
    return cell, np.repeat(by, size) * at.give[flat]


def _best_rows(
    at: _Block, ends: np.ndarray, of: np.ndarray, weight: np.ndarray, k: int, room: tuple, floor: np.ndarray
) -> tuple:
    """The ``k`` best and ties of queries whose products are added up in rows of places.

    The most common lists are multiplied for the long documents only. A place
    beyond them is looked at with all lists if what the others give it and the
    highest that the common ones can reach a score that ``k`` places have.
    """
    n, long, slack, least = len(ends) - 1, at.long, 2 / _SCORE_SCALE, 0.4 / _SCORE_SCALE
    slot = at.slot[of]
    lines = np.repeat(np.arange(n), np.diff(ends))
    scores = room[0][:n]
    scores.fill(0.0)
    short = (slot < 0) & (at.size[of] < _SHORT)
    np.add.at(scores.reshape(-1), *_spelled(at, lines[short], of[short], weight[short]))
    rest = np.flatnonzero((slot < 0) & ~short)
    for i, x, w in zip(lines[rest].tolist(), of[rest].tolist(), weight[rest].tolist()):
        at.add(scores[i], x, w)
    wanted, common = np.zeros((n, len(at.products))), slot >= 0
    wanted[lines[common], slot[common]] = weight[common]
    if common.any():
        scores[:, :long] += np.matmul(wanted, at.products[:, :long], out=room[1][:n])
    floor, groups = np.maximum(floor - slack, least), long // _GROUP
    if groups > k:
        # the k-th highest of the groups' best is a score that k places reach
        peaks = scores[:, : groups * _GROUP].reshape(n, groups, _GROUP).max(axis=2)
        floor = np.maximum(floor, np.partition(peaks, groups - k, axis=1)[:, groups - k] - slack)
    promised = wanted @ at.peaks
    found = []
    for i, (line, bar, more) in enumerate(zip(scores, floor.tolist(), promised.tolist())):
        d = np.flatnonzero(line[:long] >= bar)
        s = line[d]
        if long < at.width:
            if len(s) >= k:
                bar = max(bar, float(np.partition(s, len(s) - k)[len(s) - k]) - slack)
            rows, beyond = np.flatnonzero(wanted[i]), line[long:]
            far = np.flatnonzero(beyond >= max(bar - more, 0.0) - slack)
            if 2 * len(far) > len(beyond):
                beyond += wanted[i, rows] @ at.products[rows, long:]
                far = np.flatnonzero(beyond >= bar)
                t = beyond[far]
            else:
                t = beyond[far] + at.at(rows, wanted[i, rows], far)
                keep = t >= bar
                far, t = far[keep], t[keep]
            d, s = np.append(d, far + long), np.append(s, t)
        found.append((np.full(len(d), i), d, s))
    return _k_best(*(np.concatenate(c) for c in zip(*found)), k)


def _products(lists: DataFrame, asked: DataFrame, keys: list[str], how: _Ranking) -> DataFrame:
    """``(q, doc, score)``: of each task's blocks of documents, the ``k`` best of a query, and ties.

    ``lists`` holds ``(term, block, places, counts)`` and, without a term, the
    lengths of a block's documents; ``asked`` holds ``(q, term, tf, idf)`` and, if
    ``keys`` has it, the ``block`` that is asked. A row of the join is one list
    and those who ask for it; neither outgrows a block.
    """
    asker = F.struct(
        F.col("q").bitwiseAND(F.lit((1 << _QUERY_BITS) - 1)).cast("int").alias("place"),
        F.col("tf").cast("int").alias("times"),
    )
    packed = asked.groupBy(*keys, F.shiftright("q", _QUERY_BITS).alias("query_block")).agg(
        F.sort_array(F.collect_list(asker)).alias("askers"), F.first("idf").alias("idf")
    )
    met = lists.where(F.col("term").isNotNull()).join(packed, keys).select(
        "block",
        "query_block",
        "places",
        "counts",
        F.col("askers.place").alias("asking"),
        F.col("askers.times").alias("times"),
        "idf",
    )
    docs = lists.where(F.col("term").isNull()).select(
        "block",
        F.explode(F.array(*map(F.lit, how.query_blocks)).cast("array<long>")).alias("query_block"),
        "places",
        "counts",
    )
    met = met.unionByName(docs, allowMissingColumns=True)
    # blocks of documents that one task goes through one after the other
    number = F.shiftright("block", 33 - _DOC_BITS) + F.col("block").bitwiseAND(F.lit((1 << (33 - _DOC_BITS)) - 1))
    met = met.withColumn("turn", F.pmod(number, F.lit(how.turns)))
    # few rows hold much work, so adaptive execution must not merge their partitions
    least = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(_SPREAD * least, "turn", "query_block")
    met = met.sortWithinPartitions("turn", "query_block", "block")
    return met.groupBy("turn", "query_block").applyInArrow(
        _summed(how, _DOC_BITS, _QUERY_BITS), "q long, doc long, score double"
    )


def _two_passes(lists: DataFrame, terms: DataFrame, how: _Ranking) -> DataFrame:
    """As :func:`_products`, but only of blocks that can hold one of a query's ``k`` best.

    A block gives a query no more than its terms' weights times their highest
    saturated counts there. The block that promises most is joined first; the
    k-th score found in it rules out the blocks that promise less.
    """
    k = how.k
    each = F.zip_with("counts", "lengths", how.saturated)
    peaks = lists.select("term", "block", F.array_max(each).alias("peak"))
    most = F.sum(F.col("tf") * F.col("idf") * F.col("peak")).alias("most")
    promised = terms.join(peaks, "term").groupBy("q", "block").agg(most)
    promised = materialize(promised, "promised")
    by = W.partitionBy("q").orderBy(F.desc("most"), "block")
    first = promised.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") == 1)
    asked = terms.join(first.select("q", "block"), "q")
    found = materialize(_products(lists, asked, ["term", "block"], how), "first-scores")
    by = W.partitionBy("q").orderBy(F.desc("score"), "doc")
    floors = found.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= k)
    floors = floors.where(F.col("_rank") == k).select("q", F.col("score").alias("floor"))
    left = promised.join(floors, "q", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - _MARGIN))
    left = left.join(first.select("q", "block"), ["q", "block"], "left_anti")
    asked = terms.join(left.select("q", "block"), "q")
    return found.unionByName(_products(lists, asked, ["term", "block"], how))


def bm25_search(
    queries: DataFrame,
    index: TermIndex,
    k: int = 10,
    k1: float = K1,
    b: float = B,
    tokenizer: Tokenizer = simple_tokens,
    direct_blocks: int = DIRECT_BLOCKS,
) -> DataFrame:
    """BM25 top-k documents of each query ``(qid, text)``: ``(qid, pid, score, rank)``.

    A document without a term of the query is no hit. Up to ``direct_blocks``
    blocks of documents are joined at once, more of them in two passes, unless
    the bounds of that many queries would outgrow the lists; both give the same
    scores.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asking = materialize(queries.select("qid").distinct(), "query-ids")
    # a partition for each block of queries, with room for partitions of uneven size
    room = max(1, int(0.97 * (1 << _QUERY_BITS)))
    names = asking.repartition(1 + asking.count() // room, "qid")
    names = names.withColumn("q", F.monotonically_increasing_id())
    names = materialize(names, "query-numbers")
    query_blocks = names.select(F.shiftright("q", _QUERY_BITS).alias("b")).distinct().collect()
    same = F.col("qid").eqNullSafe(F.col("_qid"))
    numbers = names.select("q", F.col("qid").alias("_qid"))
    terms = query_weights(queries, index, tokenizer).join(numbers, same)
    terms = materialize(terms.select("q", "term", "tf", "idf"), "query-terms")

    query_blocks = tuple(sorted(r["b"] for r in query_blocks))
    blocks = index.docs.select(F.shiftright("doc", _DOC_BITS)).distinct().count()
    # a few tasks for each core; a task that goes through many blocks returns fewer hits
    cores = queries.sparkSession.sparkContext.defaultParallelism
    turns = max(1, min(blocks, -(-_WAVES * cores // max(1, len(query_blocks)))))
    how = _Ranking(k, k1, b, index.avg_dl, query_blocks, turns)
    entry = F.struct(
        F.col("doc").bitwiseAND(F.lit((1 << _DOC_BITS) - 1)).cast("int").alias("place"), "dl"
    )
    lengths = index.docs.groupBy(F.shiftright("doc", _DOC_BITS).alias("block"))
    lengths = lengths.agg(F.sort_array(F.collect_list(entry)).alias("e"))
    lengths = lengths.select(
        F.lit(None).cast("string").alias("term"),
        "block",
        F.col("e.place").alias("places"),
        F.col("e.dl").alias("counts"),
    )
    lists = index.lists.select("term", "block", *_LISTS)
    lists = lists.unionByName(lengths, allowMissingColumns=True)
    if blocks <= direct_blocks or (direct_blocks and terms.count() * blocks > _BOUNDS):
        found = _products(lists, terms, ["term"], how)
    else:
        found = _two_passes(lists, terms, how)
    # ties at the k-th place stay until the ids are known
    tied = W.partitionBy("q").orderBy(F.desc("score"))
    best = found.withColumn("_rank", F.rank().over(tied)).where(F.col("_rank") <= k)
    hits = best.join(index.docs.select("doc", "pid"), "doc").join(names, "q")
    return top_k(hits.select("qid", "pid", "score"), k).select("qid", "pid", "score", "rank")
