"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points. Equal neighbours are
merged into one symbol of their number. Deterministic coin tossing then gives
each symbol a label from its lowest bit that differs from the symbol before;
repeated on the labels, six of them are left, and no two neighbours agree. A
symbol whose label is higher than both neighbours' begins a phrase, phrases are
named by a hash of what they hold, and the names are the symbols of the next
level. Where a phrase begins depends on a few symbols around it alone, so equal
substrings hold the same phrases, but for those near their ends, wherever in a
text they stand.

A fingerprint samples the phrases of two levels, those at which a text has some
dozens of phrases or more.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findry.llm.common import mix64, tidy

#: Phrases that a text must have at a level to be sampled there.
LEAST_PHRASES = 24
#: Sampled levels of a text, the highest ones.
KEPT_LEVELS = 2
#: Cells of a level's sample.
CELLS = 64
#: Code points parsed in one go; a longer text is parsed alone.
SLICE_CHARS = 500_000
#: Code points of one sorted part, on average, and sampled rows for each part.
PART_CHARS, SAMPLED = 128_000_000, 50

_EMPTY_CELL = 0xFFFF
_ONE = np.uint64(1)
_TOP = np.uint64(1 << 63)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _toss_table(bits: int) -> np.ndarray:
    """The label of ``b`` after ``a`` at place ``a << bits | b``; 0 if they are equal."""
    a, b = np.divmod(np.arange(1 << (2 * bits)), 1 << bits)
    differ = a ^ b
    low = np.bitwise_and(differ, -differ)
    place = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(np.int64), 0)
    return (2 * place + ((b & low) > 0)).astype(np.uint8)


_TABLES = [(bits, _toss_table(bits)) for bits in (7, 4, 3)]


class _Powers:
    """Powers of an odd factor and of its inverse, modulo 2 to the 64th."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            tables = []
            for base in (_FACTOR, _INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = tables
        return self.up, self.down


def _labels(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Six labels at most, no two neighbours of a text alike. ``starts``: where texts begin."""
    differ = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
    differ[starts] = ~np.uint64(0)  # as if the symbol before were the complement
    differ |= _TOP
    low = differ & (~differ + _ONE)
    place = (low.astype(np.float64).view(np.int64) >> 52) - 1023
    label = (2 * place + ((x & low) > 0)).astype(np.uint8)
    for bits, table in _TABLES:
        at = np.empty(len(label), np.int64)
        at[1:] = label[:-1]
        at[0] = 0
        at <<= bits
        at |= label
        tossed = table[at]
        tossed[starts] = label[starts] & 1
        label = tossed
    return label


def phrase_names(
    x: np.ndarray, starts: np.ndarray, powers: _Powers
) -> tuple[np.ndarray, np.ndarray]:
    """The next level of texts laid end to end: the names of their phrases, and where texts begin.

    ``x`` holds the symbols of all texts, none of them empty; ``starts`` the
    place of each text's first.
    """
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[starts] = True
    if not new.all():
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(x)).astype(np.uint64)
        starts = np.searchsorted(first, starts)
        x = x[first]
        many = times > 1
        x[many] = mix64((x[many] ^ (times[many] << np.uint64(40))) * np.uint64(_FACTOR))
    label = _labels(x, starts)
    begins = np.zeros(len(x), bool)
    if len(x) > 2:
        np.greater(label[1:-1], label[:-2], out=begins[1:-1])
        begins[1:-1] &= label[1:-1] > label[2:]
    begins[starts[1:] - 1] = False  # the last symbol of a text begins nothing
    begins[starts] = True
    first = np.flatnonzero(begins)
    up, down = powers(len(x))
    sums = np.add.reduceat(x * up[: len(x)], first) * down[first]
    sizes = np.diff(first, append=len(x)).astype(np.uint64)
    return mix64(sums ^ (sizes << np.uint64(56))), np.searchsorted(first, starts)


def _samples(names: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each text ``CELLS`` 16-bit values: the least hash of the names that fall into a cell."""
    h = mix64(names * np.uint64(0xD6E8FEB86659FD93) + _ONE)
    cell = of * CELLS + (h >> np.uint64(58)).astype(np.int64)
    out = np.full(n * CELLS, _EMPTY_CELL, np.int64)
    np.minimum.at(out, cell, ((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.int64) % _EMPTY_CELL)
    return out.reshape(n, CELLS)


def fingerprints(texts: list[str], powers: _Powers | None = None) -> list[str]:
    """The fingerprint of each text: ``level:sample`` of its levels, parted by spaces.

    A sample is ``CELLS`` 16-bit values in base 64. The empty text has the
    empty fingerprint. A text is parsed as a whole; the work and the memory
    are in proportion to its length.
    """
    powers = powers or _Powers()
    full = [i for i, text in enumerate(texts) if text]
    kept: list[list[str]] = [[] for _ in texts]
    if not full:
        return [""] * len(texts)
    sizes = np.array([len(texts[i]) for i in full])
    x = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    level = 0
    while level == 0 or (sizes >= LEAST_PHRASES).any():
        level += 1
        x, starts = phrase_names(x, starts, powers)
        sizes = np.diff(starts, append=len(x))
        mine = sizes >= (1 if level == 1 else LEAST_PHRASES)
        of = np.repeat(np.cumsum(mine) - 1, sizes)[np.repeat(mine, sizes)]
        samples = _samples(x[np.repeat(mine, sizes)], of, int(mine.sum())).astype("<u2")
        for sample, i in zip(samples, np.flatnonzero(mine), strict=True):
            own = kept[full[i]]
            own.append(f"{level}:{base64.b64encode(sample.tobytes()).decode()}")
            del own[:-KEPT_LEVELS]
    return [" ".join(reversed(own)) for own in kept]


def _levels(fingerprint: str) -> dict[int, np.ndarray]:
    parts = (part.split(":") for part in fingerprint.split())
    return {int(k): np.frombuffer(base64.b64decode(v), "<u2") for k, v in parts}


def likeness(a: str, b: str) -> float:
    """The share of phrases that two fingerprints have in common (Jaccard), from 0 to 1.

    The highest level that both hold decides; without one the texts differ too
    much in length to be alike. Equal fingerprints give 1, also empty ones.
    """
    if a == b:
        return 1.0
    x, y = _levels(a), _levels(b)
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    x, y = x[max(both)], y[max(both)]
    used = (x != _EMPTY_CELL) | (y != _EMPTY_CELL)
    return float((used & (x == y)).sum() / used.sum())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _parts(doc_id: np.ndarray, h: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted bounds are at or before each ``(doc_id, h)``."""
    ids, hashes = bounds
    first = np.searchsorted(ids, doc_id, "left")
    last = np.searchsorted(ids, doc_id, "right")
    out = first.copy()
    for i in np.flatnonzero(first < last):  # the id is a bound itself
        out[i] += np.searchsorted(hashes[first[i] : last[i]], h[i], "right")
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` ``(key, h, doc_id, text)`` in partitions that are sorted by ``(guest, key, h)``.

    A partition is a range of ``(key, h)``, all of about equal size. The first
    row of each also goes to the one before it, as its guest and last row, and
    the very first row to the last partition. Cuts come from a bounded sample;
    they decide where a row goes, and nothing else.
    """
    spark = rows.sparkSession
    n_chars = F.length("text").cast("long")
    total = rows.agg(F.count("*").alias("n"), F.sum(n_chars).alias("chars")).first()
    n, chars = total["n"], total["chars"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    share = min(1.0, SAMPLED * parts / max(n, 1))
    sampled = rows.select("key", "h", n_chars.alias("n")).sample(share, 7).toPandas()
    sampled = sampled.sort_values(["key", "h"])
    upto = (sampled["n"] + 1).cumsum().to_numpy()
    cuts = np.searchsorted(upto, np.arange(1, parts) * (upto[-1] / parts if len(upto) else 0))
    picked = sampled.iloc[np.unique(cuts[cuts < len(sampled)])][["key", "h"]].drop_duplicates()
    bounds = spark.sparkContext.broadcast((picked["key"].to_numpy(), picked["h"].to_numpy()))

    def place(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(_parts(keys.to_numpy(), hashes.to_numpy(), bounds.value))

    part_of = F.pandas_udf(place, "int")
    firsts = rows.select("key", "h").withColumn("part", part_of("key", "h"))
    firsts = firsts.groupBy("part").agg(F.min(F.struct("key", "h")).alias("first")).collect()
    firsts = sorted((r["part"], *r["first"]) for r in firsts)
    # one row for each part
    visits = [(key, h, firsts[k - 1][0]) for k, (_, key, h) in enumerate(firsts)]
    visits = spark.createDataFrame(visits, "key long, h long, visited int")
    both = rows.join(F.broadcast(visits), ["key", "h"], "left")
    own = F.struct(part_of("key", "h").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("visited").alias("part"), F.lit(True).alias("guest"))
    copies = F.when(F.col("visited").isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = both.select(F.inline(copies), "key", "h", "doc_id", "text")
    dealt = dealt.repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("guest", "key", "h").select("guest", "doc_id", "text")


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def _compared(
    docs: list[tuple[int | None, str]], powers: _Powers
) -> pa.RecordBatch:
    """The results of all but the last of a run of documents in order."""
    texts = [text for _, text in docs]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    prints = fingerprints(texts + changed, powers)
    own, others = prints[: len(texts)], prints[len(texts) :]
    columns = [
        pa.array([i for i, _ in docs[:-1]], pa.int64()),
        pa.array([len(text) for text in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(text.encode()).hexdigest() for text in changed], pa.string()),
        pa.array(own[:-1], pa.string()),
        pa.array(others, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, others)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one partition; its guest follows the last one and is not reported itself."""
    powers = _Powers()
    run: list[tuple[int | None, str]] = []
    chars, ended = 0, False
    for batch in batches:
        for guest, doc_id, text in zip(*batch.columns, strict=True):
            if ended:
                break  # rows that repeat the guest
            run.append((doc_id.as_py(), text.as_py()))
            chars += len(run[-1][1])
            ended = guest.as_py()
            if ended or (chars >= SLICE_CHARS and len(run) > 1):
                yield _compared(run, powers)
                run, chars = run[-1:], len(run[-1][1])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` ``(doc_id, text)``, of their edited texts, and how alike these are.

    The columns are those of the result's schema: a document's length in code
    points, the digest of its edited text (see :func:`edited`), both
    fingerprints, and the likeness of its fingerprint to that of the edited
    text and to that of the next document.

    The next document is the one with the next larger ``doc_id``, after the
    last the first; null is the smallest, and rows that share an id go by a
    hash of their text. A single document follows itself. A null text is
    empty. Other columns are not read. No rows, no result.

    The texts move once, into ranges of ids of about equal size; within a
    range they are streamed in order, so that a task holds a slice of them.
    """
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(-(1 << 63))).alias("key"),
        F.xxhash64(text).alias("h"),
        doc_id.alias("doc_id"),
        text.alias("text"),
    )
    return _dealt(rows).mapInArrow(tidy(_in_order), _RESULT)
