"""Column expressions, folds and word hashes shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key falls into no fold (null)."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the columns, 128 bits together."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x9E3779B9), *cols)


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``max_bytes`` each, with the place of the first; null is empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= max_bytes:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, then freed memory goes back to the machine.

    Python workers live on for later stages, which may need it elsewhere.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words; remembers up to ``room`` words between calls."""

    def __init__(self, room: int = 100_000) -> None:
        self.room, self.known = room, {}

    def __call__(self, words: Iterable[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.room:
            known.clear()
        out = []
        for word in words:
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """The words of a text with A-Z in lower case, as bytes."""
    return text.encode("utf-8", "replace").lower().split()
