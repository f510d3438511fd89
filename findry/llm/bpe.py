"""Byte-level BPE encoding and decoding with a given vocabulary.

Words are merged in padded matrices, one matrix per length bucket: each round
every row merges its leftmost pair of lowest rank and gives up one column. The
rank of a pair comes from a hash table in numpy arrays.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findry.llm.common import text_slices, tidy

NONE = np.int32(np.iinfo(np.int32).max)

#: Wider rows are merged one at a time with a heap, in n log n steps.
WIDEST = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _ascii_split(pattern: str) -> Callable[[str], list[str]]:
    """The same matches on ASCII texts, where the letters, digits and spaces are few."""
    few = pattern.replace(r"\s\p{L}\p{N}]", r"\sA-Za-z0-9]")
    few = few.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return regex.compile(pattern).findall if r"\p" in few else re.compile(few, re.ASCII).findall


class PairTable:
    """``(left id, right id) -> merged id`` by open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[(left << 32) | right] = rank
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values = keys[~put], values[~put]
            slots = (slots[~put] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where two do not merge; negative ids are padding."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        rest = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slots(keys[rest])
        while len(rest):
            there = self.keys[slots]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            rest, slots = rest[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Bpe:
    """Encoder and decoder; built once in each Python worker that needs it."""

    _built: dict[tuple, Bpe] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 100_000) -> None:
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.room = ranks, room
        self.split_any = regex.compile(pattern).findall
        self.split_ascii = _ascii_split(pattern)
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    @classmethod
    def shared(cls, key: tuple, ranks: Callable[[], dict[bytes, int]], pattern: str) -> Bpe:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(ranks(), pattern)
        return cls._built[key]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > WIDEST:
                out[i] = self._merge_wide(piece)
            elif piece:
                buckets.setdefault(max(3, (len(piece) - 1).bit_length()), []).append(i)
        for bits, members in buckets.items():
            step = max(1, (1 << 17) >> bits)
            for at in range(0, len(members), step):
                self._merge_rows([(i, pieces[i]) for i in members[at : at + step]], out)
        return out

    def _merge_rows(self, rows: list[tuple[int, bytes]], out: list[bytes]) -> None:
        who = np.array([i for i, _ in rows])
        sizes = np.array([len(p) for _, p in rows])
        width = int(sizes.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.bytes[
            np.frombuffer(b"".join(p for _, p in rows), np.uint8)
        ]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while True:
            n = len(who)
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(n, np.int64)
            lowest = ranks[np.arange(n), at] if ranks.shape[1] else np.full(n, NONE)
            done = lowest == NONE
            if done.any():
                full = ids[done]
                real = full >= 0
                ends = (4 * real.sum(axis=1).cumsum()).tolist()
                flat, begin = full[real].astype("<u4").tobytes(), 0
                for i, end in zip(who[done].tolist(), ends, strict=True):
                    out[i] = flat[begin:end]
                    begin = end
                live = ~done
                who, ids, ranks = who[live], ids[live], ranks[live]
                at, lowest = at[live], lowest[live]
                n = len(who)
                if not n:
                    return
            each = np.arange(n)
            ids[each, at] = lowest
            stay = np.ones(ids.shape, bool)
            stay[each, at + 1] = False
            ids = ids[stay].reshape(n, -1)
            stay = np.ones(ranks.shape, bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(n, -1)
            if ranks.shape[1]:
                # the pairs that now start one place before, and at, the merged id
                for place, ok in ((at - 1, at > 0), (at, at < ranks.shape[1])):
                    r, p = each[ok], place[ok]
                    ranks[r, p] = self.pairs(ids[r, p], ids[r, p + 1])

    def _merge_wide(self, piece: bytes) -> bytes:
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                left, right = ids[i], ids[j]
                token = self.ranks.get(self.tokens[left] + self.tokens[right])
                if token is not None:
                    heapq.heappush(heap, (token, i, left, right))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        known = self.known
        parts = [
            self.split_ascii(text) if text.isascii() else self.split_any(text) for text in texts
        ]
        new = list({piece for part in parts for piece in part} - known.keys())
        if len(known) + len(new) > self.room:
            new = list(set(new).union(*parts))
            known.clear()
        known.update(zip(new, self.merge([x.encode("utf-8") for x in new]), strict=True))
        return [b"".join(map(known.__getitem__, part)) for part in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _with_binary(
    rows: DataFrame, source: str, new: str, ranks: dict[bytes, int], pattern: str, how: str
) -> DataFrame:
    own = rows.drop(new)
    out = T.StructType(list(own.schema.fields)).add(new, "binary")
    # the vocabulary's size is fixed by its file, whatever the size of the data
    vocabulary = rows.sparkSession.sparkContext.broadcast(ranks)
    key = (hash(frozenset(ranks.items())), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.shared(key, lambda: vocabulary.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            if how == "encode":
                runs = ((at, len(x), bpe.encode(x)) for at, x in text_slices(column))
            else:
                runs = (
                    (at, min(256, len(column) - at), [
                        bpe.decode(x.as_py() or b"") for x in column.slice(at, 256)
                    ])
                    for at in range(0, len(column), 256)
                )
            for at, n, made in runs:
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(made, pa.binary())], [*part.schema.names, new]
                )
        bpe.known.clear()  # the worker lives on, the tables with it

    return own.mapInArrow(tidy(run), out)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with ``ids``: the token ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately; no special tokens. Null
    and empty texts have no ids. A column already named like ``ids`` is
    replaced. Texts that no token can spell do not exist: every single byte is
    a token. A very long text is encoded as a whole, within its task; an empty
    table gives an empty result. Rows stay where they are; nothing is shuffled.
    """
    return _with_binary(docs, text, ids, ranks, pattern, "encode")


def decode(
    rows: DataFrame, ranks: dict[bytes, int], pattern: str, *, ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """``rows`` with ``decoded``: the bytes that the ids stand for.

    Null ids: no bytes. An empty table gives an empty result.
    """
    return _with_binary(rows, ids, decoded, ranks, pattern, "decode")


def n_tokens(ids: str = "ids"):
    """The number of ids in the binary column."""
    return (F.octet_length(ids) / 4).cast("long")
