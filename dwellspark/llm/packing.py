"""Packing documents into training sequences by best-fit decreasing.

A document's ids (with an end id) are cut into full windows first; what remains is
shorter than a window.  Remainders are placed longest first, each into the open window
with the least remaining capacity that still holds it: a segment tree over capacities
knows which capacities have an open window.

Each task packs the documents of its own partition in pools of at most ``POOL_IDS`` ids,
so nothing is shuffled, hot sources do not matter and a lost task is simply run again.
A pool of five hundred windows leaves well under a percent of padding.

Null text counts as empty: its end id alone.  A text of any length is encoded whole, alone if it is
longer than a slice.  Repeated rows and ids are packed like others.  Columns other than id
and text take no part, whatever their names.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pretokens
from .shared import in_arrow

#: Ids that a task packs at once, but for one larger slice of texts.
POOL_IDS = 1 << 20
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 20
#: Pieces that a worker remembers; fewer than where nothing but encoding runs, since the pipeline's executors come here with full heaps.
MOST_KNOWN = 1 << 17


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)  # windows below each node
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def add(self, window: int, capacity: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._count(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (window, capacity) of the least capacity that is >= ``least``."""
        node, tree = least + self.leaves, self.open
        while not tree[node]:  # up to the first subtree to the right that has a window
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) per piece; windows are numbered from 0."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, used = OpenWindows(window), 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = windows.take(n) if n < window else None
        if found is None:
            found, used = (used, window), used + 1
        numbers[i], offsets[i] = found[0], window - found[1]
        windows.add(found[0], found[1] - n)
    return numbers, offsets


def cut(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) per piece: full windows, then the remainder."""
    pieces = -(-tokens // window)
    of = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
    return of, start, np.minimum(window, tokens[of] - start)


def pack(docs: DataFrame, tokenizer: str, end: int, window: int = 2048, doc_id: str = "doc_id", text: str = "text", pool_ids: int = POOL_IDS) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded_length
    and ids (little-endian unsigned 32-bit integers).

    padded_length: the sequence's length with padding, which is ``window`` unless its ids
    number a power of two, when none is added.
    """
    schema = T.StructType(
        [T.StructField(doc_id, docs.schema[doc_id].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset", "padded_length")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def packed(ids_of: list[pa.Array], offsets: list[np.ndarray], ids: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        tokens, flat = np.concatenate([np.diff(o) for o in offsets]), np.concatenate(ids).astype("<u4")
        of, start, length = cut(tokens, window)
        number, offset = best_fit(length, window)
        used = np.bincount(number, weights=length).astype(np.int64)
        padded = np.where(used & (used - 1), window, used)
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        raw = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
        names = pa.concat_arrays(ids_of).take(pa.array(of))
        columns = [start, length, tokens[of], number + first, offset, padded[number]]
        return pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in columns), raw], schema.names), first + len(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        pool: tuple[list, list, list] = ([], [], [])
        for whole in batches:
            for batch in pretokens.slices(whole, text, SLICE_BYTES):
                offsets, ids = pretokens.encode(batch[text], tokenizer, end, MOST_KNOWN)
                for held, new in zip(pool, (batch[doc_id], offsets, ids)):
                    held.append(new)
                if sum(map(len, pool[2])) >= pool_ids:
                    made, first = packed(*pool, first)
                    yield made
                    pool = ([], [], [])
        if pool[0] and sum(map(len, pool[0])):
            yield packed(*pool, first)[0]

    return in_arrow(docs.select(doc_id, text), run, schema)
