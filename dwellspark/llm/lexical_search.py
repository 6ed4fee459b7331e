"""Exact ranked search for text items: branch and bound over frequent-pattern trees of documents.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; only
A-Z are lower-cased.  N documents hold a term, L terms are in all of them, n in one, df
documents hold a term and it occurs tf times in one.  A term's weight w is
floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document's m is 75 + 25 * n * N div L, and its
score for an item the sum of w * (1000000000 * tf div (1000 * tf + 12 * m)) over the item's
terms, repeats included, in 64-bit integers.

Items are searched in blocks of bounded size, whose terms (a block's vocabulary) tasks hold.
For a block every document is read once and restricted to the vocabulary; counts of documents
per term are summed by Spark.  A task then takes its documents some thousands at a time,
writes each as its terms by falling document frequency, and sorts them: documents that share
a path of the trie are neighbours, and a node of the trie (paths without a branch are one edge)
is a range of them.  Each node keeps its terms' tf maxima and the least m of its range.  The
weighted sum of these is at least every score below the node, as scores rise with tf and fall
with m; so the search of an item goes depth first, best bound first, and leaves out nodes below
the k-th score that the task has found.  Ranges of a few dozen documents are scored exactly.
Tasks pass on their k best of each item, and a window ranks those.

Null texts have no terms.  Repeated rows are documents (or items) of their own.  Equal scores
stand in the order of the ids, null ids last; rows that share an id are in any order.  Texts are read whole, in
pieces if long.  An item without terms or hits has no rows; an empty table gives none.  Columns
other than ids and texts take no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import pretokens
from .shared import forget, in_arrow, settle

#: Terms and items of a block, about.
BLOCK_TERMS, BLOCK_ITEMS = 40_000, 4_000
#: Documents and their terms in one tree; documents of a range that is scored without a branch; cells of its bounds.
TREE_DOCS, TREE_TERMS, RANGE_DOCS, BOUND_CELLS = 8192, 2_000_000, 32, 2_000_000
#: Bytes of a text that are cut into terms at once.
PIECE_BYTES = 1 << 20

#: Letters and digits, A-Z lower-cased, and bytes of characters beyond ASCII; others become blanks.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about ``PIECE_BYTES``."""
    at = 0
    while at < len(text):
        to = at + PIECE_BYTES
        piece = text[at:to].translate(_TERM)
        while to < len(text) and piece[-1:] != b" ":  # a term goes on: up to a blank
            more = text[to : to + PIECE_BYTES].translate(_TERM)
            end = more.find(b" ") + 1 or len(more)
            piece, to = piece + more[:end], to + end
        yield piece.split()
        at = to


def items_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, terms, times): a number per row, and its distinct terms with their occurrences."""
    numbered, path = settle(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "search-items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pretokens.slices(whole, "text"):
                counts = []
                for t in batch["text"].to_pylist():
                    seen: Counter = Counter()
                    for piece in terms_of((t or "").encode()):
                        seen.update(piece)
                    counts.append(seen)
                terms, times = pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["item"], batch["item_id"], terms, times], ["item", "item_id", "terms", "times"])

    schema = numbered.select("item", "item_id").schema.add("terms", T.ArrayType(T.BinaryType())).add("times", T.ArrayType(T.LongType()))
    out, _ = settle(in_arrow(numbered, run, schema), "search-item-terms")
    forget(items.sparkSession, path)
    return out


def restricted(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times): each document's number of terms, and its terms in ``codes`` with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = codes.get
        for whole in batches:
            for batch in pretokens.slices(whole, "text"):
                offsets, data = pretokens.utf8(batch["text"])
                raw, n, sizes, terms, times = data.tobytes(), [], [0], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    held, total = {}, 0
                    for piece in terms_of(raw[a:b]):
                        total += len(piece)
                        for code, k in Counter(map(find, piece)).items():
                            held[code] = held.get(code, 0) + k
                    held.pop(None, None)
                    n.append(total)
                    terms.extend(held)
                    times.extend(held.values())
                    sizes.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, t)) for v, t in ((terms, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return in_arrow(docs, run, docs.select("doc_id").schema.add("n", T.LongType()).add("terms", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.LongType())))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list array."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten().to_numpy()


def document_counts(vectors: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the ``terms`` codes of a block occurs; tasks send one row per code at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch["terms"])[1], minlength=terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in in_arrow(vectors.select("terms"), run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Tree:
    """A trie over documents given as term ranks: sorted documents, and nodes that are ranges of them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, of: np.ndarray, ranks: np.ndarray, times: np.ndarray, terms: int):
        """``of`` (ascending): the document of each of ``ranks`` and ``times``."""
        by = np.lexsort((ranks, of))
        ranks, times = ranks[by], times[by]
        sizes = np.bincount(of, minlength=len(m))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        raw = ranks.astype(">u4").tobytes()
        order = np.array(sorted(range(len(m)), key=lambda i: raw[4 * begins[i] : 4 * begins[i + 1]]), np.int64)
        at = np.repeat(begins[:-1][order] - np.concatenate([[0], np.cumsum(sizes[order])[:-1]]), sizes[order]) + np.arange(len(ranks))
        self.ids, self.m, self.ranks, times = ids[order], m[order], ranks[at], times[at]
        self.begins = np.concatenate([[0], np.cumsum(sizes[order])])
        self.shares = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(self.m, sizes[order]))
        self._divide(self._shared_lengths(), max(RANGE_DOCS, len(m) * terms // BOUND_CELLS))
        most, least_m = np.zeros((len(self.first), terms), np.int32), np.zeros((len(self.first), 1), np.int64)
        for i in range(len(self.first) - 1, -1, -1):  # children come after their parents
            kids, a, b = self.children[i], self.first[i], self.last[i]
            if len(kids):
                most[i], least_m[i] = most[kids].max(axis=0), least_m[kids].min()
            else:
                here = slice(self.begins[a], self.begins[b])
                np.maximum.at(most[i], self.ranks[here], times[here].astype(np.int32))
                least_m[i] = self.m[a:b].min()
        self.bounds = np.empty_like(most)
        for i in range(len(most)):  # row by row, to hold few long integers at once
            self.bounds[i] = 1_000_000_000 * most[i].astype(np.int64) // (1000 * most[i].astype(np.int64) + 12 * least_m[i])

    def _shared_lengths(self) -> np.ndarray:
        """Terms that each document shares with the one before it."""
        out, b = np.zeros(len(self.m), np.int64), self.begins.tolist()
        for i in range(1, len(out)):
            n = min(b[i] - b[i - 1], b[i + 1] - b[i])
            apart = np.flatnonzero(self.ranks[b[i - 1] : b[i - 1] + n] != self.ranks[b[i] : b[i] + n])
            out[i] = apart[0] if len(apart) else n
        return out

    def _divide(self, shared: np.ndarray, least: int) -> None:
        """Nodes (first, last, children): a range is cut where its documents share fewest terms.

        A branch that leaves fewer than ``least`` documents to its siblings is cut in its
        place, and neighbouring branches are one child while they hold at most ``least``
        documents, so that nodes number a few times the documents by ``least``.
        """

        def branches(a: int, b: int) -> list[int]:
            inner = shared[a + 1 : b]
            return [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist()]

        self.first, self.last, self.children = [0], [len(self.m)], []
        i = 0
        while i < len(self.first):
            a, b = self.first[i], self.last[i]
            kids: list[int] = []
            if b - a > least:
                begins = branches(a, b)
                while True:
                    sizes = np.diff([*begins, b])
                    big = int(sizes.argmax())
                    if sizes[big] <= least or b - a - sizes[big] >= least:
                        break
                    begins[big : big + 1] = branches(begins[big], begins[big] + int(sizes[big]))
                begin = a
                for now, after in zip([*begins[1:], b], [*begins[2:], b, None]):
                    if after is None or after - begin > least:
                        if (begin, now) != (a, b):
                            kids.append(len(self.first))
                            self.first.append(begin)
                            self.last.append(now)
                        begin = now
            self.children.append(np.array(kids, np.int64))
            i += 1

    def search(self, terms: np.ndarray, weights: np.ndarray, by_rank: np.ndarray, best: list, k: int) -> None:
        """Puts the documents of the tree among the ``k`` ``best`` (a heap of (score, order of the id)).

        weights: of the item's ``terms`` times their occurrences; by_rank: the same for every term.
        """
        bounds = (self.bounds[:, terms].astype(np.int64) * weights).sum(axis=1)
        least = best[0][0] if len(best) == k else 1
        todo = [0] if bounds[0] >= least else []
        while todo:
            i = todo.pop()
            if bounds[i] < least:
                continue
            kids = self.children[i]
            if len(kids):
                kids = kids[bounds[kids] >= least]
                todo.extend(kids[np.argsort(bounds[kids], kind="stable")].tolist())
                continue
            a, b = self.first[i], self.last[i]
            begins = self.begins[a : b + 1]
            sums = np.concatenate([[0], np.cumsum(by_rank[self.ranks[begins[0] : begins[-1]]] * self.shares[begins[0] : begins[-1]])])
            scores = sums[begins[1:] - begins[0]] - sums[begins[:-1] - begins[0]]
            for at in np.flatnonzero(scores >= least).tolist():
                found = (int(scores[at]), _Order(self.ids[a + at]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            least = best[0][0] if len(best) == k else 1


class _Order:
    """Ids in falling order, null lowest, so that the heap drops the last of equal scores."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: _Order) -> bool:
        return other.id is not None if self.id is None else other.id is not None and other.id < self.id

    def __eq__(self, other: object) -> bool:
        return self.id == other.id


def _searched(vectors: DataFrame, rank: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's ``k`` best of every item (number, ranks, weights)."""
    id_type, terms = vectors.schema["doc_id"], len(rank)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held, docs, entries = [], 0, 0

        def grown() -> Tree:
            ids = np.concatenate([np.array(h[0].to_pylist(), object) for h in held])
            m = 75 + np.concatenate([25 * h[1] * documents for h in held]) // length
            sizes = np.concatenate([h[2] for h in held])
            return Tree(ids, m, np.repeat(np.arange(len(m)), sizes), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), terms)

        for batch in batches:
            offsets, codes = _flat(batch["terms"])
            n, times = batch["n"].to_numpy(), _flat(batch["times"])[1]
            at = 0
            while at < len(n):
                to = min(len(n), at + TREE_DOCS - docs, max(at + 1, int(np.searchsorted(offsets, offsets[at] + TREE_TERMS - entries, side="right")) - 1))
                a, b = offsets[at], offsets[to]
                held.append((batch["doc_id"].slice(at, to - at), n[at:to], np.diff(offsets[at : to + 1]), rank[codes[a:b]], times[a:b]))
                docs, entries, at = docs + to - at, entries + b - a, to
                if docs >= TREE_DOCS or entries >= TREE_TERMS:
                    yield grown()
                    held, docs, entries = [], 0, 0
        if held:
            yield grown()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        by_rank = np.zeros(terms, np.int64)
        for tree in trees(batches):
            for (_, ranks, weights), top in zip(items, best):
                by_rank[ranks] = weights
                tree.search(ranks, weights, by_rank, top, k)
                by_rank[ranks] = 0
            pretokens.give_back()
        rows = [(i[0], order.id, score) for i, top in zip(items, best) for score, order in top]
        columns = list(zip(*rows)) or [(), (), ()]
        types = [pa.int64(), to_arrow_type(id_type.dataType), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item", "doc_id", "score"])

    return in_arrow(vectors.filter("size(terms) > 0"), run, f"item bigint, doc_id {id_type.dataType.simpleString()}, score bigint")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    asked = items_table(items, item_id, item_text)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-size["items"] // block_items), -(-size["terms"] // block_terms))
    found = None
    for block in range(blocks):
        here = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms", "times").collect()
        codes: dict[bytes, int] = {}
        for r in here:
            for term in r.terms:
                codes.setdefault(bytes(term), len(codes))
        vectors, path = settle(restricted(docs, codes), "search-vectors", "zstd")
        whole = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        documents, length = whole["documents"], max(1, whole["length"])
        df = document_counts(vectors, len(codes))
        rank = np.empty(len(codes), np.int32)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(codes), dtype=np.int32)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        queries = []
        for r in here:
            at = np.array([codes[bytes(t)] for t in r.terms], np.int64)
            at, times = at[df[at] > 0], np.array(r.times, np.int64)[df[at] > 0]
            queries.append((r.item, rank[at], weight[at] * times))
        best, _ = settle(_searched(vectors, rank, queries, documents, length, k), "search-best")
        forget(spark, path)
        found = best if found is None else found.unionByName(best)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
