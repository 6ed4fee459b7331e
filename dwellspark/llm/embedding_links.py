"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Equal vectors become one node with a number of copies.  A node's signature in a table has a
bit per random hyperplane of the table, 1 on its positive side; two vectors at angle t agree in
a bit with probability 1 - t / pi.  A signature has about as many bits as the number of nodes
has, so that unlike vectors seldom share one, and there are as many tables as let a pair right at
the least cosine meet with probability ``RECALL`` (nearer pairs meet more surely).

Nodes that share a table's signature meet in one group, and every pair of a group is verified by its cosine
in double precision.  A linked pair counts in the first table in which it meets, which both
signatures tell, so no pair leaves a task: a task passes on each node's number of links
and one edge to the least node that it reaches in the group, in rows proportional to the nodes.
Signatures of a single node are dropped before vectors move.  A signature that more than
``PART`` nodes share is dealt into parts, and a group is a pair of parts, so a task holds two parts
at most, and every pair of nodes is in exactly one group.  Edges become connected components.

Vectors that are null, empty, zero, or hold a null or a component that is not finite, link with nothing,
not even with their like; vectors of unlike length never link.  Vectors are scaled by their largest
component first, so that no square overflows.  Rows with a null id link like others; the
component is the least id that is not null.  Repeated rows each stay and are links of each
other.  Other columns take no part.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .components import connected_components
from .shared import forget, in_arrow, settle

COSINE, RECALL = 0.95, 0.995
#: Nodes of a part; cosines, and components of vectors, that a task computes at once.
PART, COSINES, CELLS = 2048, 1 << 22, 1 << 21
SEED = 42


def tables_for(nodes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a signature, tables) for a number of nodes."""
    bits = min(62, max(8, nodes.bit_length()))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, 1 if agree >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, same, size, vector): the vector as bytes of doubles, scaled to length 1, and a digest of the given one; nulls for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, size, unit = [], [], []
            for row in batch["vector"]:
                x = np.asarray(row.values.to_numpy(zero_copy_only=False), np.float64) if row.is_valid and not row.values.null_count else np.zeros(0)
                top = np.abs(x).max(initial=0.0)
                if 0 < top < np.inf:
                    same.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                    x = x / top
                    unit.append((x / math.sqrt(x @ x)).tobytes())
                    size.append(len(x))
                else:  # also where the largest is NaN
                    for column in (same, size, unit):
                        column.append(None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(same, pa.binary()), pa.array(size, pa.int32()), pa.array(unit, pa.binary())], ["id", "same", "size", "vector"])

    rows = table.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    schema = T.StructType([rows.schema["id"], T.StructField("same", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("vector", T.BinaryType())])
    return in_arrow(rows, run, schema)


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, size)


def signed(nodes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``nodes`` (node, copies, size, vector) with signatures, a long per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = batch["size"].to_numpy()
            out = np.zeros((len(sizes), tables), np.int64)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(size=(size, bits * tables))
                at = np.flatnonzero(sizes == size)
                step = max(1, CELLS // max(size, bits * tables))
                for i in range(0, len(at), step):
                    here = at[i : i + step]
                    side = _matrix(batch["vector"].take(pa.array(here)), size) @ planes[size] > 0
                    out[here] = (side.reshape(len(here), tables, bits) * powers).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "signatures"])

    return in_arrow(nodes, run, T.StructType([*nodes.schema.fields, T.StructField("signatures", T.ArrayType(T.LongType()))]))


def grouped(nodes: DataFrame, part: int = PART) -> DataFrame:
    """``nodes`` once per group that they are in: size, table, signature, one and other (the group's parts), own (the node's)."""
    met = nodes.select("node", "size", F.posexplode("signatures").alias("table", "signature"))
    key = ["size", "table", "signature"]
    shared = met.groupBy(*key).agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    met = met.join(shared, key).withColumn("parts", F.ceil(F.col("nodes") / part).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("node", *key, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.select("node", *key, "own", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"))
    return met.join(nodes.drop("size"), "node")


class _Group:
    """Counts and components of the linked pairs of one group."""

    def __init__(self, table: int, node: np.ndarray, copies: np.ndarray, own: np.ndarray, x: np.ndarray, signatures: np.ndarray, cosine: float):
        self.n, self.table, self.copies, self.x, self.signatures, self.cosine = len(node), table, copies, x, signatures, cosine
        self.node = node
        #: a group of two parts holds the pairs across them only
        self.own = own if own[0] != own[-1] or (own != own[0]).any() else None

    def rows(self, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """Which nodes are linked to those from each ``i`` on."""
        for i in range(0, self.n, step):
            linked = self.x[i : i + step] @ self.x.T >= self.cosine
            here = np.arange(i, min(self.n, i + step))
            linked[here - i, here] = False
            if self.own is not None:
                linked &= self.own[here, None] != self.own
            yield i, linked

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(links counted here, place of the least node reached) of every node."""
        step = max(1, COSINES // self.n)
        links, least = np.zeros(self.n, np.int64), np.arange(self.n)
        for i, linked in self.rows(step):
            least[i : i + step] = np.minimum(least[i : i + step], np.where(linked.any(axis=1), linked.argmax(axis=1), self.n))
            a, b = np.nonzero(linked)
            for at in range(0, len(a), COSINES // 4):
                p, q = a[at : at + COSINES // 4], b[at : at + COSINES // 4]
                new = np.ones(len(p), bool)
                for earlier in range(self.table):
                    new &= self.signatures[i + p, earlier] != self.signatures[q, earlier]
                np.add.at(links, i + p[new], self.copies[q[new]])
        if not (least < np.arange(self.n)).any():
            return links, least
        while True:  # every node takes the least label around it, until all of a component have one
            before = least.copy()
            for i, linked in self.rows(step):
                around = np.where(linked, least, self.n).min(axis=1)
                np.minimum.at(least, before[i : i + step], around)
                least[i : i + step] = np.minimum(least[i : i + step], around)
            while (least[least] < least).any():
                least = least[least]
            if (before == least).all():
                return links, least


def verified(groups: DataFrame, cosine: float = COSINE, tasks: int | None = None) -> DataFrame:
    """(node, links, least): per group and node that is linked in it, the links that count there (copies included) and the least node reached."""
    key = ["size", "table", "signature", "one", "other"]
    dealt = groups.repartition(tasks, *key) if tasks else groups.repartition(*key)

    def results(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        marks = np.stack([whole[c].to_numpy() for c in key], axis=1)
        begins = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]])
        node, copies, own = (whole[c].to_numpy() for c in ("node", "copies", "own"))
        out: list[list[np.ndarray]] = [[], [], []]

        def add(nodes: np.ndarray, links: np.ndarray, least: np.ndarray) -> None:
            told = (links > 0) | (least != nodes)
            for column, values in zip(out, (nodes[told], links[told], least[told])):
                column.append(values)

        sizes = np.diff(begins)
        # pairs are most groups: all at once
        two = begins[:-1][sizes == 2]
        for size in np.unique(marks[two, 0]).tolist():
            for a in np.array_split(two[marks[two, 0] == size], max(1, len(two) * size // CELLS)):
                if not len(a):
                    continue
                x, y = (_matrix(whole["vector"].take(pa.array(at)), size) for at in (a, a + 1))
                linked = (np.einsum("ij,ij->i", x, y) >= cosine) & ((marks[a, 3] == marks[a, 4]) | (own[a] != own[a + 1]))
                a, s = a[linked], [np.stack(whole["signatures"].take(pa.array(at[linked])).to_pylist()) if linked.any() else None for at in (a, a + 1)]
                if len(a):
                    new = ~((s[0] == s[1]) & (np.arange(s[0].shape[1]) < marks[a, 1][:, None])).any(axis=1)
                    least = np.minimum(node[a], node[a + 1])
                    add(node[a], new * copies[a + 1], least)
                    add(node[a + 1], new * copies[a], least)
        for a, b in zip(begins[:-1][sizes > 2].tolist(), begins[1:][sizes > 2].tolist()):
            if marks[a, 3] != marks[a, 4] and (own[a:b] == own[a]).all():
                continue  # the other part has no node here
            x = _matrix(whole["vector"].slice(a, b - a), int(marks[a, 0]))
            signatures = whole["signatures"].slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            sides = own[a:b] if marks[a, 3] != marks[a, 4] else np.zeros(b - a, np.int32)
            links, least = _Group(int(marks[a, 1]), node[a:b], copies[a:b], sides, x, signatures, cosine).result()
            add(node[a:b], links, node[a:b][least])
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["node", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch[c].to_numpy() for c in key], axis=1)
            changes = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            if held and all(held[-1][c][held[-1].num_rows - 1].as_py() == batch[c][0].as_py() for c in key):
                if not len(changes):
                    held.append(batch)
                    continue
                first = int(changes[0])
                yield results([*held, batch.slice(0, first)])
            else:
                first = 0
                if held:
                    yield results(held)
            last = int(changes[-1]) if len(changes) else 0
            if last > first:
                yield results([batch.slice(first, last - first)])
            held = [batch.slice(max(first, last))]
        if held:
            yield results(held)
        pretokens.give_back()

    columns = [*key, "node", "copies", "own", "vector", "signatures"]
    sorted_ = dealt.select(*columns).sortWithinPartitions(*key, "node")
    return in_arrow(sorted_, run, "node bigint, links bigint, least bigint")


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``table``.

    kept: the row's id is its component's (a null id is kept where its component has no other).
    """
    spark = table.sparkSession
    rows, _ = settle(vectors(table, vec_id, vector), "vectors", "zstd")
    nodes = rows.filter("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("vector").alias("vector"))
    nodes, _ = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes", "zstd")
    bits, tables = tables_for(nodes.count(), cosine, recall)
    hashed, hashed_path = settle(signed(nodes.select("node", "copies", "size", "vector"), bits, tables), "vector-signatures", "zstd")
    found, _ = settle(verified(grouped(hashed, part), cosine), "vector-links")
    forget(spark, hashed_path)
    spoken = connected_components(found.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "same", "first_id", "copies").join(spoken, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known, _ = settle(known.join(counts, "node", "left").drop("node"), "vector-components")
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = known.join(least, "component").select("same", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "same").join(of, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
