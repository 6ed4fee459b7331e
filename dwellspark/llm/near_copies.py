"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words and shingles are those of ``simhash``, with ``WIDTH`` words.  Texts with equal sets
are one node.  Candidates come from SimHash first: nodes whose fingerprints (``simhash``, of the set)
``simhash.links`` finds by pigeonring chains, each fingerprint by its least node.  At 0.8 most
fingerprints are too far apart for that, so others share a band of ``ROWS`` of the min-hashes and no more differing
sketch bits than ``APART``; every candidate is verified on the sets themselves before it is
linked.  A pair at 0.8 shares one of ``BANDS`` bands with probability 0.99995, a closer one
with more; the sketch loses about one pair in 100,000 at 0.8.

Candidates are made in rows proportional to the members of a band, in steps:
1. every member with the band's most met node (a copied text rather than one of its edited
   copies) and with its least; the links' components are joined;
2. in bands that still hold several components, every node outside the band's largest
   component with all nodes of other components, if at most ``CROWD`` nodes lie outside it;
3. the nodes of larger bands are told apart exactly by their shingles.  Call a shingle rare if at
   most ``CROWD`` of these nodes have it, else common.  Nodes that share a rare shingle are
   tested under it.  All others have in common at most the common shingles of either, so they
   are tested only where those alone would do, under their bands.
   Texts of one template, or copies with many edits, have too few common shingles.

Null or text without words has the empty set, one node.  The component id is the least
non-null id that a row reaches (null if there is none).  Repeated rows each stay.  Very long texts are
hashed whole, one at a time.  Other columns take no part, whatever their names.  An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens, simhash
from .components import connected_components
from .shared import add_columns, bit_map, forget, in_arrow, on_map, settle, small, without

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
#: Differing bits of the 128 of a sketch (12.8 are expected at similarity 0.8).
APART = 29
#: Nodes outside a band's largest component, up to which each is tested with the other components' nodes.
CROWD = 32
SLICE_BYTES = 1 << 20
#: Bits of the map of the nodes whose sets are made.
MAP_BITS = 1 << 24

_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, 128), dtype=np.uint64)
_FACTORS, _MASKS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = {"node": T.LongType(), "n": T.IntegerType(), "s0": T.LongType(), "s1": T.LongType(), "simhash": T.LongType(), "bands": T.ArrayType(T.LongType())}


def shingle_sets(texts: pa.Array, width: int, hashes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct shingles of every text, the texts' nodes, and ``hashes`` (2 or more) of their min-hashes."""
    offsets, data = pretokens.utf8(texts)
    sets = [np.unique(simhash.shingle_hashes(data[a:b], width)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    least = np.zeros((hashes, len(sets)), np.uint64)
    node, total = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(full):
        for k in range(hashes):
            least[k, full] = np.minimum.reduceat((every ^ _MASKS[k]) * _FACTORS[k], starts)
        mixed = (every ^ (every >> np.uint64(29))) * _MIX
        total[full] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        node[full] = (total[full] ^ least[0, full]) * _MIX + least[1, full]
    return sets, node, least


def measured(texts: pa.Array, width: int = WIDTH) -> dict[str, pa.Array]:
    """The node, set size, sketch and bands of every text."""
    sets, node, least = shingle_sets(texts, width, 128)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = ((least >> np.uint64(13)) & np.uint64(1)) << np.arange(128, dtype=np.uint64)[:, None] % np.uint64(64)
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for b in range(BANDS):
        keys[b] = b + 1
        for k in range(b * ROWS, (b + 1) * ROWS):
            keys[b] = (keys[b] ^ least[k] ^ (keys[b] >> np.uint64(31))) * _MIX
    keys = np.where(sizes > 0, keys, np.uint64(0))
    return {
        "node": pa.array(node.view(np.int64)),
        "n": pa.array(sizes, pa.int32()),
        "s0": pa.array(bits[:64].sum(axis=0, dtype=np.uint64).view(np.int64)),
        "s1": pa.array(bits[64:].sum(axis=0, dtype=np.uint64).view(np.int64)),
        "simhash": pa.array(np.array([simhash.majority(x) for x in sets], np.uint64).view(np.int64)),
        "bands": _lists(np.full(len(sets), BANDS), np.ascontiguousarray(keys.T).ravel()),
    }


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def sets_of(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, shingles) of ``nodes`` (node), made again from the texts.

    Tasks pass on what falls on a bit map of the nodes, of fixed size; a join ends wrong hits.
    """
    packed = bit_map(nodes, "node", MAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in pretokens.slices(whole, text, SLICE_BYTES):
                sets, node, _ = shingle_sets(batch[text], WIDTH, 2)
                node, picked = node.view(np.int64), []
                for i in np.flatnonzero(on_map(packed, node, MAP_BITS)).tolist():
                    if int(node[i]) not in seen:
                        picked.append(i)
                        if len(seen) < 200_000:
                            seen.add(int(node[i]))
                values = np.concatenate([*[sets[i] for i in picked], np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(node[picked], pa.int64()), _lists(np.array([len(sets[i]) for i in picked], np.int64), values)], ["node", "shingles"])

    made = in_arrow(docs.select(text), run, "node bigint, shingles array<bigint>")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


NODE = ["node", "n", "s0", "s1"]


def _side(x: str) -> list[Column]:
    return [F.col(c).alias(f"{x}_{c}") for c in NODE]


def _viable(pairs: DataFrame) -> DataFrame:
    """(a, b): distinct pairs that sizes and sketches allow to be similar."""
    apart = sum(F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in ("s0", "s1"))
    sizes = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * SIMILAR
    rows = pairs.filter("a_node <> b_node").filter(sizes & (apart <= APART))
    return rows.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets (node, shingles) are similar."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    similar = both / (F.size("a_set") + F.size("b_set") - both) >= SIMILAR
    return pairs.join(a, "a").join(b, "b").filter(similar).select("a", "b")


def _groups(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, NODE, component, main) of keys with several components: those with at most
    ``crowd`` nodes outside the largest component, ``main``, and those with more."""
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    spans = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    open_, _ = settle(rows.join(spans, "key"), "near-open")
    return open_.filter(F.col("outside") <= crowd), open_.filter(F.col("outside") > crowd)


def _pairs(rows: DataFrame) -> DataFrame:
    """Viable pairs of different components under each key; by their common shingles alone where ``rows`` count those."""
    some = ["common"] if "common" in rows.columns else []
    a, b = (rows.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("component", "main", *some)], *_side(x)) for x in "ab")
    met = a.filter("a_component <> a_main").join(b, "key").filter("a_component <> b_component")
    if some:
        met = met.filter(F.least("a_common", "b_common") >= (F.col("a_n") + F.col("b_n")) * (SIMILAR / (1 + SIMILAR)) - 1e-9)
    return _viable(met)


def _told_apart(many: DataFrame, shingles: DataFrame, crowd: int) -> list[DataFrame]:
    """Candidate pairs among the nodes of ``many`` (key, NODE, component), as in step 3."""
    here, _ = settle(many.select(*NODE, "component").distinct(), "near-crowd")
    rows = here.select("node").join(shingles, "node").select("node", F.explode("shingles").alias("shingle"))
    times = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    counted, counted_path = settle(rows.join(times, "shingle"), "near-shingles")
    rare = counted.filter(F.col("times") <= crowd).select("node", F.col("shingle").alias("key")).join(here, "node")
    common = counted.filter(F.col("times") > crowd).groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    alike = many.select("key", *NODE, "component").join(common, "node").filter(F.col("common") >= F.col("n") * SIMILAR - 1e-9)
    out = [settle(_pairs(part), "near-told")[0] for rows in (rare, alike) for part in _groups(rows, crowd)]
    forget(many.sparkSession, counted_path)
    return out


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Viable pairs of nodes (NODE, simhash) of equal or linked fingerprints, those by the least node of each."""
    least = nodes.groupBy("simhash").agg(F.min(F.struct(*NODE)).alias("o"))
    equal = nodes.join(least, "simhash").select(F.struct(*NODE).alias("a"), F.col("o").alias("b"))
    a, b = (least.select(F.col("simhash").alias(x), F.col("o").alias(f"{x}_o")) for x in "ab")
    near = simhash.links(nodes).join(a, "a").join(b, "b").select(F.col("a_o").alias("a"), F.col("b_o").alias("b"))
    return _viable(equal.union(near).select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in NODE]))


def links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], crowd: int = CROWD) -> DataFrame:
    """(a, b): verified links between ``nodes`` (NODE, simhash, bands).

    ``sets`` gives (node, shingles) for some nodes: those that share a band or a link of fingerprints with another.
    """
    rows = nodes.filter("n > 0").select(*NODE, F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    met, met_path = settle(rows.join(sizes, "key"), "near-keys")
    times = met.groupBy("node").agg(F.sum("met").alias("times"))
    me = F.struct(*NODE)
    middle = met.join(times, "node").groupBy("key").agg(F.max_by(me, F.struct("times", "node")).alias("o"), F.min(me).alias("least"))
    centres = met.join(middle, "key").select(*_side("a"), F.explode(F.array("o", "least")).alias("o"))
    star, star_path = settle(_viable(centres.select(*[f"a_{c}" for c in NODE], *[F.col(f"o.{c}").alias(f"b_{c}") for c in NODE])).union(_by_fingerprint(nodes.filter("n > 0"))).distinct(), "near-star")
    wanted, wanted_path = settle(met.select("node").union(star.select(F.explode(F.array("a", "b")))).distinct(), "near-wanted")
    shingles, shingles_path = settle(sets(wanted), "near-sets")
    found, _ = settle(verified(star, shingles), "near-found")
    of, _ = settle(connected_components(found), "near-parts")
    known = met.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")).select("key", *NODE, "component")
    few, many = _groups(known, crowd)
    pairs = [_pairs(few)]
    if not many.isEmpty():
        pairs += _told_apart(many, shingles, crowd)
    more, _ = settle(reduce(DataFrame.union, pairs).distinct().join(star, ["a", "b"], "left_anti"), "near-pairs")
    out = found if more.isEmpty() else found.union(settle(verified(more, shingles), "near-more")[0])
    forget(nodes.sparkSession, met_path, star_path, wanted_path, shingles_path)
    return out


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) per row of ``docs``."""
    made = add_columns(docs.select(doc_id, text), COLUMNS, [doc_id], lambda b: measured(b[text]), lambda b: pretokens.slices(b, text, SLICE_BYTES))
    prints, _ = settle(made, "near-prints")
    nodes, _ = settle(prints.select(*NODE, "simhash", "bands").dropDuplicates(["node"]), "near-nodes")
    of = connected_components(links(nodes, lambda pairs: sets_of(docs, pairs, text), crowd))
    least = prints.groupBy("node").agg(F.min(doc_id).alias("least")).join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least, _ = settle(least, "near-groups")
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select(doc_id, "node").join(least.join(ids, "component").select("node", "component_id"), "node").select(doc_id, "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id.

    Rows with a null id in a group that has an id go; rows that share the least id stay.
    """
    found = near_copies(docs, doc_id, text, **options).filter(F.col("component_id").isNotNull() & (F.col(doc_id).isNull() | (F.col(doc_id) > F.col("component_id"))))
    gone, _ = settle(found.select(F.col(doc_id).alias("__gone")).distinct(), "near-gone")
    return without(docs.join(small(gone, broadcast_rows), docs[doc_id].eqNullSafe(F.col("__gone")), "left_anti"), "__gone")
