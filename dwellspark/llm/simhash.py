"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: A-Z are lower-cased, words are runs of bytes other than ASCII white
space, and every run of ``width`` words (repeats included; all words if fewer) is
hashed with XXH64, seed 42.  A bit is 1 if it is set in over half of the hashes.

Links: two fingerprints that differ in at most ``radius`` bits.  The 64 bits form a
ring of segments.  If the whole ring differs in at most tau bits, some segment begins
a chain whose every prefix of l of m segments differs in at most l * tau / m bits
(pigeonring).  The prefixes whose budget is below 1 must be equal, so they are the
equi-join key; the longer prefixes prune candidates, and a full Hamming check follows.

Distinct fingerprints only are joined, so exact copies cost one row.  A key under which
more than ``CROWD`` fingerprints meet is not paired: each such fingerprint emits itself
and its one-bit variants outside the key, and those that share a variant are linked in
a star.  Fingerprints at 2 bits or fewer share a variant and others do not, so the
same components result with rows in proportion to the crowd.

Null or empty text has fingerprint zero, which links like any other.  Repeated rows
and ids each stay; the component id is the least non-null id that a row reaches (null
if there is none).  Very long texts are hashed whole, one at a time, and their bits summed in pieces.
Other columns take no part, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .components import connected_components
from .shared import add_columns, settle, without

SEGMENTS = 16
RADIUS = 2
#: Fingerprints under one key up to which all pairs are tested (about twice the variants of one).
CROWD = 64

#: ASCII white space, lower-cased letters.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words of one text's bytes."""
    words = ~BLANKS[text]
    if not words.any():
        return np.zeros(0, np.uint64)
    kept = words.copy()
    kept[1:] |= words[:-1]  # the first blank after a word stands for the whole gap
    flat = LOWER[text[kept]]
    flat[~words[kept]] = 32
    gaps = np.flatnonzero(flat == 32)
    if len(gaps) and gaps[-1] == len(flat) - 1:
        gaps, flat = gaps[:-1], flat[:-1]
    begins, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(flat))
    n = max(1, len(begins) - width + 1)
    begins, ends = begins[:n].tolist(), ends[-n:].tolist()
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], 42) for a, b in zip(begins, ends)), np.uint64, n)


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of some hashes have."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return _POWERS[totals * 2 > len(hashes)].sum(dtype=np.uint64)


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """Fingerprints (as signed longs) of an array of texts."""
    offsets, data = pretokens.utf8(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        hashes = shingle_hashes(data[a:b], width)
        if len(hashes):
            out[i] = majority(hashes)
    return out.view(np.int64)


def fingerprint(docs: DataFrame, text: str = "text", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with simhash (long)."""
    return add_columns(docs, {"simhash": T.LongType()}, keep, lambda b: {"simhash": pa.array(fingerprints(b[text], width))}, lambda b: pretokens.slices(b, text))


def _rotated(bits: Column, by: int) -> Column:
    return bits if by % 64 == 0 else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))


def _prefix(bits: Column, n: int) -> Column:
    """The first n bits, from the lowest."""
    return bits if n == 64 else bits.bitwiseAND(F.lit((1 << n) - 1))


def _joined_bits(segments: int, radius: int) -> int:
    """Bits of the longest chain prefix whose budget is below one differing bit."""
    return max(n for n in range(1, segments + 1) if n * radius < segments) * (64 // segments)


def links(prints: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the distinct values of ``prints.simhash`` whose components are
    those of all pairs at ``radius`` bits or fewer.

    ``segments`` divides 64 and exceeds ``radius``; crowds are resolved for radius 2 and
    are paired in full for any other.
    """
    if 64 % segments or segments <= radius:
        raise ValueError("segments must divide 64 and exceed the radius")
    width, key_bits = 64 // segments, _joined_bits(segments, radius)
    spun = F.array(*[F.struct(F.lit(i).alias("i"), _rotated(F.col("simhash"), 64 - i * width).alias("bits")) for i in range(segments)])
    rows = prints.select("simhash").distinct().select("simhash", F.explode(spun).alias("s")).select("simhash", "s.i", "s.bits", _prefix(F.col("s.bits"), key_bits).alias("key"))
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met, _ = settle(rows.join(sizes, ["i", "key"]), "simhash-keys")
    few = met if radius != 2 else met.filter(F.col("n") <= crowd)
    left, right = (few.select("i", "key", F.col("simhash").alias(x), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    apart = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    viable = F.lit(True)
    for n in range(key_bits // width + 1, segments):
        viable &= F.bit_count(_prefix(apart, n * width)) * segments <= n * radius
    pairs = left.join(right, ["i", "key"]).filter(F.col("a") < F.col("b")).filter(viable).filter(F.bit_count(apart) <= radius).select("a", "b")
    if radius != 2:
        return pairs.distinct()
    flips = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63))) for b in range(key_bits, 64)])
    variants = met.filter(F.col("n") > crowd).select("i", "simhash", F.explode(flips).alias("variant"))
    centres = variants.groupBy("i", "variant").agg(F.min("simhash").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = variants.join(centres, ["i", "variant"]).select(F.col("simhash").alias("a"), "b").filter("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, simhash, fingerprint, component_id) per row of ``docs``."""
    prints, _ = settle(fingerprint(docs.select(doc_id, text), text, width, [doc_id]), "simhash")
    spoken = connected_components(links(prints, segments, radius)).withColumnRenamed("node", "simhash")
    least = prints.groupBy("simhash").agg(F.min(doc_id).alias("least"))
    groups = least.join(spoken, "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    groups, _ = settle(groups, "simhash-groups")
    ids = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    of = groups.join(ids, "component").select("simhash", "component_id")
    return prints.join(of, "simhash").select(doc_id, "simhash", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id.

    Rows with a null id in a group that has an id go; rows that share the least id stay.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    gone, _ = settle(
        found.filter(F.col("component_id").isNotNull() & (F.col(doc_id).isNull() | (F.col(doc_id) > F.col("component_id")))).select(F.col(doc_id).alias("__gone")).distinct(), "simhash-gone"
    )
    from .shared import small

    return without(docs.join(small(gone, broadcast_rows), docs[doc_id].eqNullSafe(F.col("__gone")), "left_anti"), "__gone")
