"""A Merkle manifest of a dataset: every row's leaf, its source's root, the root of all, and its proof.

H is the lower-case hex SHA-256 of its inputs put end to end; digests enter as hex text.  A
leaf is H of the row's fields, each ``-`` if null, else its UTF-8 length, ``:`` and its value.
In every source the leaves stand in the order of their ids, and runs of ``ARITY`` neighbours
(the last run may be shorter, even a single one) become their H until one node is left, the
subroot; a lone leaf is its own subroot.  Subroots in the order of their sources (null first,
then by UTF-8 bytes) become the root in the same way.

Positions come from one range-partitioned order: a row's slot is its place in its range plus
the rows of its source in earlier ranges, so no source is ordered by one task.  A tree is then
climbed ``LEVELS`` levels at a time within chunks of ``ARITY ** LEVELS`` slots, which are the
windows' partitions: one shuffle and one sort serve all levels of a climb.  At level l a node
sits on the row of its first leaf; lag and lead by a fixed ``ARITY ** l`` rows, masked by the
node's place in its run and the run's length, are its siblings, and first children hash their
parents.  The chunks' tops are the next climb's rows, some hundreds of times fewer.

Ids that are null come first, and rows of one id are ordered by their leaf; rows that are equal
in all fields are leaves of their own with equal digests.  Null, empty and very long texts are
fields like any other.  Columns other than the fields take no part, whatever their names.  An
empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import forget, settle, small

ARITY, LEVELS = 3, 6
#: Rows of the table of range offsets (or of source roots) that may be broadcast.
BROADCAST_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**fields: Column) -> Column:
    return digest(*[field(c) for c in fields.values()])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, ...) with slot, their position in the key by ``order``, and n, the key's rows."""
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged, _ = settle(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order", "zstd")
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    sizes = ranged.groupBy("key", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    here = W.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(here.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts, _ = settle(sizes.select("key", "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(here).alias("n")), "merkle-starts")
    joined = ranged.join(small(starts, BROADCAST_ROWS), ["key", "range"])
    return joined.withColumn("slot", F.col("at") + F.col("shift")).drop("range", "shift", "at", *order)


def climbed(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (key, slot, n, d, ...) with their chunk, their path within it, and ``top`` on each chunk's first row.

    path: per level an entry (before, after), the digests of the node's siblings on either
    side; levels above the key's last node have none.
    """
    size = arity**levels
    w = W.partitionBy("key", "chunk").orderBy("slot")
    out = nodes.withColumn("chunk", F.expr(f"slot div {size}")).withColumn("d0", F.col("d"))
    for level in range(levels):
        stride = arity**level
        at, count = F.expr(f"slot div {stride}"), F.expr(f"(n + {stride - 1}) div {stride}")
        child, d = at % arity, F.col(f"d{level}")
        before = [F.when(child >= back, F.lag(d, back * stride).over(w)).otherwise("") for back in range(arity - 1, 0, -1)]
        after = [F.when((child + ahead < arity) & (at + ahead < count), F.lead(d, ahead * stride).over(w)).otherwise("") for ahead in range(1, arity)]
        sides = out.withColumns({"before": F.concat(*before), "after": F.concat(*after)})
        own, first = F.col("slot") % stride == 0, F.col("slot") % (arity * stride) == 0
        parent = F.when(first, F.when(count > 1, digest(d, F.col("after"))).otherwise(d))
        out = sides.withColumns({f"s{level}": F.when(own & (count > 1), F.struct("before", "after")), f"d{level + 1}": parent}).drop("before", "after")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    path = F.array_compact(F.array(*[F.last(f"s{level}", ignorenulls=True).over(upto) for level in range(levels)]))
    made = [f"{x}{level}" for level in range(levels) for x in "sd"]
    return out.withColumn("path", path).withColumn("top", F.col(f"d{levels}")).drop(*made, f"d{levels}")


def _tops(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.filter(F.col("slot") % size == 0).select("key", F.col("chunk").alias("slot"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("d"))


def tree(leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees over (settled) ``leaves`` (key, slot, n, d, ...), one per key.

    Returns the leaves with chunk and path within it, the chunks' paths (key, chunk, above)
    on to the root, and the roots (key, d).
    """
    size = arity**levels
    low = climbed(leaves, arity, levels)
    nodes, _ = settle(_tops(low, size), "merkle-tops", "zstd")
    climbs = []
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        climb, _ = settle(climbed(nodes, arity, levels), "merkle-climb", "zstd")
        climbs.append(climb)
        nodes, _ = settle(_tops(climb, size), "merkle-tops", "zstd")
    above = nodes.select("key", F.col("slot").alias("chunk"), F.array().cast("array<struct<before:string,after:string>>").alias("above"))
    for climb in reversed(climbs):
        above = climb.select("key", "slot", "chunk", "path").join(above, ["key", "chunk"]).select("key", F.col("slot").alias("chunk"), F.concat("path", "above").alias("above"))
    return low.drop("top"), above, nodes.select("key", "d")


def manifest(docs: DataFrame, leaf_of: Column, doc_id: str = "doc_id", source: str = "source", also: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path) per row, and the columns ``also``.

    path: the entries (before, after) from the leaf to the root, as ``fold`` takes them.
    """
    also = also or {}
    # a null source sorts before all others and equals itself in joins
    key = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(source)))
    leaves = docs.select(key.alias("key"), F.col(doc_id).alias("id"), leaf_of.alias("d"), *[c.alias(f"also_{n}") for n, c in also.items()])
    leaves, path = settle(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves", "zstd")
    spots = placed(leaves.withColumns({"by_id": F.col("id"), "by_leaf": F.col("d")}), ["by_id", "by_leaf", "row"])
    spots, _ = settle(spots, "merkle-slots", "zstd")
    forget(docs.sparkSession, path)
    low, above, subroots = tree(spots, arity, levels)
    heads, _ = settle(placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("key").alias("by_key"), "d"), ["by_key"]), "merkle-sources", "zstd")
    low_heads, above_heads, root = tree(heads, arity, levels)
    of_source = low_heads.join(above_heads, ["key", "chunk"]).join(root.withColumnRenamed("d", "root"), "key")
    of_source = of_source.select(F.col("source_key").alias("key"), F.col("d").alias("subroot"), "root", F.concat("path", "above").alias("beyond"))
    of_source, _ = settle(of_source, "merkle-source-paths", "zstd")
    of_chunk = above.join(small(of_source, BROADCAST_ROWS), "key").select("key", "chunk", "subroot", "root", F.concat("above", "beyond").alias("above"))
    out = low.join(of_chunk, ["key", "chunk"])
    return out.select(
        F.col("id").alias(doc_id), F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias(source), F.col("d").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"), *[F.col(f"also_{n}").alias(n) for n in also]
    )


def proof_digest(path: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))
