"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per component, 1 where the component is positive.  A code is
cut into segments of nearly equal width, some bits narrower than the logarithm of the number of
codes, so that a segment's value is shared by few codes.  In round r every open query
emits the values at exactly r bits from each of its segments, and these meet the table's
segments in an equi-join.  After round r every code nearer than (r + 1) * segments bits
has been verified, so a query is closed once its k-th verified distance is below that;
only open queries go on.  A pair that meets in several segments or rounds is taken in
the first alone, which both codes tell, so nothing is deduplicated.

Of equal codes only the k least ids can be neighbours, and equal queries are searched
once, so groups of copies cost k rows.  A value that more than ``BUCKET`` rows hold is
split into parts that every probe visits, and one that more than ``BLOCK`` queries hold
into blocks of queries that every row visits, so no task gets more than a part and a block.

Ties go to the smaller id.  A query finds itself.  Rows with a null id, a null or empty
vector or one whose length differs from ``bits`` have no code and take no part; null or
NaN components count as 0.  Repeated rows are separate rows: each may be a neighbour, and
each query row gets a list, also where two share an id (with equal or other codes).
Other columns take no part.  Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import forget, settle, small

#: Rows of one segment value, and queries that hold it, which meet in one task.
BUCKET = 20_000
BLOCK = 5_000
#: Split values up to this number (24 bytes each) are broadcast.
BROADCAST_SPLITS = 200_000


def codes(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", bits: int = 64) -> DataFrame:
    """(id, code): sign bits as a long, the first component lowest; ``bits`` is at most 64."""
    positive = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(positive, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return table.filter(F.col(vec_id).isNotNull() & (F.size(vector) == bits)).select(F.col(vec_id).alias("id"), code.alias("code"))


def segment_widths(rows: int, bits: int) -> list[int]:
    """Widths of the segments: about 16 codes to a value if codes are spread evenly."""
    most = min(bits, max(4, rows.bit_length() - 5))
    n = -(-bits // most)
    return [bits // n + (i < bits % n) for i in range(n)]


class Segments:
    """Column expressions for the segments of a code."""

    def __init__(self, widths: list[int]):
        self.widths = widths
        self.offsets = [sum(widths[:i]) for i in range(len(widths))]

    def value(self, code: Column, i: int) -> Column:
        shifted = F.shiftrightunsigned(code, self.offsets[i]) if self.offsets[i] else code
        return shifted if self.widths[i] == 64 else shifted.bitwiseAND(F.lit((1 << self.widths[i]) - 1))

    def exploded(self, code: str) -> Column:
        """A row per segment: a struct (segment, width, value)."""
        return F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(w).alias("width"), self.value(F.col(code), i).alias("value")) for i, w in enumerate(self.widths)]))

    def first_meeting(self, apart: Column, radius: int) -> Column:
        """Whether no segment is nearer than ``radius`` and none before ``segment`` as near."""
        here = F.lit(True)
        for i in range(len(self.widths)):
            far = F.bit_count(self.value(apart, i))
            here &= (far > radius) | ((far == radius) & (F.col("segment") <= i))
        return here


def probes(asked: DataFrame, segments: Segments, radius: int) -> DataFrame:
    """(query, worst, segment, value): the values at exactly ``radius`` bits from each segment of ``query``."""
    out = asked.select("query", "worst", segments.exploded("query").alias("s")).select("query", "worst", "s.*", F.lit(-1).alias("top"))
    for _ in range(radius):  # one more differing bit, above the last
        out = out.filter("top < width - 1").withColumn("bit", F.explode(F.sequence(F.col("top") + 1, F.col("width") - 1)))
        flipped = F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
        out = out.select("query", "worst", "segment", "width", flipped.alias("value"), F.col("bit").alias("top"))
    return out.drop("width", "top")


def _splits(rows: DataFrame, asked: DataFrame, segments: Segments, bucket: int, block: int) -> DataFrame:
    """(segment, value, parts, blocks) of the values that many rows or queries hold."""
    held = lambda df, code, n: df.select(segments.exploded(code).alias("s")).groupBy("s.segment", "s.value").agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > (bucket if n == "rows" else block))
    both = held(rows, "code", "rows").join(held(asked, "query", "queries"), ["segment", "value"], "full")
    parts, blocks = F.ceil(F.coalesce("rows", F.lit(1)) / bucket), F.ceil(F.coalesce("queries", F.lit(1)) / block)
    return both.select("segment", "value", parts.cast("int").alias("parts"), blocks.cast("int").alias("blocks"))


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k codes of ``table`` nearest to each of ``queries``.

    Both are tables (id, code).
    """
    spark = table.sparkSession
    nth = F.row_number().over(W.partitionBy("code").orderBy("id"))
    rows, rows_path = settle(table.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth"), "search-rows")
    open_, _ = settle(queries.filter("id IS NOT NULL AND code IS NOT NULL").select(F.col("code").alias("query"), F.lit(None).cast("int").alias("worst")).distinct(), "search-open")
    n = rows.count()
    segments = Segments(segment_widths(n, bits))
    splits, _ = settle(_splits(rows, open_, segments, bucket, block), "search-splits")
    splits = small(splits, BROADCAST_SPLITS)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * len(segments.widths) // 100_000))
    key = ["segment", "value", "part", "block"]

    def dealt(df: DataFrame, code: str) -> DataFrame:
        """Rows or probes with the part and block of their value where they meet."""
        df = df.join(splits, ["segment", "value"], "left")
        own = lambda many: F.pmod(F.xxhash64(code), F.coalesce(many, F.lit(1))).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.coalesce(many, F.lit(1)) - 1))
        if code == "code":
            df = df.withColumn("part", own(F.col("parts"))).withColumn("block", every(F.col("blocks")))
        else:
            df = df.withColumn("part", every(F.col("parts"))).withColumn("block", own(F.col("blocks")))
        return df.drop("parts", "blocks").repartition(tasks, *key)

    met, _ = settle(rows.select("id", "code", segments.exploded("code").alias("s")).select("id", "code", "s.segment", "s.value"), "search-segments")
    best, closed = None, []
    for radius in range(max(segments.widths) + 1):
        apart = F.col("query").bitwiseXOR(F.col("code"))
        found = dealt(probes(open_, segments, radius), "query").join(dealt(met, "code"), key)
        found = found.withColumn("distance", F.bit_count(apart)).filter(segments.first_meeting(apart, radius) & (F.col("worst").isNull() | (F.col("distance") <= F.col("worst"))))
        found = found.select("query", "id", "distance")
        if best is not None:
            found = found.unionByName(best.join(open_.select("query"), "query"))
        rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
        after, _ = settle(found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "search-best")
        seen = open_.select("query").join(after.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")), "query", "left")
        done = (F.coalesce("n", F.lit(0)) >= min(k, n)) & ((F.coalesce("far", F.lit(0)) < (radius + 1) * len(segments.widths)) | (F.coalesce("n", F.lit(0)) >= n))
        state, _ = settle(seen.select("query", F.when(F.col("n") >= k, F.col("far")).cast("int").alias("worst"), done.alias("done")), "search-state")
        closed.append(after.join(state.filter("done").select("query"), "query"))
        open_, best = state.filter("NOT done").drop("done"), after
        if open_.isEmpty():
            break
    answers = reduce(DataFrame.unionByName, closed)
    forget(spark, rows_path)
    return _listed(queries, answers)


def _listed(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers (query, id, distance) of every query row, ranked."""
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    ranked = answers.select("query", rank.cast("bigint").alias("rank"), F.col("id").alias("neighbor_id"), F.col("distance").cast("bigint").alias("distance"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asked.join(ranked, "query").select("query_id", "rank", "neighbor_id", "distance")
