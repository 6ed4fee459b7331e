"""Univariate series: lag vectors, rolling figures, filling, encodings and splits.

Series are keyed (``series``) so that windows never gather the whole table in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .patterns import work_folder, written


def _order(keys, t):
    return W.partitionBy(*keys).orderBy(t)


def lag_vectors(df: DataFrame, n: int, keys=("series",), t: str = "t", value: str = "value") -> DataFrame:
    """Rows with n values before them: ``lags`` (lag_1 is the oldest) and the value as ``target``."""
    lags = F.collect_list(value).over(_order(keys, t).rowsBetween(-n, -1))
    return df.select(*keys, t, lags.alias("lags"), F.col(value).alias("target")).filter(F.size("lags") == n)


def rolling_stats(df: DataFrame, n: int, keys=("series",), t: str = "t", value: str = "value") -> DataFrame:
    """Mean, population deviation, least, most and change of the n values before each row."""
    w = _order(keys, t).rowsBetween(-n, -1)
    out = df.select(
        "*", F.avg(value).over(w).alias("lag_mean"), F.stddev_pop(value).over(w).alias("lag_std"), F.min(value).over(w).alias("lag_min"), F.max(value).over(w).alias("lag_max"),
        (F.last(value).over(w) - F.first(value).over(w)).alias("lag_change"), F.count(value).over(w).alias("lag_count"), (F.row_number().over(_order(keys, t)) - 1).alias("i"),
    )
    return out.filter(F.col("lag_count") == n).withColumns({"month_index": F.col("i") % 12, "month": F.date_format(t, "yyyy-MM")})


def forward_fill(df: DataFrame, keys=("series",), t: str = "t", value: str = "value") -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(_order(keys, t).rowsBetween(W.unboundedPreceding, 0)))


def calendar(df: DataFrame, keys=("series",), t: str = "t") -> DataFrame:
    """Every day between a series' first and last, with the row's other columns or null."""
    span = df.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias(t))
    return span.join(df, [*keys, t], "left")


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with position (from 0, by ``order``) and total, the number of rows.

    Rows are dealt to ranges of all of ``order``, so equal first columns don't gather in one
    task; a position is that within its range plus the rows of earlier ranges.  The
    ranges are settled in the shared folder, since sampling them again could move them.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), work_folder(df))
    per = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row per range
    before = per.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("total"))
    place = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return dealt.join(before, "__p").withColumn("position", F.col("__before") + place - 1).drop("__p", "__before")


#: Bins of a histogram, and rows of a bin whose places are read off it by collecting them.
BINS, FEW_ROWS = 4096, 10_000


def order_statistics(df: DataFrame, places: list[int], first: str, second: str) -> list[tuple[int, int]]:
    """The pairs (first, second) at ``places`` (from 0) in the order of two whole-number columns, exactly.

    Histograms are refined until the bin of each place has few rows, which are collected:
    a scan per round for all places at once, no ordering of the table, and at most ``FEW_ROWS`` rows
    or ``BINS`` counts per place to the driver.  Columns without nulls are expected.
    """
    out: dict[int, tuple[int, int]] = {}
    whole = df.agg(F.min(first), F.max(first), F.min(second), F.max(second)).first()
    # place: (fixed first column or None, low, high of the column that is refined, places before low, rows within)
    todo = {p: (None, whole[0], whole[1], 0) for p in places}
    while todo:
        states = sorted(set(todo.values()), key=str)
        cases = []
        for i, (fixed, low, high, _) in enumerate(states):
            column = first if fixed is None else second
            here = F.col(column).between(low, high) if fixed is None else (F.col(first) == fixed) & F.col(column).between(low, high)
            width = -(-(high - low + 1) // BINS)
            cases.append(F.when(here, F.struct(F.lit(i).alias("state"), F.floor((F.col(column) - low) / width).cast("int").alias("bin"))))
        counts: dict[int, dict[int, int]] = {}
        for r in df.select(F.explode(F.array_compact(F.array(*cases))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r.c.state, {})[r.c.bin] = r.n
        after, read = {}, {}
        for place, state in todo.items():
            i = states.index(state)
            fixed, low, high, before = state
            width = -(-(high - low + 1) // BINS)
            for b in sorted(counts[i]):
                if place < before + counts[i][b]:
                    break
                before += counts[i][b]
            a, z = low + b * width, min(high, low + (b + 1) * width - 1)
            if counts[i][b] <= FEW_ROWS:
                read[place] = (fixed, a, z, before)
            elif a < z:
                after[place] = (fixed, a, z, before)
            elif fixed is None:
                after[place] = (a, whole[2], whole[3], before)
            else:
                out[place] = (fixed, a)  # rows that are equal in both columns
        for bounds in set(read.values()):
            fixed, a, z, before = bounds
            here = F.col(first).between(a, z) if fixed is None else (F.col(first) == fixed) & F.col(second).between(a, z)
            rows = sorted((r[0], r[1]) for r in df.filter(here).select(first, second).collect())
            out |= {p: rows[p - before] for p, x in read.items() if x == bounds}
        todo = after
    return [out[p] for p in places]


def time_cut_split(df: DataFrame, splits: dict[str, tuple[tuple[float, ...], tuple[str, ...]]], t: str = "t", tie: str = "id") -> DataFrame:
    """``df`` with a column per split (name: shares, names) by position in (t, tie) order of the whole table.

    The first floor(n * share) rows (1 at least) get the first name, and so on.  The rows
    at the cuts are selected, and others compared with them.  Rows equal in t and tie stay
    together; those without a time come first.
    """
    wall = df.schema[t].dataType.typeName() == "timestamp_ntz"  # no session zone may reorder wall-clock times
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{t}`)") if wall else F.unix_micros(F.col(t).cast("timestamp"))
    at = F.coalesce(micros, F.lit(-(1 << 62)))
    marked = df.withColumns({"__t": at, "__tie": F.col(tie).cast("bigint")})
    known = marked.filter(F.col(t).isNotNull()).select("__t", "__tie")
    n, absent = df.agg(F.count(F.lit(1)), F.count_if(F.col(t).isNull())).first()
    cuts = {}
    for name, (shares, names) in splits.items():
        total, places = 0.0, []
        for share in shares[:-1]:
            total += share
            places.append(max(1, math.floor(n * round(total, 9))))
        cuts[name] = places
    wanted = sorted({p - absent for places in cuts.values() for p in places if absent <= p < n})
    found = dict(zip(wanted, order_statistics(known, wanted, "__t", "__tie"))) if wanted else {}
    made = {}
    for name, (_, names) in splits.items():
        split = F.lit(names[-1])
        for place, label in reversed(list(zip(cuts[name], names))):
            if place >= n:
                split = F.lit(label)
            elif place < absent:
                split = F.when(F.col(t).isNull(), label).otherwise(split)
            else:
                ft, fi = found[place - absent]
                split = F.when((F.col("__t") < ft) | ((F.col("__t") == ft) & (F.col("__tie") < fi)), label).otherwise(split)
        made[name] = split
    return marked.withColumns(made).drop("__t", "__tie")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): positions of the distinct texts in order, from 0."""
    return positions(df.select(column).distinct(), column).select(column, F.col("position").alias("code"))


def target_means(train: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Mean target by key, and the mean of all."""
    return train.groupBy(key).agg(F.avg(target).alias("encoded")), train.agg(F.avg(target).alias("mean_all"))


def target_encode(rows: DataFrame, train: DataFrame, key: str, target: str) -> DataFrame:
    per, whole = target_means(train, key, target)
    return rows.join(per, key, "left").join(F.broadcast(whole)).withColumn("encoded", F.coalesce("encoded", "mean_all")).drop("mean_all")
