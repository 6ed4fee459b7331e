"""06:00 days: cutting stays, hour bins, place minutes, daily vectors and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time as ft

DAY = ["hashvin", "date06"]


def split_by_day06(stays: DataFrame) -> DataFrame:
    """Pieces (date06, s, e) of every stay; empty ones are dropped, other columns kept."""
    days = F.sequence(ft.date06("start_time"), ft.date06("end_time"), F.expr("INTERVAL '1' DAY"))
    out = stays.withColumn("date06", F.explode(days))
    out = out.withColumns({"s": F.greatest("start_time", "date06"), "e": F.least("end_time", F.expr("date06 + INTERVAL '1' DAY"))})
    return out.filter("s < e")


def hour_bins(pieces: DataFrame, size: int = 1) -> DataFrame:
    """Pieces by hour bin (index from 06:00) with the minutes that lie in it."""
    hours = lambda c: F.floor(F.expr(f"cast(cast({c} - date06 AS INTERVAL SECOND) AS DECIMAL(20,6))") / (3600 * size)).cast("int")
    last = F.least(hours("e"), F.lit(24 // size - 1))
    out = pieces.withColumn("bin", F.explode(F.sequence(hours("s"), last)))
    step = f"make_dt_interval(0, bin * {size})"
    out = out.withColumns({"bs": F.expr(f"greatest(s, date06 + {step})"), "be": F.expr(f"least(e, date06 + {step} + make_dt_interval(0, {size}))")})
    return out.filter("bs < be").withColumn("minutes", ft.minutes_between("bs", "be")).drop("bs", "be")


#: Stays of a partition of days, some; each makes a row per hour that it touches.
PART_STAYS = 10_000


def parts_of(stays: int) -> int:
    """Partitions for so many stays, so that a task's share does not grow with the table."""
    return max(1, -(-stays // PART_STAYS))


def dealt_days(stays: DataFrame, parts: int | None = None) -> DataFrame:
    """``split_by_day06`` with whole days in ``parts`` partitions (None: the session's), before pieces become hours; what is grouped by day next needs no shuffle."""
    return split_by_day06(stays).repartition(*([parts] if parts else []), *DAY)


def place_minutes(stays: DataFrame, size: int = 1, parts: int | None = None) -> DataFrame:
    """(hashvin, date06, bin, session_cluster, minutes)."""
    return hour_bins(dealt_days(stays, parts), size).groupBy(*DAY, "bin", "session_cluster").agg(F.sum("minutes").alias("minutes"))


def top_places(stays: DataFrame, k: int = 20) -> DataFrame:
    """(session_cluster, minutes): the fleet's places with most minutes."""
    return stays.groupBy("session_cluster").agg(F.sum("duration_minutes").alias("minutes")).orderBy(F.desc("minutes"), "session_cluster").limit(k)


def place_transitions(stays: DataFrame) -> DataFrame:
    """Consecutive stays of a vehicle at different places: when, from and to where."""
    w = W.partitionBy("hashvin").orderBy("start_time", "session_id")
    nxt = stays.select("session_id", "hashvin", F.col("session_cluster").alias("from_place"), F.lead("session_cluster").over(w).alias("to_place"), F.lead("start_time").over(w).alias("moved_at"))
    out = nxt.filter("to_place IS NOT NULL AND from_place <> to_place")
    return out.withColumns({"date06": ft.date06("moved_at"), "period": ft.period("moved_at")})


def top_transitions(moves: DataFrame, k: int = 15) -> DataFrame:
    return moves.groupBy("from_place", "to_place").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_place", "to_place").limit(k)


def folded_minutes(minutes: DataFrame, places: DataFrame) -> DataFrame:
    """``place_minutes`` with places outside ``places`` (a top-k table) folded to OTHER."""
    named = minutes.join(F.broadcast(places.select(F.col("session_cluster").alias("top"))), F.col("session_cluster") == F.col("top"), "left")
    return named.groupBy(*DAY, "bin", F.coalesce("top", F.lit("OTHER")).alias("place")).agg(F.sum("minutes").alias("minutes"))


def day_totals(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy(*DAY).agg(F.sum("minutes").alias("total_minutes"))


def wide_vectors(folded: DataFrame, places: list[str], size: int = 1) -> DataFrame:
    """A column of minutes per hour bin and place; for export only."""
    names = [f"{b}__{p}" for b in range(24 // size) for p in [*places, "OTHER"]]
    keyed = folded.withColumn("name", F.concat(F.col("bin").cast("string"), F.lit("__"), F.col("place")))
    return keyed.groupBy(*DAY).pivot("name", names).agg(F.sum("minutes")).na.fill(0.0)


def top_per_bin(stays: DataFrame, k: int = 3, size: int = 1, parts: int | None = None) -> DataFrame:
    """(hashvin, date06, bin, rank, place, minutes) for all bins and ranks of days with stays.

    Ties keep the place whose stay began first; missing ranks are ('', 0).
    """
    # one shuffle by day serves sums, ranks and the filling of what a day lacks
    cut = hour_bins(dealt_days(stays, parts), size)
    sums = cut.groupBy(*DAY, "bin", "session_cluster").agg(F.sum("minutes").alias("minutes"), F.min("s").alias("first"))
    w = W.partitionBy(*DAY, "bin").orderBy(F.desc("minutes"), "first", "session_cluster")
    best = sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    at = (F.col("bin") * k + F.col("rank") - 1).cast("int")
    days = best.groupBy(*DAY).agg(F.collect_list(F.struct(at.alias("at"), F.col("session_cluster").alias("place"), "minutes")).alias("held"))
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(24 // size * k - 1)), F.col("held.at"))
    filled = F.concat("held", F.transform(lacking, lambda i: F.struct(i.alias("at"), F.lit("").alias("place"), F.lit(0.0).alias("minutes"))))
    out = days.select(*DAY, F.explode(filled).alias("h"))
    return out.select(*DAY, F.expr(f"CAST(h.at div {k} AS INT)").alias("bin"), (F.col("h.at") % k + 1).alias("rank"), F.coalesce("h.place", F.lit("")).alias("place"), F.coalesce("h.minutes", F.lit(0.0)).alias("minutes"))


def transition_features(moves: DataFrame) -> DataFrame:
    """Per day: moves in all and by period, and distinct places at either end."""
    counts = {p: F.count_if(F.col("period") == p).alias(f"n_{p}") for p in ("morning", "afternoon", "evening", "night")}
    places = F.size(F.array_distinct(F.concat(F.collect_set("from_place"), F.collect_set("to_place")))).alias("places")
    return moves.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n_moves"), *counts.values(), places)


def transition_long(moves: DataFrame, top: DataFrame) -> DataFrame:
    """(hashvin, date06, feature, value) of days with moves: the count of every top transition, of moves by period and in all, and distinct places; only what is above 0."""
    named = transition_counts(moves, top).select(*DAY, F.concat(F.lit("trans__"), "from_place", F.lit("--"), "to_place").alias("feature"), F.col("n").cast("double").alias("value"))
    counts = {f"trans_count_{p}": f"n_{p}" for p in ("morning", "afternoon", "evening", "night")} | {"trans_count_total": "n_moves", "unique_clusters_visited": "places"}
    made = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(c).cast("double").alias("value")) for name, c in counts.items()])).alias("f")
    return named.unionByName(transition_features(moves).select(*DAY, made).select(*DAY, "f.*").filter("value > 0"))


def transition_counts(moves: DataFrame, top: DataFrame) -> DataFrame:
    return moves.join(F.broadcast(top.select("from_place", "to_place")), ["from_place", "to_place"]).groupBy(*DAY, "from_place", "to_place").agg(F.count(F.lit(1)).alias("n"))


def day_transitions(days: DataFrame, counts: DataFrame, top: DataFrame) -> DataFrame:
    """Every existing day with every top transition, 0 where it didn't occur."""
    frame = days.select(*DAY).distinct().crossJoin(F.broadcast(top.select("from_place", "to_place")))
    return frame.join(counts, [*DAY, "from_place", "to_place"], "left").na.fill(0, ["n"])


def dwell_ratios(folded: DataFrame, divide_other: bool = True) -> DataFrame:
    """minutes over the day's total; OTHER stays in minutes if not ``divide_other``."""
    total = F.sum("minutes").over(W.partitionBy(*DAY))
    ratio = F.when(total > 0, F.col("minutes") / total).otherwise(0.0)
    if not divide_other:
        ratio = F.when(F.col("place") == "OTHER", F.col("minutes")).otherwise(ratio)
    return folded.withColumns({"total_minutes": total, "ratio": ratio})


def vector_quality(ratios: DataFrame) -> DataFrame:
    """Days, the largest gap of a day's ratios from 1, the largest bin sum, and the verdict."""
    bins = ratios.groupBy(*DAY, "bin").agg(F.sum("ratio").alias("r"))
    days = bins.groupBy(*DAY).agg(F.sum("r").alias("row_sum"), F.max("r").alias("bin_max"))
    gap, most = F.max(F.abs(F.col("row_sum") - 1)), F.max("bin_max")
    return days.agg(F.count(F.lit(1)).alias("days"), gap.alias("max_gap"), most.alias("max_bin"), ((gap <= 1e-3) & (most <= 1 + 1e-9)).alias("ok"))
