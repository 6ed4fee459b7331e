"""Visit history, adaptive windows and candidate places of every charge.

What a charge knows of earlier charges depends on rows before it only.  Stays of the last
days meet it in an equi-join on vehicle and bucket of days, its last stays come from one
ordered pass over the vehicle, and the last visit to a place is a running maximum; no
charge is joined with its vehicle's whole history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time as ft
from .places import LABEL

TOP_K, MIN_PLACES, MIN_STAYS, RECENT = 6, 4, 8, 10
SHORTEST, LONGEST, GROWTH = 7.0, 56.0, 1.5
NEVER_HOURS = 1e6


def reference() -> Column:
    return F.coalesce("charge_end_time", "charge_start_time")


def in_days(asks: DataFrame, seen: DataFrame, keys: list[str], days: float) -> DataFrame:
    """Pairs of asks (keys, order, at) and earlier events (keys, e_order, began, event_time) by keys and time.

    Holds all pairs with e_order < order and event_time at ``days`` before ``at`` or later, and
    some older ones.  An event is in the buckets of ``days`` days from its charge (``began``,
    no later than any later ask) to the one after its time, an ask in one bucket.
    """
    bucket = lambda c: F.floor(ft.epoch_seconds(c) / (days * 86400))
    asks = asks.withColumn("bucket", bucket("at"))
    first, last = F.least(bucket("began"), bucket("event_time")), bucket("event_time") + 1
    seen = seen.withColumn("bucket", F.explode(F.sequence(first, last)))
    return asks.join(seen, [*keys, "bucket"]).filter("e_order < order").drop("bucket", "began")


def history(rows: DataFrame, days: float = LONGEST) -> DataFrame:
    """Each session with the earlier events of its vehicle in the last ``days`` days: session_uid, place, event_time, age_days."""
    at = F.coalesce("inactive_start_time", "charge_end_time")
    seen = rows.select("hashvin", F.col("session_order").alias("e_order"), F.col(LABEL).alias("place"), F.col("charge_start_time").alias("began"), at.alias("event_time")).filter("event_time IS NOT NULL")
    asks = rows.select("session_uid", "hashvin", F.col("session_order").alias("order"), reference().alias("at"))
    out = in_days(asks, seen, ["hashvin"], days).withColumn("age_days", ft.hours_between("event_time", "at") / 24)
    return out.filter(F.col("age_days") <= days).select("session_uid", "place", "event_time", "age_days")


def history_in_window(rows: DataFrame, days: float) -> DataFrame:
    """(session_uid, place, n): earlier stays not older than ``days`` at the reference time."""
    return history(rows, days).groupBy("session_uid", "place").agg(F.count(F.lit(1)).alias("n"))


def last_events(rows: DataFrame, n: int = RECENT) -> DataFrame:
    """(session_uid, place, back): the last ``n`` registered stays before each session, newest first from 1."""
    place = F.when(F.coalesce("inactive_start_time", "charge_end_time").isNotNull(), F.col(LABEL))
    marked = rows.select("session_uid", "hashvin", "session_order", place.alias("stay"))
    back = [F.expr(f"lag(stay, {i}) IGNORE NULLS OVER (PARTITION BY hashvin ORDER BY session_order)") for i in range(1, n + 1)]
    return marked.select("session_uid", F.array(*back).alias("stays")).select("session_uid", F.posexplode("stays").alias("i", "place")).filter("place IS NOT NULL").select("session_uid", "place", (F.col("i") + 1).alias("back"))


def last_visit(asks: DataFrame, seen: DataFrame, keys: list[str], latest: Column) -> DataFrame:
    """``asks`` (keys, order, ...) with ``last``: ``latest``, a running aggregate of event_time over earlier events.

    seen: (keys, e_order, event_time).  One ordered pass over both by keys.
    """
    both = asks.withColumns({"event_time": F.lit(None).cast("timestamp_ntz"), "is_event": F.lit(0)}).unionByName(
        seen.select(*keys, F.col("e_order").alias("order"), "event_time", F.lit(1).alias("is_event")), allowMissingColumns=True
    )
    before = W.partitionBy(*keys).orderBy("order", "is_event").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("last", latest.over(before)).filter("is_event = 0").drop("event_time", "is_event")


def ladder(base_days: Column) -> Column:
    """Growing windows: base * 1.5**j within 7 and 56 days, up to the first that is 56."""
    last = F.greatest(F.lit(0), F.ceil(F.log(F.lit(LONGEST) / base_days) / F.log(F.lit(GROWTH)) - 1e-9)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), base_days * F.pow(F.lit(GROWTH), j))))


def adaptive_windows(rows: DataFrame, intervals: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """(session_uid, window_days, stays_in_window).

    The window is the first with ``MIN_PLACES`` places and ``MIN_STAYS`` stays, else the last.
    """
    past = history(rows) if past is None else past
    steps = rows.select("session_uid", "hashvin").join(intervals, "hashvin").withColumn("steps", ladder(F.col("interval_days"))).drop("interval_days")
    level = F.size(F.filter("steps", lambda w: w < F.col("age_days")))
    levelled = past.join(steps.drop("hashvin"), "session_uid").withColumn("level", level)
    per = levelled.groupBy("session_uid", "place", "level").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("level") == F.min("level").over(W.partitionBy("session_uid", "place"))
    by = per.withColumn("new", first.cast("int")).groupBy("session_uid", "level").agg(F.sum("n").alias("stays"), F.sum("new").alias("places"))
    up = W.partitionBy("session_uid").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    sums = by.withColumns({"stays": F.sum("stays").over(up), "places": F.sum("places").over(up)})
    enough = (F.col("stays") >= MIN_STAYS) & (F.col("places") >= MIN_PLACES)
    found = sums.groupBy("session_uid").agg(F.min(F.when(enough, F.col("level"))).alias("met"), F.array_sort(F.collect_list(F.struct("level", "stays"))).alias("sums"))
    out = steps.join(found, "session_uid", "left").withColumn("chosen", F.least(F.coalesce("met", F.size("steps") - 1), F.size("steps") - 1))
    held = F.coalesce(F.array_max(F.transform(F.filter("sums", lambda s: s["level"] <= F.col("chosen")), lambda s: s["stays"])), F.lit(0))
    return out.select("session_uid", F.element_at("steps", F.col("chosen") + 1).alias("window_days"), held.cast("bigint").alias("stays_in_window"))


def recent_places(rows: DataFrame, n: int = RECENT) -> DataFrame:
    """(session_uid, recent_rank, place): distinct places of the last n events, newest first."""
    last = last_events(rows, n).groupBy("session_uid", "place").agg(F.min("back").alias("back"))
    return last.select("session_uid", F.row_number().over(W.partitionBy("session_uid").orderBy("back")).alias("recent_rank"), "place")


def candidates(rows: DataFrame, intervals: DataFrame, nearest: DataFrame, include_truth: str = "all") -> DataFrame:
    """Up to ``TOP_K`` candidate places per session, with their evidence.

    Places in the adaptive window, then recent ones, then the nearest others, and the true
    place (``include_truth``: all, train or none).
    """
    past = history(rows)
    windows = adaptive_windows(rows, intervals, past)
    per = past.join(windows.select("session_uid", "window_days"), "session_uid").filter("age_days <= window_days").groupBy("session_uid", "place").agg(F.count(F.lit(1)).alias("freq"))
    truth = rows.select("session_uid", F.col(LABEL).alias("place"), "split")
    truth = truth.filter("split = 'train'") if include_truth == "train" else truth.filter("false") if include_truth == "none" else truth
    told = [per, last_events(rows).select("session_uid", "place", F.lit(True).alias("recent")), nearest.select("session_uid", "place", "distance_order"), truth.select("session_uid", "place", F.lit(True).alias("is_truth"))]
    # all that is told of a session's places meets in one shuffle by session, which the windows below share
    known = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), told).repartition("session_uid").groupBy("session_uid", "place")
    known = known.agg(F.max("freq").alias("freq"), F.max("recent").alias("recent"), F.min("distance_order").alias("distance_order"), F.coalesce(F.max("is_truth"), F.lit(False)).alias("is_truth"))
    known = known.withColumn("listed", F.when(F.col("freq") > 0, "window").when(F.col("recent"), "recent"))
    all_, rest = W.partitionBy("session_uid"), F.col("listed").isNull() & F.col("distance_order").isNotNull()
    known = known.withColumns({"have": F.count("listed").over(all_), "order": F.when(rest, F.row_number().over(all_.orderBy(F.when(rest, 0).otherwise(1), "distance_order")))})
    near = F.col("order") <= F.greatest(F.lit(1), TOP_K - F.col("have"))
    named = known.select(
        "session_uid", "place", F.coalesce("listed", F.when(near, "fallback"), F.when(F.col("is_truth"), "label")).alias("source"), F.when(near, F.col("order")).alias("distance_order"), "is_truth", F.coalesce("freq", F.lit(0)).alias("freq")
    ).filter("source IS NOT NULL")
    me = rows.select("session_uid", "hashvin", F.col("session_order").alias("order"), reference().alias("ref")).join(windows, "session_uid")
    seen = rows.select("hashvin", F.col(LABEL).alias("place"), F.col("session_order").alias("e_order"), F.coalesce("inactive_start_time", "charge_end_time").alias("event_time"))
    visited = last_visit(named.join(me, "session_uid"), seen.filter("event_time IS NOT NULL"), ["hashvin", "place"], F.max("event_time")).drop("hashvin", "order")
    hours = ft.hours_between("last", "ref")
    full = visited.withColumn("recency_hours", F.coalesce(F.when(hours >= 0, hours), F.lit(NEVER_HOURS))).drop("last", "ref")
    full = full.withColumn("in_window", F.col("source").isin("window", "label"))
    order = [F.desc("is_truth"), F.when(F.col("source") == "window", 0).otherwise(1), F.desc("freq"), "recency_hours", F.coalesce("distance_order", F.lit(9999)), "place"]
    return full.withColumn("rank", F.row_number().over(W.partitionBy("session_uid").orderBy(*order))).filter(F.col("rank") <= TOP_K)


def place_visits(rows: DataFrame, pairs: DataFrame, days: int = 90, alpha: float = 1.0, never: float = NEVER_HOURS, split: str = "split") -> DataFrame:
    """``pairs`` (session_uid, hashvin, place) with freq (+ alpha) within ``days`` before the charge and hours since the last registered visit.

    Of a place's earlier stays, those before the ``days`` are taken off: two running counts over charges and stays
    by vehicle and place, so no charge meets its vehicle's stays one by one.
    """
    span = F.expr(f"INTERVAL '{days}' DAY")
    absent = [c for c in ("session_order", "charge_start_time") if c not in pairs.columns]
    asks = pairs.join(rows.select("session_uid", *absent), "session_uid") if absent else pairs
    asks = asks.withColumns({"__order": F.col("session_order"), "__at": F.col("charge_start_time"), "__cut": F.col("charge_start_time") - span, "__event": F.lit(None).cast("timestamp_ntz"), "__is": F.lit(0)})
    # a stay counts from its charge on; one that lies ``days`` before some charge up to its own can't be told by the two counts below
    so_far = F.max("charge_start_time").over(W.partitionBy("hashvin").orderBy("session_order").rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("__odd", F.col("inactive_start_time") < so_far - span).filter((F.col(split) == "train") & F.col("inactive_start_time").isNotNull())
    seen = kept.select("hashvin", F.col(LABEL).alias("place"), F.col("session_order").alias("__order"), F.col("inactive_start_time").alias("__event"), F.lit(1).alias("__is"), "__odd")
    odd, key = seen.filter("__odd"), W.partitionBy("hashvin", "place")
    both = asks.unionByName(seen.drop("__odd").withColumn("__cut", F.col("__event")), allowMissingColumns=True)
    before, older = (key.orderBy(by, "__is").rowsBetween(W.unboundedPreceding, 0) for by in ("__order", "__cut"))
    both = both.withColumns({"__last": F.last("__event", ignorenulls=True).over(before), "__n": F.count("__event").over(before)}).withColumn("__n", F.col("__n") - F.count("__event").over(older))
    out = both.filter("__is = 0")
    if not odd.isEmpty():
        late = odd.select("hashvin", "place", F.col("__order").alias("__o"), F.col("__event").alias("__e"))
        late = asks.join(late, ["hashvin", "place"]).filter("__o >= __order AND __e < __cut").groupBy("session_uid", "place").agg(F.count(F.lit(1)).alias("__late"))
        out = out.join(late, ["session_uid", "place"], "left").withColumn("__n", F.col("__n") + F.coalesce("__late", F.lit(0)))
    n = F.when(F.col("__at").isNotNull(), F.col("__n")).otherwise(0)
    recency = F.when(F.col("__last").isNotNull(), F.greatest(F.lit(0.0), ft.hours_between("__last", "__at"))).otherwise(never)
    return out.select(*pairs.columns, (n + F.lit(alpha)).alias("freq"), recency.alias("recency_hours"))


def daily_bins(rows: DataFrame, stays: DataFrame, mode: str = "calendar", size: int = 6) -> DataFrame:
    """(session_uid, bin, place, minutes): the place with most minutes in each bin before the charge.

    calendar: bins of the charge's day from 00:00, those not yet begun are empty; rolling:
    bins of the 24 hours before.  Empty bins are ('unknown', 0); ties keep the place that
    began first.
    """
    n = 24 // size
    start = F.expr("charge_start_time - INTERVAL '24' HOUR") if mode == "rolling" else ft.midnight("charge_start_time")
    base = rows.select("session_uid", "hashvin", "charge_start_time", start.alias("w0"))
    bins = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    bins = bins.withColumns({"b0": F.expr(f"w0 + make_dt_interval(0, bin * {size})"), "b1": F.expr(f"least(charge_start_time, w0 + make_dt_interval(0, (bin + 1) * {size}))")})
    days = F.sequence(F.to_date("b0"), F.to_date("b1"))
    asked = bins.filter("b0 < b1").select("session_uid", "hashvin", "bin", "b0", "b1", F.explode(days).alias("day"))
    lain = stays.select("hashvin", F.col("session_cluster").alias("place"), "start_time", "end_time", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))).alias("day"))
    both = asked.join(lain, ["hashvin", "day"])
    midnight, next_midnight = F.col("day").cast("timestamp_ntz"), F.expr("cast(day AS timestamp_ntz) + INTERVAL '1' DAY")
    both = both.withColumns({"o0": F.greatest("b0", "start_time", midnight), "o1": F.least("b1", "end_time", next_midnight)}).filter("o0 < o1")
    sums = both.groupBy("session_uid", "bin", "place").agg(F.sum(ft.minutes_between("o0", "o1")).alias("minutes"), F.min("start_time").alias("first"))
    best = sums.withColumn("r", F.row_number().over(W.partitionBy("session_uid", "bin").orderBy(F.desc(F.round(F.col("minutes") + 2e-9, 6)), "first", "place"))).filter("r = 1")
    out = bins.select("session_uid", "bin").join(best, ["session_uid", "bin"], "left")
    return out.select("session_uid", "bin", F.coalesce("place", F.lit("unknown")).alias("place"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def wide_bins(bins: DataFrame, n: int = 4) -> DataFrame:
    """One row per session: daily_bin_{i}_place and daily_bin_{i}_minutes."""
    return bins.groupBy("session_uid").agg(*[x for i in range(n) for x in (F.max(F.when(F.col("bin") == i, F.col("place"))).alias(f"daily_bin_{i}_place"), F.max(F.when(F.col("bin") == i, F.col("minutes"))).alias(f"daily_bin_{i}_minutes"))])
