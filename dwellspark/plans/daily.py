"""Ordered sessions, splits, daily vectors and their transitions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import time as ft
from ..operators import daily as dy
from ..sources import fleet
from .base import BIN_LABEL, CHARGES, DATE06, PIECES, SESSIONS, Family
from .inputs import _PERIOD, ordered, sessions

family = Family()
r6 = lambda c: F.round(c, 6).alias(c)
m6 = lambda c: F.round(F.col(c) + 2e-9, 6).alias(c)

PLACE_MINUTES = PIECES + ", pm AS (SELECT hashvin, date06, bin, session_cluster, sum(minutes) AS minutes FROM bins GROUP BY ALL)"
TOP = ", top AS (SELECT session_cluster, sum(duration_minutes) AS minutes FROM sessions GROUP BY 1 ORDER BY minutes DESC, session_cluster LIMIT 6)"
FOLDED = PLACE_MINUTES + TOP + """, folded AS (SELECT hashvin, date06, bin, coalesce(t.session_cluster, 'OTHER') AS place, sum(pm.minutes) AS minutes FROM pm LEFT
  JOIN top t ON t.session_cluster = pm.session_cluster GROUP BY ALL)"""
MOVES = (
    SESSIONS
    + f""", lw AS (SELECT hashvin, session_id, session_cluster AS from_place, lead(session_cluster) OVER w AS to_place, lead(start_time) OVER w AS moved_at
  FROM sessions WINDOW w AS (PARTITION BY hashvin ORDER BY start_time, session_id)),
moves AS (SELECT *, {DATE06.format('moved_at')} AS date06, {_PERIOD.format('moved_at')} AS period FROM lw WHERE to_place IS NOT NULL AND from_place <> to_place),
topmoves AS (SELECT from_place, to_place, count(*) AS n FROM moves GROUP BY ALL ORDER BY n DESC, from_place, to_place LIMIT 15)"""
)
#: Places of the registered daily vectors; the fixture has 15 in all.
K_PLACES = 6


def day_parts(spark, d):
    """Partitions of days, by the events' count, which Parquet's footers hold."""
    return dy.parts_of(fleet.table(spark, d, "events").count())


def folded(spark, d):
    stays = sessions(spark, d)
    return dy.folded_minutes(dy.place_minutes(stays, parts=day_parts(spark, d)), dy.top_places(stays, K_PLACES))


@family.query(f"WITH {PLACE_MINUTES} SELECT hashvin, date06, {BIN_LABEL.format('bin')} AS hour_bin, session_cluster, round(minutes + 2e-9, 6) AS minutes FROM pm")
def bin_place_minutes(spark, d):
    return dy.place_minutes(sessions(spark, d)).select("hashvin", "date06", ft.bin_label(F.col("bin")).alias("hour_bin"), "session_cluster", m6("minutes"))


@family.query(f"""WITH {CHARGES} SELECT session_uid, CAST(session_order AS BIGINT) AS session_order, hashvin, charge_start_time, prev_cluster, round(prev_lat,
  6) AS prev_lat, round(prev_lon, 6) AS prev_lon FROM split""")
def session_order(spark, d):
    return ordered(spark, d).select("session_uid", "session_order", "hashvin", "charge_start_time", "prev_cluster", r6("prev_lat"), r6("prev_lon"))


@family.query(f"WITH {CHARGES} SELECT session_uid, split AS split_70, split8 AS split_80 FROM split")
def chrono_split(spark, d):
    return ordered(spark, d).select("session_uid", F.col("split").alias("split_70"), F.col("split8").alias("split_80"))


@family.query(f"WITH {SESSIONS} SELECT session_cluster, round(sum(duration_minutes), 4) AS minutes FROM sessions GROUP BY 1 ORDER BY sum(duration_minutes) DESC, 1 LIMIT 20")
def top_places(spark, d):
    return dy.top_places(sessions(spark, d), 20).select("session_cluster", F.round("minutes", 4).alias("minutes"))


@family.query(f"WITH {MOVES} SELECT from_place, to_place, n FROM topmoves")
def top_transitions(spark, d):
    return dy.top_transitions(dy.place_transitions(sessions(spark, d)), 15)


@family.query(
    f"""WITH {FOLDED} SELECT hashvin, date06, {BIN_LABEL.format('bin')} AS hour_bin, place, round(minutes + 2e-9, 6) AS minutes,
  round(sum(minutes) OVER (PARTITION BY hashvin, date06) + 2e-9, 6) AS total_minutes, CAST(isodow(date06) - 1 AS INTEGER) AS weekday, 0 AS is_empty_day
  FROM folded"""
)
def full_vectors(spark, d):
    f = folded(spark, d)
    total = F.sum("minutes").over(W.partitionBy("hashvin", "date06"))
    return f.withColumn("total_minutes", total).select("hashvin", "date06", ft.bin_label(F.col("bin")).alias("hour_bin"), "place", m6("minutes"), m6("total_minutes"), ft.weekday("date06").alias("weekday"), (F.col("total_minutes") <= 0).cast("int").alias("is_empty_day"))


TOPK = (
    PIECES
    + """, sums AS (SELECT hashvin, date06, bin, session_cluster, sum(minutes) AS minutes, min(s) AS first FROM bins GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY hashvin, date06, bin ORDER BY minutes DESC, first, session_cluster) AS rank FROM sums),
frame AS (SELECT hashvin, date06, b.bin, r.rank FROM (SELECT DISTINCT hashvin, date06
  FROM bins), (SELECT CAST(unnest(range(24)) AS INTEGER) AS bin) b, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS rank) r),
topk AS (SELECT hashvin, date06, f.bin, f.rank, coalesce(session_cluster, '') AS place, coalesce(minutes, 0) AS minutes FROM frame f LEFT JOIN best b USING (hashvin, date06, bin, rank))"""
)


@family.query(f"WITH {TOPK} SELECT hashvin, date06, bin, rank, place, round(minutes + 2e-9, 6) AS minutes FROM topk")
def topk_vectors(spark, d):
    # the first start among pieces of one place decides ties, as in the SQL
    return dy.top_per_bin(sessions(spark, d), 3, parts=day_parts(spark, d)).select("hashvin", "date06", "bin", "rank", "place", m6("minutes"))


@family.query(
    f"""WITH {MOVES} SELECT hashvin, date06, count(*) AS n_moves, {', '.join(f"count(*) FILTER (WHERE period = '{p}') AS n_{p}" for p in ('morning', 'afternoon', 'evening', 'night'))},
CAST(len(list_distinct(list_concat(list(from_place), list(to_place)))) AS INTEGER) AS places FROM moves GROUP BY ALL"""
)
def transition_features(spark, d):
    return dy.transition_features(dy.place_transitions(sessions(spark, d)))


@family.query(f"WITH {FOLDED} SELECT hashvin, date06, bin, place, round(minutes / sum(minutes) OVER (PARTITION BY hashvin, date06), 6) AS ratio FROM folded")
def dwell_ratios(spark, d):
    return dy.dwell_ratios(folded(spark, d)).select("hashvin", "date06", "bin", "place", r6("ratio"))


@family.query(
    f"""WITH {FOLDED}, r AS (SELECT hashvin, date06, bin, minutes / sum(minutes) OVER (PARTITION BY hashvin, date06) AS ratio
  FROM folded), b AS (SELECT hashvin, date06, bin, sum(ratio) AS r FROM r GROUP BY ALL),
y AS (SELECT hashvin, date06, sum(r) AS row_sum, max(r) AS bin_max FROM b GROUP BY ALL)
  SELECT count(*) AS days, round(max(abs(row_sum - 1)), 6) AS max_gap, round(max(bin_max), 6) AS max_bin, max(abs(row_sum - 1)) <= 1e-3
  AND max(bin_max) <= 1 + 1e-9 AS ok FROM y"""
)
def vector_quality(spark, d):
    return dy.vector_quality(dy.dwell_ratios(folded(spark, d))).select("days", r6("max_gap"), r6("max_bin"), "ok")


@family.query(
    f"""SELECT count(*) AS n, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std, round(min(total), 6) AS min, round(quantile_cont(total, 0.25),
  6) AS q25, round(quantile_cont(total, 0.5), 6) AS q50, round(quantile_cont(total, 0.75), 6) AS q75, round(max(total), 6) AS max FROM (WITH {PLACE_MINUTES}
  SELECT hashvin, date06, sum(minutes) AS total FROM pm GROUP BY ALL)"""
)
def describe_vectors(spark, d):
    t = dy.day_totals(dy.place_minutes(sessions(spark, d))).withColumnRenamed("total_minutes", "total")
    q = lambda p: F.round(F.percentile("total", p), 6)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("mean"), F.round(F.stddev("total"), 6).alias("std"), F.round(F.min("total"), 6).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.round(F.max("total"), 6).alias("max"))


@family.query(f"WITH {MOVES} SELECT session_id, hashvin, from_place, to_place, moved_at, date06, period FROM moves")
def place_transitions(spark, d):
    return dy.place_transitions(sessions(spark, d)).select("session_id", "hashvin", "from_place", "to_place", "moved_at", "date06", "period")


@family.query(
    f"""WITH {MOVES}, days AS (SELECT DISTINCT hashvin, {DATE06.format('start_time')} AS date06 FROM sessions),
c AS (SELECT hashvin, date06, from_place, to_place, count(*) AS n FROM moves GROUP BY ALL)
SELECT d.hashvin, d.date06, t.from_place, t.to_place, coalesce(c.n, 0) AS n FROM days d CROSS JOIN topmoves t LEFT JOIN c ON c.hashvin = d.hashvin
  AND c.date06 = d.date06 AND c.from_place = t.from_place AND c.to_place = t.to_place"""
)
def day_transition_join(spark, d):
    stays = sessions(spark, d)
    moves = dy.place_transitions(stays)
    top = dy.top_transitions(moves, 15)
    days = stays.select("hashvin", ft.date06("start_time").alias("date06"))
    return dy.day_transitions(days, dy.transition_counts(moves, top), top)


@family.query(
    f"""WITH {FOLDED}, rr AS (SELECT *, sum(minutes) OVER (PARTITION BY hashvin, date06) AS total FROM folded)
SELECT hashvin, date06, bin, place, round(minutes + 2e-9, 6) AS minutes, round(minutes / total, 6) AS ratio, round(total + 2e-9, 6) AS total_minutes FROM rr"""
)
def daily_behavior_vectors(spark, d):
    return dy.dwell_ratios(folded(spark, d)).select("hashvin", "date06", "bin", "place", m6("minutes"), r6("ratio"), m6("total_minutes"))


@family.query(f"WITH {SESSIONS} SELECT session_id, hashvin, row_number() OVER (PARTITION BY hashvin ORDER BY start_time, session_id) AS number FROM sessions")
def session_number(spark, d):
    n = F.row_number().over(W.partitionBy("hashvin").orderBy("start_time", "session_id"))
    return sessions(spark, d).select("session_id", "hashvin", n.cast("bigint").alias("number"))


@family.query(f"WITH {CHARGES} SELECT session_id, hashvin, row_number() OVER (PARTITION BY hashvin ORDER BY charge_start_time, session_id) AS position FROM charges")
def time_order(spark, d):
    p = F.row_number().over(W.partitionBy("hashvin").orderBy("charge_start_time", "session_id"))
    return fleet.charges(sessions(spark, d)).select("session_id", "hashvin", p.cast("bigint").alias("position"))
