"""Place statistics of training charges and the lookups in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as ft
from ..operators import cleaning as cl
from ..operators import places as pl
from .base import CHARGES, Family
from .inputs import HAV, LONG_CUT, ordered, stays

family = Family()
r = lambda c, n=6: F.round(c, n).alias(c)
HOURS = "(epoch_us({1}) - epoch_us({0})) / 1e6 / 60 / 60"
DELAY = HOURS.format("charge_start_time", "inactive_start_time")
SLOT = "CAST(isodow({0}) - 1 AS INTEGER) AS dow, CAST(hour({0}) // 4 AS INTEGER) AS bin"
SLOTS7 = "(SELECT CAST(unnest(range(7)) AS INTEGER) AS dow) dd, (SELECT CAST(unnest(range(6)) AS INTEGER) AS bin) bb"

BASE = CHARGES + LONG_CUT + """, tr AS (SELECT * FROM split WHERE split = 'train'), places AS (SELECT DISTINCT hashvin, next_long_inactive_cluster AS place FROM tr)"""
CENTRES = BASE + """, own AS (SELECT hashvin, next_long_inactive_cluster AS place, median(inactive_lat) AS lat1, median(inactive_lon) AS lon1 FROM tr GROUP BY ALL),
rest AS (SELECT s.hashvin, session_cluster AS place, median(start_lat) AS lat2, median(start_lon) AS lon2 FROM sessions s JOIN cut USING (hashvin)
  WHERE session_type = 'inactive' AND start_time <= cutoff GROUP BY ALL),
centres AS (SELECT o.hashvin, o.place, coalesce(lat1, lat2) AS lat, coalesce(lon1, lon2) AS lon FROM own o LEFT JOIN rest USING (hashvin, place))"""
DELAYS = f""", hrs AS (SELECT hashvin, charge_cluster AS origin, next_long_inactive_cluster AS place, {DELAY} AS h FROM tr),
bp AS (SELECT hashvin, place, greatest(0.0::DOUBLE, least(24.0::DOUBLE, CASE WHEN count(h) >= 3 THEN median(h) ELSE any_value(a) END)) AS delay_h FROM hrs
  JOIN (SELECT hashvin, median(h) AS a FROM hrs GROUP BY 1) USING (hashvin) GROUP BY ALL),
bq AS (SELECT hashvin, origin, place, greatest(0.0::DOUBLE, least(24.0::DOUBLE, median(h))) AS delay_h FROM hrs GROUP BY ALL HAVING count(h) >= 2)"""
STARTS = f""", seen AS (SELECT hashvin, session_cluster AS place, {SLOT.format('start_time')}, count(*) AS n FROM long_cut GROUP BY ALL),
starts AS (SELECT hashvin, place, dow, bin, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY hashvin, place) AS p FROM (SELECT *
  FROM places, {SLOTS7}) LEFT JOIN seen USING (hashvin, place, dow, bin))"""
MOVED = f""", mv AS (SELECT hashvin, coalesce(prev_cluster, 'NONE') AS prev, {SLOT.format('charge_start_time')}, next_long_inactive_cluster AS target FROM tr),
counts AS (SELECT hashvin, 'prev_slot' AS level, prev, dow, bin, target, count(*) AS n FROM mv GROUP BY ALL UNION ALL SELECT hashvin, 'prev', prev, NULL, NULL, target, count(*) FROM mv GROUP BY ALL
UNION ALL SELECT hashvin, 'slot', NULL, dow, bin, target, count(*) FROM mv GROUP BY ALL UNION ALL SELECT hashvin, 'all', NULL, NULL, NULL, target, count(*) FROM mv GROUP BY ALL),
keys AS (SELECT DISTINCT hashvin, level, prev, dow, bin FROM counts), targets AS (SELECT hashvin, place AS target FROM places UNION SELECT hashvin, 'OTHER' FROM places),
tp AS (SELECT k.hashvin, k.level, k.prev, k.dow, k.bin, t.target, (coalesce(c.n, 0) + 1.0) / sum(coalesce(c.n, 0) + 1.0) OVER (PARTITION BY k.hashvin, k.level, k.prev, k.dow, k.bin) AS p
  FROM keys k JOIN targets t USING (hashvin) LEFT JOIN counts c ON c.hashvin = k.hashvin AND c.level = k.level AND c.prev IS NOT DISTINCT FROM k.prev
  AND c.dow IS NOT DISTINCT FROM k.dow AND c.bin IS NOT DISTINCT FROM k.bin AND c.target = t.target)"""
HEAD = """, ow AS (SELECT hashvin, next_long_inactive_cluster AS place, count(*) AS n, sum(inactive_time_minutes) / 60 AS hours, 'charge' AS source FROM tr GROUP BY ALL),
an AS (SELECT hashvin, session_cluster AS place, count(*) AS n, sum(duration_minutes) / 60 AS hours, 'any' AS source FROM long_cut GROUP BY ALL),
hd AS (SELECT * FROM ow UNION ALL SELECT a.* FROM an a WHERE a.hashvin IN (SELECT hashvin FROM ow) AND NOT EXISTS (SELECT 1 FROM ow o WHERE o.hashvin = a.hashvin AND o.place = a.place)),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hashvin ORDER BY source = 'any', n DESC, hours DESC, place) AS head_rank FROM hd) WHERE head_rank <= 5)"""
#: HEAD places per vehicle in the registered queries; the fixture has 8 labels.
HEAD_K = 5


def long_cut(spark, d):
    return cl.long_inactive(stays(spark, d), cl.train_cutoffs(ordered(spark, d)))


def centres(spark, d):
    rows = ordered(spark, d)
    return pl.centroids(rows, stays(spark, d), cl.train_cutoffs(rows))


def facts(spark, d):
    rows = ordered(spark, d)
    return pl.place_facts(rows, stays(spark, d), long_cut(spark, d), cl.train_cutoffs(rows))


def meters_to_centre():
    return geo.haversine_m(F.col("charge_lat"), F.col("charge_lon"), F.col("lat"), F.col("lon"))


def starts(spark, d):
    return pl.start_probability(long_cut(spark, d), pl.train_places(ordered(spark, d)))


def charges(spark, d, *more):
    """Every session with its place, the one before and its slot."""
    dow, b = ft.slot("charge_start_time", 4)
    return ordered(spark, d).select("session_uid", "hashvin", F.col("charge_cluster").alias("origin"), "charge_start_time", F.coalesce("prev_cluster", F.lit("NONE")).alias("prev"), dow.alias("dow"), b.alias("bin"), *more)


def pairs(spark, d):
    """Every session with each of its vehicle's training places, and the charge's slot."""
    return charges(spark, d).join(pl.train_places(ordered(spark, d)), "hashvin")


PAIRS = f""", prs AS (SELECT session_uid, s.hashvin, charge_cluster AS origin, charge_start_time, coalesce(prev_cluster, 'NONE') AS prev,
  {SLOT.format('charge_start_time')}, place FROM split s JOIN places USING (hashvin))"""


@family.query(
    f"""WITH {BASE}, g AS (SELECT hashvin, {HOURS.format('lag(charge_start_time) OVER w', 'charge_start_time')} / 24 AS gap FROM tr
  WINDOW w AS (PARTITION BY hashvin ORDER BY charge_start_time, session_id)) SELECT hashvin, round(CASE WHEN median(gap) > 0 THEN median(gap)
  ELSE 14.0 END, 6) AS interval_days FROM g GROUP BY 1"""
)
def charge_interval_median(spark, d):
    return pl.charge_interval(ordered(spark, d)).select("hashvin", r("interval_days"))


@family.query(f"WITH {BASE} SELECT * FROM places")
def train_places(spark, d):
    return pl.train_places(ordered(spark, d))


@family.query(f"WITH {CENTRES} SELECT hashvin, place, round(lat, 7) AS lat, round(lon, 7) AS lon FROM centres")
def centroids(spark, d):
    return centres(spark, d).select("hashvin", "place", r("lat", 7), r("lon", 7))


@family.query(f"WITH {BASE}{DELAYS} SELECT hashvin, '' AS origin, place, round(delay_h, 6) AS delay_h FROM bp UNION ALL SELECT hashvin, origin, place, round(delay_h, 6) FROM bq")
def delays(spark, d):
    rows = ordered(spark, d)
    both = pl.place_delays(rows).withColumn("origin", F.lit("")).unionByName(pl.pair_delays(rows))
    return both.select("hashvin", "origin", "place", r("delay_h"))


@family.query(f"WITH {BASE}{STARTS} SELECT hashvin, place, dow, bin, round(p, 6) AS p FROM starts")
def start_probability(spark, d):
    return starts(spark, d).select("hashvin", "place", "dow", "bin", r("p"))


@family.query(f"WITH {BASE}{MOVED} SELECT hashvin, level, prev, dow, bin, target, round(p, 6) AS p FROM tp")
def transition_probability(spark, d):
    return pl.transition_probability(ordered(spark, d)).select("hashvin", "level", "prev", "dow", "bin", "target", r("p"))


@family.query(f"WITH {BASE} SELECT hashvin, round(1.0 / (count(*) + 1), 6) AS p FROM places GROUP BY 1")
def uniform_transition(spark, d):
    return pl.uniform_transition(ordered(spark, d)).select("hashvin", r("p"))


@family.query(f"WITH {BASE}{HEAD} SELECT hashvin, head_rank, place, source, n, round(hours, 4) AS hours FROM head")
def head_clusters(spark, d):
    return pl.head_places(ordered(spark, d), long_cut(spark, d), HEAD_K).select("hashvin", "head_rank", "place", "source", "n", r("hours", 4))


@family.query(
    f"""WITH {BASE}, c AS (SELECT hashvin, session_cluster AS place, count(*) AS n FROM long_cut GROUP BY ALL) SELECT *
  FROM (SELECT hashvin, place, n, row_number() OVER (PARTITION BY hashvin ORDER BY n DESC, place) AS rank FROM c) WHERE rank <= 18"""
)
def frequent_long_stay(spark, d):
    return pl.frequent_long_stay(long_cut(spark, d), 18)


NEAR = f""", near AS (SELECT session_uid, s.hashvin, place, {HAV.format('charge_lat', 'charge_lon', 'lat', 'lon')} AS meters FROM split s
  JOIN centres USING (hashvin)), nearest AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY round(meters, 3), place) - 1 AS distance_order
  FROM near WHERE meters IS NOT NULL)"""


@family.query(f"WITH {CENTRES}{NEAR} SELECT session_uid, place, round(meters, 3) AS meters, distance_order FROM nearest")
def nearest_places(spark, d):
    return pl.nearest_places(ordered(spark, d), centres(spark, d), F.round(meters_to_centre(), 3)).select("session_uid", "place", "meters", F.col("distance_order").cast("bigint").alias("distance_order"))


RESOLVED = ", rs AS (SELECT p.*, coalesce(q.delay_h, b.delay_h, 0) AS delay_h FROM prs p LEFT JOIN bq q USING (hashvin, origin, place) LEFT JOIN bp b USING (hashvin, place))"


@family.query(f"WITH {BASE}{DELAYS}{PAIRS}{RESOLVED} SELECT session_uid, place, round(delay_h, 6) AS delay_h FROM rs")
def resolve_delay(spark, d):
    rows = ordered(spark, d)
    return pl.resolve_delay(pairs(spark, d), pl.pair_delays(rows), pl.place_delays(rows)).select("session_uid", "place", r("delay_h"))


RANKING = """, lr AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM keys k WHERE k.level = 'prev_slot' AND k.hashvin = p.hashvin AND k.prev = p.prev
  AND k.dow = p.dow AND k.bin = p.bin) THEN t1.p ELSE t2.p END AS a, t3.p AS b, t4.p AS c FROM prs p
LEFT JOIN tp t1 ON t1.level = 'prev_slot' AND t1.hashvin = p.hashvin AND t1.prev = p.prev AND t1.dow = p.dow AND t1.bin = p.bin AND t1.target = p.place
LEFT JOIN tp t2 ON t2.level = 'prev' AND t2.hashvin = p.hashvin AND t2.prev = p.prev AND t2.target = p.place
LEFT JOIN tp t3 ON t3.level = 'slot' AND t3.hashvin = p.hashvin AND t3.dow = p.dow AND t3.bin = p.bin AND t3.target = p.place
LEFT JOIN tp t4 ON t4.level = 'all' AND t4.hashvin = p.hashvin AND t4.target = p.place)"""


@family.query(f"WITH {BASE}{MOVED}{PAIRS}{RANKING} SELECT session_uid, place, round(coalesce(a, b, c, 0), 6) AS transition_p FROM lr")
def transition_lookup_ranking(spark, d):
    p = pl.with_transitions(charges(spark, d), ordered(spark, d)).join(pl.train_places(ordered(spark, d)), "hashvin")
    return p.withColumn("transition_p", pl.transition_share()).select("session_uid", "place", r("transition_p"))


#: Sessions with their HEAD places, and the level that the multiclass lookup reads.
HEADED = f""", hp AS (SELECT session_uid, s.hashvin, charge_cluster AS origin, charge_start_time, coalesce(prev_cluster, 'NONE') AS prev,
  {SLOT.format('charge_start_time')}, place, head_rank FROM split s JOIN head USING (hashvin)),
lv AS (SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM keys k WHERE k.level = 'prev' AND k.hashvin = h.hashvin AND k.prev = h.prev)
    THEN CASE WHEN EXISTS (SELECT 1 FROM keys k WHERE k.level = 'prev_slot' AND k.hashvin = h.hashvin AND k.prev = h.prev AND k.dow = h.dow AND k.bin = h.bin) THEN 'prev_slot' ELSE 'prev' END
    ELSE CASE WHEN EXISTS (SELECT 1 FROM keys k WHERE k.level = 'slot' AND k.hashvin = h.hashvin AND k.dow = h.dow AND k.bin = h.bin) THEN 'slot' ELSE 'all' END END AS at_level FROM hp h),
ml AS (SELECT l.*, coalesce(a.p, b.p, 1.0 / 5) AS transition_p FROM lv l
 LEFT JOIN tp a ON a.hashvin = l.hashvin AND a.level = at_level AND a.target = l.place AND a.prev IS NOT DISTINCT FROM CASE
  WHEN at_level LIKE 'prev%' THEN l.prev END AND a.dow IS NOT DISTINCT FROM CASE WHEN at_level LIKE '%slot' THEN l.dow END AND a.bin IS NOT DISTINCT FROM CASE
  WHEN at_level LIKE '%slot' THEN l.bin END
 LEFT JOIN tp b ON b.hashvin = l.hashvin AND b.level = at_level AND b.target = 'OTHER' AND b.prev IS NOT DISTINCT FROM CASE
  WHEN at_level LIKE 'prev%' THEN l.prev END AND b.dow IS NOT DISTINCT FROM CASE WHEN at_level LIKE '%slot' THEN l.dow END AND b.bin IS NOT DISTINCT FROM CASE
  WHEN at_level LIKE '%slot' THEN l.bin END)"""


def heads(spark, d):
    return pl.head_places(ordered(spark, d), long_cut(spark, d), HEAD_K)


def head_charges(spark, d):
    """``charges`` with what features of HEAD places ask of a charge."""
    return charges(spark, d, "session_order", "charge_lat", "charge_lon")


def head_pairs(spark, d):
    """Every session with each of its vehicle's HEAD places."""
    return head_charges(spark, d).join(heads(spark, d).select("hashvin", "place", "head_rank"), "hashvin")


@family.query(f"WITH {BASE}{MOVED}{HEAD}{HEADED} SELECT session_uid, place, round(transition_p, 6) AS transition_p FROM ml")
def transition_lookup_multiclass(spark, d):
    p = pl.with_transitions(head_charges(spark, d), ordered(spark, d)).join(heads(spark, d).select("hashvin", "place"), "hashvin")
    return p.withColumn("transition_p", F.coalesce(pl.transition_share(), F.lit(1.0 / HEAD_K))).select("session_uid", "place", r("transition_p"))


ARRIVED = """, ar AS (SELECT r.*, charge_start_time + to_microseconds(CAST(round(delay_h * 3600, 6) * 1000000 AS BIGINT)) AS arrive FROM rs r),
tc AS (SELECT a.session_uid, a.place, coalesce(s.p, 0) AS time_compat FROM ar a LEFT JOIN starts s ON s.hashvin = a.hashvin AND s.place = a.place
  AND s.dow = isodow(arrive) - 1 AND s.bin = hour(arrive) // 4)"""


@family.query(f"WITH {BASE}{DELAYS}{STARTS}{PAIRS}{RESOLVED}{ARRIVED} SELECT session_uid, place, round(time_compat, 6) AS time_compat FROM tc")
def time_compat_ranking(spark, d):
    p = pairs(spark, d).join(facts(spark, d), ["hashvin", "place"], "left")
    return pl.time_compat_ranking(p).select("session_uid", "place", r("time_compat"))


COMPAT = """, hr AS (SELECT h.*, h.charge_start_time + to_microseconds(CAST(round(coalesce(q.delay_h, b.delay_h, 0) * 3600, 6) * 1000000 AS BIGINT)) AS arrive
  FROM hp h LEFT JOIN bq q USING (hashvin, origin, place) LEFT JOIN bp b USING (hashvin, place)),
mc AS (SELECT h.session_uid, h.place, 0.75 * coalesce(a.p, 1.0 / 42) + 0.25 * coalesce(b.p, 1.0 / 42) AS time_compat FROM hr h
LEFT JOIN starts a ON a.hashvin = h.hashvin AND a.place = h.place AND a.dow = isodow(arrive) - 1 AND a.bin = hour(arrive) // 4
LEFT JOIN starts b ON b.hashvin = h.hashvin AND b.place = h.place AND b.dow = isodow(arrive) - 1 AND b.bin = (hour(arrive) // 4 + 5) % 6)"""


@family.query(f"WITH {BASE}{MOVED}{DELAYS}{STARTS}{HEAD}{HEADED}{COMPAT} SELECT session_uid, place, round(time_compat, 6) AS time_compat FROM mc")
def time_compat_multiclass(spark, d):
    p = head_pairs(spark, d).join(facts(spark, d), ["hashvin", "place"], "left")
    return pl.time_compat_multiclass(p).select("session_uid", "place", r("time_compat"))


@family.query(f"""WITH {BASE}{HEAD} SELECT session_uid, CASE WHEN place IS NULL THEN 'OTHER' ELSE next_long_inactive_cluster END AS y_class FROM split s LEFT
  JOIN head h ON h.hashvin = s.hashvin AND h.place = s.next_long_inactive_cluster""")
def label_or_other(spark, d):
    return labels(spark, d).select("session_uid", "y_class")


def labels(spark, d):
    rows = ordered(spark, d)
    head = pl.head_places(rows, long_cut(spark, d), HEAD_K).select("hashvin", F.col("place").alias(pl.LABEL), F.lit(True).alias("in_head"))
    return rows.join(head, ["hashvin", pl.LABEL], "left").withColumn("y_class", F.when(F.col("in_head"), F.col(pl.LABEL)).otherwise("OTHER"))


@family.query(
    f"""WITH {CENTRES}{STARTS}{DELAYS}{HEAD}, oa AS (SELECT hashvin, place, n, hours FROM hd WHERE source = 'charge')
SELECT h.hashvin, h.head_rank, h.place, CASE h.source WHEN 'charge' THEN 'after_charge'
  ELSE 'anytime' END AS source, coalesce(oa.n, 0) AS n_after_charge, round(coalesce(oa.hours, 0), 4) AS hours_after_charge,
       coalesce(an.n, 0) AS n_any, round(coalesce(an.hours, 0), 4) AS hours_any, round(c.lat, 7) AS lat, round(c.lon, 7) AS lon, round(coalesce(bp.delay_h, 0),
  6) AS delay_h, s.dow, s.bin, round(s.p, 6) AS p
FROM head h LEFT JOIN oa USING (hashvin, place) LEFT JOIN an USING (hashvin, place) LEFT JOIN centres c USING (hashvin, place) LEFT
  JOIN bp USING (hashvin, place) LEFT JOIN starts s USING (hashvin, place)"""
)
def head_details_json(spark, d):
    """Flattened HEAD details; ``sinks.head_details`` writes them as JSON documents."""
    rows, long = ordered(spark, d), long_cut(spark, d)
    head = pl.head_places(rows, long, HEAD_K).select("hashvin", "head_rank", "place")
    after = pl.train(rows).groupBy("hashvin", F.col(pl.LABEL).alias("place")).agg(F.count(F.lit(1)).alias("n_after_charge"), (F.sum("inactive_time_minutes") / 60).alias("hours_after_charge"))
    anytime = long.groupBy("hashvin", F.col("session_cluster").alias("place")).agg(F.count(F.lit(1)).alias("n_any"), (F.sum("duration_minutes") / 60).alias("hours_any"))
    out = head
    for facts in (after, anytime, centres(spark, d), pl.place_delays(rows), starts(spark, d)):
        out = out.join(facts, ["hashvin", "place"], "left")
    source = F.when(F.col("n_after_charge").isNotNull(), "after_charge").otherwise("anytime").alias("source")
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n).alias(c)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_after_charge", "n_any")]
    return out.select("hashvin", "head_rank", "place", source, *counts, zero("hours_after_charge", 4), zero("hours_any", 4), r("lat", 7), r("lon", 7), zero("delay_h", 6), "dow", "bin", r("p"))
