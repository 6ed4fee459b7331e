"""History, adaptive windows, candidates and the scoring tables built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as ft
from ..operators import candidates as cd
from ..operators import cleaning as cl
from ..operators import places as pl
from .base import Family
from .inputs import EAST, HAV, KINDS, NORTH, ONEHOT, STATIONS, ordered, stays
from .places import ARRIVED, BASE, CENTRES, COMPAT, DELAYS, HEAD, HEADED, HOURS, HEAD_K, MOVED, NEAR, PAIRS, RANKING, RESOLVED, STARTS, centres, facts, head_charges, head_pairs, heads, labels, meters_to_centre

family = Family()
r = lambda c, n=6: F.round(c, n).alias(c)

PAST = """, evs AS (SELECT hashvin, session_order AS e_order, next_long_inactive_cluster AS place, coalesce(inactive_start_time, charge_end_time) AS event_time
  FROM split WHERE coalesce(inactive_start_time, charge_end_time) IS NOT NULL),
past AS (SELECT session_uid, s.hashvin, coalesce(charge_end_time, charge_start_time) AS ref, place, event_time, (epoch_us(coalesce(charge_end_time,
  charge_start_time)) - epoch_us(event_time)) / 1e6 / 60 / 60 / 24 AS age_days,
  row_number() OVER (PARTITION BY session_uid ORDER BY e_order DESC) AS back FROM split s JOIN evs e ON e.hashvin = s.hashvin AND e_order < session_order)"""
STEPS = f""", g AS (SELECT hashvin, {HOURS.format('lag(charge_start_time) OVER w', 'charge_start_time')} / 24 AS gap FROM tr WINDOW w AS (PARTITION BY hashvin ORDER BY charge_start_time, session_id)),
iv AS (SELECT hashvin, CASE WHEN median(gap) > 0 THEN median(gap) ELSE 14.0 END AS base FROM g GROUP BY 1),
st AS (SELECT session_uid, j, greatest(7.0::DOUBLE, least(56.0::DOUBLE, base * pow(1.5::DOUBLE, j))) AS w
  FROM (SELECT session_uid, base, unnest(range(greatest(0, CAST(ceil(ln(56.0::DOUBLE / base) / ln(1.5::DOUBLE) - 1e-9) AS INTEGER)) + 1)) AS j FROM split
  JOIN iv USING (hashvin))),
cnt AS (SELECT t.session_uid, t.j, t.w, count(p.place) AS stays, count(DISTINCT p.place) AS places FROM st t LEFT JOIN past p ON p.session_uid = t.session_uid AND p.age_days <= t.w GROUP BY ALL),
win AS (SELECT session_uid, w AS window_days, stays AS stays_in_window FROM (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY CASE WHEN stays >= 8
  AND places >= 4 THEN j ELSE 1000 - j END) AS k FROM cnt) WHERE k = 1)"""
CANDS = """, pr AS (SELECT p.session_uid, place, count(*) FILTER (WHERE age_days <= window_days) AS freq,
  (epoch_us(any_value(ref)) - epoch_us(max(event_time))) / 1e6 / 60 / 60 AS h, min(back) AS back FROM past p JOIN win USING (session_uid) GROUP BY ALL),
li AS (SELECT session_uid, place, CASE WHEN freq > 0 THEN 'window' ELSE 'recent' END AS source FROM pr WHERE freq > 0 OR back <= 10),
hv AS (SELECT session_uid, count(*) AS have FROM li GROUP BY 1),
fb AS (SELECT n.session_uid, n.place, row_number() OVER (PARTITION BY n.session_uid ORDER BY distance_order) AS o, coalesce(have, 0) AS have FROM nearest n LEFT
  JOIN hv USING (session_uid) WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.session_uid = n.session_uid AND li.place = n.place)),
nm AS (SELECT session_uid, place, source, NULL::INTEGER AS distance_order FROM li UNION ALL SELECT session_uid, place, 'fallback', CAST(o AS INTEGER) FROM fb WHERE o <= greatest(1, 6 - have)),
al AS (SELECT coalesce(n.session_uid, s.session_uid) AS session_uid, coalesce(n.place, s.next_long_inactive_cluster) AS place, coalesce(source,
  'label') AS source, n.distance_order, s.session_uid IS NOT NULL AS is_truth
  FROM nm n FULL JOIN split s ON s.session_uid = n.session_uid AND s.next_long_inactive_cluster = n.place),
fu AS (SELECT a.session_uid, a.place, a.source, a.distance_order, a.is_truth, coalesce(p.freq, 0) AS freq, CASE WHEN p.h >= 0 THEN p.h
  ELSE 1e6 END AS recency_hours, a.source IN ('window', 'label') AS in_window, window_days, stays_in_window
  FROM al a LEFT JOIN pr p ON p.session_uid = a.session_uid AND p.place = a.place JOIN win w ON w.session_uid = a.session_uid),
cand AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_uid
  ORDER BY NOT is_truth, source <> 'window', freq DESC, recency_hours, coalesce(distance_order, 9999), place) AS INTEGER) AS rank FROM fu) WHERE rank <= 6)"""
ALL = CENTRES + NEAR + PAST + STEPS + CANDS


def intervals(spark, d):
    return pl.charge_interval(ordered(spark, d))


def nearest(spark, d):
    return pl.nearest_places(ordered(spark, d), centres(spark, d), F.round(meters_to_centre(), 3))


def candidate_table(spark, d, include_truth: str = "all"):
    return cd.candidates(ordered(spark, d), intervals(spark, d), nearest(spark, d), include_truth)


@family.query(f"WITH {BASE}{PAST} SELECT session_uid, place, count(*) AS n FROM past WHERE age_days <= 14 GROUP BY ALL")
def history_in_window(spark, d):
    return cd.history_in_window(ordered(spark, d), 14.0)


@family.query(f"WITH {BASE}{PAST}{STEPS} SELECT session_uid, round(window_days, 6) AS window_days, stays_in_window FROM win")
def adaptive_window(spark, d):
    return cd.adaptive_windows(ordered(spark, d), intervals(spark, d)).select("session_uid", r("window_days"), "stays_in_window")


@family.query(f"""WITH {BASE}{PAST}, l AS (SELECT session_uid, place, min(back) AS back FROM past WHERE back <= 10 GROUP BY ALL)
  SELECT session_uid, CAST(row_number() OVER (PARTITION BY session_uid ORDER BY back) AS INTEGER) AS recent_rank, place FROM l""")
def recent_places(spark, d):
    return cd.recent_places(ordered(spark, d))


_CAND = "session_uid, rank, place, source, distance_order, is_truth, freq, round(recency_hours, 6) AS recency_hours, in_window, round(window_days, 6) AS window_days, stays_in_window"


def _cand(df):
    return df.select("session_uid", "rank", "place", "source", F.col("distance_order").cast("int").alias("distance_order"), "is_truth", F.col("freq").cast("bigint").alias("freq"), r("recency_hours"), "in_window", r("window_days"), "stays_in_window")


@family.query(f"WITH {ALL} SELECT {_CAND} FROM cand")
def candidates(spark, d):
    return _cand(candidate_table(spark, d))


@family.query(f"WITH {ALL} SELECT session_uid, rank, place FROM cand")
def candidate_topk(spark, d):
    return candidate_table(spark, d).select("session_uid", "rank", "place")


FEATURES = (
    ALL
    + DELAYS
    + STARTS
    + MOVED
    + """, prs AS (SELECT c.session_uid, s.hashvin, charge_cluster AS origin, charge_start_time, coalesce(prev_cluster, 'NONE') AS prev,
  CAST(isodow(charge_start_time) - 1 AS INTEGER) AS dow, CAST(hour(charge_start_time) // 4 AS INTEGER) AS bin, c.place FROM cand c
  JOIN split s USING (session_uid))"""
    + RESOLVED
    + ARRIVED
    + RANKING
    + f""", feat AS (SELECT c.session_uid, c.place, c.rank, c.is_truth,
  round_even({HAV.format('s.charging_start_lat', 's.charging_start_lon', 'x.lat', 'x.lon')}, 0) AS cand_distance_m, c.freq + 1.0 AS cand_freq,
  round(ln(1 + c.freq), 6) AS cand_freq_log,
round(c.recency_hours, 6) AS cand_recency_hours, round(c.window_days, 6) AS cand_window_days, c.stays_in_window AS cand_stays_in_window,
  c.source AS cand_source, CAST(c.in_window AS INTEGER) AS cand_in_window, coalesce(c.distance_order, -1) AS cand_distance_order,
round(t.time_compat, 6) AS cand_time_compat, round(coalesce(l.a, l.b, l.c, 0), 6) AS cand_transition_prev
FROM cand c JOIN split s USING (session_uid) LEFT JOIN centres x ON x.hashvin = s.hashvin AND x.place = c.place LEFT JOIN tc t ON t.session_uid = c.session_uid
  AND t.place = c.place LEFT JOIN lr l ON l.session_uid = c.session_uid AND l.place = c.place)"""
)


def features(spark, d, include_truth: str = "all"):
    rows = ordered(spark, d)
    dow, b = ft.slot("charge_start_time", 4)
    me = rows.select("session_uid", "hashvin", F.col("charge_cluster").alias("origin"), "charge_start_time", "charging_start_lat", "charging_start_lon", F.coalesce("prev_cluster", F.lit("NONE")).alias("prev"), dow.alias("dow"), b.alias("bin"))
    c = candidate_table(spark, d, include_truth).join(pl.with_transitions(me, rows), "session_uid").join(facts(spark, d), ["hashvin", "place"], "left")
    c = pl.time_compat_ranking(c.withColumn("transition_p", F.when(F.col("known"), pl.transition_share()).otherwise(0.0)))
    meters = geo.haversine_m(F.col("charging_start_lat"), F.col("charging_start_lon"), F.col("lat"), F.col("lon"))
    return c.select(
        "session_uid", "place", "rank", "is_truth", F.bround(meters, 0).alias("cand_distance_m"), (F.col("freq") + 1.0).alias("cand_freq"), F.round(geo.log1p_safe(F.col("freq")), 6).alias("cand_freq_log"),
        F.round("recency_hours", 6).alias("cand_recency_hours"), F.round("window_days", 6).alias("cand_window_days"), F.col("stays_in_window").alias("cand_stays_in_window"),
        F.col("source").alias("cand_source"), F.col("in_window").cast("int").alias("cand_in_window"), F.coalesce("distance_order", F.lit(-1)).cast("int").alias("cand_distance_order"),
        F.round("time_compat", 6).alias("cand_time_compat"), F.round("transition_p", 6).alias("cand_transition_prev"),
    )


@family.query(f"WITH {FEATURES} SELECT * FROM feat")
def candidate_features(spark, d):
    return features(spark, d)


def _bins_sql(mode: str) -> str:
    start = "charge_start_time - INTERVAL 24 HOUR" if mode == "rolling" else "CAST(CAST(charge_start_time AS DATE) AS TIMESTAMP)"
    return f""", bz AS (SELECT session_uid, hashvin, bin, w0 + bin * INTERVAL 6 HOUR AS b0, least(charge_start_time, w0 + (bin + 1) * INTERVAL 6 HOUR) AS b1
  FROM (SELECT session_uid, hashvin, charge_start_time, {start} AS w0, CAST(unnest(range(4)) AS INTEGER) AS bin FROM split)),
ov AS (SELECT b.session_uid, b.bin, s.session_cluster AS place, sum((epoch_us(least(b1, end_time)) - epoch_us(greatest(b0, start_time))) / 1e6 / 60) AS minutes,
  min(start_time) AS first FROM bz b JOIN sessions s ON s.hashvin = b.hashvin AND greatest(b0, start_time) < least(b1, end_time) GROUP BY ALL),
ob AS (SELECT *, row_number() OVER (PARTITION BY session_uid, bin ORDER BY round(minutes + 2e-9, 6) DESC, first, place) AS k FROM ov),
db AS (SELECT z.session_uid, z.bin, coalesce(o.place, 'unknown') AS place, coalesce(o.minutes, 0) AS minutes FROM bz z LEFT JOIN ob o ON o.session_uid = z.session_uid AND o.bin = z.bin AND k = 1)"""


@family.query(f"WITH {BASE}{_bins_sql('calendar')} SELECT session_uid, bin, place, round(minutes + 2e-9, 6) AS minutes FROM db")
def daily_bins(spark, d):
    return cd.daily_bins(ordered(spark, d), stays(spark, d)).select("session_uid", "bin", "place", F.round(F.col("minutes") + 2e-9, 6).alias("minutes"))


@family.query(f"WITH {BASE}{_bins_sql('rolling')} SELECT session_uid, bin, place, round(minutes + 2e-9, 6) AS minutes FROM db")
def daily_bins_rolling(spark, d):
    return cd.daily_bins(ordered(spark, d), stays(spark, d), "rolling").select("session_uid", "bin", "place", F.round(F.col("minutes") + 2e-9, 6).alias("minutes"))


WIDE = ", wb AS (SELECT session_uid, " + """,
  """.join(f"""max(CASE WHEN bin = {i} THEN place END) AS daily_bin_{i}_place, round(max(CASE
  WHEN bin = {i} THEN minutes END) + 2e-9, 6) AS daily_bin_{i}_minutes""" for i in range(4)) + """
  FROM db GROUP BY 1)"""
COMMON = f"""SELECT session_uid, CAST(isodow(charge_start_time) - 1 AS INTEGER) AS dow,
  round(sin(2 * pi() * (hour(charge_start_time) + minute(charge_start_time) / 60.0::DOUBLE) / 24), 6) AS time_sin,
  round(cos(2 * pi() * (hour(charge_start_time) + minute(charge_start_time) / 60.0::DOUBLE) / 24), 6) AS time_cos,
epoch_us(charge_start_time) / 1e6 AS time_raw_timestamp, printf('%02d_%02d', hour(charge_start_time) // 2 * 2,
  hour(charge_start_time) // 2 * 2 + 2) AS time_band, ['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'][isodow(charge_start_time)] AS day_name,
CAST(hour(charge_start_time) >= 18 OR hour(charge_start_time) < 6 AS INTEGER) AS is_return_band, CAST(hour(charge_start_time) >= 7
  AND hour(charge_start_time) < 18 AS INTEGER) AS is_commute_band, CAST(isodow(charge_start_time) >= 6 AS INTEGER) AS is_weekend,
charge_start_soc AS soc_start, round({NORTH}, 4) AS north_m, round({EAST}, 4) AS east_m, {', '.join(f"CAST({ONEHOT} = '{k}' AS INTEGER) AS station_{k}" for k in KINDS)} FROM split"""


def common(rows, mode: str = "all"):
    """Features of the charge itself; ``mode``: cyclic, raw, categorical or all."""
    ts = "charge_start_time"
    made = {}
    if mode in ("cyclic", "all"):
        made |= {k: (v if k == "dow" else F.round(v, 6)) for k, v in ft.cyclic(ts).items()}
    if mode in ("raw", "all"):
        made["time_raw_timestamp"] = ft.epoch_seconds(ts)
    if mode in ("categorical", "all"):
        made |= {"time_band": ft.two_hour_band(ts), "day_name": ft.weekday_name(ts)}
    made |= ft.behavior_flags(ts)
    north, east, _ = geo.north_east_m(F.col("prev_lat"), F.col("prev_lon"), F.col("charging_start_lat"), F.col("charging_start_lon"))
    made |= {"soc_start": F.col("charge_start_soc"), "north_m": F.round(north, 4), "east_m": F.round(east, 4)}
    kind = cl.station_types(rows, STATIONS)
    made |= {f"station_{k}": (kind == k).cast("int") for k in KINDS}
    return rows.select("session_uid", *[c.alias(n) for n, c in made.items()])


@family.query(f"WITH {BASE} {COMMON}")
def common_features(spark, d):
    return common(ordered(spark, d))


@family.query(
    f"""WITH {FEATURES}{_bins_sql('calendar')}{WIDE}, cm AS ({COMMON}), sz AS (SELECT session_uid, count(*) AS candidate_set_size FROM cand GROUP BY 1)
SELECT f.session_uid, s.hashvin, s.split, f.place AS candidate_cluster, s.next_long_inactive_cluster AS true_cluster,
  CAST(f.place = s.next_long_inactive_cluster AS INTEGER) AS label, z.candidate_set_size,
       f.* EXCLUDE (session_uid, place, is_truth), c.* EXCLUDE (session_uid), w.* EXCLUDE (session_uid)
FROM feat f JOIN split s USING (session_uid) JOIN sz z USING (session_uid) JOIN cm c USING (session_uid) JOIN wb w USING (session_uid)"""
)
def scoring_table(spark, d):
    """A row per charge and candidate with every feature of the candidate, of the charge, and of the day's bins before it."""
    from pyspark.sql import Window as W

    rows = ordered(spark, d)
    f = features(spark, d).withColumn("candidate_set_size", F.count(F.lit(1)).over(W.partitionBy("session_uid")))
    f = f.withColumnRenamed("place", "candidate_cluster").drop("is_truth")
    me = rows.select("session_uid", "hashvin", "split", F.col(pl.LABEL).alias("true_cluster"))
    out = f.join(me, "session_uid").join(common(rows), "session_uid").join(day_bins(rows, spark, d), "session_uid")
    return out.withColumn("label", (F.col("candidate_cluster") == F.col("true_cluster")).cast("int"))


def day_bins(rows, spark, d):
    """Places and minutes of the four bins of the charge's day, a column each."""
    wide = cd.wide_bins(cd.daily_bins(rows, stays(spark, d)))
    return wide.withColumns({f"daily_bin_{i}_minutes": F.round(F.col(f"daily_bin_{i}_minutes") + 2e-9, 6) for i in range(4)})


VISITS = """, vs AS (SELECT h.session_uid, h.place, count(*) FILTER (WHERE v.inactive_start_time >= s.charge_start_time - INTERVAL 90 DAY) AS n,
  arg_max(v.inactive_start_time, v.session_order) AS last, any_value(s.charge_start_time) AS start
FROM hp h JOIN split s USING (session_uid) JOIN tr v ON v.hashvin = s.hashvin AND v.next_long_inactive_cluster = h.place AND v.session_order < s.session_order GROUP BY ALL),
vf AS (SELECT h.session_uid, h.place, coalesce(n, 0) + 1.0 AS freq, CASE WHEN last IS NULL THEN 1e6
  ELSE greatest(0.0, (epoch_us(start) - epoch_us(last)) / 1e6 / 60 / 60) END AS recency_hours FROM hp h LEFT JOIN vs USING (session_uid, place))"""


@family.query(f"WITH {BASE}{MOVED}{HEAD}{HEADED}{VISITS} SELECT session_uid, place, freq FROM vf")
def visit_frequency(spark, d):
    return cd.place_visits(ordered(spark, d), head_pairs(spark, d)).select("session_uid", "place", "freq")


@family.query(f"WITH {BASE}{MOVED}{HEAD}{HEADED}{VISITS} SELECT session_uid, place, round(recency_hours, 6) AS recency_hours FROM vf")
def visit_recency(spark, d):
    return cd.place_visits(ordered(spark, d), head_pairs(spark, d)).select("session_uid", "place", r("recency_hours"))


PLACE_FEATURES = (
    CENTRES + MOVED + DELAYS + STARTS + HEAD + HEADED + COMPAT + VISITS
    + f""", pf AS (SELECT h.session_uid, h.head_rank, h.place, round_even({HAV.format('s.charge_lat', 's.charge_lon', 'x.lat', 'x.lon')}, 0) AS dist_m, v.freq,
  round(v.recency_hours, 6) AS recency_hours, round(c.time_compat, 6) AS time_compat, round(m.transition_p, 6) AS transition_p
FROM hp h JOIN split s USING (session_uid) LEFT JOIN centres x ON x.hashvin = h.hashvin AND x.place = h.place JOIN vf v ON v.session_uid = h.session_uid
  AND v.place = h.place JOIN mc c ON c.session_uid = h.session_uid AND c.place = h.place JOIN ml m ON m.session_uid = h.session_uid AND m.place = h.place)"""
)


def place_features(spark, d):
    rows = ordered(spark, d)
    p = pl.with_transitions(head_charges(spark, d), rows).join(heads(spark, d).select("hashvin", "place", "head_rank"), "hashvin")
    p = p.withColumn("transition_p", F.coalesce(pl.transition_share(), F.lit(1.0 / HEAD_K))).drop("told", "n_targets", "prev", "dow", "bin")
    p = pl.time_compat_multiclass(cd.place_visits(rows, p).join(facts(spark, d), ["hashvin", "place"], "left"))
    return p.select("session_uid", "head_rank", "place", F.bround(meters_to_centre(), 0).alias("dist_m"), "freq", r("recency_hours"), r("time_compat"), r("transition_p"))


@family.query(f"WITH {PLACE_FEATURES} SELECT * FROM pf")
def place_features_wide(spark, d):
    """Long form (session, place); ``multiclass_table`` pivots it by place rank."""
    return place_features(spark, d)


_NAMES = ("dist_m", "freq", "recency_hours", "time_compat", "transition_p")


@family.query(
    f"""WITH {PLACE_FEATURES}{_bins_sql('calendar')}{WIDE}, cm AS ({COMMON}),
wd AS (SELECT session_uid, {', '.join(f"max(CASE WHEN head_rank = {k} THEN {n} END) AS {n}_{k}" for k in range(1, 6) for n in _NAMES)} FROM pf GROUP BY 1)
SELECT s.session_uid, s.split8 AS split, CASE WHEN h.place IS NULL THEN 'OTHER' ELSE s.next_long_inactive_cluster END AS y_class,
       c.* EXCLUDE (session_uid), w.* EXCLUDE (session_uid), {', '.join(f'wd.{n}_{k}' for k in range(1, 6) for n in _NAMES)}
FROM split s LEFT JOIN head h ON h.hashvin = s.hashvin AND h.place = s.next_long_inactive_cluster JOIN cm c ON c.session_uid = s.session_uid
  JOIN wb w ON w.session_uid = s.session_uid LEFT JOIN wd ON wd.session_uid = s.session_uid"""
)
def multiclass_table(spark, d):
    """A row per charge with its class and every feature of the charge, of the day's bins before it, and of its vehicle's HEAD places."""
    rows = ordered(spark, d)
    wide = place_features(spark, d).groupBy("session_uid").agg(*[F.max(F.when(F.col("head_rank") == k, F.col(n))).alias(f"{n}_{k}") for k in range(1, 6) for n in _NAMES])
    y = labels(spark, d).select("session_uid", F.col("split8").alias("split"), "y_class")
    return y.join(common(rows), "session_uid").join(day_bins(rows, spark, d), "session_uid").join(wide, "session_uid", "left")


#: Columns of the base table that the assembled one keeps.
_BASE = ["session_uid", "session_id", "session_order", "hashvin", "charge_start_time", "charge_end_time", "charge_cluster", "prev_cluster", "next_long_inactive_cluster", "split", "split8"]


@family.query(
    f"""WITH {BASE}, cm AS ({COMMON})
SELECT s.session_uid, s.session_id, CAST(s.session_order AS BIGINT) AS session_order, s.hashvin, s.charge_start_time, s.charge_end_time, s.charge_cluster,
  s.prev_cluster, s.next_long_inactive_cluster, s.split, s.split8,
       CAST(isodow(s.charge_start_time) - 1 AS INTEGER) AS dow, c.* EXCLUDE (session_uid, dow)
FROM split s JOIN cm c USING (session_uid)"""
)
def feature_assembly(spark, d):
    """The base's columns and the common features, each name once: the base's where both have it."""
    rows = ordered(spark, d).withColumn("dow", ft.weekday("charge_start_time"))
    extra = common(rows)
    return rows.select(*_BASE, "dow").join(extra.select("session_uid", *[c for c in extra.columns if c not in [*_BASE, "dow"]]), "session_uid")
