"""Sources, projections, type repair and scalar expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as ft
from ..operators import cleaning as cl
from ..operators import daily as dy
from ..operators.patterns import work_folder
from ..sources import fleet
from .base import BIN_LABEL, CHARGES, DATE06, PIECES, SESSIONS, Family

family = Family()
STATIONS = {"C_0": "home", "C_1": "office", "C_2": "public", "C_3": "public"}
KINDS = ["home", "office", "public", "unknown"]
LABELED = "SELECT * FROM split"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return fleet.sessions(spark, d)


_stays: dict[tuple[str, str], DataFrame] = {}
_ordered: dict[tuple[str, str], DataFrame] = {}


def stays(spark: SparkSession, d: str) -> DataFrame:
    """All sessions, persisted (memory, then disk): the charges and what is told of places are read from one table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stays:
        _stays[key] = fleet.sessions(spark, d)
    return _stays[key].persist()


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """Labelled charges in order, with the 70/10/20 (split) and 80/10/10 (split8) splits.

    The statistics, histories and features of one query all begin here, so the table is
    persisted (memory, then disk) for its session.
    """
    key = (spark.sparkContext.applicationId, d)
    whole = stays(spark, d)
    if key not in _ordered:
        out = cl.order_charges(cl.labeled(fleet.charges(whole)))
        _ordered[key] = cl.chrono_split(cl.chrono_split(out, 0.7), 0.8, name="split8")
    return _ordered[key].persist()


@family.query(f"""WITH {SESSIONS} SELECT session_id, hashvin, session_type, session_cluster, start_time, end_time, round(duration_minutes + 2e-9,
  6) AS duration_minutes FROM sessions WHERE duration_minutes >= 20""")
def scan_sessions(spark, d):
    out = sessions(spark, d).filter("duration_minutes >= 20")
    return out.select("session_id", "hashvin", "session_type", "session_cluster", "start_time", "end_time", F.round(F.col("duration_minutes") + 2e-9, 6).alias("duration_minutes"))


#: Rows that the written file breaks: a text for a number, a field too few, no vehicle.
_BROKEN = "CASE WHEN session_id % 97 = 0 THEN 'text' WHEN session_id % 89 = 0 THEN 'short' WHEN session_id % 83 = 0 THEN 'vehicle' END"


@family.query(
    f"""WITH {SESSIONS}, b AS (SELECT *, {_BROKEN} AS fault FROM sessions)
SELECT hashvin, count(*) AS n, 0::BIGINT AS unparsed, 0::BIGINT AS incomplete, round(sum(duration_minutes), 4) AS minutes FROM b WHERE fault IS NULL AND duration_minutes >= 20 GROUP BY 1
UNION ALL SELECT '(quarantine)', count(*), count(*) FILTER (WHERE fault <> 'vehicle'), count(*) FILTER (WHERE fault = 'vehicle'), NULL FROM b WHERE fault IS NOT NULL"""
)
def read_session_files(spark, d):
    """Sessions written as CSV with broken rows among them, read back: stays and minutes per vehicle, and what went to quarantine."""
    s = sessions(spark, d).withColumn("fault", F.expr(_BROKEN))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = [f.split()[0] for f in fleet.SESSION_SCHEMA.split(", ")]
    shown = {c: text(c) for c in names} | {"duration_minutes": F.when(F.col("fault") == "text", "n/a").otherwise(text("duration_minutes")), "hashvin": F.when(F.col("fault") == "vehicle", "").otherwise(F.col("hashvin"))}
    line = F.when(F.col("fault") == "short", F.concat_ws(",", *[shown[c] for c in names[:4]])).otherwise(F.concat_ws(",", *[shown[c] for c in names]))
    top = f"{work_folder(s)}/{uuid.uuid4().hex}"
    s.select(line.alias("value")).write.text(f"{top}/sessions")
    good = fleet.read_sessions(spark, f"{top}/sessions", 20, "csv", quarantine=f"{top}/quarantine", header=False)
    per = good.groupBy("hashvin").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("unparsed"), F.lit(0).cast("bigint").alias("incomplete"), F.round(F.sum("duration_minutes"), 4).alias("minutes"))
    lost = spark.read.parquet(f"{top}/quarantine").agg(F.lit("(quarantine)").alias("hashvin"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "unparsed").alias("unparsed"), F.count_if(F.col("reason") != "unparsed").alias("incomplete"), F.lit(None).cast("double").alias("minutes"))
    return per.unionByName(lost)


@family.query(f"WITH {CHARGES} SELECT DISTINCT hashvin FROM charges ORDER BY hashvin")
def scan_charges(spark, d):
    return fleet.charges(sessions(spark, d)).select("hashvin").distinct().orderBy("hashvin")


@family.query("SELECT CAST(o_orderdate AS DATE) AS t, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def scan_series(spark, d):
    out = fleet.read_series(fleet.daily_series(spark, d), "value", "t")
    return out.select("t", F.round("value", 4).alias("value"))


@family.query(
    f"""WITH {SESSIONS} SELECT count(*) AS rows_read, count(*) FILTER (WHERE duration_minutes < 20) AS rows_dropped, count(DISTINCT hashvin) AS vehicles,
  min(start_time) AS first_start, max(end_time) AS last_end FROM sessions"""
)
def load_profile(spark, d):
    return sessions(spark, d).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("duration_minutes") < 20).alias("rows_dropped"), F.countDistinct("hashvin").alias("vehicles"),
        F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"),
    )


@family.query(
    """WITH n AS (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders), s AS (SELECT unnest(range(n)) AS t FROM n)
  SELECT t, round(5 + 0.0015 * t + sin(2 * pi() * t / 24) + 0.5 * sin(2 * pi() * t / 168), 6) AS value FROM s"""
)
def seasonal_series(spark, d):
    """The noise-free series, as long as the table's daily series."""
    n = fleet.daily_series(spark, d).count()
    return fleet.seasonal_series(spark, n).select("t", F.round("value", 6).alias("value"))


@family.query(
    f"""WITH {SESSIONS}, v AS (SELECT DISTINCT hashvin FROM sessions) SELECT hashvin, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00',
  TIMESTAMP '2024-01-14 23:00:00', INTERVAL 1 HOUR)) AS timestamp FROM v"""
)
def vehicle_hour_grid(spark, d):
    return fleet.vehicle_hours(sessions(spark, d).select("hashvin").distinct(), "2024-01-01 00:00:00", 14)


_TEXTS = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' ELSE 'n/a' END"


@family.query(
    f"""WITH x AS (SELECT event_id, ts, {_TEXTS} AS text FROM events)
SELECT event_id, text, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) + INTERVAL 9 HOUR END AS parsed FROM x"""
)
def normalize_times(spark, d):
    ev = fleet.table(spark, d, "events")
    plain, tee = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("event_id") % 4
    ev = ev.withColumn("text", F.when(m == 0, plain).when(m == 1, tee).when(m == 2, F.concat(plain, F.lit("+00:00"))).otherwise("n/a"))
    return ev.select("event_id", "text", ft.japan_time("text").alias("parsed"))


@family.query(
    f"""WITH {CHARGES}, t AS (SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'unknown' ELSE CAST(charge_start_soc AS VARCHAR) END AS charge_start_soc,
  CASE WHEN session_id % 7 = 0 THEN '' ELSE CAST(charge_end_soc AS VARCHAR) END AS charge_end_soc FROM charges)
SELECT session_id, TRY_CAST(charge_start_soc AS DOUBLE) AS charge_start_soc, TRY_CAST(charge_end_soc AS DOUBLE) AS charge_end_soc FROM t"""
)
def coerce_numeric(spark, d):
    c = fleet.charges(sessions(spark, d))
    i = F.col("session_id")
    text = c.select("session_id", F.when(i % 5 == 0, "unknown").otherwise(F.col("charge_start_soc").cast("string")).alias("charge_start_soc"), F.when(i % 7 == 0, "").otherwise(F.col("charge_end_soc").cast("string")).alias("charge_end_soc"))
    return cl.coerce_numeric(text)


@family.query(f"WITH {CHARGES} SELECT session_id, hashvin, charge_cluster, next_long_inactive_cluster FROM charges WHERE next_long_inactive_cluster IS NOT NULL")
def labeled_charges(spark, d):
    return cl.labeled(fleet.charges(sessions(spark, d))).select("session_id", "hashvin", "charge_cluster", "next_long_inactive_cluster")


LONG_CUT = """, cut AS (SELECT hashvin, max(charge_start_time) AS cutoff FROM split WHERE split = 'train' GROUP BY 1),
long_cut AS (SELECT s.* FROM sessions s JOIN cut USING (hashvin) WHERE session_type = 'inactive' AND duration_minutes >= 360 AND session_cluster <> '-1' AND start_time <= cutoff)"""


@family.query(f"WITH {CHARGES}{LONG_CUT} SELECT session_id, hashvin, session_cluster, start_time, round(duration_minutes + 2e-9, 6) AS duration_minutes FROM long_cut")
def long_inactive_filter(spark, d):
    out = cl.long_inactive(stays(spark, d), cl.train_cutoffs(ordered(spark, d)))
    return out.select("session_id", "hashvin", "session_cluster", "start_time", F.round(F.col("duration_minutes") + 2e-9, 6).alias("duration_minutes"))


@family.query(f"WITH {CHARGES} SELECT session_id, hashvin, charge_start_time, charge_cluster, charge_start_soc, next_long_inactive_cluster FROM charges")
def drop_leak_columns(spark, d):
    c = fleet.charges(sessions(spark, d)).drop(*cl.LEAKS)
    return c.select("session_id", "hashvin", "charge_start_time", "charge_cluster", "charge_start_soc", "next_long_inactive_cluster")


ONEHOT = "CASE charge_cluster WHEN 'C_0' THEN 'home' WHEN 'C_1' THEN 'office' WHEN 'C_2' THEN 'public' WHEN 'C_3' THEN 'public' ELSE 'unknown' END"
_FLAGS = ", ".join(f"CAST({ONEHOT} = '{k}' AS INTEGER) AS station_{k}" for k in KINDS)


@family.query(f"WITH {CHARGES} SELECT session_uid, charge_start_soc, {_FLAGS} FROM split")
def feature_whitelist(spark, d):
    return cl.whitelist(cl.station_onehot(ordered(spark, d), STATIONS, KINDS), ["session_uid", "charge_start_soc"])


@family.query(f"WITH {CHARGES} SELECT session_uid, charge_start_soc, charge_lat, charge_lon, CAST(session_order AS BIGINT) AS session_order FROM split")
def select_model_columns(spark, d):
    df = cl.station_onehot(ordered(spark, d), STATIONS, KINDS).select("session_uid", "charge_start_soc", "charge_lat", "charge_lon", "session_order", "split", "hashvin", "station_home")
    return df.select(*cl.model_columns(df.columns, ["split", "hashvin"], station=False))


@family.query(f"WITH {CHARGES} SELECT session_id, {_FLAGS} FROM charges")
def station_onehot(spark, d):
    out = cl.station_onehot(fleet.charges(sessions(spark, d)), STATIONS, KINDS)
    return out.select("session_id", *[f"station_{k}" for k in KINDS])


@family.query(
    """WITH x AS (SELECT unnest([{'column': 'value', 'x': value}, {'column': 'third', 'x': value / 3}, {'column': 'event_id', 'x': CAST(event_id AS DOUBLE)}]) AS p FROM events)
SELECT p.column AS "column", round(max(abs(p.x - CAST(CAST(p.x AS FLOAT) AS DOUBLE))), 9) AS max_error, round(avg(abs(p.x - CAST(CAST(p.x AS FLOAT) AS DOUBLE))), 9) AS mean_error FROM x GROUP BY 1"""
)
def float32_cast_error(spark, d):
    ev = fleet.table(spark, d, "events").select("value", (F.col("value") / 3).alias("third"), "event_id")
    return cl.float32_error(ev, ["value", "third", "event_id"]).select("column", F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"))


@family.query("SELECT event_id, round(ln(1 + greatest(value - 5, 0)), 6) AS logged FROM events")
def log1p_safe(spark, d):
    return fleet.table(spark, d, "events").select("event_id", F.round(geo.log1p_safe(F.col("value") - 5), 6).alias("logged"))


@family.query(f"WITH {SESSIONS} SELECT session_id, {DATE06.format('start_time')} AS date06 FROM sessions")
def date06(spark, d):
    return sessions(spark, d).select("session_id", ft.date06("start_time").alias("date06"))


@family.query(f"WITH {PIECES} SELECT session_id, hashvin, session_cluster, date06, s, e FROM pieces")
def split_by_day06(spark, d):
    return dy.split_by_day06(sessions(spark, d)).select("session_id", "hashvin", "session_cluster", "date06", "s", "e")


@family.query(f"WITH {PIECES} SELECT DISTINCT bin, {BIN_LABEL.format('bin')} AS label FROM bins")
def hour_bin_labels(spark, d):
    return dy.hour_bins(dy.split_by_day06(sessions(spark, d))).select("bin").distinct().select("bin", ft.bin_label(F.col("bin")).alias("label"))


@family.query(f"WITH {PIECES} SELECT session_id, date06, bin, round(minutes + 2e-9, 6) AS minutes FROM bins")
def hour_bin_minutes(spark, d):
    return dy.hour_bins(dy.split_by_day06(sessions(spark, d))).select("session_id", "date06", "bin", F.round(F.col("minutes") + 2e-9, 6).alias("minutes"))


_PERIOD = "CASE WHEN hour({0}) >= 6 AND hour({0}) < 12 THEN 'morning' WHEN hour({0}) >= 12 AND hour({0}) < 17 THEN 'afternoon' WHEN hour({0}) >= 17 AND hour({0}) < 21 THEN 'evening' ELSE 'night' END"


@family.query(f"SELECT event_id, {_PERIOD.format('ts')} AS period FROM events")
def time_period(spark, d):
    return fleet.table(spark, d, "events").select("event_id", ft.period("ts").alias("period"))


@family.query("""SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS time_sin,
  round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS time_cos FROM events""")
def cyclic_time(spark, d):
    c = ft.cyclic("ts")
    return fleet.table(spark, d, "events").select("event_id", c["dow"].alias("dow"), F.round(c["time_sin"], 6).alias("time_sin"), F.round(c["time_cos"], 6).alias("time_cos"))


@family.query("SELECT event_id, ts AS time_raw, epoch_us(ts) / 1e6 AS time_raw_timestamp, epoch_us(ts) / 1e6 - 32400 AS time_true_timestamp FROM events")
def raw_time(spark, d):
    return fleet.table(spark, d, "events").select("event_id", F.col("ts").alias("time_raw"), ft.epoch_seconds("ts").alias("time_raw_timestamp"), ft.epoch_seconds("ts", -9).alias("time_true_timestamp"))


@family.query(
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS ts FROM events)
SELECT event_id, CASE WHEN ts IS NULL THEN 'unknown' ELSE printf('%02d_%02d', hour(ts) // 2 * 2, hour(ts) // 2 * 2 + 2) END AS band, CASE
  WHEN ts IS NULL THEN 'unknown' ELSE ['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'][isodow(ts)] END AS day FROM x"""
)
def categorical_time(spark, d):
    x = fleet.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"))
    return x.select("event_id", ft.two_hour_band("ts").alias("band"), ft.weekday_name("ts").alias("day"))


@family.query("""SELECT event_id, CAST(hour(ts) >= 18 OR hour(ts) < 6 AS INTEGER) AS is_return_band, CAST(hour(ts) >= 7
  AND hour(ts) < 18 AS INTEGER) AS is_commute_band, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""")
def behavior_flags(spark, d):
    return fleet.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in ft.behavior_flags("ts").items()])


_CYC = ", ".join(f"""round({f}(2 * pi() * ({e})),
  6) AS {n}_{f}""" for n, e in (("month", "(month(ts) - 1) / 12.0::DOUBLE"), ("day", "(day(ts) - 1) / 31.0::DOUBLE"), ("hour", "hour(ts) / 24.0::DOUBLE")) for f in ("sin", "cos"))


@family.query(f"SELECT event_id, CAST(year(ts) AS INTEGER) AS year, {_CYC} FROM events")
def calendar_cycles(spark, d):
    cols = ft.calendar_cycles("ts")
    return fleet.table(spark, d, "events").select("event_id", *[(c if n == "year" else F.round(c, 6)).alias(n) for n, c in cols.items()])


_CHORD = "(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))"
HAV = f"(2 * 6371000.0::DOUBLE * asin(sqrt({_CHORD} - greatest({_CHORD} - 1, 0))))"


@family.query(f"""WITH {SESSIONS} SELECT session_id, round({HAV.format('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 4) AS meters,
  round({HAV.format('start_lat', 'start_lon', 'end_lat', 'end_lon')} / 1000, 4) AS km FROM sessions""")
def haversine(spark, d):
    m = geo.haversine_m(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))
    return sessions(spark, d).select("session_id", F.round(m, 4).alias("meters"), F.round(m / 1000, 4).alias("km"))


NORTH = "(charging_start_lat - prev_lat) * 111320.0::DOUBLE"
EAST = "(charging_start_lon - prev_lon) * (40075000.0::DOUBLE * cos(radians((prev_lat + charging_start_lat) / 2)) / 360)"


@family.query(f"WITH {CHARGES} SELECT session_uid, round({NORTH}, 4) AS north_m, round({EAST}, 4) AS east_m, round(sqrt({NORTH} * ({NORTH}) + {EAST} * ({EAST})), 4) AS distance_m FROM split")
def latlon_delta(spark, d):
    north, east, far = geo.north_east_m(F.col("prev_lat"), F.col("prev_lon"), F.col("charging_start_lat"), F.col("charging_start_lon"))
    return ordered(spark, d).select("session_uid", F.round(north, 4).alias("north_m"), F.round(east, 4).alias("east_m"), F.round(far, 4).alias("distance_m"))


@family.query("SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) // 4 AS INTEGER) AS bin FROM events")
def dow_bin(spark, d):
    dow, b = ft.slot("ts")
    return fleet.table(spark, d, "events").select("event_id", dow.alias("dow"), b.alias("bin"))


TEXT = "(floor(duration_minutes)::INT // 60) || '時間' || (floor(duration_minutes)::INT % 60) || '分'"


@family.query(
    f"""WITH {SESSIONS} SELECT session_id, {TEXT} AS duration_text, round(end_soc - start_soc, 6) AS soc_delta, CASE WHEN end_soc > start_soc THEN 'up'
  WHEN end_soc < start_soc THEN 'down' ELSE 'flat' END AS soc_direction,
'https://www.google.com/maps?q=' || printf('%.6f', start_lat) || ',' || printf('%.6f', start_lon) AS map_url FROM sessions"""
)
def session_text(spark, d):
    way = F.when(F.col("end_soc") > F.col("start_soc"), "up").when(F.col("end_soc") < F.col("start_soc"), "down").otherwise("flat")
    return sessions(spark, d).select(
        "session_id", geo.duration_text(F.col("duration_minutes")).alias("duration_text"), F.round(F.col("end_soc") - F.col("start_soc"), 6).alias("soc_delta"),
        way.alias("soc_direction"), geo.map_url(F.col("start_lat"), F.col("start_lon")).alias("map_url"),
    )
