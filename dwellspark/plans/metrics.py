"""Metrics of pseudo-predictions, set operations and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as ft
from ..operators import metrics as mt
from ..operators import places as pl
from ..operators.patterns import work_folder
from ..sources import fleet, sinks
from .base import DATE06, Family
from .inputs import TEXT, ordered, sessions
from .places import BASE, HEAD, HEAD_K, long_cut

family = Family()
r = lambda c, n=6: F.round(c, n).alias(c)

SCORED = (
    BASE
    + HEAD
    + """, sc AS (SELECT session_uid, session_id, hashvin, split, next_long_inactive_cluster AS y_class, CASE
  WHEN session_id % 3 = 0 THEN next_long_inactive_cluster ELSE 'I_' || ((k + session_id) % 8) END AS y_pred, ((session_id * 37) % 100) / 100.0::DOUBLE AS proba,
  CAST(next_long_inactive_cluster = CASE WHEN session_id % 3 = 0 THEN next_long_inactive_cluster ELSE 'I_' || ((k + session_id) % 8) END AS DOUBLE) AS hit
  FROM split),
mk AS (SELECT s.*, h.place IS NOT NULL AS in_head FROM sc s LEFT JOIN head h ON h.hashvin = s.hashvin AND h.place = s.y_class)"""
)
CANDIDATES = SCORED + """, sa AS (SELECT session_uid, session_id, hashvin, split, 'I_' || p.no AS place, y_class,
  CAST(y_class = 'I_' || p.no AS INTEGER) AS label, ((session_id * 37 + p.no * 13) % 101) / 101.0::DOUBLE AS proba FROM sc, (SELECT unnest(range(8)) AS no) p)"""


def head(spark, d):
    return pl.head_places(ordered(spark, d), long_cut(spark, d), HEAD_K)


def scored(spark, d):
    i = F.col("session_id")
    pred = F.when(i % 3 == 0, F.col(pl.LABEL)).otherwise(F.concat(F.lit("I_"), ((F.col("k") + i) % 8).cast("string")))
    return ordered(spark, d).select("session_uid", "session_id", "hashvin", "split", F.col(pl.LABEL).alias("y_class"), pred.alias("y_pred"), (((i * 37) % 100) / 100.0).alias("proba"))


def scored_candidates(spark, d):
    x = scored(spark, d).select("session_uid", "session_id", "hashvin", "split", "y_class", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("no"))
    place = F.concat(F.lit("I_"), F.col("no").cast("string"))
    return x.select("session_uid", "hashvin", "split", place.alias("place"), "y_class", (place == F.col("y_class")).cast("int").alias("label"), (((F.col("session_id") * 37 + F.col("no") * 13) % 101) / 101.0).alias("proba"))


@family.query(f"WITH {SCORED} SELECT split, round(avg(hit), 6) AS top1, round(avg(hit) FILTER (WHERE in_head), 6) AS top1_head FROM mk GROUP BY 1")
def top1_accuracy(spark, d):
    return mt.accuracies(scored(spark, d), head(spark, d), ["split"]).select("split", r("top1"), r("top1_head"))


@family.query(f"""WITH {SCORED}, p AS (SELECT split, hashvin, y_class, in_head, avg(hit) AS recall FROM mk GROUP BY ALL)
  SELECT split, hashvin, round(avg(recall), 6) AS balanced, round(avg(recall) FILTER (WHERE in_head), 6) AS balanced_head FROM p GROUP BY ALL""")
def balanced_accuracy(spark, d):
    return mt.accuracies(scored(spark, d), head(spark, d), ["split", "hashvin"]).select("split", "hashvin", r("balanced"), r("balanced_head"))


@family.query(f"""WITH {SCORED}, p AS (SELECT hashvin, y_class, avg(hit) AS recall FROM sc WHERE split = 'test' GROUP BY ALL)
  SELECT h.hashvin, h.head_rank, h.place, round(recall, 6) AS recall FROM head h LEFT JOIN p ON p.hashvin = h.hashvin AND p.y_class = h.place""")
def class_recalls(spark, d):
    return mt.head_recalls(scored(spark, d).filter("split = 'test'"), head(spark, d)).select("hashvin", "head_rank", "place", r("recall"))


@family.query(f"""WITH {SCORED} SELECT t.hashvin, t.head_rank AS truth_rank, p.head_rank AS pred_rank, count(s.session_id) AS n FROM head t
  JOIN head p USING (hashvin) LEFT JOIN sc s ON s.hashvin = t.hashvin AND s.y_class = t.place AND s.y_pred = p.place GROUP BY ALL""")
def head_confusion(spark, d):
    return mt.head_confusion(scored(spark, d), head(spark, d))


@family.query(f"""WITH {SCORED} SELECT tau, round(avg(CAST(proba >= tau AS DOUBLE)), 6) AS coverage, round(avg(hit) FILTER (WHERE proba >= tau), 6) AS accuracy,
  count(*) FILTER (WHERE proba >= tau) AS n FROM sc, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS tau) GROUP BY 1""")
def threshold_metrics(spark, d):
    return mt.threshold_metrics(scored(spark, d)).select("tau", r("coverage"), r("accuracy"), "n")


_SPLITS = """count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'valid') AS n_valid,
  count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split = 'test' AND hit = 1) AS hits, count(*) FILTER (WHERE split = 'test'
  AND hit = 0) AS misses, avg(hit) FILTER (WHERE split = 'test') AS accuracy"""


@family.query(f"""WITH {SCORED}, c AS (SELECT y_class, count(*) AS n, {_SPLITS} FROM sc GROUP BY 1)
  SELECT y_class, n, n_train, n_valid, n_test, hits, misses, round(n / sum(n) OVER (), 6) AS share, round(accuracy, 6) AS accuracy, y_class IN (SELECT place
  FROM head) AS is_head FROM c""")
def class_stats(spark, d):
    x = mt.class_stats(scored(spark, d), head(spark, d))
    return x.select("y_class", "n", "n_train", "n_valid", "n_test", "hits", "misses", r("share"), r("accuracy"), "is_head")


_AUC = """SELECT {0}, CASE WHEN count(*) FILTER (WHERE label = 1) > 0
  AND count(*) FILTER (WHERE label = 0) > 0 THEN (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {0} ORDER BY proba) + (count(*) OVER (PARTITION BY {0}, proba) - 1) / 2.0 AS rk FROM sa) GROUP BY ALL"""


@family.query(f"WITH {CANDIDATES} SELECT split, hashvin, round(auc, 6) AS auc FROM ({_AUC.format('split, hashvin')})")
def candidate_auc(spark, d):
    return mt.auc(scored_candidates(spark, d), ["split", "hashvin"]).select("split", "hashvin", r("auc"))


@family.query(f"""WITH {CANDIDATES} SELECT session_uid, place, label, round(proba, 6) AS proba FROM (SELECT *, row_number() OVER (PARTITION BY session_uid
  ORDER BY proba DESC, place) AS o FROM sa) WHERE o = 1""")
def session_top1(spark, d):
    return mt.session_top1(scored_candidates(spark, d)).select("session_uid", "place", "label", r("proba"))


@family.query(f"""WITH {CANDIDATES}, p AS (SELECT split, session_uid, max(label) AS found, count(*) AS n FROM sa GROUP BY ALL)
  SELECT split, round(avg(found), 6) AS coverage, round(avg(n), 6) AS mean_candidates FROM p GROUP BY 1""")
def candidate_coverage(spark, d):
    return mt.candidate_coverage(scored_candidates(spark, d), ["split"]).select("split", r("coverage"), r("mean_candidates"))


@family.query(
    f"""WITH {CANDIDATES}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY proba DESC, place) AS o FROM sa)
  WHERE o = 1), a AS ({_AUC.format('hashvin')}), c AS (SELECT hashvin, avg(found) AS coverage FROM (SELECT hashvin, session_uid, max(label) AS found FROM sa
  GROUP BY ALL) GROUP BY 1)
SELECT hashvin, count(*) AS sessions, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'valid') AS n_valid,
  count(*) FILTER (WHERE split = 'test') AS n_test, round(avg(label), 6) AS accuracy, sum(label)::BIGINT AS hits, (count(*) - sum(label))::BIGINT AS misses,
  round(any_value(a.auc), 6) AS auc, round(any_value(c.coverage), 6) AS coverage
FROM t JOIN a USING (hashvin) JOIN c USING (hashvin) GROUP BY 1"""
)
def vehicle_summary(spark, d):
    s = scored_candidates(spark, d)
    t = mt.session_top1(s).groupBy("hashvin").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.count_if(F.col("split") == x).alias(f"n_{x}") for x in ("train", "valid", "test")], F.avg("label").alias("accuracy"),
        F.sum("label").alias("hits"), (F.count(F.lit(1)) - F.sum("label")).alias("misses"),
    )
    out = t.join(mt.auc(s, ["hashvin"]), "hashvin").join(mt.candidate_coverage(s, ["hashvin"]), "hashvin")
    return out.select("hashvin", "sessions", "n_train", "n_valid", "n_test", r("accuracy"), "hits", "misses", r("auc"), r("coverage"))


@family.query(f"""WITH {SCORED}, c AS (SELECT hashvin, y_class, count(*) AS n, {_SPLITS} FROM sc GROUP BY ALL)
  SELECT hashvin, y_class, n, n_train, n_valid, n_test, hits, misses, round(n / sum(n) OVER (PARTITION BY hashvin), 6) AS share, round(accuracy, 6) AS accuracy
  FROM c""")
def place_summary(spark, d):
    x = mt.class_stats(scored(spark, d), head(spark, d), ("hashvin", "y_class"))
    return x.select("hashvin", "y_class", "n", "n_train", "n_valid", "n_test", "hits", "misses", r("share"), r("accuracy"))


PARITY = "pt AS (SELECT event_id, value AS truth, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) * 3 + (event_id % 5 - 2) * 0.1::DOUBLE AS prediction FROM events)"


def parity(spark, d):
    e = fleet.table(spark, d, "events")
    return e.select("event_id", F.col("value").alias("truth"), ((F.col("value") / 3).cast("float").cast("double") * 3 + (F.col("event_id") % 5 - 2) * F.lit(0.1)).alias("prediction"))


@family.query(f"""WITH {PARITY} SELECT round(sqrt(avg(pow(truth - prediction, 2))), 6) AS rmse, round(avg(abs(truth - prediction)), 6) AS mae,
  round(1 - sum(pow(truth - prediction, 2)) / (var_pop(truth) * count(*)), 6) AS r2 FROM pt""")
def regression_metrics(spark, d):
    return mt.regression(parity(spark, d)).select(r("rmse"), r("mae"), r("r2"))


@family.query(f"""WITH {PARITY}, s AS (SELECT truth - prediction AS e, min(truth - prediction) OVER () AS a, max(truth - prediction) OVER () AS b FROM pt)
  SELECT CAST(least(49, floor((e - a) / ((b - a) / 50))) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1""")
def residual_table(spark, d):
    return mt.residual_histogram(parity(spark, d))


@family.query("""SELECT round(avg(abs(value / 7 - CAST(CAST(value / 7 AS FLOAT) AS DOUBLE))), 12) AS mean_diff,
  round(max(abs(value / 7 - CAST(CAST(value / 7 AS FLOAT) AS DOUBLE))), 12) AS max_diff, round(median(abs(value / 7 - CAST(CAST(value / 7 AS FLOAT) AS DOUBLE))),
  12) AS median_diff, avg(abs(value / 7 - CAST(CAST(value / 7 AS FLOAT) AS DOUBLE))) < 1e-5 AS same FROM events""")
def dtype_parity(spark, d):
    x = F.col("value") / 7
    gap = F.abs(x - x.cast("float").cast("double"))
    e = fleet.table(spark, d, "events")
    return e.agg(F.round(F.avg(gap), 12).alias("mean_diff"), F.round(F.max(gap), 12).alias("max_diff"), F.round(F.median(gap), 12).alias("median_diff"), (F.avg(gap) < 1e-5).alias("same"))


@family.query(f"WITH {SCORED} SELECT session_uid, y_class FROM mk WHERE in_head")
def head_semi_filter(spark, d):
    h = head(spark, d).select("hashvin", F.col("place").alias("y_class"))
    return scored(spark, d).join(h, ["hashvin", "y_class"], "left_semi").select("session_uid", "y_class")


@family.query(f"WITH {CANDIDATES}, d AS (SELECT session_uid, min(place) AS place FROM sa GROUP BY 1) SELECT * FROM d")
def dedupe_sessions(spark, d):
    w = W.partitionBy("session_uid").orderBy("place")
    return scored_candidates(spark, d).withColumn("o", F.row_number().over(w)).filter("o = 1").select("session_uid", "place")


@family.query(f"WITH {SCORED} SELECT y_class AS label FROM sc UNION SELECT y_pred FROM sc UNION SELECT place FROM head")
def label_universe(spark, d):
    s = scored(spark, d)
    return s.select(F.col("y_class").alias("label")).union(s.select("y_pred")).union(head(spark, d).select("place")).distinct()


@family.query(f"""WITH {SCORED}, h AS (SELECT hashvin, place, head_rank AS o FROM head UNION ALL SELECT hashvin, session_cluster, 100 + o2
  FROM (SELECT hashvin, session_cluster, row_number() OVER (PARTITION BY hashvin ORDER BY c DESC, session_cluster) AS o2
  FROM (SELECT hashvin, session_cluster, count(*) AS c FROM long_cut GROUP BY ALL))) SELECT hashvin, place, CAST(row_number() OVER (PARTITION BY hashvin
  ORDER BY o) AS INTEGER) AS position FROM (SELECT hashvin, place, min(o) AS o FROM h GROUP BY ALL)""")
def union_results(spark, d):
    """HEAD places, then frequent long-stay places, each name once in its first position."""
    rest = pl.frequent_long_stay(long_cut(spark, d), 1000).select("hashvin", "place", (F.col("rank") + 100).alias("o"))
    both = head(spark, d).select("hashvin", "place", F.col("head_rank").alias("o")).unionByName(rest)
    first = both.groupBy("hashvin", "place").agg(F.min("o").alias("o"))
    return first.select("hashvin", "place", F.row_number().over(W.partitionBy("hashvin").orderBy("o")).alias("position"))


@family.query(f"""WITH {SCORED}, m AS (SELECT hashvin, avg(hit) AS accuracy FROM sc GROUP BY 1)
  SELECT hashvin, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY round(accuracy, 9) DESC, hashvin) AS INTEGER) AS position FROM m
  ORDER BY round(accuracy, 9) DESC, hashvin LIMIT 10""")
def top_n_rows(spark, d):
    m = scored(spark, d).groupBy("hashvin").agg(F.round(F.avg(mt.hit()), 9).alias("accuracy")).orderBy(F.desc("accuracy"), "hashvin").limit(10)
    return m.select("hashvin", r("accuracy"), F.row_number().over(W.orderBy(F.desc(F.col("accuracy")), "hashvin")).alias("position"))


@family.query(
    f"""WITH {SCORED}, o AS (SELECT hashvin, y_class AS feature, count(*) AS importance FROM sc GROUP BY ALL),
n AS (SELECT hashvin, 'new' AS feature, 1::BIGINT AS importance FROM (SELECT DISTINCT hashvin FROM sc) WHERE CAST(substr(hashvin, 4) AS INTEGER) % 2 = 0)
SELECT * FROM o WHERE hashvin NOT IN (SELECT hashvin FROM n) UNION ALL SELECT * FROM n"""
)
def upsert_importance(spark, d):
    """A table by vehicle in which later rows of a vehicle take the place of its earlier ones."""
    s = scored(spark, d)
    old = s.groupBy("hashvin", F.col("y_class").alias("feature")).agg(F.count(F.lit(1)).alias("importance"))
    new = s.select("hashvin").distinct().filter(F.substring("hashvin", 4, 10).cast("int") % 2 == 0).select("hashvin", F.lit("new").alias("feature"), F.lit(1).cast("bigint").alias("importance"))
    path = f"{work_folder(s)}/{uuid.uuid4().hex}"
    sinks.upsert(old, path, parts=sinks.PARTS)
    sinks.upsert(new, path, parts=sinks.PARTS)
    return spark.read.schema("feature string, importance bigint, hashvin string").parquet(path).select("feature", "importance", "hashvin")


PATTERN = f"CASE WHEN session_cluster LIKE 'C%' THEN NULL WHEN (isodow({DATE06.format('start_time')})) % 4 = 0 THEN NULL ELSE 'P' || (isodow({DATE06.format('start_time')}) % 4) END"


@family.query(f"WITH {BASE} SELECT session_id, CASE WHEN session_cluster LIKE 'C%' THEN session_cluster ELSE coalesce({PATTERN}, 'N/A') END AS shown FROM sessions")
def session_pattern_lookup(spark, d):
    """A charge shows its place, other stays the pattern of their 06:00 day."""
    s = sessions(spark, d).withColumn("date06", ft.date06("start_time"))
    days = s.select("hashvin", "date06").distinct().withColumn("label", (ft.weekday("date06") + 1) % 4).filter("label <> 0")
    out = s.join(days, ["hashvin", "date06"], "left")
    shown = F.when(F.col("session_cluster").startswith("C"), F.col("session_cluster")).otherwise(F.coalesce(F.concat(F.lit("P"), F.col("label").cast("string")), F.lit("N/A")))
    return out.select("session_id", shown.alias("shown"))


def map_rows(spark, d):
    """A feature per stay with what its popup shows; moves without an end are none."""
    s = sessions(spark, d)
    kind = F.when(F.col("session_type") == "moving", "LineString").otherwise("Point")
    color = F.when(F.col("session_type") == "charging", "red").when(F.col("session_type") == "moving", "green").otherwise("blue")
    label = F.when(F.col("session_type") == "charging", "Charging").when(F.col("session_type") == "moving", "Moving").otherwise("Inactive")
    n = F.row_number().over(W.partitionBy("hashvin").orderBy("start_time", "session_id"))
    out = s.withColumn("number", n).filter("session_type <> 'moving' OR end_lat IS NOT NULL")
    end_soc = F.coalesce("end_soc", "start_soc")
    tenth = lambda c: F.round(c + 2e-9, 1)  # noqa: E731 - ties as in the SQL
    popup = {
        "title": F.concat(label, F.lit(" #"), F.col("number").cast("string")), "place": F.col("session_cluster"), "start_time": F.col("start_time"), "end_time": F.col("end_time"),
        "start_soc": tenth(F.col("start_soc")), "end_soc": F.when(F.col("start_soc").isNotNull(), tenth(end_soc)), "soc_change": tenth(end_soc - F.col("start_soc")),
        "position": F.format_string("%.6f, %.6f", "start_lat", "start_lon"), "link": F.format_string("https://www.google.com/maps?q=%.6f,%.6f", "start_lat", "start_lon"),
    }
    return out.select(
        "session_id", "hashvin", "number", kind.alias("geometry"), color.alias("color"), ft.date06("start_time").alias("time"), "start_lon", "start_lat", *[F.when(kind == "LineString", F.col(c)).alias(c) for c in ("end_lon", "end_lat")],
        geo.duration_text(F.col("duration_minutes")).alias("duration_text"), *[c.alias(name) for name, c in popup.items()],
    )


@family.query(
    f"""WITH {BASE}, nm AS (SELECT *, row_number() OVER (PARTITION BY hashvin ORDER BY start_time, session_id) AS number FROM sessions)
SELECT session_id, hashvin, CASE session_type WHEN 'moving' THEN 'LineString' ELSE 'Point' END AS geometry, CASE session_type WHEN 'charging' THEN 'red'
  WHEN 'moving' THEN 'green' ELSE 'blue' END AS color,
       {DATE06.format('start_time')} AS time, round(start_lon, 6) AS start_lon, round(start_lat, 6) AS start_lat, CASE WHEN session_type = 'moving' THEN round(end_lon, 6) END AS end_lon,
       CASE WHEN session_type = 'moving' THEN round(end_lat, 6) END AS end_lat, {TEXT} AS duration_text,
       CASE session_type WHEN 'charging' THEN 'Charging' WHEN 'moving' THEN 'Moving' ELSE 'Inactive' END || ' #' || number AS title, session_cluster AS place, start_time, end_time,
       round(start_soc + 2e-9, 1) AS start_soc, CASE WHEN start_soc IS NOT NULL THEN round(coalesce(end_soc, start_soc) + 2e-9, 1) END AS end_soc,
  round(coalesce(end_soc, start_soc) - start_soc + 2e-9, 1) AS soc_change,
       printf('%.6f, %.6f', start_lat, start_lon) AS position, printf('https://www.google.com/maps?q=%.6f,%.6f', start_lat, start_lon) AS link
FROM nm WHERE session_type <> 'moving' OR end_lat IS NOT NULL"""
)
def map_features(spark, d):
    """Flat columns; ``sinks.geojson`` makes the GeoJSON documents."""
    return map_rows(spark, d).drop("number").withColumns({c: F.round(c, 6) for c in ("start_lon", "start_lat", "end_lon", "end_lat")})


#: Features of a map document in the registered queries, fewer than some vehicles have.
MAP_CHUNK = 25


@family.query(
    f"""WITH {BASE}, nm AS (SELECT *, row_number() OVER (PARTITION BY hashvin ORDER BY start_time, session_id) AS number FROM sessions),
ft AS (SELECT hashvin, count(*) AS features, CAST((max(number) - 1) // {MAP_CHUNK} - (min(number) - 1) // {MAP_CHUNK} + 1 AS INTEGER) AS chunks,
  avg(start_lat) AS lat, avg(start_lon) AS lon FROM nm WHERE session_type <> 'moving' OR end_lat IS NOT NULL GROUP BY 1)
SELECT hashvin, coalesce(features, 0) AS features, coalesce(chunks, 0) AS chunks, round(coalesce(lat, 35.6812), 6) AS center_lat, round(coalesce(lon, 139.7671), 6) AS center_lon
FROM (SELECT DISTINCT hashvin FROM sessions UNION SELECT 'hv_' || lpad(CAST(c_custkey + 100000 AS VARCHAR), 6, '0') FROM customer) LEFT JOIN ft USING (hashvin)"""
)
def map_collections(spark, d):
    """The index of the map documents; vehicles without stays (here named after customers) have the default centre."""
    known = sessions(spark, d).select("hashvin").distinct()
    others = fleet.table(spark, d, "customer").select(F.concat(F.lit("hv_"), F.lpad((F.col("c_custkey") + 100000).cast("string"), 6, "0")).alias("hashvin"))
    index = sinks.map_index(map_rows(spark, d), known.union(others), MAP_CHUNK)
    return index.select("hashvin", "features", "chunks", r("center_lat"), r("center_lon"))
