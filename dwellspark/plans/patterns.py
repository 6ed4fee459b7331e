"""Day patterns: scaling, clustering, scores on given labels, profiles and their report tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time as ft
from ..operators import daily as dy
from ..operators import patterns as pt
from ..sources import fleet
from .base import DATE06, SESSIONS, Family
from .daily import FOLDED, MOVES, folded

family = Family()
r = lambda c, n=6: F.round(c, n).alias(c)

#: Long day features (key, day, feature, value) from the daily ratios; a day's label in the registered queries.
LONG = FOLDED + ", lg AS (SELECT hashvin AS key, date06 AS day, bin || '__' || place AS feature, round(minutes / sum(minutes) OVER (PARTITION BY hashvin, date06), 9) AS value FROM folded)"
#: The same with the day's moves, which clustering takes too.
FEATURES = (
    LONG
    + MOVES.removeprefix(SESSIONS)
    + """, tf AS (
  SELECT hashvin AS key, date06 AS day, 'trans__' || from_place || '--' || to_place AS feature, count(*)::DOUBLE AS value FROM moves JOIN topmoves USING (from_place, to_place) GROUP BY ALL
  UNION ALL SELECT hashvin, date06, 'trans_count_' || period, count(*)::DOUBLE FROM moves GROUP BY ALL
  UNION ALL SELECT hashvin, date06, 'trans_count_total', count(*)::DOUBLE FROM moves GROUP BY ALL
  UNION ALL SELECT hashvin, date06, 'unique_clusters_visited', len(list_distinct(list_concat(list(from_place), list(to_place))))::DOUBLE FROM moves GROUP BY ALL
), lf AS (SELECT * FROM lg UNION ALL SELECT * FROM tf)"""
)
#: Every day of a vehicle with every feature of it, 0 where it has none, and its standard score.
SCALED = """, dn_fs AS (SELECT DISTINCT key, feature FROM lf),
dn_dy AS (SELECT DISTINCT key, day, CAST(date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) AS INTEGER) AS no FROM lf),
dn_dv AS (
  SELECT dn_dy.key, dn_dy.day, dn_dy.no, f.feature, l.value IS NOT NULL AS held, coalesce(l.value, 0) AS x
  FROM dn_dy JOIN dn_fs f ON f.key = dn_dy.key LEFT JOIN lf l ON l.key = dn_dy.key AND l.day = dn_dy.day AND l.feature = f.feature
), dn_sd AS (
  SELECT *, avg(x) OVER w AS mean, CASE WHEN min(x) OVER w = max(x) OVER w THEN 1 ELSE stddev_pop(x) OVER w END AS sd FROM dn_dv WINDOW w AS (PARTITION BY key, feature)
), dn_sc AS (SELECT key, day, no, feature, held, (x - mean) / sd AS z, (0 - mean) / sd AS z_absent FROM dn_sd)"""
DAY_LABEL = "CAST((isodow(day) + CAST(substr(key, 4) AS INTEGER)) % 4 AS INTEGER) - 1"
LABELS = f", lb AS (SELECT DISTINCT key, day, {DAY_LABEL} AS label FROM lg)"


def long_days(spark, d):
    x = dy.dwell_ratios(folded(spark, d))
    return x.select(F.col("hashvin").alias("key"), F.col("date06").alias("day"), F.concat(F.col("bin").cast("string"), F.lit("__"), F.col("place")).alias("feature"), F.round("ratio", 9).alias("value"))


def day_features(spark, d):
    """``long_days`` with the day's moves."""
    moves = dy.place_transitions(fleet.sessions(spark, d))
    x = dy.transition_long(moves, dy.top_transitions(moves, 15))
    return long_days(spark, d).unionByName(x.select(F.col("hashvin").alias("key"), F.col("date06").alias("day"), "feature", "value"))


def once(long):
    """The long rows written once, for steps that read them several times."""
    return pt.written(long, pt.work_folder(long))


def given_labels(long):
    label = ((ft.weekday("day") + 1 + F.substring("key", 4, 10).cast("int")) % 4).cast("int") - 1
    return long.select("key", "day").distinct().withColumn("label", label)


def embedded(spark, d):
    """Labelled vectors as one vehicle's days."""
    e = fleet.table(spark, d, "embeddings")
    return e.select(F.lit("all").alias("key"), F.col("vec_id").alias("day"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def day_vectors(spark, d):
    """(key, day, vector): standardised shares of the day by hour bin and place, and moves; days as numbers."""
    long = day_features(spark, d).select("key", F.unix_date(F.to_date("day")).alias("day"), "feature", "value")
    return pt.standard_vectors(once(long))


@family.query(f"WITH {FEATURES}{SCALED} SELECT key, day, feature, round(z, 5) + 0.0 AS z, round(z_absent, 5) + 0.0 AS z_absent FROM dn_sc WHERE held")
def standardize_days(spark, d):
    r5 = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return pt.standardize(once(day_features(spark, d))).select("key", "day", "feature", r5("z"), r5("z_absent"))


@family.query()
def day_kmeans(spark, d):
    return pt.day_kmeans(day_vectors(spark, d))


@family.query()
def k_metric_table(spark, d):
    days = day_vectors(spark, d)
    days = pt.written(days, pt.work_folder(days))
    return pt.average_ranks(pt.scores_by_k(pt.day_kmeans(days), days), "key")


SCORES = """
WITH e AS (SELECT vec_id AS x, CAST(label AS INTEGER) AS label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT x, label, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, i, avg(c) AS c FROM f GROUP BY ALL), mv AS (SELECT label, list(c ORDER BY i) AS c FROM m GROUP BY 1), g AS (SELECT i, avg(c) AS c FROM f
  GROUP BY 1), gv AS (SELECT list(c ORDER BY i) AS c FROM g),
nr AS (SELECT e.x, e.label, list_distance(e.v, mv.c) AS d FROM e JOIN mv USING (label)),
sp AS (SELECT label, count(*) AS n, avg(d) AS s, sum(d * d) AS w FROM nr GROUP BY 1), pa AS (SELECT sp.*, mv.c FROM sp JOIN mv USING (label)),
ch AS (SELECT (sum(n * pow(list_distance(pa.c, gv.c), 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS v FROM pa, gv),
db AS (SELECT avg(r) AS v FROM (SELECT p.label, max((p.s + q.s) / list_distance(p.c, q.c)) AS r FROM pa p JOIN pa q ON p.label <> q.label GROUP BY 1)),
pr AS (SELECT a.x, a.label AS lx, b.label AS ly, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.x <> b.x GROUP BY ALL),
si AS (SELECT avg(CASE WHEN own IS NULL THEN 0 ELSE (oth - own) / greatest(own, oth) END) AS v FROM (SELECT x, max(CASE
  WHEN lx = ly THEN d END) AS own, min(CASE WHEN lx <> ly THEN d END) AS oth FROM pr GROUP BY 1))
SELECT 'all' AS key, round(si.v, 5) AS silhouette, round(ch.v, 4) AS calinski_harabasz, round(db.v, 5) AS davies_bouldin FROM si, ch, db"""


@family.query(SCORES)
def cluster_scores(spark, d):
    return pt.cluster_scores(embedded(spark, d), "key").select("key", r("silhouette", 5), r("calinski_harabasz", 4), r("davies_bouldin", 5))


_RANKS = """WITH s AS (SELECT c_custkey % 20 AS key, c_nationkey AS k, round(avg(c_acctbal), -2) AS silhouette, count(*) AS calinski_harabasz,
  round(min(c_acctbal), -3) AS davies_bouldin FROM customer GROUP BY ALL)"""


@family.query(
    f"""{_RANKS}, q AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY silhouette DESC) + (count(*) OVER (PARTITION BY key, silhouette) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY key ORDER BY calinski_harabasz DESC) + (count(*) OVER (PARTITION BY key, calinski_harabasz) - 1) / 2.0 AS r2,
rank() OVER (PARTITION BY key ORDER BY davies_bouldin) + (count(*) OVER (PARTITION BY key, davies_bouldin) - 1) / 2.0 AS r3 FROM s)
SELECT key, k, round((r1 + r2 + r3) / 3.0, 6) AS mean_rank, row_number() OVER (PARTITION BY key ORDER BY round((r1 + r2 + r3) / 3.0, 9), k) = 1 AS best FROM q"""
)
def average_rank(spark, d):
    return _choose(spark, d)


def _choose(spark, d):
    """Average ranks of scores by key and k, here of customers by segment and nation."""
    c = fleet.table(spark, d, "customer").groupBy((F.col("c_custkey") % 20).alias("key"), F.col("c_nationkey").alias("k"))
    s = c.agg(F.round(F.avg("c_acctbal"), -2).alias("silhouette"), F.count(F.lit(1)).alias("calinski_harabasz"), F.round(F.min("c_acctbal"), -3).alias("davies_bouldin"))
    return pt.average_ranks(s, "key").select("key", "k", r("mean_rank"), "best")


@family.query(
    f"""SELECT key, k AS best_k FROM ({_RANKS}, q AS (SELECT *, rank() OVER (PARTITION BY key
  ORDER BY silhouette DESC) + (count(*) OVER (PARTITION BY key, silhouette) - 1) / 2.0 + rank() OVER (PARTITION BY key
  ORDER BY calinski_harabasz DESC) + (count(*) OVER (PARTITION BY key, calinski_harabasz) - 1) / 2.0
+ rank() OVER (PARTITION BY key ORDER BY davies_bouldin) + (count(*) OVER (PARTITION BY key, davies_bouldin) - 1) / 2.0 AS t FROM s)
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, k) AS o FROM q) WHERE o = 1"""
)
def choose_k(spark, d):
    return _choose(spark, d).filter("best").select("key", F.col("k").alias("best_k"))


#: Standardised day vectors, distances, core distances, links and what each day reaches.
DENSITY = SCALED + """,
dn_pr AS (SELECT a.key, a.no AS a, b.no AS b, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 9) AS d FROM dn_sc a JOIN dn_sc b ON b.key = a.key AND b.feature = a.feature AND b.no <> a.no GROUP BY ALL),
dn_co AS (SELECT key, a AS no, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY key, a ORDER BY d, b) AS k FROM dn_pr)
  WHERE k = 3), dn_ep AS (SELECT key, quantile_cont(core, 0.9) AS eps FROM dn_co GROUP BY 1),
dn_ed AS (SELECT p.key, p.a, p.b FROM dn_pr p JOIN dn_co x ON x.key = p.key AND x.no = p.a JOIN dn_co y ON y.key = p.key AND y.no = p.b
  JOIN dn_ep ON dn_ep.key = p.key WHERE greatest(p.d, x.core, y.core) <= eps + 1e-9),
dn_re AS (SELECT key, no AS a, no AS b FROM dn_dy UNION SELECT r.key, r.a, e.b FROM dn_re r JOIN dn_ed e ON e.key = r.key
  AND e.a = r.b), dn_la AS (SELECT key, a AS day, min(b) AS label FROM dn_re GROUP BY ALL)
SELECT key, day, CASE WHEN count(*) OVER (PARTITION BY key, label) >= 5 THEN label ELSE -1 END AS label FROM dn_la"""


@family.query(f"WITH RECURSIVE {FEATURES}{DENSITY}")
def density_days(spark, d):
    return pt.density_groups(day_vectors(spark, d))


NEAREST = """, vc AS (SELECT key, label, i, avg(x) AS c FROM lv GROUP BY ALL),
nd AS (SELECT lv.key, lv.label, lv.day, round(sum((x - c) * (x - c)), 9) AS d2 FROM lv JOIN vc ON vc.key = lv.key AND vc.label = lv.label AND vc.i = lv.i GROUP BY ALL)
SELECT key, label, CAST(rank AS INTEGER) AS rank, day FROM (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY d2, day) AS rank FROM nd) WHERE rank <= 3"""


@family.query(f"""WITH {LONG}{LABELS}, fs AS (SELECT DISTINCT key, feature FROM lg), lv AS (SELECT b.key, b.label, b.day, f.feature AS i, coalesce(l.value, 0) AS x
FROM lb b JOIN fs f ON f.key = b.key LEFT JOIN lg l ON l.key = b.key AND l.day = b.day AND l.feature = f.feature WHERE b.label <> -1){NEAREST}""")
def nearest_days(spark, d):
    """The three days nearest to the mean of their pattern."""
    x = once(long_days(spark, d))
    return pt.nearest_days(x, given_labels(x))


PROFILE = LONG + LABELS + """, ds AS (SELECT key, label, count(*) AS days FROM lb WHERE label <> -1
  GROUP BY ALL), pf AS (SELECT l.key, b.label, feature, sum(value) / any_value(days) AS mean, any_value(days) AS days FROM lg l JOIN lb b USING (key, day)
  JOIN ds ON ds.key = l.key AND ds.label = b.label GROUP BY ALL)"""


@family.query(f"WITH {PROFILE} SELECT key, label, feature, round(mean, 6) AS mean, days FROM pf")
def pattern_profiles(spark, d):
    x = long_days(spark, d)
    return pt.profiles(x, given_labels(x)).select("key", "label", "feature", r("mean"), "days")


@family.query(f"WITH {LONG}{LABELS} SELECT key, label, days, round(days / sum(days) OVER (PARTITION BY key), 6) AS share FROM (SELECT key, label, count(*) AS days FROM lb GROUP BY ALL)")
def pattern_sizes(spark, d):
    return pt.pattern_sizes(given_labels(long_days(spark, d))).select("key", "label", "days", r("share"))


@family.query(
    f"""WITH {PROFILE}, fr AS (SELECT key, label, b.bin, p.place FROM (SELECT DISTINCT key, label
  FROM pf), (SELECT unnest(range(24)) AS bin) b, (SELECT session_cluster AS place FROM top UNION ALL SELECT 'OTHER') p)
SELECT fr.key, fr.label, CAST(fr.bin AS INTEGER) AS bin, fr.place, coalesce(round(mean, 6), 0) AS mean FROM fr LEFT JOIN pf ON pf.key = fr.key
  AND pf.label = fr.label AND pf.feature = fr.bin || '__' || fr.place"""
)
def pattern_heatmap(spark, d):
    x = once(long_days(spark, d))
    p = pt.profiles(x, given_labels(x)).groupBy("key", "label").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.round("mean", 6)))).alias("means"))
    places = dy.top_places(fleet.sessions(spark, d), 6).select(F.col("session_cluster").alias("place")).union(spark.createDataFrame([("OTHER",)], "place string"))
    frame = p.crossJoin(F.broadcast(places)).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("bin"))
    mean = F.col("means")[F.concat(F.col("bin").cast("string"), F.lit("__"), F.col("place"))]
    return frame.select("key", "label", "bin", "place", F.coalesce(mean, F.lit(0.0)).alias("mean"))


WEEKDAYS = LONG + LABELS + """, wc AS (SELECT key, label, CAST(isodow(day) - 1 AS INTEGER) AS dow, count(*) AS n FROM lb GROUP BY ALL),
wk AS (SELECT f.key, f.label, f.dow, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY f.key, f.label) AS share
  FROM (SELECT DISTINCT key, label, CAST(dd.dow AS INTEGER) AS dow FROM lb, (SELECT unnest(range(7)) AS dow) dd) f LEFT JOIN wc USING (key, label, dow))"""


@family.query(f"WITH {WEEKDAYS} SELECT key, label, dow, round(share, 6) AS share, row_number() OVER (PARTITION BY key, label ORDER BY n DESC, dow) = 1 AS is_top FROM wk")
def pattern_weekdays(spark, d):
    lb = given_labels(long_days(spark, d))
    n = lb.groupBy("key", "label", ft.weekday("day").alias("dow")).agg(F.count(F.lit(1)).alias("n"))
    frame = lb.select("key", "label").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    x = frame.join(n, ["key", "label", "dow"], "left").na.fill(0, ["n"])
    w = W.partitionBy("key", "label")
    return x.select("key", "label", "dow", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), (F.row_number().over(w.orderBy(F.desc("n"), "dow")) == 1).alias("is_top"))
