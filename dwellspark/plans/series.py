"""Series features, splits and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as sr
from ..sources import fleet
from .base import Family

family = Family()
r = lambda c, n=6: F.round(c, n).alias(c)

#: Order value per day and order priority: five series.
DAILY = "daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"
HOURS = "vh AS (SELECT event_id AS id, 'hv_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS hashvin, ts AS timestamp, value AS target FROM events)"


def daily(spark, d):
    return fleet.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("t")).agg(F.sum("o_totalprice").alias("value"))


def vehicle_hours(spark, d):
    return fleet.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("hv_"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("hashvin"), F.col("ts").alias("timestamp"), F.col("value").alias("target"))


@family.query(
    f"""WITH {DAILY}, l AS (SELECT series, t, value, lag(value, 4) OVER w AS lag_1, lag(value, 3) OVER w AS lag_2, lag(value, 2) OVER w AS lag_3, lag(value,
  1) OVER w AS lag_4 FROM daily WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t, round(lag_1, 2) AS lag_1, round(lag_2, 2) AS lag_2, round(lag_3,
  2) AS lag_3, round(lag_4, 2) AS lag_4, round(value, 2) AS target FROM l WHERE lag_1 IS NOT NULL"""
)
def lag_vector(spark, d):
    x = sr.lag_vectors(daily(spark, d), 4)
    return x.select("series", "t", *[F.round(F.col("lags")[i], 2).alias(f"lag_{i + 1}") for i in range(4)], r("target", 2))


@family.query(
    f"""WITH {DAILY}, s AS (SELECT series, t, avg(value) OVER w AS lag_mean, stddev_pop(value) OVER w AS lag_std, min(value) OVER w AS lag_min,
  max(value) OVER w AS lag_max, last_value(value) OVER w - first_value(value) OVER w AS lag_change, count(value) OVER w AS c,
row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i FROM daily WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT series, t, round(lag_mean + 1e-5, 2) AS lag_mean, round(lag_std, 2) AS lag_std, round(lag_min, 2) AS lag_min, round(lag_max, 2) AS lag_max,
  round(lag_change, 2) AS lag_change, CAST(i % 12 AS INTEGER) AS month_index, strftime(t, '%Y-%m') AS month FROM s WHERE c = 6"""
)
def rolling_stats(spark, d):
    x = sr.rolling_stats(daily(spark, d), 6)
    return x.select("series", "t", F.round(F.col("lag_mean") + 1e-5, 2).alias("lag_mean"), *[r(f"lag_{c}", 2) for c in ("std", "min", "max", "change")], F.col("month_index").cast("int").alias("month_index"), "month")


@family.query(
    f"""WITH {DAILY}, c AS (SELECT series, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM daily
  GROUP BY 1), j AS (SELECT c.series, c.t, value FROM c LEFT JOIN daily USING (series, t))
SELECT series, t, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS value FROM j"""
)
def forward_fill(spark, d):
    return sr.forward_fill(sr.calendar(daily(spark, d))).select("series", "t", r("value", 2))


@family.query(
    f"""WITH {HOURS}, o AS (SELECT id, row_number() OVER (ORDER BY timestamp, id) - 1 AS i, count(*) OVER () AS n FROM vh)
SELECT id, CASE WHEN i < greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' ELSE 'test' END AS split_80, CASE
  WHEN i < greatest(1, floor(n * 0.6::DOUBLE)) THEN 'train' WHEN i < greatest(1, floor(n * 0.8::DOUBLE)) THEN 'valid' ELSE 'test' END AS split_60 FROM o"""
)
def ratio_split(spark, d):
    splits = {"split_80": ((0.8, 0.2), ("train", "test")), "split_60": ((0.6, 0.2, 0.2), ("train", "valid", "test"))}
    return sr.time_cut_split(vehicle_hours(spark, d), splits, "timestamp").select("id", "split_80", "split_60")


@family.query(f"WITH {HOURS} SELECT hashvin, CAST(dense_rank() OVER (ORDER BY hashvin) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT hashvin FROM vh)")
def category_code(spark, d):
    return sr.category_codes(vehicle_hours(spark, d), "hashvin").select("hashvin", F.col("code").cast("int").alias("code"))


_TRAIN = "tr AS (SELECT * FROM vh WHERE id % 5 < 3 AND hashvin <> 'hv_00001')"


@family.query(f"WITH {HOURS}, {_TRAIN} SELECT hashvin, round(avg(target), 6) AS encoded FROM tr GROUP BY 1 UNION ALL SELECT '(all)', round(avg(target), 6) FROM tr")
def target_mean(spark, d):
    per, whole = sr.target_means(vehicle_hours(spark, d).filter("id % 5 < 3 AND hashvin <> 'hv_00001'"), "hashvin", "target")
    return per.unionByName(whole.select(F.lit("(all)").alias("hashvin"), F.col("mean_all").alias("encoded"))).select("hashvin", r("encoded"))


@family.query(f"""WITH {HOURS}, {_TRAIN}, p AS (SELECT hashvin, avg(target) AS e FROM tr GROUP BY 1) SELECT id, hashvin, round(coalesce(e, (SELECT avg(target)
  FROM tr)), 6) AS encoded FROM vh LEFT JOIN p USING (hashvin)""")
def target_encode_join(spark, d):
    x = vehicle_hours(spark, d)
    return sr.target_encode(x, x.filter("id % 5 < 3 AND hashvin <> 'hv_00001'"), "hashvin", "target").select("id", "hashvin", r("encoded"))


_MONTHS = ", ".join(f"round(sum(o_totalprice) FILTER (WHERE month(o_orderdate) = {m}), 2) AS m{m:02d}" for m in range(1, 13))


@family.query(f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_MONTHS} FROM orders GROUP BY 1 HAVING count(DISTINCT month(o_orderdate)) = 12")
def season_pivot(spark, d):
    o = fleet.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    p = o.groupBy("year").pivot("month", list(range(1, 13))).agg(F.sum("o_totalprice"))
    return p.dropna().select("year", *[F.round(F.col(f"`{m}`"), 2).alias(f"m{m:02d}") for m in range(1, 13)])
