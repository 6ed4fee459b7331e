"""Edge rules on a few hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import geo
from dwellspark.functions import time as ft
from dwellspark.operators import candidates as cd
from dwellspark.operators import cleaning as cl
from dwellspark.operators import daily as dy
from dwellspark.operators import metrics as mt
from dwellspark.operators import patterns as pt
from dwellspark.operators import series as sr
from dwellspark.sources import fleet


def at(text):
    return datetime.fromisoformat(text)


def test_day_begins_at_six(spark):
    df = spark.createDataFrame([(at("2025-10-23 20:00"),), (at("2025-10-23 03:00"),), (at("2025-10-23 06:00"),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(ft.date06("ts")).collect()] == [at("2025-10-23 06:00"), at("2025-10-22 06:00"), at("2025-10-23 06:00")]


def test_stays_are_cut_into_days_and_hours(spark):
    rows = [(1, at("2024-01-01 05:30"), at("2024-01-01 06:30")), (2, at("2024-01-01 07:00"), at("2024-01-04 07:00")), (3, at("2024-01-01 07:00"), at("2024-01-01 07:00"))]
    stays = spark.createDataFrame([(i, "v", f"I_{i}", a, b) for i, a, b in rows], "session_id int, hashvin string, session_cluster string, start_time timestamp_ntz, end_time timestamp_ntz")
    pieces = dy.split_by_day06(stays)
    assert {r.session_id: r.n for r in pieces.groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 4}
    bins = dy.hour_bins(pieces)
    assert {r.session_id: r.m for r in bins.groupBy("session_id").agg(F.sum("minutes").alias("m")).collect()} == {1: 60.0, 2: 3 * 24 * 60.0}
    assert sorted((r.bin, r.minutes) for r in bins.filter("session_id = 1").collect()) == [(0, 30.0), (23, 30.0)]


@pytest.mark.parametrize("n,share,expected", [(1, 0.7, (1, 0, 0)), (2, 0.7, (1, 0, 1)), (3, 0.7, (2, 0, 1)), (5, 0.7, (3, 1, 1)), (10, 0.7, (7, 1, 2)), (30, 0.7, (21, 3, 6)), (10, 0.8, (8, 1, 1)), (30, 0.8, (24, 3, 3))])
def test_chrono_split(spark, n, share, expected):
    df = spark.range(n).select(F.lit("v").alias("hashvin"), F.col("id").alias("session_order"))
    got = {r.split: r["count"] for r in cl.chrono_split(df, share).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "valid", "test")) == expected


def test_numbers_and_times_that_do_not_parse(spark):
    df = spark.createDataFrame([("12.5", "2024-01-01 10:00:00"), ("x", "n/a"), (None, None), ("3", "2024-01-01T10:00:00+00:00")], "start_soc string, t string")
    assert [r.start_soc for r in cl.coerce_numeric(df).collect()] == [12.5, None, None, 3.0]
    assert [r[0] for r in df.select(ft.japan_time("t")).collect()] == [at("2024-01-01 10:00"), None, None, at("2024-01-01 19:00")]


@pytest.mark.parametrize("base,expected", [(0.5, 7.0), (2.3, 7.0), (14.0, 14.0), (80.0, 56.0)])
def test_ladder_begins_and_ends_within_bounds(spark, base, expected):
    steps = spark.range(1).select(cd.ladder(F.lit(base)).alias("w")).first().w
    assert steps[0] == expected and steps[-1] == 56.0 and sorted(steps) == steps


def test_distance_of_missing_points_is_null(spark):
    df = spark.createDataFrame([(35.0, 139.0, None, 139.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine_m(*map(F.col, "abcd"))).collect()]
    assert got[0] is None and abs(got[1] - 20015086.8) < 1


def test_auc_and_thresholds(spark):
    one = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.9)], "g string, label int, proba double")
    assert mt.auc(one, ["g"]).first().auc is None
    two = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, 0.1)], "g string, label int, proba double")
    assert mt.auc(two, ["g"]).first().auc == 0.75
    s = spark.createDataFrame([("x", "x", 0.4)], "y_class string, y_pred string, proba double")
    assert [r.accuracy for r in mt.threshold_metrics(s).orderBy("tau").collect()] == [None, None, None]


def test_tied_scores_share_ranks(spark):
    df = spark.createDataFrame([("v", 3, 0.5, 10.0, 1.0), ("v", 4, 0.5, 9.0, 1.0), ("v", 5, 0.1, 9.0, 2.0)], "key string, k int, silhouette double, calinski_harabasz double, davies_bouldin double")
    got = {r.k: (r.mean_rank, r.best) for r in pt.average_ranks(df, "key").collect()}
    assert got[3][1] and abs(got[3][0] - (1.5 + 1 + 1.5) / 3) < 1e-9 and abs(got[4][0] - (1.5 + 2.5 + 1.5) / 3) < 1e-9


def test_missing_series_column_is_named(spark):
    with pytest.raises(ValueError, match="available: id"):
        fleet.read_series(spark.range(3), "value")


def test_lag_one_is_the_oldest(spark):
    df = spark.range(5).select(F.lit("s").alias("series"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"))
    row = sr.lag_vectors(df, 3).orderBy("t").first()
    assert row.lags == [0.0, 1.0, 2.0] and row.target == 3.0


def test_calendar_bins_before_the_charge(spark):
    rows = spark.createDataFrame([("u0", "v", at("2024-01-02 00:00")), ("u1", "v", at("2024-01-02 06:00")), ("u2", "v", at("2024-01-02 23:59"))], "session_uid string, hashvin string, charge_start_time timestamp_ntz")
    stays = spark.createDataFrame([("v", "I_2", at("2024-01-01 12:00"), at("2024-01-02 03:00")), ("v", "I_1", at("2024-01-02 03:00"), at("2024-01-02 06:00"))], "hashvin string, session_cluster string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = {(r.session_uid, r.bin): (r.place, r.minutes) for r in cd.daily_bins(rows, stays).collect()}
    assert all(got["u0", b] == ("unknown", 0.0) for b in range(4))
    assert got["u1", 0] == ("I_2", 180.0) and got["u1", 1] == ("unknown", 0.0)  # a tie keeps the stay that began first
    assert got["u2", 0] == ("I_2", 180.0) and len(got) == 12


def test_top_places_fill_what_a_day_lacks(spark):
    stays = spark.sql(
        """SELECT * FROM VALUES ('v', 1, 'inactive', 'a', TIMESTAMP_NTZ'2024-01-01 06:00:00', TIMESTAMP_NTZ'2024-01-01 06:20:00'), ('v', 2, 'inactive', 'b', TIMESTAMP_NTZ'2024-01-01 06:20:00', TIMESTAMP_NTZ'2024-01-01 06:40:00'),
        ('v', 3, 'inactive', 'c', TIMESTAMP_NTZ'2024-01-01 06:40:00', TIMESTAMP_NTZ'2024-01-01 06:50:00') AS t(hashvin, session_id, session_type, session_cluster, start_time, end_time)"""
    )
    rows = dy.top_per_bin(stays, 2).collect()
    got = {(r.bin, r["rank"]): (r.place, round(r.minutes, 6)) for r in rows}
    assert len(rows) == len(got) == 48 and {k: v for k, v in got.items() if v != ("", 0.0)} == {(0, 1): ("a", 20.0), (0, 2): ("b", 20.0)}
    assert dy.top_per_bin(stays.filter("false"), 2).count() == 0


@pytest.mark.parametrize("truth, kept", [("all", {"train", "valid", "test"}), ("train", {"train"}), ("none", set())])
def test_truth_is_forced_where_asked(spark, truth, kept):
    rows = spark.sql(
        """SELECT 'v' AS hashvin, concat('v_', id) AS session_uid, id AS session_order, timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 08:00:00') AS charge_start_time,
        timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 09:00:00') AS charge_end_time, timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 10:00:00') AS inactive_start_time,
        concat('p', id) AS next_long_inactive_cluster, CASE WHEN id < 3 THEN 'train' WHEN id = 3 THEN 'valid' ELSE 'test' END AS split FROM range(5)"""
    )
    intervals = spark.createDataFrame([("v", 7.0)], "hashvin string, interval_days double")
    nearest = spark.createDataFrame([(f"v_{i}", f"q{j}", j) for i in range(5) for j in (1, 2)], "session_uid string, place string, distance_order int")
    found = cd.candidates(rows, intervals, nearest, truth).collect()
    assert {r.source for r in found if r.is_truth} <= {"label"} and {s.split for s in rows.collect() if any(r.is_truth and r.session_uid == s.session_uid for r in found)} == kept
    last = sorted((r["rank"], r.place, r.source) for r in found if r.session_uid == "v_4" and not r.is_truth)
    # four earlier places, then the nearest others up to six in all
    assert [x[2] for x in last][:4] == ["window"] * 4 and {x[1] for x in last} <= {"p0", "p1", "p2", "p3", "q1", "q2"}
