"""Visits and lookups of places: counts instead of joins of charges with their vehicle's stays, and one table of facts per place."""

from datetime import datetime, timedelta

from dwellspark import registry
from dwellspark.operators import candidates as cd

SMALL = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1)


def test_visits_equal_brute_force_and_no_join_is_made(spark):
    # (session, order, charge, later stay, place): one stay lies 100 days before its charge, so it is no visit of the 90 days before any
    rows = [("v", i, DAY + timedelta(days=20 * i), DAY + timedelta(days=20 * i + (-100 if i == 5 else 1)), "ab"[i % 3 == 0], "train" if i < 8 else "test") for i in range(10)]
    schema = "hashvin string, session_order bigint, charge_start_time timestamp_ntz, inactive_start_time timestamp_ntz, next_long_inactive_cluster string, split string, session_uid string"
    table = lambda rs: spark.createDataFrame([(*r, f"v_{r[1]}") for r in rs], schema)
    for some in (rows, [r for r in rows if r[1] != 5]):
        pairs = spark.createDataFrame([(f"v_{r[1]}", "v", p) for r in some for p in "abc"], "session_uid string, hashvin string, place string")
        made = cd.place_visits(table(some), pairs)
        got = {(r.session_uid, r.place): (r.freq, round(r.recency_hours, 6)) for r in made.collect()}
        for _, order, at, *_ in some:
            for p in "abc":
                seen = [(o, t) for _, o, _, t, q, s in some if q == p and s == "train" and o < order]
                n = sum(t >= at - timedelta(days=90) for _, t in seen)
                hours = max(0.0, (at - max(seen)[1]).total_seconds() / 3600) if seen else 1e6
                assert got[f"v_{order}", p] == (n + 1.0, round(hours, 6))
        assert len(got) == 3 * len(some)
    plan = cd.place_visits(table(some), pairs.join(table(some).select("session_uid", "session_order", "charge_start_time"), "session_uid"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the one just above


def test_no_frame_reads_a_vehicle_to_its_end_for_every_row(spark):
    plan = registry.QUERIES["labeled_charges"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan


def test_lookups_make_no_row_per_absent_slot_or_target(spark):
    plan = registry.QUERIES["place_features_wide"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Expand" not in plan
