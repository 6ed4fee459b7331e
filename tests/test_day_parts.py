import datetime as dt

from dwellspark.operators import daily as dy


def test_days_are_dealt_before_pieces_become_hours(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(f"v{v}", i, f"p{i % 3}", at(5 * i), at(5 * i + 5)) for v in range(3) for i in range(12)]
    stays = spark.createDataFrame(rows, "hashvin string, session_id int, session_cluster string, start_time timestamp_ntz, end_time timestamp_ntz")
    found = dy.place_minutes(stays, parts=5)
    assert found.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dy.place_minutes(stays).collect()))
    top = dy.top_per_bin(stays, 2, parts=5)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, dy.top_per_bin(stays, 2).collect()))
    assert dy.parts_of(0) == 1 and dy.parts_of(10 * dy.PART_STAYS + 1) == 11
