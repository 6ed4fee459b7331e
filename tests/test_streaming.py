"""The streaming job against the batch operators, and the export pivot."""

from pyspark.sql import functions as F

from dwellspark.functions.time import minutes_between
from dwellspark.operators import daily as dy
from dwellspark.plans.daily import folded
from dwellspark.sources import fleet
from dwellspark.streaming import daily as stream

SMALL = "/root/testdata/sf0.001"


def test_streamed_days_equal_the_batch(spark, tmp_path):
    stays = fleet.sessions(spark, SMALL).select("session_id", "hashvin", "session_cluster", "start_time", "end_time")
    stays.repartition(3).write.parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema(stays.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = stream.place_minutes(read).writeStream.format("memory").queryName("streamed_minutes").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(str(r.date06), r.hashvin, r.session_cluster): round(r.minutes, 6) for r in spark.table("streamed_minutes").collect()}
    pieces = dy.split_by_day06(stays).withColumn("minutes", minutes_between("s", "e"))
    want = pieces.groupBy("date06", "hashvin", "session_cluster").agg(F.sum("minutes").alias("minutes")).collect()
    assert got == {(str(r.date06), r.hashvin, r.session_cluster): round(r.minutes, 6) for r in want} and len(got) > 100


def test_wide_vectors_hold_what_the_long_ones_do(spark):
    long = folded(spark, SMALL)
    places = sorted(r.place for r in long.select("place").distinct().collect() if r.place != "OTHER")
    wide = dy.wide_vectors(long, places)
    assert len(wide.columns) == 2 + 24 * (len(places) + 1)
    names = [c for c in wide.columns if "__" in c]
    total = wide.select(sum((F.col(f"`{c}`") for c in names), F.lit(0.0)).alias("m")).agg(F.sum("m")).first()[0]
    assert abs(total - long.agg(F.sum("minutes")).first()[0]) < 1e-3
    few = wide.select("hashvin", "date06", F.col(f"`3__{places[0]}`").alias("m")).filter("m > 0").collect()
    held = {(r.hashvin, r.date06): r.minutes for r in long.filter((F.col("bin") == 3) & (F.col("place") == places[0])).collect()}
    assert {(r.hashvin, r.date06): r.m for r in few} == held
