"""Minutes per vehicle, 06:00 day and place over a stream of stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.daily import split_by_day06
from ..functions.time import minutes_between


def place_minutes(stays: DataFrame, late: str = "2 days") -> DataFrame:
    """(date06, hashvin, session_cluster, minutes) of a streaming session table.

    Stays count for each 06:00 day that they touch; a day is final once ``late`` has passed
    after its last stay.  The stream's session zone must be UTC, so that wall-clock
    times keep their values.
    """
    pieces = split_by_day06(stays).withColumn("minutes", minutes_between("s", "e")).withColumn("at", F.col("s").cast("timestamp"))
    day = F.window("at", "24 hours", "24 hours", "6 hours")
    sums = pieces.withWatermark("at", late).groupBy(day.alias("w"), "hashvin", "session_cluster").agg(F.sum("minutes").alias("minutes"))
    return sums.select(F.col("w.start").alias("date06"), "hashvin", "session_cluster", "minutes")
