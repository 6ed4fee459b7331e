"""Session, charge and series tables, read from files or derived from event tables.

``sessions`` and ``charges`` map the event stream onto vehicle stays; everything is
partitioned by vehicle (``hashvin``).  Times are wall-clock ``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONG_STAY_MINUTES = 360.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of a session file.
SESSION_SCHEMA = (
    "session_id bigint, hashvin string, session_type string, session_cluster string, start_time timestamp_ntz, end_time timestamp_ntz, duration_minutes double, "
    "start_lat double, start_lon double, start_soc double, end_soc double"
)
#: Fields without which a row is no session.
REQUIRED = ("session_id", "hashvin", "start_time", "end_time", "duration_minutes")
BROKEN = "broken_record"


def read_sessions(spark: SparkSession, path: str, min_minutes: float = 0.0, fmt: str = "parquet", schema: str = SESSION_SCHEMA, quarantine: str | None = None, header: bool = True) -> DataFrame:
    """A session file of a declared schema without stays shorter than ``min_minutes`` (pushed to a Parquet scan).

    Rows of text files that don't parse, or lack a required field, are left out; with ``quarantine``, they are
    written there with the reason (``reason``) and the text (``broken_record``).
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path).filter(F.col("duration_minutes") >= min_minutes)
    reader = spark.read.format(fmt).schema(f"{schema}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    rows = (reader.option("header", header) if fmt == "csv" else reader).load(path)
    absent = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in REQUIRED if c in rows.columns])
    reason = F.when(F.col(BROKEN).isNotNull(), "unparsed").when(absent != "", F.concat(F.lit("missing "), absent))
    marked = rows.withColumn("reason", reason)
    if quarantine is not None:
        marked.filter("reason IS NOT NULL").write.mode("overwrite").parquet(quarantine)
    return marked.filter("reason IS NULL").drop("reason", BROKEN).filter(F.col("duration_minutes") >= min_minutes)


def read_series(df: DataFrame, value: str, time: str | None = None) -> DataFrame:
    """(t, value) of a table; a missing column is an error that lists those available."""
    for c in (value, *([time] if time else [])):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}; available: {', '.join(df.columns)}")
    return df.select(*([F.col(time).alias("t")] if time else []), F.col(value).cast("double").alias("value"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per stay, charge or move: an event until the vehicle's next one.

    Rows are dealt by hashvin, of which a user has one, so that later windows and groups by vehicle shuffle nothing.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "purchase", "charging").when(F.col("event_type") == "signup", "moving").otherwise("inactive")
    order = W.partitionBy("hashvin", "user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", k.alias("k"), kind.alias("session_type"))
    place = F.when(F.col("session_type") == "charging", 20 + F.col("k") % 5).when(F.col("session_type") == "moving", 30).otherwise(F.col("k") % 8)
    ev = ev.withColumn("place_no", place.cast("int"))
    ev = ev.withColumns(
        {
            "lat": F.lit(35.0) + F.lit(0.01) * F.col("place_no") + F.lit(0.0001) * (F.col("event_id") % 7),
            "lon": F.lit(139.0) + F.lit(0.012) * F.col("place_no") + F.lit(0.0001) * (F.col("event_id") % 11),
            "soc": F.least("value", F.lit(100.0)),
        }
    )
    cluster = (
        F.when(F.col("session_type") == "charging", F.concat(F.lit("C_"), (F.col("k") % 5).cast("string")))
        .when(F.col("session_type") == "moving", "M_0")
        .when(F.col("k") >= 95, "-1")
        .otherwise(F.concat(F.lit("I_"), (F.col("k") % 8).cast("string")))
    )
    ev = ev.withColumn("hashvin", F.concat(F.lit("hv_"), F.lpad(F.col("user_id").cast("string"), 5, "0"))).repartition("hashvin")
    nxt = {c: F.lead(c).over(order) for c in ("ts", "lat", "lon", "soc")}
    out = ev.select(
        F.col("event_id").alias("session_id"), "hashvin", F.col("ts").alias("start_time"),
        nxt["ts"].alias("end_time"), "session_type", cluster.alias("session_cluster"), "place_no", "k", F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"),
        nxt["lat"].alias("end_lat"), nxt["lon"].alias("end_lon"), F.col("soc").alias("start_soc"), nxt["soc"].alias("end_soc"),
    )
    return out.filter("end_time IS NOT NULL").withColumn("duration_minutes", F.expr("cast(cast(cast(end_time - start_time AS INTERVAL SECOND) AS DECIMAL(20,6)) AS DOUBLE) / 60"))


def charges(stays: DataFrame) -> DataFrame:
    """A row per charge with the vehicle's next long stay (null label if there is none).

    The vehicle is passed from its end, since Spark reads a frame that ends with the vehicle anew for every row.
    """
    later = W.partitionBy("hashvin").orderBy(F.desc("start_time"), F.desc("session_id")).rowsBetween(W.unboundedPreceding, -1)
    long = (F.col("session_type") == "inactive") & (F.col("duration_minutes") >= LONG_STAY_MINUTES) & (F.col("session_cluster") != "-1")
    fields = F.struct("session_cluster", "start_time", "end_time", "start_lat", "start_lon", "duration_minutes")
    found = stays.withColumn("n", F.last(F.when(long, fields), ignorenulls=True).over(later)).filter("session_type = 'charging'")
    return found.select(
        "session_id", "hashvin", F.col("start_time").alias("charge_start_time"), F.col("end_time").alias("charge_end_time"), F.col("session_cluster").alias("charge_cluster"),
        F.col("start_lat").alias("charge_lat"), F.col("start_lon").alias("charge_lon"), F.col("start_lat").alias("charging_start_lat"), F.col("start_lon").alias("charging_start_lon"),
        F.col("start_soc").alias("charge_start_soc"), F.col("end_soc").alias("charge_end_soc"), F.col("duration_minutes").alias("charge_durations_minutes"), "k",
        F.col("n.session_cluster").alias("next_long_inactive_cluster"), F.col("n.start_time").alias("inactive_start_time"), F.col("n.end_time").alias("inactive_end_time"),
        F.col("n.start_lat").alias("inactive_lat"), F.col("n.start_lon").alias("inactive_lon"), F.col("n.duration_minutes").alias("inactive_time_minutes"),
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, value): order value per day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("t")).agg(F.sum("o_totalprice").alias("value"))


def seasonal_series(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """(t, value) with a trend, a daily and a weekly cycle of hourly steps, and optional noise."""
    t, turn = F.col("t"), 6.283185307179586
    value = 5 + 0.0015 * t + F.sin(turn * t / 24) + 0.5 * F.sin(turn * t / 168)
    return spark.range(n).select(F.col("id").alias("t")).select("t", (value + noise * F.randn(seed) if noise else value).alias("value"))


def vehicle_hours(vehicles: DataFrame, start: str, days: int) -> DataFrame:
    """(hashvin, timestamp): every hour of ``days`` days for each vehicle."""
    hours = F.sequence(F.expr(f"timestamp_ntz'{start}'"), F.expr(f"timestamp_ntz'{start}' + make_dt_interval({days}, -1)"), F.expr("INTERVAL '1' HOUR"))
    return vehicles.select("hashvin", F.explode(hours).alias("timestamp"))
