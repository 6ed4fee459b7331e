"""Filters, type repair, ordering and time splits of session and charge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names that are unknown when a prediction is made.
LEAKS = ("charge_end_time", "charge_durations_minutes", "charge_end_soc", "inactive_start_time", "inactive_end_time", "inactive_time_minutes")
NUMERIC = ("charge_start_soc", "charge_end_soc", "start_soc", "end_soc", "charge_durations_minutes", "inactive_time_minutes")
LONG_STAY_MINUTES = 360.0


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Texts that are no number become null; absent columns are skipped."""
    return df.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in columns if c in df.columns})


def labeled(df: DataFrame, label: str = "next_long_inactive_cluster") -> DataFrame:
    return df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))


def is_long_inactive(minutes: float = LONG_STAY_MINUTES) -> Column:
    return (F.col("session_type") == "inactive") & (F.col("duration_minutes") >= minutes) & (F.col("session_cluster") != "-1")


def long_inactive(stays: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Long parking stays, up to each vehicle's ``cutoff`` if given."""
    out = stays.filter(is_long_inactive())
    return out if cutoffs is None else out.join(cutoffs, "hashvin").filter(F.col("start_time") <= F.col("cutoff")).drop("cutoff")


def order_charges(df: DataFrame) -> DataFrame:
    """session_order from 0, session_uid, and the previous label and parking position."""
    w = W.partitionBy("hashvin").orderBy("charge_start_time", "session_id")
    return df.withColumns(
        {
            "session_order": (F.row_number().over(w) - 1).cast("bigint"),
            "prev_cluster": F.lag("next_long_inactive_cluster").over(w),
            "prev_lat": F.lag("inactive_lat").over(w),
            "prev_lon": F.lag("inactive_lon").over(w),
        }
    ).withColumn("session_uid", F.concat("hashvin", F.lit("_"), F.col("session_order").cast("string")))


def chrono_split(df: DataFrame, train: float, valid: float = 0.1, name: str = "split") -> DataFrame:
    """Each vehicle's rows by session_order: train, then valid, then test.

    One or two rows: the first trains.  Else train has floor(n * train) rows (1 at least),
    valid floor(n * valid) (1 at least), and one row at least is left for test.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("hashvin"))
    te = F.greatest(F.floor(n * F.lit(train)), F.lit(1))
    ve = F.least(F.greatest(te + F.floor(n * F.lit(valid)), te + 1), n - 1)
    i = F.col("session_order")
    split = F.when(n <= 2, F.when(i == 0, "train").otherwise("test")).when(i < te, "train").when(i < ve, "valid").otherwise("test")
    return df.withColumn(name, split)


def train_cutoffs(split: DataFrame, name: str = "split") -> DataFrame:
    """(hashvin, cutoff): the last training charge's start."""
    return split.filter(F.col(name) == "train").groupBy("hashvin").agg(F.max("charge_start_time").alias("cutoff"))


def station_types(df: DataFrame, by_cluster: Mapping[str, str]) -> Column:
    """station_type, else charge_station_type, else the place's type; 'unknown' for null."""
    present = [c for c in ("station_type", "charge_station_type") if c in df.columns]
    if present:
        return F.coalesce(F.col(present[0]), F.lit("unknown"))
    pairs = [x for k, v in by_cluster.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.col("charge_cluster")] if pairs else F.lit(None).cast("string"), F.lit("unknown"))


def station_onehot(df: DataFrame, by_cluster: Mapping[str, str], kinds: Sequence[str]) -> DataFrame:
    kind = station_types(df, by_cluster)
    return df.withColumns({f"station_{k}": (kind == k).cast("int") for k in kinds})


def whitelist(df: DataFrame, allowed: Sequence[str], prefixes: Sequence[str] = ("daily_bin_", "station_")) -> DataFrame:
    """Columns that are allowed or begin with a prefix, each name once, in their order."""
    names = dict.fromkeys(c for c in df.columns if c in set(allowed) or c.startswith(tuple(prefixes)))
    return df.select(*names)


def model_columns(columns: Sequence[str], meta: Sequence[str], station: bool = True) -> list[str]:
    """Names that a model reads: all but ``meta`` ones, without repeats."""
    return list(dict.fromkeys(c for c in columns if c not in set(meta) and (station or not c.startswith("station_"))))


def float32_error(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, max_error, mean_error) of rounding each column to single precision."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    gap = F.abs(F.col("p.x") - F.col("p.x").cast("float").cast("double"))
    return df.select(pairs.alias("p")).groupBy(F.col("p.column").alias("column")).agg(F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"))
