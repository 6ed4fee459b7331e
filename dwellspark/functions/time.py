"""Wall-clock time expressions: 06:00 days, hour bins, cycles and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_START_HOUR = 6


def minutes_between(start: str, end: str) -> Column:
    """Minutes from one timestamp_ntz column to another, whatever the session's zone."""
    return F.expr(f"cast(cast(cast({end} - {start} AS INTERVAL SECOND) AS DECIMAL(20,6)) AS DOUBLE) / 60")


def hours_between(start: str, end: str) -> Column:
    return minutes_between(start, end) / 60


def midnight(ts: str) -> Column:
    return F.expr(f"cast(cast({ts} AS date) AS timestamp_ntz)")


def date06(ts: str) -> Column:
    """The 06:00 that begins the day of ``ts``."""
    return F.expr(f"cast(cast({ts} - INTERVAL '{DAY_START_HOUR}' HOUR AS date) AS timestamp_ntz) + INTERVAL '{DAY_START_HOUR}' HOUR")


def bin_label(index: Column, size: int = 1) -> Column:
    """'06-07' ... '05-06': the label of the index-th bin of a 06:00 day."""
    first = index * size + DAY_START_HOUR
    return F.format_string("%02d-%02d", (first % 24).cast("int"), ((first + size) % 24).cast("int"))


def weekday(ts: str) -> Column:
    """0 for Monday."""
    return F.weekday(F.col(ts)).cast("int")


def slot(ts: str, hours: int = 4) -> tuple[Column, Column]:
    """(weekday, bin of the day)."""
    return weekday(ts), F.floor(F.hour(F.col(ts)) / hours).cast("int")


def period(ts: str) -> Column:
    h = F.hour(F.col(ts))
    return F.when((h >= 6) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 21), "evening").otherwise("night")


def cyclic(ts: str) -> dict[str, Column]:
    angle = 2 * F.pi() * (F.hour(F.col(ts)) + F.minute(F.col(ts)) / 60) / 24
    return {"dow": weekday(ts), "time_sin": F.sin(angle), "time_cos": F.cos(angle)}


def epoch_seconds(ts: str, offset_hours: int = 0) -> Column:
    """Seconds from 1970-01-01 of the wall clock, shifted by ``offset_hours``."""
    return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20,6)) AS DOUBLE)") + offset_hours * 3600


def two_hour_band(ts: str) -> Column:
    first = (F.floor(F.hour(F.col(ts)) / 2) * 2).cast("int")
    return F.coalesce(F.when(F.col(ts).isNotNull(), F.format_string("%02d_%02d", first, (first + 2).cast("int"))), F.lit("unknown"))


def weekday_name(ts: str) -> Column:
    names = F.array(*map(F.lit, ("mon", "tue", "wed", "thu", "fri", "sat", "sun")))
    return F.when(F.col(ts).isNotNull(), F.element_at(names, weekday(ts) + 1)).otherwise("unknown")


def behavior_flags(ts: str) -> dict[str, Column]:
    h = F.hour(F.col(ts))
    return {
        "is_return_band": ((h >= 18) | (h < 6)).cast("int"),
        "is_commute_band": ((h >= 7) & (h < 18)).cast("int"),
        "is_weekend": (weekday(ts) >= 5).cast("int"),
    }


def calendar_cycles(ts: str) -> dict[str, Column]:
    c, turn = F.col(ts), 2 * F.pi()
    parts = {"month": (F.month(c) - 1) / 12, "day": (F.dayofmonth(c) - 1) / 31, "hour": F.hour(c) / 24}
    out = {"year": F.year(c)}
    for name, share in parts.items():
        out |= {f"{name}_sin": F.sin(turn * share), f"{name}_cos": F.cos(turn * share)}
    return out


def japan_time(text: str) -> Column:
    """Mixed time texts as wall-clock Japan time; null where they don't parse.

    Text without an offset is Japan time already; text with one is converted.
    """
    shifted = F.expr(f"try_to_timestamp({text})")
    offset = F.col(text).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & F.col(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+")
    local = F.expr("from_utc_timestamp(to_utc_timestamp({0}, current_timezone()), 'Asia/Tokyo')".format(f"try_to_timestamp({text})")).cast("timestamp_ntz")
    return F.when(offset & shifted.isNotNull(), local).otherwise(F.expr(f"try_cast({text} AS timestamp_ntz)"))
