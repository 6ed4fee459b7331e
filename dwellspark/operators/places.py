"""Per-vehicle place statistics from training charges, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time as ft

SLOT_HOURS = 4
SLOTS = 24 // SLOT_HOURS
LABEL = "next_long_inactive_cluster"


def train(rows: DataFrame, split: str = "split") -> DataFrame:
    return rows.filter(F.col(split) == "train")


def charge_interval(rows: DataFrame, default: float = 14.0) -> DataFrame:
    """(hashvin, interval_days): median days between training charges; the default where that is no positive number."""
    w = W.partitionBy("hashvin").orderBy("charge_start_time", "session_id")
    gaps = train(rows).withColumn("before", F.lag("charge_start_time").over(w))
    gap = ft.hours_between("before", "charge_start_time") / 24
    out = gaps.groupBy("hashvin").agg(F.median(gap).alias("m"))
    return out.select("hashvin", F.when(F.col("m") > 0, F.col("m")).otherwise(default).alias("interval_days"))


def train_places(rows: DataFrame) -> DataFrame:
    return train(rows).select("hashvin", F.col(LABEL).alias("place")).distinct()


def centroids(rows: DataFrame, stays: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(hashvin, place, lat, lon): median parking position of training rows, else of all inactive stays up to the cutoff."""
    own = train(rows).groupBy("hashvin", F.col(LABEL).alias("place")).agg(F.median("inactive_lat").alias("lat1"), F.median("inactive_lon").alias("lon1"))
    seen = stays.filter("session_type = 'inactive'").join(cutoffs, "hashvin").filter("start_time <= cutoff")
    rest = seen.groupBy("hashvin", F.col("session_cluster").alias("place")).agg(F.median("start_lat").alias("lat2"), F.median("start_lon").alias("lon2"))
    out = own.join(rest, ["hashvin", "place"], "left")
    return out.select("hashvin", "place", F.coalesce("lat1", "lat2").alias("lat"), F.coalesce("lon1", "lon2").alias("lon"))


def _clip(hours: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(24.0), hours))


def place_delays(rows: DataFrame, least: int = 3) -> DataFrame:
    """(hashvin, place, delay_h): median hours from charge start to parking; the vehicle's median below ``least`` samples."""
    t = train(rows).select("hashvin", F.col(LABEL).alias("place"), ft.hours_between("charge_start_time", "inactive_start_time").alias("h"))
    whole = t.groupBy("hashvin").agg(F.median("h").alias("all_h"))
    per = t.groupBy("hashvin", "place").agg(F.median("h").alias("h"), F.count("h").alias("n")).join(whole, "hashvin")
    return per.select("hashvin", "place", _clip(F.when(F.col("n") >= least, F.col("h")).otherwise(F.col("all_h"))).alias("delay_h"))


def pair_delays(rows: DataFrame, least: int = 2) -> DataFrame:
    """(hashvin, origin, place, delay_h) for charge and parking places with ``least`` samples."""
    t = train(rows).select("hashvin", F.col("charge_cluster").alias("origin"), F.col(LABEL).alias("place"), ft.hours_between("charge_start_time", "inactive_start_time").alias("h"))
    return t.groupBy("hashvin", "origin", "place").agg(F.median("h").alias("h"), F.count("h").alias("n")).filter(F.col("n") >= least).select("hashvin", "origin", "place", _clip(F.col("h")).alias("delay_h"))


def _slots(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("bin"))


def start_probability(long_stays: DataFrame, places: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(hashvin, place, dow, bin, p): smoothed shares of weekday and slot among a place's long stays."""
    dow, b = ft.slot("start_time", SLOT_HOURS)
    seen = long_stays.groupBy("hashvin", F.col("session_cluster").alias("place"), dow.alias("dow"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = _slots(places).join(seen, ["hashvin", "place", "dow", "bin"], "left")
    n = F.coalesce("n", F.lit(0)) + F.lit(alpha)
    return out.select("hashvin", "place", "dow", "bin", (n / F.sum(n).over(W.partitionBy("hashvin", "place"))).alias("p"))


def transition_counts(rows: DataFrame) -> DataFrame:
    """Training counts of targets by (previous place, slot), previous place, slot, and in all.

    ``level`` is prev_slot, prev, slot or all; absent keys are null.
    """
    dow, b = ft.slot("charge_start_time", SLOT_HOURS)
    t = train(rows).select("hashvin", F.coalesce("prev_cluster", F.lit("NONE")).alias("prev"), dow.alias("dow"), b.alias("bin"), F.col(LABEL).alias("target"))
    keys = ["hashvin", "prev", "dow", "bin", "target"]
    sets = [keys, ["hashvin", "prev", "target"], ["hashvin", "dow", "bin", "target"], ["hashvin", "target"]]
    no_prev, no_slot = F.grouping("prev") == 1, F.grouping("dow") == 1
    level = F.when(~no_prev & ~no_slot, "prev_slot").when(~no_prev, "prev").when(~no_slot, "slot").otherwise("all")
    return t.groupingSets(sets, *keys).agg(level.alias("level"), F.count(F.lit(1)).alias("n")).select("hashvin", "level", "prev", "dow", "bin", "target", "n")


def transition_probability(rows: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``transition_counts`` smoothed over the vehicle's training places and OTHER."""
    counts = transition_counts(rows)
    targets = train_places(rows).withColumnRenamed("place", "target")
    other = targets.select("hashvin").distinct().withColumn("target", F.lit("OTHER"))
    targets = targets.unionByName(other)
    keys = counts.select("hashvin", "level", "prev", "dow", "bin").distinct()
    same = ["hashvin", "level", "prev", "dow", "bin"]
    frame = keys.join(targets, "hashvin")
    c = counts.select(*[F.col(x).alias(f"c_{x}") for x in same], F.col("target").alias("c_target"), "n")
    on = F.col("hashvin") == F.col("c_hashvin")
    for x in same[1:]:
        on &= F.col(x).eqNullSafe(F.col(f"c_{x}"))
    out = frame.join(c, on & (F.col("target") == F.col("c_target")), "left")
    n = F.coalesce("n", F.lit(0)) + F.lit(alpha)
    return out.select(*same, "target", (n / F.sum(n).over(W.partitionBy(*same))).alias("p"))


def uniform_transition(rows: DataFrame) -> DataFrame:
    """(hashvin, p): the same share for each training place and OTHER."""
    return train_places(rows).groupBy("hashvin").agg((1 / (F.count(F.lit(1)) + 1)).alias("p"))


def head_places(rows: DataFrame, long_stays: DataFrame, k: int = 10, split: str = "split") -> DataFrame:
    """(hashvin, head_rank, place, source, n, hours): top training labels, filled up with long-stay places."""
    own = train(rows, split).groupBy("hashvin", F.col(LABEL).alias("place")).agg(F.count(F.lit(1)).alias("n"), (F.sum("inactive_time_minutes") / 60).alias("hours")).withColumn("source", F.lit("charge"))
    rest = long_stays.groupBy("hashvin", F.col("session_cluster").alias("place")).agg(F.count(F.lit(1)).alias("n"), (F.sum("duration_minutes") / 60).alias("hours"))
    rest = rest.join(own.select("hashvin", "place"), ["hashvin", "place"], "left_anti").join(own.select("hashvin").distinct(), "hashvin", "left_semi").withColumn("source", F.lit("any"))
    w = W.partitionBy("hashvin").orderBy(F.when(F.col("source") == "charge", 0).otherwise(1), F.desc("n"), F.desc("hours"), "place")
    return own.unionByName(rest).withColumn("head_rank", F.row_number().over(w)).filter(F.col("head_rank") <= k)


def frequent_long_stay(long_stays: DataFrame, k: int) -> DataFrame:
    """(hashvin, rank, place, n): the vehicle's k places with most long stays."""
    c = long_stays.groupBy("hashvin", F.col("session_cluster").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("hashvin").orderBy(F.desc("n"), "place"))).filter(F.col("rank") <= k)


def nearest_places(rows: DataFrame, centres: DataFrame, meters) -> DataFrame:
    """Each session's places with a centre, by distance from the charger (distance_order from 0).

    ``meters``: an expression of charge_lat, charge_lon, lat and lon.
    """
    out = rows.select("session_uid", "hashvin", "charge_lat", "charge_lon").join(centres, "hashvin").withColumn("meters", meters).filter("meters IS NOT NULL")
    return out.select("session_uid", "hashvin", "place", "meters", (F.row_number().over(W.partitionBy("session_uid").orderBy("meters", "place")) - 1).alias("distance_order"))


def resolve_delay(pairs: DataFrame, by_pair: DataFrame, by_place: DataFrame) -> DataFrame:
    """``pairs`` (with hashvin, origin, place) with delay_h: of the pair, else of the place, else 0."""
    a, b = by_pair.withColumnRenamed("delay_h", "pair_h"), by_place.withColumnRenamed("delay_h", "place_h")
    out = pairs.join(a, ["hashvin", "origin", "place"], "left").join(b, ["hashvin", "place"], "left")
    return out.withColumn("delay_h", F.coalesce("pair_h", "place_h", F.lit(0.0))).drop("pair_h", "place_h")


def _told(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, told): the training charges of the keys, in all (``total``) and by target (``counts``)."""
    per = counts.groupBy(*keys, "target").agg(F.sum("n").alias("n"))
    return per.groupBy(*keys).agg(F.struct(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("target", "n"))).alias("counts")).alias("told"))


def _levels(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, ``name``, ``name``_slots): what is told of the keys, and of their slots by slot."""
    slots = _told(counts.filter("slot IS NOT NULL"), [*keys, "slot"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "told"))).alias(f"{name}_slots"))
    return _told(counts, keys).withColumnRenamed("told", name).join(slots, keys, "left")


def _slot(dow: Column, b: Column) -> Column:
    return dow * SLOTS + b


def with_transitions(charges: DataFrame, rows: DataFrame) -> DataFrame:
    """``charges`` (hashvin, prev, dow, bin) with ``told``, the training charges of ``rows`` that transition shares come from, and ``n_targets``, the vehicle's places and OTHER.

    Those after the same previous place in the same slot, else after that place; of a place never seen, those of
    the slot, else all.  Counts of targets are kept as they are, so no share of an absent target is made.
    """
    dow, b = ft.slot("charge_start_time", SLOT_HOURS)
    t = train(rows).select("hashvin", F.coalesce("prev_cluster", F.lit("NONE")).alias("prev"), _slot(dow, b).alias("slot"), F.col(LABEL).alias("target"))
    counts = t.groupBy("hashvin", "prev", "slot", "target").agg(F.count(F.lit(1)).alias("n"))
    out = charges.withColumn("slot", _slot(F.col("dow"), F.col("bin")))
    out = out.join(_levels(counts, ["hashvin"], "all"), "hashvin", "left").join(_levels(counts, ["hashvin", "prev"], "after"), ["hashvin", "prev"], "left")
    told = F.coalesce(F.col("after_slots")[F.col("slot")], F.col("after"), F.col("all_slots")[F.col("slot")], F.col("all"))
    return out.withColumns({"told": told, "n_targets": F.size("all.counts") + 1}).drop("slot", "all", "all_slots", "after", "after_slots")


def transition_share(alpha: float = 1.0) -> Column:
    """Of rows with ``told``, ``n_targets`` and ``place``: the place's smoothed share, that of OTHER for a place without training charges; null for a vehicle without."""
    return (F.coalesce(F.col("told.counts")[F.col("place")], F.lit(0)) + F.lit(alpha)) / (F.col("told.total") + F.lit(alpha) * F.col("n_targets"))


def place_facts(rows: DataFrame, stays: DataFrame, long_stays: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """A row per vehicle and training place with what lookups ask of it, so that they are one join.

    (hashvin, place, known, lat, lon, place_h, origin_h, starts, start_n): its centre, its delay and those by
    the charge's place, and its long stays by slot and in all.
    """
    keys = ["hashvin", "place"]
    dow, b = ft.slot("start_time", SLOT_HOURS)
    origins = pair_delays(rows).filter("origin IS NOT NULL").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("origin", "delay_h"))).alias("origin_h"))
    seen = long_stays.select("hashvin", F.col("session_cluster").alias("place"), _slot(dow, b).alias("slot")).filter("slot IS NOT NULL")
    seen = seen.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("starts"), F.sum("n").alias("start_n"))
    out = centroids(rows, stays, cutoffs).withColumn("known", F.lit(True)).join(place_delays(rows).withColumnRenamed("delay_h", "place_h"), keys, "left")
    return out.join(origins, keys, "left").join(seen, keys, "left")


def _start_share(slot: Column, alpha: float) -> Column:
    """A training place's smoothed share of its long stays in the slot; null for other places."""
    n = F.coalesce(F.col("starts")[slot], F.lit(0)) + F.lit(alpha)
    return F.when(F.col("known") & slot.isNotNull(), n / (F.coalesce("start_n", F.lit(0)) + F.lit(alpha * 7 * SLOTS)))


def _arrived(pairs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``pairs`` (origin, charge_start_time, ``place_facts``) with ``arrive``, the time that the delay leads to, and its slot (dow, bin)."""
    delay = F.coalesce(F.col("origin_h")[F.col("origin")], F.col("place_h"), F.lit(0.0))
    out = pairs.withColumn("arrive", F.col("charge_start_time") + F.make_dt_interval(secs=F.round(delay * 3600, 6).cast("decimal(18,6)")))
    return out, *ft.slot("arrive", SLOT_HOURS)


def time_compat_ranking(pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``pairs`` with time_compat: the place's share of the slot of arrival, 0 without a table."""
    out, dow, b = _arrived(pairs)
    return out.withColumn("time_compat", F.coalesce(_start_share(_slot(dow, b), alpha), F.lit(0.0))).drop("arrive")


def time_compat_multiclass(pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``pairs`` with time_compat: 3/4 of the share of the slot of arrival and 1/4 of that of the slot before on that weekday; flat without a table."""
    flat, (out, dow, b) = F.lit(1.0 / (7 * SLOTS)), _arrived(pairs)
    before = _start_share(_slot(dow, (b + SLOTS - 1) % SLOTS), alpha)
    return out.withColumn("time_compat", 0.75 * F.coalesce(_start_share(_slot(dow, b), alpha), flat) + 0.25 * F.coalesce(before, flat)).drop("arrive")
