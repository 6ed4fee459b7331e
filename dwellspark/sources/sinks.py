"""Writers: tables by split or vehicle, JSON documents, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, name: str = "split", fmt: str = "parquet") -> None:
    """A folder per split."""
    df.write.mode("overwrite").partitionBy(name).format(fmt).save(path)


#: Rows of a file at most.
FILE_ROWS = 2_000_000


def write_vectors(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Daily vectors in files by size, in order of vehicle and day.

    Ranges of (vehicle, day, bin) are files: adaptive execution joins small ranges up to the
    session's advisory size, a hot vehicle spans several, small ones share one, and no file
    has more than ``file_rows`` rows.  Files are sorted, so Parquet's statistics find a vehicle's row groups.
    """
    order = [c for c in ("hashvin", "date06", "bin") if c in df.columns]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)


#: Folders of a registered table of all vehicles.
PARTS = 64


def upsert(df: DataFrame, path: str, key: str = "hashvin", parts: int | None = None) -> None:
    """Puts ``df`` in place of its keys' rows in the table at ``path``, which has a folder per key.

    Folders of other keys are not touched; a second run with the same rows changes nothing.  A folder costs the
    driver some milliseconds, so a table of many keys has ``parts`` folders (column ``part``) by a hash of the key
    instead: other keys' rows of the parts that ``df`` meets are written anew beside its own.
    """
    if parts is not None:
        spark, rows = df.sparkSession, df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            met = rows.select("part", key).distinct()
            old = spark.read.schema(rows.schema).parquet(path).join(F.broadcast(met.select("part").distinct()), "part", "left_semi")
            rows = rows.unionByName(old.join(met.select(key), key, "left_anti"))
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        return
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows (hashvin, metric, value) as JSON lines."""
    df.write.mode("overwrite").json(path)


def head_details(df: DataFrame) -> DataFrame:
    """(hashvin, json): HEAD places of flat rows (head_rank, place, source, n_after_charge, hours_after_charge, n_any, hours_any, lat, lon, delay_h, dow, bin, p) as documents."""
    facts = [c for c in df.columns if c not in ("hashvin", "dow", "bin", "p")]
    p = F.array_sort(F.collect_list(F.struct("dow", "bin", "p"))).alias("p_start")
    places = df.groupBy("hashvin", *facts).agg(p)
    heads = F.array_sort(F.collect_list(F.struct(*facts, "p_start"))).alias("places")  # HEAD places: a few per vehicle
    return places.groupBy("hashvin").agg(heads).select("hashvin", F.to_json(F.struct("places")).alias("json"))


#: Features of a map document at most; the centre of a map without features (a fixed value).
CHUNK_FEATURES, DEFAULT_CENTER = 1_000, (35.6812, 139.7671)
_POPUP = ("title", "place", "start_time", "end_time", "duration_text", "start_soc", "end_soc", "soc_change", "position", "link")


def geojson(df: DataFrame, most: int = CHUNK_FEATURES) -> DataFrame:
    """(hashvin, chunk, features, json): FeatureCollections of at most ``most`` features of map rows, in order of their number.

    A Point has one position, a LineString those of its start and end; columns of the popup, where
    the rows have them, are properties.
    """
    start, end = F.array("start_lon", "start_lat"), F.array("end_lon", "end_lat")
    position = F.when(F.col("geometry") == "LineString", F.to_json(F.array(start, end))).otherwise(F.to_json(start))
    popup = [c for c in _POPUP if c in df.columns and c != "duration_text"]
    properties = F.to_json(F.struct("number", "color", "time", "duration_text", F.col("session_id").alias("id"), *popup))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), "geometry", F.lit('","coordinates":'), position, F.lit('},"properties":'), properties, F.lit("}"))
    features = F.transform(F.array_sort(F.collect_list(F.struct("number", feature.alias("text")))), lambda f: f["text"])
    made = df.withColumn("chunk", F.expr(f"(number - 1) div {most}").cast("int")).groupBy("hashvin", "chunk").agg(F.count(F.lit(1)).alias("features"), features.alias("texts"))
    return made.select("hashvin", "chunk", "features", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("texts", ","), F.lit("]}")).alias("json"))


def map_index(df: DataFrame, vehicles: DataFrame | None = None, most: int = CHUNK_FEATURES) -> DataFrame:
    """(hashvin, features, chunks, center_lat, center_lon): a row per vehicle of map rows, and per other of ``vehicles``, which has the default centre."""
    per = df.groupBy("hashvin").agg(
        F.count(F.lit(1)).alias("features"), (F.floor((F.max("number") - 1) / most) - F.floor((F.min("number") - 1) / most) + 1).cast("int").alias("chunks"),
        F.avg("start_lat").alias("center_lat"), F.avg("start_lon").alias("center_lon"),
    )
    if vehicles is not None:
        per = vehicles.select("hashvin").distinct().join(per, "hashvin", "left").na.fill(0, ["features", "chunks"])
    lat, lon = DEFAULT_CENTER
    return per.withColumns({"center_lat": F.coalesce("center_lat", F.lit(lat)), "center_lon": F.coalesce("center_lon", F.lit(lon))})


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
