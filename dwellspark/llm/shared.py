"""Intermediate tables in the folder that all executors share, and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens

#: Bytes of a side of a join that is broadcast, at most.
BROADCAST_BYTES = 64 << 20
#: Bytes of a batch that Spark hands to Python.  Both ends hold a batch several times over, and
#: Spark's own bound of 64 MB leaves two tasks of a small executor too little.
BATCH_BYTES = 8 << 20
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bits that one row of a bit map holds.
MAP_ROW = 1 << 15


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which is deleted when the driver exits.

    A local folder is used where that is unset, in a local session only: executors elsewhere
    would not find it.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[context.applicationId] = _own.get(context.applicationId) or f"file://{tempfile.mkdtemp(prefix='spark-llm-')}"
        top = _own[context.applicationId]
    folder = f"{top.rstrip('/')}/llm-{context.applicationId}"
    if folder not in _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _made.add(folder)
    return folder


_own: dict[str, str] = {}
_made: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """The table written to the shared folder and reread, which cuts its lineage; its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes settled tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bit_map(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bit map (lowest bit first) with bit ``column`` modulo ``bits`` set for every row.

    Executors set the bits; the driver gets at most ``bits / 2**15`` rows of 4 KB.
    """
    at = F.pmod(F.col(column), F.lit(bits))
    rows = hashes.select(F.floor(at / MAP_ROW).cast("int").alias("row"), (at % MAP_ROW).alias("bit"))
    out = np.zeros((-(-bits // MAP_ROW), MAP_ROW // 8), np.uint8)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        out[r.row] = np.frombuffer(bytes(r.map), np.uint8)
    return out.ravel()[: -(-bits // 8)]


def on_map(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of some 64-bit hashes (as in ``bit_map``) have their bit set."""
    at = (hashes.view(np.int64) % bits).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Without columns of these names in any case: a result column replaces such a column."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def small(df: DataFrame, most: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The (settled) side of a join, marked for broadcast if it has at most ``most`` rows and ``most_bytes``."""
    long = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum(long, F.lit(16 * len(df.columns)))
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` on batches of ``BATCH_BYTES``, unless the session has a bound of its own.

    A worker that is done returns its freed memory: it stays beside those of later stages.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _SPARKS_OWN) == _SPARKS_OWN:
        conf.set(_BATCH, f"{BATCH_BYTES}b")


    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pretokens.give_back()

    return df.mapInArrow(task, schema)


def add_columns(
    df: DataFrame, names: dict[str, T.DataType], keep: list[str] | None, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], most: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """``df`` (its columns ``keep``; None: all) with columns that ``work`` makes of each batch.

    ``most`` cuts a batch to what a task may hold at once.
    """
    df = without(df, *names)
    kept = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in most(whole):
                made = work(batch)
                yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + list(made.values()), [*kept, *made])

    return in_arrow(df, run, schema)
