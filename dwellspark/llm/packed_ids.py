"""Token ids in fixed-width binary blocks, in ascending id order of the documents.

The file format is a Parquet folder whose rows are blocks:
shard, block (order of the blocks), shard_start (ids of the shard before the block),
width (bits per id), n_ids, first_doc and last_doc (its least and greatest document id, so that
Parquet's statistics find a document's blocks), doc_ids and lengths (ids per document), and
data: id k of the block in bits [k * width, (k + 1) * width), least significant bit first.
The width is the least that holds the vocabulary's largest id, so any id or document of a
block is found by arithmetic and whole blocks unpack with numpy.  Parquet's commit leaves
no partial files when an executor is lost.

Texts are encoded where they are read; only packed ids (a third of the text or so) are then
dealt to shards by ranges of the document's id.  Null text counts as empty (its ids are the end id
alone); a null id sorts first; repeated ids stand side by side, by a hash of their
ids.  A document longer than a block is a block of its own; reading back one of more than 2**29 ids raises.  Other
columns than id and text are not written.  An empty table writes no block and reads as
no document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .shared import forget, in_arrow, settle, small

#: Ids of a block, but for one longer document.
BLOCK_IDS = 1 << 20
#: Ids whose bits are spread out at once (32 bytes each).
SPREAD_IDS = 1 << 16
#: Bytes of text that a writing task encodes at once.
SLICE_BYTES = 2 << 20
#: Shards (16 bytes each) whose starts are broadcast, at most.
MOST_SHARDS = 100_000


def width_of(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (unsigned, below 2**width) at ``width`` bits each."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(ids), SPREAD_IDS):  # a multiple of 8 ids fills whole bytes
        bits = np.unpackbits(ids[at : at + SPREAD_IDS].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a block's data."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, first * (width // 8)).astype(np.uint32)
    begin, end = first * width, (first + n) * width
    raw = np.frombuffer(data, np.uint8, (end + 7) // 8 - begin // 8, begin // 8)
    out = np.zeros(n, np.uint32)
    for at in range(0, n, SPREAD_IDS):
        m = min(SPREAD_IDS, n - at)
        start = begin % 8 + at * width
        bits = np.unpackbits(raw[start // 8 : (start + m * width + 7) // 8], bitorder="little")[start % 8 : start % 8 + m * width].reshape(m, width)
        wide = np.zeros((m, 32), np.uint8)
        wide[:, :width] = bits
        out[at : at + m] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all documents, each with id ``end`` after it, to ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = width_of(max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end))
    id_type = docs.schema[doc_id].dataType
    coded = T.StructType([T.StructField("doc", id_type), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])
    schema = T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("shard", "block")]
        + [T.StructField("shard_start", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("first_doc", id_type), T.StructField("last_doc", id_type)]
        + [T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())]
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pretokens.slices(whole, "text", SLICE_BYTES):
                offsets, ids = pretokens.encode(batch["text"], tokenizer, end)
                cut = zip(offsets[:-1].tolist(), offsets[1:].tolist())
                yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(np.diff(offsets)), pa.array([pack(ids[a:b], width) for a, b in cut], pa.binary())], coded.names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, done, total = TaskContext.get().partitionId(), 0, 0, 0
        held: tuple[list, list, list] = ([], [], [])  # documents, their numbers of ids, and ids

        def made() -> pa.RecordBatch:
            doc, lengths = pa.array(held[0], pa_type), np.array(held[1], np.int64)
            # ids of whole bytes stand side by side as they are
            data = b"".join(held[2]) if width in (8, 16, 32) else pack(np.concatenate([unpack(d, width, 0, n) for d, n in zip(held[2], held[1])]), width)
            heads = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([done], pa.int64()), pa.array([width], pa.int32()), pa.array([total], pa.int64()), doc.slice(0, 1), doc.slice(len(doc) - 1, 1)]
            rows = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
            return pa.RecordBatch.from_arrays([*heads, rows, pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())], schema.names)

        for batch in batches:
            pa_type = batch["doc"].type
            for doc, n, data in zip(*(batch[c].to_pylist() for c in ("doc", "n", "data"))):
                if held[0] and total + n > block_ids:
                    yield made()
                    block, done, total, held = block + 1, done + total, 0, ([], [], [])
                total += n
                for column, value in zip(held, (doc, n, data)):
                    column.append(value)
        if held[0]:
            yield made()

    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    ids, ids_path = settle(in_arrow(rows, encoded, coded), "token-ids-unordered", "zstd")
    dealt = ids.repartitionByRange(F.col("doc"), F.xxhash64("data")).sortWithinPartitions("doc", F.xxhash64("data"))
    in_arrow(dealt, blocks, schema).write.option("compression", "zstd").parquet(path)
    forget(spark, ids_path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before each; a row per shard."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))


def read(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document of the files, ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(path)
    schema = T.StructType(
        [T.StructField(doc_id, blocks.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch["lengths"][i].values.to_numpy()
                ids = unpack(batch["data"][i].as_py(), batch["width"][i].as_py(), 0, int(lengths.sum())).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(lengths)])
                if ends[-1] * 4 >= 1 << 31:
                    raise ValueError("a document of more than 2**29 ids is no single row; unpack its block in parts")
                first = batch["shard_start"][i].as_py() + batch["before"][i].as_py()
                raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch["doc_ids"][i].values, pa.array(first + ends[:-1], pa.int64()), pa.array(lengths, pa.int64()), raw], schema.names)

    starts, _ = settle(shard_starts(blocks), "token-id-starts")
    return in_arrow(blocks.join(small(starts, MOST_SHARDS), "shard").select("shard_start", "before", "width", "doc_ids", "lengths", "data"), run, schema)


def read_document(spark: SparkSession, path: str, wanted: int, doc_id: str = "doc_id") -> list[np.ndarray]:
    """The ids of each document with id ``wanted`` (not null), from its blocks alone."""
    near = (F.col("first_doc").isNull() | (F.col("first_doc") <= wanted)) & (F.col("last_doc") >= wanted)
    found = spark.read.parquet(path).filter(near).filter(F.array_contains("doc_ids", F.lit(wanted))).collect()
    out = []
    for b in sorted(found, key=lambda b: (b.shard, b.block)):
        ends = np.concatenate([[0], np.cumsum(b.lengths)]).astype(int)
        out += [unpack(bytes(b.data), b.width, int(ends[i]), b.lengths[i]) for i, d in enumerate(b.doc_ids) if d == wanted]
    return out
