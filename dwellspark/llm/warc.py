"""WARC archives of pages, written and read by parallel tasks.

Writing: each task writes the records of its partition to one uncompressed archive in
the shared folder.  Of pages with equal payloads of ``LEAST`` bytes or more, that with the
least id is a response with the payload (behind an HTTP head); the others are revisit
records that name it.  Smaller pages are all responses.  All records of a run carry its
date and the page's url, so that any WARC/1.0 reader takes the archives; page ids stand in a
field of their own.

Reading: archives are cut into byte ranges.  A task looks for the record magic in its
range and emits every candidate with the offset of its successor, which its declared
length gives.  Payloads may hold the magic too, so candidates prove nothing: pointer
jumping from offset 0 of each file (targets double their distance each round) marks the
candidates that the chain of records reaches, and only those are kept.  A file whose
chain doesn't end at its last byte raises.  A header is at most ``HEADER_BYTES`` long, or as
long as the longest that the file's writer recorded, and the search for its end never looks
at a byte twice, whatever a payload repeats.

An archive gets its name only when it is complete, and the list of archives is a table, so a
lost or repeated task leaves no half archive in it.  Null html is an empty payload; very
long pages are one record each, and very long urls stand whole in its header.  A null or malformed url becomes ``urn:page:`` and the id;
other characters than visible ASCII are percent-encoded.  A null page id is written as ``null``
and revisits like any other id, but is never the response that others name.  Ids of any type
are kept as they are written.  Rows that share the least id of their payload are all
responses.  Extra columns are not archived.  An empty table gives no archives and no records.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .shared import forget, in_arrow, settle, small

#: Payload bytes from which equal payloads are stored once.
LEAST = 100
#: Revisits up to this number (some 10 MB) are broadcast to the writers; more are joined.
BROADCAST_REVISITS = 50_000
#: Bytes of an archive that a reading task scans.
RANGE_BYTES = 8 << 20
#: Bytes of a record's header, unless an archive has longer ones, and bytes read first at a time when one crosses the range's end.
HEADER_BYTES, MORE_BYTES = 64 << 10, 16 << 10
#: Bytes of payload that a writing task holds as Python objects at once.
SLICE_BYTES = 4 << 20

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Characters of a url that stay as they are.
PLAIN = "".join(chr(c) for c in range(33, 127))


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Local, HDFS or object store, by the path's scheme."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def plan(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) per page; refers_to is null for responses."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    made = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marked = made.filter(F.length("payload") >= LEAST).select("page_id", "digest")
    marked, _ = settle(marked, "page-digests")
    first = marked.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = marked.join(first, "digest").filter("page_id IS NULL OR page_id > refers_to")
    again = again.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to").distinct()
    again, _ = settle(again, "page-revisits")
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return made.join(small(again, BROADCAST_REVISITS), same, "left").drop("__id", "__digest")


def _record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {digest}')}>"


def _record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    kind, body = ("response", head + payload) if refers_to is None else ("revisit", b"")
    target = quote(url, safe=PLAIN) if url and "://" in url else f"urn:page:{quote(page)}"
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {quote(page, safe=PLAIN)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {quote(refers_to, safe=PLAIN)}"]
    return MAGIC + "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + END + body + END


def write(planned: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes archives of ``plan``'s rows to ``folder``; the table (file, path, bytes, header_bytes) of them.

    date: the records' WARC-Date, now if None.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _file_system(folder)
        store.create_dir(top, recursive=True)
        name = f"{top}/pages-{uuid.uuid4().hex}"
        out, size, longest = None, 0, 0
        for whole in batches:
            for batch in pretokens.slices(whole, "payload", SLICE_BYTES):
                for page, url, payload, digest, to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    out = out or store.open_output_stream(f"{name}.open")
                    record = _record("null" if page is None else str(page), url, payload, digest, None if to is None else str(to), date)
                    out.write(record)
                    size, longest = size + len(record), max(longest, record.find(END) + len(END))
        if out:
            out.close()
            store.move(f"{name}.open", f"{name}.warc")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}.warc"], "bytes": [size], "header_bytes": [longest]})

    made, _ = settle(in_arrow(planned, run, "path string, bytes bigint, header_bytes bigint"), "warc-archives")
    return made.select(F.xxhash64("path").alias("file"), "path", "bytes", "header_bytes")


def candidates(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, path, at, next, body, headers) for every occurrence of the magic with a header that parses.

    archives: (file, path, bytes), and header_bytes if headers may be longer than ``HEADER_BYTES``.  ``next`` is the offset after the declared body and its
    end mark, ``body`` the body's offset.
    """
    longest = F.greatest(F.lit(HEADER_BYTES).cast("bigint"), "header_bytes") if "header_bytes" in archives.columns else F.lit(HEADER_BYTES).cast("bigint")
    archives = archives.withColumn("header_bytes", longest)
    begins = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = archives.filter("bytes > 0").select("*", F.explode(begins).alias("begin"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    table = ranges.repartition(max(1, min(int(n), 20_000)), "file", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _file_system(row["path"])
                with store.open_input_file(path) as f:
                    for some in _in_range(f, row["begin"], range_bytes, row["bytes"], row["header_bytes"]):
                        yield pa.RecordBatch.from_pylist([{"file": row["file"], "path": row["path"], **c} for c in some], _CANDIDATE_ARROW)

    return table.mapInArrow(run, _CANDIDATE)


def _in_range(f, begin: int, range_bytes: int, file_bytes: int, header_bytes: int = HEADER_BYTES) -> Iterator[list[dict]]:
    """The candidates whose magic begins in a range of an open file, some at a time."""
    f.seek(begin)
    data = f.read(range_bytes + len(MAGIC) - 1)
    found: list[dict] = []
    stop, looked = -1, 0  # the header end found last, and the place up to which there is none
    at = data.find(MAGIC)
    while 0 <= at < range_bytes:
        after = data.find(MAGIC, at + 1)
        if stop < at:
            stop, looked, more = -1, max(looked, at), MORE_BYTES
            while stop < 0:
                stop = data.find(END, looked, at + header_bytes)
                if stop >= 0 or at + header_bytes <= len(data) or begin + len(data) >= file_bytes:
                    break
                looked = max(at, len(data) - len(END) + 1)
                f.seek(begin + len(data))
                data += f.read(more)
                more *= 2
            if stop < 0:
                looked = max(at, min(at + header_bytes, len(data)) - len(END) + 1)
        # a line that is the magic itself is no field, so this header can't parse
        torn = 0 <= after < stop and data[after - 2 : after] == b"\r\n"
        if 0 <= stop - at <= header_bytes and not torn:
            headers = _headers(data[at + len(MAGIC) : stop])
            if headers is not None:
                body = begin + stop + len(END)
                found.append({"at": begin + at, "next": body + int(headers["content-length"]) + len(END), "body": body, "headers": list(headers.items())})
                if len(found) >= 2000:
                    yield found
                    found = []
        at = after if after >= 0 else data.find(MAGIC, at + 1)
    if found:
        yield found


_CANDIDATE = "file bigint, path string, at bigint, next bigint, body bigint, headers map<string,string>"
_CANDIDATE_ARROW = pa.schema([("file", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("body", pa.int64()), ("headers", pa.map_(pa.string(), pa.string()))])


def _headers(block: bytes) -> dict[str, str] | None:
    """Named fields by lower-case name; None unless all lines are fields and one is a length."""
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or " " in name:
            return None
        out[name.lower()] = value.strip()
    return out if out.get("content-length", "").isdigit() and len(out["content-length"]) < 16 else None


def reachable(found: DataFrame, archives: DataFrame) -> DataFrame:
    """The rows of ``found`` that the chain of records from each file's start reaches.

    After round r, ``jump`` leads 2**r records on, and the first 2**r records of every
    chain are marked.  No side of these joins has a bounded size, so none is broadcast.
    """
    spark = found.sparkSession
    now, path = settle(found.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("kept")), "warc-jumps")
    marked = -1
    while True:
        seen = now.filter("kept").count()
        if seen == marked:
            break
        marked = seen
        on = now.select("file", F.col("at").alias("jump"), F.col("jump").alias("further")).hint("shuffle_hash")
        marks = now.filter("kept AND jump IS NOT NULL").select("file", F.col("jump").alias("at"), F.lit(True).alias("mark")).distinct().hint("shuffle_hash")
        after = now.join(on, ["file", "jump"], "left").join(marks, ["file", "at"], "left")
        after = after.select("file", "at", F.col("further").alias("jump"), (F.col("kept") | F.coalesce("mark", F.lit(False))).alias("kept"))
        after, after_path = settle(after, "warc-jumps")
        forget(spark, path)
        now, path = after, after_path
    kept = found.join(now.filter("kept").select("file", "at").hint("shuffle_hash"), ["file", "at"])
    ends = kept.groupBy("file").agg(F.max("next").alias("last"))
    broken = archives.join(ends.hint("shuffle_hash"), "file", "left").filter("bytes > 0 AND (last IS NULL OR last <> bytes)")
    broken = [r.path for r in broken.select("path").limit(5).collect()]
    if broken:
        raise ValueError(f"chains of records that don't end with their files: {broken}")
    return kept


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True, id_type: str = "bigint") -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, url, payload) per record.

    payload is read from the archive's bytes (null for revisits, whose digest and length
    are the header's); for responses digest and length are those of the payload read.
    id_type: the type of the ids; what is none of it is null.
    """
    kept, _ = settle(candidates(archives, range_bytes), "warc-candidates")
    kept = reachable(kept, archives)
    field = lambda name: F.col("headers")[name]
    rows = kept.select("file", "path", "at", "body", field("content-length").cast("bigint").alias("n"), field("x-page-id").alias("page"), field("warc-type").alias("type"), field("x-refers-to-page").alias("to"), F.regexp_replace(field("warc-payload-digest"), "^sha256:", "").alias("digest"), field("x-payload-length").cast("bigint").alias("length"), field("warc-target-uri").alias("url"))
    rows = rows.repartition("file", F.floor(F.col("at") / range_bytes)).sortWithinPartitions("file", "at")
    kept_columns = ("page", "type", "to", "digest", "length", "url")
    schema = "page string, type string, to string, digest string, length bigint, url string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)
        for whole in batches:
            for batch in _by_bytes(whole, SLICE_BYTES):
                bodies = []
                for path, body, n, kind in zip(*(batch[c].to_pylist() for c in ("path", "body", "n", "type"))):
                    if kind != "response":
                        bodies.append(None)
                        continue
                    if opened[0] != path:
                        if opened[1] is not None:
                            opened[1].close()
                        store, at = _file_system(path)
                        opened = (path, store.open_input_file(at))
                    opened[1].seek(body)
                    block = opened[1].read(n)
                    bodies.append(block[block.find(END) + len(END) :] if block.startswith(b"HTTP/") else block)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept_columns), pa.array(bodies, pa.binary())], [*kept_columns, "payload"])

    out = in_arrow(rows.select("path", "body", "n", *kept_columns), run, schema)
    full = F.col("payload").isNotNull()
    spelt = lambda c: F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))).try_cast(id_type)
    return out.select(
        F.when(F.col("page") != "null", spelt("page")).alias("page_id"), F.when(full, F.length("payload")).otherwise(F.col("length")).cast("bigint").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), spelt("to").alias("refers_to"), *(["url", "payload"] if payloads else []),
    )


def _by_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of records whose blocks have at most ``most`` bytes (one record at least)."""
    done = np.concatenate([[0], np.cumsum(batch["n"].to_numpy())])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
