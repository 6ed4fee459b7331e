"""Benchmark decontamination by canonical templates.

Texts become template tokens: numbers, names and units turn into typed placeholders,
other words are lower-cased and stripped of outer punctuation.  A name is a word with
one leading capital, wherever it stands, or a run of such words with nothing but blanks
between them; a unit is a listed word after a number (or glued to it).  Windows of
``WINDOW`` template tokens with at least ``LITERALS`` plain words are hash-joined between
documents and benchmark items.  Matched windows on one alignment (document position minus
item position) must replace each slot value of the item by one value; windows with a
value that gets two are dropped.  A document holds an item if ``ENOUGH`` windows, or all of
a shorter item, remain on one alignment.

Items without such a window (short, or mostly placeholders) are found by a second, exact
key: all their windows of ``EXACT`` words as they stand, on one alignment; items of two or
three words by those words anywhere, and single words only where they are a whole document.

Tasks hash windows with numpy and pass on only those whose hash falls on a bit map of
the benchmark's hashes, of at most ``MOST_BITS`` bits; wrong hits of it end in the join.
Windows meet distinct benchmark windows first.  A document that holds an item has one of the
item's rarest windows, all but the needed number less one, so only those lead from documents to items:
a window that many items and documents share leads nowhere unless an item needs it.  The pairs found meet their
windows by document and item.  Equal items count once until the end.

Null and empty texts match nothing, nor do items without a word.  Rows are judged by
id and text: rows that share an id (or have none) each by their own text, repeated rows
alike.  Very long texts are cut into windows whole.  Columns other than id and text take no
part and are kept, whatever their names.  Empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .shared import bit_map, in_arrow, on_map, settle, small

WINDOW = 8
LITERALS = 4
ENOUGH = 5
#: Words of an exact window.
EXACT = 4
#: Bytes of text whose windows are made together; a word needs some 150 bytes of memory.
SLICE_BYTES = 1 << 20
#: Bits of the map of benchmark hashes.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Distinct benchmark windows (24 bytes each) that are broadcast, at most.
BROADCAST_WINDOWS = 1_000_000

#: Units of measure (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers inch inches foot feet yard yards mg g kg lb lbs oz gram grams kilogram "
    "kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years cent cents dollar dollars euro euros percent % $ usd eur mph kph w kw kwh v degrees".split()
)
STRIPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—"

LITERAL, NUMBER, UNIT, NAME, MEASURE, NOTHING = range(6)
PLACEHOLDER = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>", MEASURE: "<number><unit>"}
#: Forms of a window: template, exact words, a whole text of one word, exactly two and three words.
TEMPLATE, WORDS, WHOLE, TWO, THREE = range(5)
FORMS = (TEMPLATE, WORDS, WHOLE, TWO, THREE)
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHECKS = np.random.default_rng(11).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FORMS = np.random.default_rng(12).integers(1, 1 << 63, (len(FORMS), WINDOW + 1), dtype=np.uint64)


def _kind(core: str, word: str) -> tuple[int, str]:
    """(kind, canonical form) of a word with this core."""
    if not core:
        return (UNIT, word) if word in UNITS else (NOTHING, "")
    if core[0].isdigit():
        plain = core.replace(",", "").replace(".", "").replace("/", "")
        if plain.isdigit():
            return NUMBER, core
        figures = len(core) - len(core.lstrip("0123456789.,"))
        if core[figures:].lower() in UNITS:
            return MEASURE, core.lower()
        return LITERAL, core.lower()
    if len(core) > 1 and core[0].isupper() and core[1:].islower():
        return NAME, core.lower()
    low = core.lower()
    return (UNIT if low in UNITS else LITERAL), low


@functools.lru_cache(maxsize=1 << 16)
def word_facts(word: str) -> tuple[int, bool, bool, int, str]:
    """(kind, whether it ends and begins with its core, hash and text of its canonical form) of a word as it stands."""
    core = word.strip(STRIPPED)
    kind, form = _kind(core, word)
    return kind, word.endswith(core), word.startswith(core), _hash(form), form


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text, 42)


class Words:
    """The words of an array of texts: kind and code of each, the text it is in, and whether it goes on a name."""

    def __init__(self, texts: pa.Array):
        offsets, data = pretokens.utf8(texts)
        inside = ~BLANKS[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts_at = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[starts_at] = inside[starts_at]
        begins = np.flatnonzero(begins)
        # a word ends at the next blank or text
        stop = np.zeros(len(data) + 1, bool)
        stop[:-1] |= ~inside
        stop[offsets] = True
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, begins, side="right")] if len(begins) else begins
        both = np.stack([begins, ends], axis=1).ravel() if len(begins) else np.zeros(0, np.int64)
        raw = pa.Array.from_buffers(pa.large_string(), max(0, len(both) - 1), [None, pa.py_buffer(both.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = raw.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode() if len(both) else pa.array([], pa.large_string()).dictionary_encode()
        facts = list(map(word_facts, coded.dictionary.to_pylist()))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        column = lambda i, kind: np.fromiter((f[i] for f in facts), kind, len(facts))[codes]
        kind, bare_end, bare_start, hashes = column(0, np.int8), column(1, bool), column(2, bool), column(3, np.uint64)
        self.cores = [f[4] for f in facts]
        of = np.searchsorted(offsets, begins, side="right") - 1
        same_line = np.zeros(len(begins), bool)
        if len(begins) > 1:
            feeds = np.concatenate([[0], np.cumsum(data == 10)])
            same_line[1:] = (of[1:] == of[:-1]) & (feeds[begins[1:]] == feeds[begins[:-1]])
        goes_on = np.zeros(len(begins), bool)
        goes_on[1:] = same_line[1:] & (kind[1:] == NAME) & (kind[:-1] == NAME) & bare_end[:-1] & bare_start[1:]
        real = kind != NOTHING
        self.kind, self.of, self.codes, self.hashes, self.goes_on = kind[real], of[real], codes[real], hashes[real], goes_on[real]
        #: Each text's first word, and one past the last.
        self.first = np.searchsorted(self.of, np.arange(len(offsets)))

    def exact(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it lies in one text) of the windows of ``size`` words as they stand."""
        rolled, whole = _rolled(self.hashes, self.of, size)
        return rolled ^ _FORMS[WORDS, size], whole

    def text(self, word: int, end: int) -> str:
        return " ".join(self.cores[c] for c in self.codes[word:end].tolist())


def _rolled(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + hashes[k : n + k]
    return rolled ^ (rolled >> np.uint64(31)), of[:n] == of[size - 1 : n + size - 1]


class Templates:
    """The template tokens of some words, and their windows."""

    def __init__(self, words: Words):
        begins = np.flatnonzero(~words.goes_on)
        kind, of = words.kind[begins], words.of[begins]
        counted = np.zeros(len(kind), bool)
        counted[1:] = (kind[:-1] == NUMBER) & (of[1:] == of[:-1])
        kind = np.where((kind == UNIT) & ~counted, LITERAL, kind)
        hashes = words.hashes[begins]
        for k, mark in PLACEHOLDER.items():
            hashes = np.where(kind == k, np.uint64(_hash(mark)), hashes)
        self.words, self.begins, self.ends = words, begins, np.append(begins[1:], len(words.kind))
        self.kind, self.of, self.hashes = kind, of, hashes
        self.first = np.searchsorted(of, np.arange(len(words.first)))
        rolled, whole = _rolled(hashes, of, WINDOW)
        plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        n = len(rolled)
        self.hash = rolled ^ _FORMS[TEMPLATE, WINDOW]
        self.usable = whole & (plain[WINDOW:][:n] - plain[:n] >= LITERALS)

    def slots(self, at: np.ndarray) -> list[list[str]]:
        """Slot values of the windows that begin at tokens ``at``."""
        out = []
        for a in at.tolist():
            places = [i for i in range(a, a + WINDOW) if self.kind[i] != LITERAL]
            out.append([f"{PLACEHOLDER[int(self.kind[i])]} {self.words.text(self.begins[i], self.ends[i])}" for i in places])
        return out


_HIT = {"pos": T.LongType(), "form": T.IntegerType(), "hash": T.LongType(), "check": T.LongType(), "slots": T.ArrayType(T.StringType())}


def _hits(texts: pa.Array, packed: np.ndarray | None, bits: int, forms: tuple[int, ...]) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
    """(text, columns of ``_HIT``) of windows: those of items (no map), or those of documents on the map."""
    words = Words(texts)
    made = Templates(words)
    n_words = np.diff(words.first)
    bare = np.ones(len(n_words), bool)  # texts without a template window
    bare[made.of[: len(made.usable)][made.usable]] = False

    def rows(form: int, hashes: np.ndarray, tokens: np.ndarray, size: int, at: np.ndarray, of: np.ndarray, first: np.ndarray, slots: list[list[str]]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        check = (tokens[at[:, None] + np.arange(size)] * _CHECKS[:size]).sum(axis=1, dtype=np.uint64)
        columns = {"pos": pa.array(at - first[of], pa.int64()), "form": pa.array(np.full(len(at), form), pa.int32()), "hash": pa.array(hashes.view(np.int64)), "check": pa.array(check.view(np.int64)), "slots": pa.array(slots, pa.list_(pa.string()))}
        return of, columns

    def parts(hashes: np.ndarray, usable: np.ndarray) -> Iterator[np.ndarray]:
        if packed is not None:
            usable = usable & on_map(packed, hashes, bits)
        at = np.flatnonzero(usable)
        return iter(np.array_split(at, max(1, len(at) // 50_000)))

    for at in parts(made.hash, made.usable):
        yield rows(TEMPLATE, made.hash[at], made.hashes, WINDOW, at, made.of[at], made.first, made.slots(at))
    if WORDS in forms:
        hashes, whole = words.exact(EXACT)
        n = len(whole)
        for at in parts(hashes, whole if packed is not None else whole & bare[words.of[:n]]):
            yield rows(WORDS, hashes[at], words.hashes, EXACT, at, words.of[at], words.first, [[]] * len(at))
    for form, size in ((WHOLE, 1), (TWO, 2), (THREE, 3)):
        if form in forms:
            hashes, whole = words.exact(size)
            n = len(whole)
            hashes, alone = hashes ^ _FORMS[form, size], n_words[words.of[:n]] == size
            # an item is its only window; a single word counts in a document that has no other
            for at in parts(hashes, whole & alone & bare[words.of[:n]] if packed is None else whole & (alone if form == WHOLE else True)):
                yield rows(form, hashes[at], words.hashes, size, at, words.of[at], words.first, [[]] * len(at))


def windows(texts: DataFrame, key: str, text: str, packed: np.ndarray | None = None, bits: int = LEAST_BITS, forms: tuple[int, ...] = FORMS) -> DataFrame:
    """(key, same, pos, form, hash, check, slots) per window that may count; ``same`` is a hash of the text."""
    rows = texts.select(F.col(key).alias("key"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(n, t) for n, t in _HIT.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pretokens.slices(whole, "text", SLICE_BYTES):
                for of, columns in _hits(batch["text"], packed, bits, forms):
                    of = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch["key"].take(of), batch["same"].take(of), *columns.values()], schema.names)
        word_facts.cache_clear()  # the worker lives on for other stages

    return in_arrow(rows, run, schema)


def _matched(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, enough: int) -> DataFrame:
    """(key, same, item, windows, share, start, replaced)."""
    bench, _ = settle(windows(items.filter(F.col(item_id).isNotNull()), item_id, item_text).withColumnRenamed("key", "item").distinct(), "benchmark-windows")
    # items with equal windows count once
    facts = F.array_sort(F.collect_set(F.struct("pos", "form", "hash", "check", "slots")))
    sizes = bench.groupBy("item", "same").agg(F.xxhash64(facts).alias("content"), F.count(F.lit(1)).alias("n_windows"), F.max("form").alias("form"))
    sizes, _ = settle(sizes.withColumn("of", F.min(F.struct("item", "same")).over(W.partitionBy("content", "n_windows"))), "benchmark-items")
    needed = F.when(F.col("form") == TEMPLATE, F.least(F.lit(enough), F.col("n_windows"))).otherwise(F.col("n_windows"))
    least, total = sizes.agg(F.min(needed), F.sum("n_windows")).first()
    forms = tuple(r.form for r in bench.select("form").distinct().collect())  # three rows at most
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * (total or 1)).bit_length()))
    known, _ = settle(bench.select("hash", "check").distinct(), "benchmark-known")
    hits = windows(docs, doc_id, text, bit_map(known, "hash", bits), bits, forms).join(small(known, BROADCAST_WINDOWS), ["hash", "check"], "left_semi")
    hits, _ = settle(hits, "benchmark-hits")
    some = hits.groupBy("key", "same").agg(F.countDistinct("pos").alias("n")).filter(F.col("n") >= (least or 1)).select(F.col("key").alias("__key"), F.col("same").alias("__same"))
    hits = hits.join(some, F.col("key").eqNullSafe(F.col("__key")) & (F.col("same") == F.col("__same"))).drop("__key", "__same")
    one = sizes.filter("of.item = item AND of.same = same").select("item", "same", "n_windows", needed.alias("needed"))
    asked = bench.join(one, ["item", "same"]).select(F.struct("item", "same").alias("of"), "n_windows", "needed", F.col("pos").alias("item_pos"), "hash", "check", F.col("slots").alias("old"))
    met_by = hits.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("met_by"))
    rarest = F.row_number().over(W.partitionBy("of").orderBy("met_by", "hash", "item_pos"))
    leads = asked.join(met_by, ["hash", "check"], "left").withColumn("met_by", F.coalesce("met_by", F.lit(0))).withColumn("nth", rarest)
    leads = leads.filter("nth <= n_windows - needed + 1 AND met_by > 0").select("of", "hash", "check").distinct()
    pairs = hits.select("key", "same", "hash", "check").join(leads, ["hash", "check"]).select(F.coalesce(F.xxhash64("key"), F.lit(0)).alias("key_hash"), "key", "same", "of").distinct()
    pairs, _ = settle(pairs, "benchmark-pairs")
    slots = F.zip_with("old", "slots", lambda o, r: F.struct(o.alias("o"), r.alias("r")))
    wanted = pairs.join(asked, "of").withColumnsRenamed({"key": "__key", "same": "__same"})
    hits = hits.withColumn("key_hash", F.coalesce(F.xxhash64("key"), F.lit(0)))
    met = hits.join(wanted, ["key_hash", "hash", "check"]).filter(F.col("key").eqNullSafe(F.col("__key")) & (F.col("same") == F.col("__same")))
    met = met.select("key", "same", "of", "n_windows", "needed", (F.col("pos") - F.col("item_pos")).alias("shift"), F.struct("item_pos", slots.alias("slots")).alias("hit"))
    # all windows of an item on one alignment: no more than the item has
    lines = met.groupBy("key", "same", "of", "shift").agg(F.collect_set("hit").alias("hits"), F.first("n_windows").alias("n_windows"), F.first("needed").alias("needed")).filter("size(hits) >= needed")
    lines = lines.withColumn("pairs", F.array_distinct(F.flatten(F.transform("hits", lambda h: h["slots"]))))
    olds = F.transform("pairs", lambda p: p["o"])
    lines = lines.withColumn("torn", F.filter(F.array_distinct(olds), lambda o: F.size(F.filter("pairs", lambda p: p["o"] == o)) > 1))
    whole = F.filter("hits", lambda h: ~F.exists(h["slots"], lambda s: F.array_contains("torn", s["o"])))
    lines = lines.select("key", "same", "of", "shift", "n_windows", "needed", F.size(whole).cast("bigint").alias("windows"), F.size(F.filter("pairs", lambda p: p["o"] != p["r"])).cast("bigint").alias("replaced"))
    lines = lines.filter("windows >= needed")
    best = F.max_by(F.struct("windows", (F.col("windows") / F.col("n_windows")).alias("share"), F.col("shift").alias("start"), "replaced"), F.struct("windows", -F.col("shift")))
    best = lines.groupBy("key", "same", "of").agg(best.alias("b"))
    return best.join(sizes.select("of", "item"), "of").select("key", "same", "item", "b.*").distinct()


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", enough: int = ENOUGH) -> DataFrame:
    """(doc_id, item_id, windows, share, start, replaced): items that documents hold.

    windows: matched windows of the item on the best alignment; share: of all its windows;
    start: position of the item's first token in the document; replaced: slot values
    that differ from the item's.  A row per item and distinct text of an id.
    """
    out = _matched(docs, items, doc_id, text, item_id, item_text, enough)
    return out.select(F.col("key").alias(doc_id), F.col("item").alias(item_id), "windows", "share", "start", "replaced")


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000, item_id: str = "item_id", item_text: str = "text", enough: int = ENOUGH) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = _matched(docs, items, doc_id, text, item_id, item_text, enough)
    bad, _ = settle(found.select(F.col("key").alias("__bad"), F.col("same").alias("__bad_text")).distinct(), "contaminated")
    same = docs[doc_id].eqNullSafe(F.col("__bad")) & (F.xxhash64(docs[text]) == F.col("__bad_text"))
    return docs.join(small(bad, broadcast_rows), same, "left_anti")
