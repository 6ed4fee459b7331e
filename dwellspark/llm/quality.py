"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad.  Its evidence is a vector of character-class and
word-shape shares of the line, of the line before and of the line after; neighbouring
labels are tied by a 2 x 2 transition table.  Forward-backward gives each line's
marginal; the document's score is the length-weighted mean marginal of good, passed
through a one-variable logistic curve.

The field is fitted on at most ``MOST_FITTED`` labelled documents (whole texts of at most
``LONGEST_FITTED`` lines) and ``MOST_LINES`` lines, drawn by a hash of the id and the text; lines
inherit the label of their document.  Executors make the line features; the driver gets
only those (some 70 bytes a line), and fits by gradient ascent.

Null and empty texts are one empty line and get a score like any other; a very long
text is scored whole; repeated rows get equal scores; an empty table gives an empty
table.  Rows with null labels or ids are not fitted on.  Columns named score, n_lines or
bad_lines (in any case) are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .shared import add_columns, settle

#: Labelled documents that the field is fitted on, at most.
MOST_FITTED = 3000
#: Lines of such a document, and of all of them, at most.
LONGEST_FITTED, MOST_LINES = 2_000, 300_000
#: Bytes of text whose lines are measured together; a byte needs some 60 bytes of memory.
SLICE_BYTES = 2 << 20

#: Classes of UTF-8 bytes: other, upper, lower, digit, blank, sentence mark, symbol, letter of several bytes, control.
OTHER, UPPER, LOWER, DIGIT, BLANK, MARK, SYMBOL, WIDE, EXCLAIM, BAR = range(10)
N_CLASSES = 10


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"0123456789", DIGIT), (b" \t\r\x0b\x0c", BLANK), (b".,;:?'\"()-", MARK), (b"*#$%&<>{}[]\\/=+@_^~`", SYMBOL), (b"!", EXCLAIM), (b"|", BAR)):
        table[np.frombuffer(chars, np.uint8)] = kind
    table[128:] = WIDE
    return table


CLASSES = _classes()
#: A number per byte, whose sum stands for a word.
CODES = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64)
#: Features of a line: a constant, log length, shares of eight classes, words' length, words
#: that end in a symbol, words that repeat the one before, repeated line, short line, empty line.
N_LOCAL = 16
N_FEATURES = 3 * N_LOCAL


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each text and one past the last, bytes per line, local features)."""
    offsets, data = pretokens.utf8(texts)
    n = len(offsets) - 1
    after = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(offsets, after - 1, side="right") - 1  # the text that a line feed stands in
    starts = np.concatenate([offsets[:-1], after])
    of = np.concatenate([np.arange(n), owner])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    first = np.searchsorted(of, np.arange(n + 1))
    last = np.zeros(len(of), bool)
    last[first[1:] - 1] = True
    ends = np.where(last, offsets[of + 1], np.append(starts[1:], 0) - 1)
    size = ends - starts

    kinds = CLASSES[data]
    line = np.zeros(len(data) + 1, np.int64)
    np.add.at(line, starts[1:], 1)
    line = np.cumsum(line)[: len(data)]
    feeds = data == 10
    counts = np.bincount((line * N_CLASSES + kinds)[~feeds], minlength=len(of) * N_CLASSES).reshape(-1, N_CLASSES)[: len(of)].astype(np.float64)
    gap = (kinds == BLANK) | feeds
    begin = np.zeros(len(data) + 1, bool)  # a line begins, in the same text or another
    begin[starts] = True
    word_end = ~gap
    word_end[:-1] &= gap[1:] | begin[1:-1]
    words = np.bincount(line[word_end], minlength=len(of)).astype(np.float64)
    odd = word_end & np.isin(kinds, (SYMBOL, EXCLAIM, BAR))
    odd_ends = np.bincount(line[odd], minlength=len(of)).astype(np.float64)
    # words that repeat the word before them in their line, by length and summed byte codes
    word_start = ~gap
    word_start[1:] &= gap[:-1] | begin[1:-1]
    begins = np.flatnonzero(word_start)
    again = np.zeros(len(of))
    if len(begins):
        held = np.add.reduceat(np.where(gap, np.uint64(0), CODES[data]), begins)
        same = np.zeros(len(begins), bool)
        same[1:] = (held[1:] == held[:-1]) & (line[begins[1:]] == line[begins[:-1]])
        again = np.bincount(line[begins[same]], minlength=len(of)).astype(np.float64)
    # lines that occur more than once in their text, by content
    repeated = np.zeros(len(of))
    if len(data):
        bounds = np.stack([starts, ends], axis=1).ravel().astype(np.int64)
        raw = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).take(pa.array(np.arange(0, len(bounds), 2)))
        same = raw.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = of * (int(same.max()) + 1) + same
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated = (times[where] > 1).astype(np.float64)
    length = np.maximum(size, 1).astype(np.float64)
    n_words = np.maximum(words, 1)
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER] + counts[:, WIDE], 1)
    x = np.stack(
        [
            np.ones(len(of)), np.log1p(size) / 5, counts[:, UPPER] / letters, counts[:, DIGIT] / length, counts[:, BLANK] / length, counts[:, MARK] / n_words,
            counts[:, SYMBOL] / n_words, counts[:, EXCLAIM] / n_words, counts[:, BAR] / n_words, counts[:, WIDE] / length, length / n_words / 10,
            odd_ends / n_words, again / n_words, repeated, size < 20, size == 0,
        ],
        axis=1,
    )
    return first, size, np.minimum(x, 5.0)


def with_neighbours(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it (0 at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(first: np.ndarray, emit: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once, a line at a time.

    emit: each line's log potential of good against bad.  tie: log potentials [from, to],
    0 bad and 1 good.  Returns P(good) per line and the summed pair marginals.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    longest = int(counts.max(initial=0))
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t lines
    # scaled to sum to 1 at each line; a line's scale cancels in its marginals
    peak = np.maximum(emit, 0)
    lift = np.stack([np.exp(-peak), np.exp(emit - peak)], axis=1)
    step = np.exp(tie - tie.max())
    forward, backward = np.empty_like(lift), np.ones_like(lift)
    for t in range(longest):
        at = begin[: alive[t]] + t
        now = lift[at] * (forward[at - 1] @ step) if t else lift[at]
        forward[at] = now / (now[:, :1] + now[:, 1:])
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        now = (lift[at + 1] * backward[at + 1]) @ step.T
        backward[at] = now / (now[:, :1] + now[:, 1:])
    both = forward * backward
    good = both[:, 1] / (both[:, 0] + both[:, 1])
    tied = np.ones(len(emit), bool)
    tied[first[1:] - 1] = False
    at = np.flatnonzero(tied)
    pairs = forward[at][:, :, None] * step * (lift[at + 1] * backward[at + 1])[:, None, :]
    return good, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass(frozen=True)
class LineField:
    """A fitted field: feature weights, transitions, and the curve of document scores."""

    weights: tuple[float, ...]
    tie: tuple[float, float, float, float]
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, first: np.ndarray, x: np.ndarray) -> np.ndarray:
        return marginals(first, with_neighbours(first, x) @ np.array(self.weights), np.array(self.tie).reshape(2, 2))[0]

    def documents(self, first: np.ndarray, size: np.ndarray, good: np.ndarray) -> np.ndarray:
        weight = np.maximum(size, 1).astype(np.float64)
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_field(first: np.ndarray, size: np.ndarray, x: np.ndarray, label: np.ndarray, steps: int = 80, l2: float = 1e-3) -> LineField:
    """The field that makes the lines' labels likeliest (Adam on the exact gradient)."""
    n = len(label)
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    wide = with_neighbours(first, x)
    share = 1 / np.repeat(np.diff(first), np.diff(first))  # a text weighs 1, however many lines it has
    tied = np.ones(len(y), bool)
    tied[first[1:] - 1] = False
    at = np.flatnonzero(tied)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    theta = np.zeros(wide.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, pairs = marginals(first, wide @ theta[:-4], theta[-4:].reshape(2, 2))
        up = np.concatenate([wide.T @ ((y - good) * share) / n, ((seen - pairs) / max(1, len(at))).ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = LineField(tuple(theta[:-4]), tuple(theta[-4:]))
    good = field.lines(first, x)
    weight = np.maximum(size, 1).astype(np.float64)
    z = _logit(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = max(0.05, a + 0.05 * (((label - p) * z).mean() - 1e-3 * (a - 1))), b + 0.2 * (label - p).mean()
    return LineField(field.weights, field.tie, float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_FITTED) -> LineField:
    """A field fitted on ``docs`` whose id has a 0/1 ``label``; ``most`` bounds the sample."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    texts = texts.select("y", F.xxhash64("id").alias("of"), F.xxhash64("text").alias("same"), "text")

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        first, size, x = line_features(batch["text"])
        cut = list(zip(first[:-1].tolist(), first[1:].tolist()))
        return {
            "size": pa.array([size[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()),
            "x": pa.array([x[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary()),
        }

    # lines are measured where texts are read; only numbers are ordered
    made = add_columns(texts, {"size": T.BinaryType(), "x": T.BinaryType()}, ["y", "of", "same"], work, lambda b: pretokens.slices(b, "text", SLICE_BYTES))
    made, _ = settle(made.withColumn("n", F.length("size") / 4).withColumn("row", F.monotonically_increasing_id()), "quality-lines")
    few = made.select("row", "y", "of", "same", "n").orderBy("of", "same", "y", "row").limit(most).filter(F.col("n") <= LONGEST_FITTED)  # ids may be repeated
    before = F.sum("n").over(W.orderBy("of", "same", "y", "row").rowsBetween(W.unboundedPreceding, 0))  # of MOST_FITTED rows
    chosen = few.withColumn("lines", before).filter(F.col("lines") <= MOST_LINES).select("row")
    rows = made.join(F.broadcast(chosen), "row").select("y", "size", "x").collect()
    rows = sorted(((r.y, bytes(r.size), bytes(r.x)) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return LineField((0.0,) * N_FEATURES, (0.0,) * 4)
    sizes = [np.frombuffer(s, np.int32) for _, s, _ in rows]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    x = np.concatenate([np.frombuffer(b, np.float32) for _, _, b in rows]).reshape(-1, N_LOCAL).astype(np.float64)
    return fit_field(first, np.concatenate(sizes), x, np.array([y for y, _, _ in rows]))


def score(docs: DataFrame, field: LineField, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1), n_lines and bad_lines (positions of lines labelled bad)."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        first, size, x = line_features(batch[text])
        good = field.lines(first, x)
        bad = good < 0.5
        place = np.arange(len(bad)) - np.repeat(first[:-1], np.diff(first))
        ends = np.concatenate([[0], np.cumsum(bad)])[first].astype(np.int32)
        return {
            "score": pa.array(field.documents(first, size, good), pa.float64()),
            "n_lines": pa.array(np.diff(first), pa.int64()),
            "bad_lines": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[bad].astype(np.int32), pa.int32())),
        }

    names = {"score": T.DoubleType(), "n_lines": T.LongType(), "bad_lines": T.ArrayType(T.IntegerType())}
    return add_columns(docs, names, keep, work, lambda b: pretokens.slices(b, text, SLICE_BYTES))
