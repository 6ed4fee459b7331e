"""Encoding texts through their distinct pre-tokens, inside a task.

The public tokenizers cut a text into pre-tokens before any merge, and a blank or
line feed that follows a letter, digit or sign always begins a new one.  So does a sign that follows a letter, but for a few signs.  A batch is
therefore cut there, equal pieces are encoded once, and the results are joined back
to the pieces' places by dictionary code.  Cutting at fewer places than the library
does is always safe: a piece that holds several pre-tokens is encoded whole.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut and encoded together; bounds a task's memory.
SLICE_BYTES = 4 << 20


@functools.cache
def library(path: str):
    """The tokenizer of a ``.json`` or ``.model`` file, loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


#: Signs that never stand in one pre-token with a letter before them.  Apostrophes and hyphens may, and "<", "|" and ">" make up special tokens.
SIGNS = b"!\"#$%&()*+,./:;=?@[\\]^`{}~"
_SIGN, _LETTER, _WIDE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(SIGNS)] = True
_LETTER[65:91] = _LETTER[97:123] = True
_WIDE[128:192] = True
_WIDE[[0x97, 0xB7]] = False  # after 0xC3 the signs of multiplication and division, else letters


def sign_cuts(data: np.ndarray) -> np.ndarray:
    """Offsets of signs that follow a letter of ASCII or of U+00C0 to U+00FF."""
    at = np.flatnonzero(_SIGN[data])
    at = at[at >= 2]
    last = data[at - 1]
    return at[_LETTER[last] | (_WIDE[last] & (data[at - 2] == 0xC3))]


def cuts(data: np.ndarray) -> np.ndarray:
    """Offsets at which every one of the tokenizers begins a new pre-token.

    Before a blank or line feed whose predecessor certainly is no white space: a
    visible ASCII character, or the end of a two-byte letter from U+00C0 or of a
    character from U+4000 (Unicode's white space lies below or between those).
    """
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at >= 3]
    last, second, third = data[at - 1], data[at - 2], data[at - 3]
    sure = (last > 32) & (last < 127)
    sure |= (last >= 128) & (second >= 0xC3) & (second <= 0xDF)
    sure |= (last >= 128) & (second >= 128) & (second < 0xC0) & (third >= 0xE4) & (third <= 0xEF)
    return at[sure]


class Pieces:
    """The pieces of some texts: distinct ones, and where they stand."""

    def __init__(self, texts: pa.Array, divisible: bool = True, at_signs: bool = False):
        offsets, data = utf8(texts)
        self.n_bytes = np.diff(offsets)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        if divisible:
            begins[cuts(data)] = True
        if at_signs:
            begins[sign_cuts(data)] = True
        bounds = np.flatnonzero(begins) if len(data) else np.zeros(1, np.int64)
        bounds = bounds if not len(data) or bounds[-1] == len(data) else np.append(bounds, len(data))
        #: Texts' first pieces, and one past the last.
        self.first = np.searchsorted(bounds, offsets)
        whole = pa.Array.from_buffers(
            pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        )
        encoded = whole.dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()

    def summed(self, per_distinct: np.ndarray) -> np.ndarray:
        """Per text, the sum of a figure of its pieces."""
        total = np.concatenate([[0], np.cumsum(per_distinct[self.codes], dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]


#: Pieces that one call of a library gets, and pieces that are joined into one text.
CALL, JOINED = 20_000, 20


@functools.cache
def _joint(path: str) -> tuple[str, int, tuple[str, ...]] | None:
    """A special token that may stand between pieces, its id, and all special strings."""
    added = library(path).get_added_tokens_decoder()
    fit = [(i, t) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
    return (fit[-1][1].content, fit[-1][0], tuple(t.content for t in added.values())) if fit else None


def encode_each(pieces: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids per piece, all ids).

    The library cuts a text at its special tokens before anything else, so pieces that
    hold none are joined by one and come apart at its id; a call costs far more
    than a piece.
    """
    joint = _joint(path) if divides(path) else None
    counts, ids = np.zeros(len(pieces), np.int64), []
    for at in range(0, len(pieces), CALL):
        part = pieces[at : at + CALL]
        if joint is None or any(s in p for p in part for s in joint[2]):
            found = [e.ids for e in library(path).encode_batch_fast(part, add_special_tokens=False)] if divides(path) else library(path).encode(part, num_threads=1)
            counts[at : at + len(part)] = np.fromiter(map(len, found), np.int64, len(found))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts[at : at + len(part)].sum())))
            continue
        mark, mark_id, _ = joint
        texts = [mark.join(part[i : i + JOINED]) + mark for i in range(0, len(part), JOINED)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == mark_id)
        counts[at : at + len(part)] = np.diff(ends, prepend=-1) - 1
        ids.append(flat[flat != mark_id])
    return counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


class Known:
    """Pieces that this worker has encoded before, up to ``MOST`` of them and a slice's (some 200 bytes each); of more, those met again stay."""

    MOST = 3 << 17

    def __init__(self, path: str, most: int | None = None):
        self.path, self.most = path, most or self.MOST
        self.index: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def shorten(self) -> None:
        """Forgets the pieces that were not met again since the last time, and of the others those beyond half of the most."""
        kept = np.flatnonzero(self.again)[: self.most // 2]
        names, counts = list(self.index), self.counts[kept]
        begins = (np.cumsum(self.counts) - self.counts)[kept]
        self.ids = self.ids[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        self.index = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.counts, self.again = counts, np.zeros(len(kept), bool)

    def lookup(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids, first id's place, ids), the first two per piece."""
        if len(self.index) > self.most:
            self.shorten()
        at = np.fromiter(map(self.index.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            counts, ids = encode_each(new, self.path)
            at[missing] = len(self.index) + np.arange(len(new))
            self.index.update(zip(new, at[missing].tolist()))
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        begins = np.cumsum(self.counts) - self.counts
        return self.counts[at], begins[at], self.ids


@functools.cache
def known(path: str, most: int | None = None) -> Known:
    return Known(path, most)


class Counts:
    """Numbers of tokens of pieces that this worker has counted before, up to ``MOST`` of them; no ids are kept or built."""

    MOST = 3 << 18

    def __init__(self, path: str):
        self.path = path
        self.found: dict[str, int] = {}

    def of(self, distinct: list[str]) -> np.ndarray:
        if len(self.found) > self.MOST:
            self.found.clear()
        counts = np.fromiter(map(self.found.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            counts[missing] = count_each(new, self.path)
            self.found.update(zip(new, counts[missing].tolist()))
        return counts


@functools.cache
def counted(path: str) -> Counts:
    return Counts(path)


def count_each(pieces: list[str], path: str) -> np.ndarray:
    """Tokens of each piece, as lengths of the library's encodings."""
    lib, out = library(path), np.zeros(len(pieces), np.int64)
    for at in range(0, len(pieces), CALL):
        part = pieces[at : at + CALL]
        made = lib.encode_batch_fast(part, add_special_tokens=False) if divides(path) else lib.encode(part, num_threads=1)
        out[at : at + len(part)] = np.fromiter(map(len, made), np.int64, len(part))
    return out


def divides(path: str) -> bool:
    """Whether the file's library never merges over the places of ``cuts``."""
    return path.endswith(".json")


@functools.cache
def divides_at_signs(path: str) -> bool:
    """Whether the same holds of the places of ``sign_cuts``: no added token has one inside."""
    return divides(path) and not any(len(sign_cuts(np.frombuffer(t.content.encode(), np.uint8))) for t in library(path).get_added_tokens_decoder().values())


def count_tokens(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) per text; each distinct pre-token is counted once."""
    pieces = Pieces(texts, divides(path), divides_at_signs(path))
    return pieces.n_bytes, pieces.summed(counted(path).of(pieces.distinct))


def encode(texts: pa.Array, path: str, end: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of all texts, with id ``end`` after each text if given; ``most``: pieces to remember."""
    pieces = Pieces(texts, divides(path), divides_at_signs(path))
    counts, begins, flat = known(path, most).lookup(pieces.distinct)
    codes, first = pieces.codes, pieces.first
    if end is not None:  # one more distinct piece, which follows each text's last
        flat, codes = np.append(flat, np.uint32(end)), np.insert(codes, first[1:], len(counts))
        counts, begins = np.append(counts, 1), np.append(begins, len(flat) - 1)
        first = first + np.arange(len(first))
    lengths = counts[codes]
    ends = np.cumsum(lengths)
    places = np.repeat(begins[codes] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
    return np.concatenate([[0], ends])[first], flat[places]
