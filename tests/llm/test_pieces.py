"""Pieces end before signs, and repeated pieces outlive a full store."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dwellspark.llm import pretokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def test_words_before_signs_are_one_piece():
    pieces = pretokens.Pieces(pa.array(["some word, a word. a word", "été, é! é"]), at_signs=True)
    assert sorted(pieces.distinct) == sorted(["some", " word", " a", ",", ".", "été", " é", "!"])


@pytest.mark.parametrize("file", FILES)
def test_cut_texts_have_the_librarys_ids(file):
    path, rng = public_tokenizers.path(file), random.Random(5)
    parts = ["word", "Word", "WORD", "é", "ß", "×", "÷", "é", "́", "Σ", "İ", "한", "1", "23", "'s", "'", "'LL", "_", "-", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", *map(chr, pretokens.SIGNS), " ", "  ", "\n", "\t", " ", " ", "…", "“"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(4000)]
    offsets, ids = pretokens.encode(pa.array(texts), path)
    plain = pretokens.library(path).encode_batch_fast(texts, add_special_tokens=False)
    for text, a, b, whole in zip(texts, offsets[:-1], offsets[1:], plain):
        assert ids[a:b].tolist() == whole.ids, text


def test_pieces_met_again_stay(monkeypatch):
    path, encoded = public_tokenizers.path(FILES[0]), []
    each = pretokens.encode_each
    monkeypatch.setattr(pretokens, "encode_each", lambda pieces, path: encoded.extend(pieces) or each(pieces, path))
    monkeypatch.setattr(pretokens.Known, "MOST", 40)
    known, common = pretokens.Known(path), [f" common{i}" for i in range(10)]
    lib = pretokens.library(path)
    for turn in range(30):
        asked = common + [f" rare{turn}x{i}" for i in range(9)]
        counts, begins, ids = known.lookup(asked)
        assert [ids[b : b + n].tolist() for n, b in zip(counts, begins)] == [e.ids for e in lib.encode_batch_fast(asked, add_special_tokens=False)]
        assert len(known.index) <= 40 + len(asked)
    assert all(encoded.count(c) == 1 for c in common)
    assert np.all(np.array([encoded.count(f" rare{t}x0") for t in range(30)]) == 1)
