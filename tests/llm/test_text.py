"""The numpy kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import _text as kernels

TEXTS = st.lists(st.none() | st.text("ab é\t\n\x0b.X\U0001f600", max_size=30), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans())
def test_words(texts, punctuation):
    data, offsets = kernels.binary(pa.array(texts, pa.string()))
    words = kernels.Words(data, offsets, punctuation)
    want = [re.findall(rb"[^\x20\x09-\x0D]+" if not punctuation else rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()) for t in texts]
    got = [[bytes(data[words.starts[k] : words.ends[k]]) for k in range(a, b)] for a, b in zip(words.first, words.first[1:])]
    assert got == want
    flat = [w for ws in want for w in ws]
    hashes = words.hashes()
    assert len({*hashes.tolist()}) == len({*flat})
    assert [flat.index(w) for w in flat] == [hashes.tolist().index(h) for h in hashes.tolist()]


def test_hashes_do_not_depend_on_place_or_pieces(monkeypatch):
    text = " ".join(f"word{k % 50}" for k in range(2000))
    whole = kernels.Words(*kernels.binary(pa.array([text]))).hashes()
    monkeypatch.setattr(kernels, "PIECE", 64)
    cut = kernels.Words(*kernels.binary(pa.array([text]))).hashes()
    assert (whole == cut).all() and len({*whole.tolist()}) == 50
    assert (kernels.Words(*kernels.binary(pa.array(["x " + text]))).hashes()[1:] == whole).all()
    assert (kernels.Words(*kernels.binary(pa.array(["abcdef abcdxx"]))).hashes(4)[[0]] == kernels.Words(*kernels.binary(pa.array(["abcd"]))).hashes()).all()


@pytest.mark.parametrize("width", [1, 2, 3, 7, 28])
def test_sliding_and_grams(width):
    x = np.random.default_rng(0).integers(0, 9, 100).astype(np.uint64)
    assert (kernels.sliding(x, width, np.minimum) == [x[k : k + width].min() for k in range(101 - width)]).all()
    g = kernels.grams(x, width).tolist()
    rows = [tuple(x[k : k + width].tolist()) for k in range(101 - width)]
    assert [rows.index(r) for r in rows] == [g.index(v) for v in g]
    assert len(kernels.grams(x[: width - 1], width)) == 0


def test_slices():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "", "c" * 5] * 3)})
    parts = list(kernels.slices(batch, "text", 20))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()
    assert list(kernels.slices(batch.slice(0, 0), "text", 20)) == []
