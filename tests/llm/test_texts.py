"""Kernels over Arrow buffers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from proselens.llm.textkit import NOT_WORD, SPACES, Texts, shingles, slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.7😀", max_size=30)), max_size=6)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    for separator, pattern in ((SPACES, r"[^\x20\x09-\x0D]+"), (NOT_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        t = Texts(pa.array(texts, pa.string()), lower=True)
        starts, ends, bounds = t.spans(separator)
        found = [[bytes(t.data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        assert found == [re.findall(pattern, (x or "").translate(LOWER)) for x in texts]
        h = t.hashes(starts, ends)
        words = [w for own in found for w in own]
        assert len(set(words)) == len(set(h.tolist()))


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles(texts, k):
    t = Texts(pa.array(texts, pa.string()))
    starts, ends, bounds = t.spans(SPACES)
    h, at = shingles(t.hashes(starts, ends), bounds, k, short=True)
    seen: dict = {}
    for i, text in enumerate(texts):
        w = (text or "").split()
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = [tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))] if w else []
        own = h[at[i] : at[i + 1]].tolist()
        assert len(own) == len(want)
        for gram, value in zip(want, own, strict=True):
            assert seen.setdefault(gram, value) == value
    assert len(set(seen.values())) == len(seen)


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "c", "d" * 5])], names=["text"])
    parts = list(slices(iter([batch]), "text", 12))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert not list(slices(iter([batch.slice(0, 0)]), "text"))
    assert np.array_equal(Texts(batch.column(0).slice(2, 2)).offsets, [0, 30, 31])
