import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import words

from rivulet.llm._text import shingles, word_hashes
from rivulet.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=60)
@given(st.lists(st.none() | st.text("aAéß _-.\n0漢", max_size=40), max_size=6))
def test_words_are_told_apart(texts):
    hashes, first = word_hashes(texts)
    want = [words(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    by_word = {}
    for h, w in zip(hashes.tolist(), (x for ws in want for x in ws), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60)
@given(st.lists(st.text("ab ", max_size=30), max_size=5))
def test_shingles_are_runs_of_five_words(texts):
    hashes, begin = shingles(*word_hashes(texts))
    by_run = {}
    for i, t in enumerate(texts):
        w = words(t)
        runs = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        own = hashes[begin[i] : begin[i + 1]].tolist()
        assert len(own) == len(runs)
        for r, h in zip(runs, own, strict=True):
            assert by_run.setdefault(r, h) == h
    assert len(set(by_run.values())) == len(by_run)


@settings(max_examples=150)
@given(st.binary(max_size=80) | st.text("ab", max_size=120).map(str.encode))
def test_suffix_array(data):
    array = suffix_array(np.frombuffer(data, dtype=np.uint8))
    assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    lengths = common_prefixes(np.frombuffer(data, dtype=np.uint8), array, 30)
    for i in range(1, len(data)):
        x, y, n = data[array[i - 1] :], data[array[i] :], 0
        while n < min(len(x), len(y), 30) and x[n] == y[n]:
            n += 1
        assert lengths[i] == n
