import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import _words
from tests.llm import brute


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .-\néßЖ", max_size=30)), max_size=8))
def test_words_equal_a_regular_expression(texts):
    w = _words.words(pa.array(texts, pa.string()))
    got = [[w.data[a:z].tobytes().decode() for a, z in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [brute.words(t) for t in texts]
    names = [x for d in got for x in d]
    assert len(set(w.hash.tolist())) == len(set(names))
    assert _words.word_keys(names).tolist() == w.hash.tolist()


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(0)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(400)), "", "y" * 5000, "a b"]
    whole = _words.words(pa.array(texts)).hash.tolist()
    monkeypatch.setattr(_words, "PIECE", 64)
    assert _words.words(pa.array(texts)).hash.tolist() == whole


def test_gram_sets_equal_brute_force():
    texts = ["a b c a b c a b", "a b", "", "b a", "a b c"]
    for n in (1, 2, 3, 5):
        key, edge = _words.sets(*_words.grams(_words.words(pa.array(texts)), n), len(texts))
        assert np.diff(edge).tolist() == [len(brute.grams(t, n)) for t in texts]
        first, last = set(key[edge[0] : edge[1]].tolist()), set(key[edge[4] : edge[5]].tolist())
        assert len(first & last) == len(brute.grams(texts[0], n) & brute.grams(texts[4], n))
