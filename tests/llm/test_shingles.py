"""Shingles of few distinct words: their order counts."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from lexiphyte.llm import near_duplicates


@pytest.mark.parametrize("words", ["ab", "abc"])
@pytest.mark.parametrize("size", [2, 5, 7])
def test_order_counts(words, size):
    texts = [" ".join(w) for n in range(1, size + 1) for w in itertools.product(words, repeat=n)]
    h, ends = near_duplicates.shingle_sets(pa.RecordBatch.from_pydict({"text": texts}), size)
    assert np.diff(ends).tolist() == [1] * len(texts)
    assert len(np.unique(h)) == len(texts)


def test_sets_of_two_words():
    w = np.random.default_rng(9).choice(["a", "b"], 2000).tolist()
    h, _ = near_duplicates.shingle_sets(pa.RecordBatch.from_pydict({"text": [" ".join(w)]}), 5)
    assert len(np.unique(h)) == len({tuple(w[k : k + 5]) for k in range(1996)}) == 32
