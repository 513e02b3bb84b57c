"""Distinct words of text buffers and the hashed character n-grams in them, shared by the text classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexiphyte.llm.common import buffers, span_hashes, word_bounds


@dataclass
class Words:
    """Words of some rows: each row's first word (and, last, their number), each word's distinct one, and their n-grams."""

    row: np.ndarray
    of: np.ndarray
    letters: np.ndarray  # bytes of each distinct word
    gram: np.ndarray  # hashes of n-grams, word by word
    gram_end: np.ndarray


def letter_class() -> np.ndarray:
    """Bytes of words here: ASCII letters and all beyond ASCII."""
    b = np.arange(256)
    return ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90)) | (b >= 128)


_INSIDE = letter_class()


def word_grams(text, sizes: tuple[int, ...], whole: bool) -> Words:
    """Lower-cased words of a string column with their n-grams of bytes, word ends marked, and (``whole``) themselves."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    data, ends = buffers(pc.utf8_lower(text.cast(pa.large_string())))
    starts, stops, row = word_bounds(data, ends, _INSIDE)
    h = span_hashes(data, starts, stops)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    starts, stops = starts[first], stops[first]
    n = stops - starts
    # The distinct words one after another, each as <word>.
    upto = np.concatenate(([0], np.cumsum(n + 2)))
    flat = np.full(upto[-1], ord("<"), np.uint8)
    flat[upto[1:] - 1] = ord(">")
    inner = np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)
    place = np.arange(n.sum()) + np.repeat(upto[:-1] + 1 - np.cumsum(n) + n, n)
    flat[place] = data[inner]
    width = n + 2
    kinds = [np.maximum(width - s + 1, 0) for s in sizes] + ([np.ones(len(n), np.int64)] if whole else [])
    count = sum(kinds) if kinds else np.zeros(len(n), np.int64)
    gram_end = np.concatenate(([0], np.cumsum(count)))
    a, b = np.zeros(gram_end[-1], np.int64), np.zeros(gram_end[-1], np.int64)
    at = gram_end[:-1].copy()
    for size, k in zip([*sizes, *([0] if whole else [])], kinds, strict=True):
        total = int(k.sum())
        step = np.arange(total) - np.repeat(np.cumsum(k) - k, k)
        to = np.repeat(at, k) + step
        a[to] = np.repeat(upto[:-1], k) + step
        b[to] = a[to] + size if size else np.repeat(upto[1:], k)
        at += k
    return Words(row, of, n, span_hashes(flat, a, b), gram_end)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of values given by their ends; empty runs are 0."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(values, ends[full], axis=0)
    return out
