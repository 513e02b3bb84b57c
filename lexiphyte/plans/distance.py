"""Edit distance between many keys at once: bit-parallel columns over pairs, in numpy.

Every column of the distance matrix is held as bits of its steps up and down (Myers; Hyyrö for blocks of 64), one pair of
words for 64 characters of a query. Nothing is approximate: pairs are only left out where a lower bound says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs whose columns are held at once, sized for a core's cache.
PAIRS = 1 << 15
#: Cells of a block of queries by references that are bounded at once, and characters or masks held for them.
CELLS, HELD, QUERIES = 1 << 20, 1 << 21, 256
#: Letters and their counts that the lower bound tells apart.
_LETTERS, _COUNTS = 40, 4
#: Steps of references that are taken for all with the same beginning at once, if few differ in it.
_SHARED = 8

_ONE, _ZERO = np.uint64(1), np.uint64(0)


def _codes(keys: list[str], lengths: np.ndarray) -> np.ndarray:
    """Code points of the keys, a row each, zero beyond their ends."""
    width = max(1, int(lengths.max(initial=0)))
    return np.array(keys, dtype=f"U{width}").view(np.uint32).reshape(len(keys), width)


def _bags(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the first few occurrences of each letter a key has. Letters that share a place only weaken the bound."""
    n = len(codes)
    inside = np.arange(codes.shape[1]) < lengths[:, None]
    at = np.nonzero(inside)
    counts = np.bincount(at[0] * _LETTERS + codes[at] % _LETTERS, minlength=n * _LETTERS).reshape(n, _LETTERS, 1)
    return (counts > np.arange(_COUNTS)).reshape(n, -1).astype(np.float32)


def _runs(keys: list[str], most: int, one_width: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, lengths and codes of keys by falling length, in runs that hold a bounded number of characters; with
    ``one_width`` all of a run take as many words."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(-lengths, kind="stable")
    start = 0
    while start < len(order):
        longest = max(1, int(lengths[order[start]]))
        size = max(1, min(most, HELD // (longest * (_LETTERS if one_width else 1))))
        rows = order[start : start + size]
        if one_width and longest > 64:
            rows = rows[lengths[rows] > (longest - 1) // 64 * 64]
        yield rows, lengths[rows], _codes([keys[k] for k in rows], lengths[rows])
        start += len(rows)


def pairs_within(queries: list[str], references: list[str], max_dist: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and references within ``max_dist`` of each other, part by part.

    At exactly ``max_dist``, if it is whole, a pair fails if only deleting the reference's end gets there.
    """
    if max_dist < 0 or not queries or not references:
        return
    whole = int(max_dist // 1)
    ours = [(rows, n, codes, bags := _bags(codes, n), bags.sum(1)) for rows, n, codes in _runs(references, CELLS // QUERIES, False)]
    for qrows, m, qcodes in _runs(queries, QUERIES, True):
        letters = np.unique(qcodes)
        masks, qbags = _masks(qcodes, m, letters), _bags(qcodes, m)
        qsum = qbags.sum(1)
        for rrows, n, rcodes, rbags, rsum in ours:
            if n[0] < m[-1] - whole or n[-1] > m[0] + whole:
                continue
            # Each letter that the other key lacks takes an edit; so does each by which one is longer.
            bound = np.maximum(rsum[:, None], qsum[None, :])
            bound -= rbags @ qbags.T
            near = bound <= whole
            near &= np.abs(n[:, None].astype(np.float32) - m[None, :].astype(np.float32)) <= whole
            r, q = np.nonzero(near)
            if not len(r):
                continue
            columns = _Columns(masks, m, qcodes, letters, rcodes, n)
            for a in range(0, len(r), PAIRS):
                pq, pr = q[a : a + PAIRS], r[a : a + PAIRS]
                good = columns.within(pq, pr, whole, whole == max_dist)
                if good.any():
                    yield qrows[pq[good]], rrows[pr[good]]


def _masks(codes: np.ndarray, m: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """words x (queries * (letters + 1)): bits of the places where a query has a letter; none for other letters."""
    words = max(1, -(-int(m[0]) // 64))
    out = np.zeros((words, len(codes) * (len(letters) + 1)), np.uint64)
    place = np.searchsorted(letters, codes)
    base = np.arange(len(codes)) * (len(letters) + 1)
    for k in range(int(m[0])):
        has = np.nonzero(m > k)[0]
        out[k // 64, base[has] + place[has, k]] |= _ONE << np.uint64(k % 64)
    return out


class _Columns:
    """Distances of pairs of a run of queries, all of as many words, and a run of references by falling length."""

    def __init__(self, masks: np.ndarray, m: np.ndarray, qcodes: np.ndarray, letters: np.ndarray, rcodes: np.ndarray, n: np.ndarray):
        self.masks, self.m, self.n, self.wide = masks, m, n, len(letters) + 1
        place = np.minimum(np.searchsorted(letters, rcodes), len(letters) - 1)
        #: Each reference's letters as places among the queries', a row for each step.
        self.steps = np.ascontiguousarray(np.where(letters[place] == rcodes, place, len(letters)).T)
        self.ends_in = np.searchsorted(letters, qcodes[np.arange(len(m)), np.maximum(m, 1) - 1])
        self.words = len(masks)
        self.top = (np.maximum(m, 1) - 1).astype(np.uint64) % np.uint64(64)
        self.shared = self._begin()

    def _begin(self) -> int:
        """Take the first steps once for all references that begin alike; leaves each its last step at least."""
        most, heads, of = int(self.n[-1]) - 1, np.zeros(1, np.int64), np.zeros(len(self.n), np.int64)
        shared = 0
        while shared < most:
            _, first, then = np.unique(of * self.wide + self.steps[shared], return_index=True, return_inverse=True)
            if len(first) > max(1, len(self.n) // _SHARED):
                break
            heads, of, shared = first, then, shared + 1
        q = np.tile(np.arange(len(self.m)), len(heads))
        r = np.repeat(heads, len(self.m))
        self.of = of * len(self.m)
        up, down, score = self._fresh(q)
        for j in range(shared):
            self._step(q * self.wide + self.steps[j][r], self.top[q], up, down, score)
        self.begun = (up, down, score)
        return shared

    def _fresh(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.full((self.words, len(q)), ~_ZERO), np.zeros((self.words, len(q)), np.uint64), self.m[q].astype(np.int32)

    def _step(self, at: np.ndarray, top: np.ndarray, up: np.ndarray, down: np.ndarray, score: np.ndarray) -> None:
        """One reference letter: the next column from the one before, in place."""
        plus, minus = _ONE, _ZERO  # the step in row 0 goes up
        for w in range(self.words):
            vp, vn = up[w], down[w]
            eq = self.masks[w].take(at)
            xv = eq | vn
            if w:
                eq |= minus
            xh = eq & vp
            xh += vp
            xh ^= vp
            xh |= eq
            hp = xh | vp
            np.invert(hp, out=hp)
            hp |= vn
            hn = vp & xh
            if w == self.words - 1:
                score += ((hp >> top) & _ONE).astype(np.int32)
                score -= ((hn >> top) & _ONE).astype(np.int32)
            else:
                carry = hp >> np.uint64(63), hn >> np.uint64(63)
            hp <<= _ONE
            hp |= plus
            hn <<= _ONE
            if w:
                hn |= minus
            if w < self.words - 1:
                plus, minus = carry
            np.bitwise_and(hp, xv, out=vn)
            xv |= hp
            np.invert(xv, out=xv)
            np.bitwise_or(hn, xv, out=vp)

    def within(self, q: np.ndarray, r: np.ndarray, whole: int, gate: bool) -> np.ndarray:
        """Which pairs, by falling length of the reference, are near enough."""
        start = self.of[r] + q
        up, down, score = (x.take(start, axis=-1) for x in self.begun)
        base, top, n = q * self.wide, self.top[q], self.n[r]
        good = np.zeros(len(q), bool)
        live = len(q)
        last = int(n[0])
        ends = len(n) - np.searchsorted(n[::-1], np.arange(last + 2), "left")  # how many have at least so many letters
        good[ends[1] :] = score[ends[1] :] <= whole  # references without a letter
        for j in range(self.shared, last):
            live, after = int(ends[j + 1]), int(ends[j + 2])
            done = slice(after, live)
            if after < live:
                was, was_short = score[done].copy(), self._shorter(up, down, score, top, done)
            self._step(base[:live] + self.steps[j].take(r[:live]), top[:live], up[:, :live], down[:, :live], score[:live])
            if after < live:
                d = score[done]
                ok = d <= whole
                if gate:
                    differ = self.ends_in[q[done]] != self.steps[j].take(r[done])
                    ok &= ~((d == whole) & (was + 1 == d) & (d < was_short + differ) & (d < self._shorter(up, down, score, top, done) + 1))
                good[done] = ok
        empty = self.m[q] == 0  # a column without rows has no steps to hold
        good[empty] = n[empty] <= whole
        return good

    def _shorter(self, up: np.ndarray, down: np.ndarray, score: np.ndarray, top: np.ndarray, at: slice) -> np.ndarray:
        """The distance of the query without its last letter, in the column as it is."""
        t = top[at]
        return score[at] - ((up[-1, at] >> t) & _ONE).astype(np.int32) + ((down[-1, at] >> t) & _ONE).astype(np.int32)
