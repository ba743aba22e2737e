"""difflib's ratio for many pairs of strings at once, in numpy.

``SequenceMatcher(None, a, b).ratio()`` takes the longest common block of a and b (of equal ones the
first in a, then in b), then the same left and right of it. It walks every character of the remaining
part of a for each block. Here the stretches of equal characters (runs along a diagonal) are listed
once; all blocks of all pairs that are still open are then cut in one step: each takes its longest run
and hands what is left of its runs to its two sides. Results are those of difflib to the last block,
with its rule that characters of over 1 % of a b of 200 or more characters only extend a block.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Pairs of equal characters that are held at a time, and above which difflib takes a pair of strings:
#: it holds one character's matches at a time.
PAIRS_AT_ONCE, PAIRS_OF_ONE = 500_000, 2_000_000


def ratios(a: list[str], b: list[str]) -> list[float]:
    """``SequenceMatcher(None, x, y).ratio()`` of each x, y of a and b."""
    out = [1.0] * len(a)
    todo = [r for r in range(len(a)) if a[r] != b[r]]
    if not todo:
        return out
    texts_a, texts_b = _Texts([a[r] for r in todo]), _Texts([b[r] for r in todo])
    first, count, places = _equal_characters(texts_a, texts_b)
    load = np.bincount(texts_a.row, count, minlength=len(todo))
    total = texts_a.size + texts_b.size
    start, held = 0, 0
    for r in range(len(todo) + 1):
        if r == len(todo) or held + load[r] > PAIRS_AT_ONCE:
            if start < r:
                found = _matched(texts_a, texts_b, start, r, first, count, places)
                for k in range(start, r):
                    out[todo[k]] = 2.0 * int(found[k - start]) / int(total[k])
            start, held = r, 0
        if r < len(todo):
            if load[r] > PAIRS_OF_ONE:
                out[todo[r]] = difflib.SequenceMatcher(None, a[todo[r]], b[todo[r]]).ratio()
                start = r + 1
            else:
                held += load[r]
    return out


class _Texts:
    """Strings end to end with a place between two of them: code points, the row and place of each, and
    where each row starts."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = codes.astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.size)
        self.place = np.arange(len(self.row)) + self.row

    def keys(self) -> np.ndarray:
        return self.row << 21 | self.codes[self.place]


def _equal_characters(a: _Texts, b: _Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, places): the character of a at i equals those of b at
    ``places[first[i]:first[i] + count[i]]``, ascending; frequent characters of b have none."""
    keys = b.keys()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(heads, append=len(keys))
    size = b.size[b.row[order[heads]]]
    counts[(size >= 200) & (counts > size // 100 + 1)] = 0
    if not len(heads):
        return np.zeros(len(a.row), np.int64), np.zeros(len(a.row), np.int64), b.place
    mine = a.keys()
    at = np.minimum(np.searchsorted(keys[heads], mine), len(heads) - 1)
    count = np.where(keys[heads][at] == mine, counts[at], 0)
    return heads[at], count, b.place[order]


def _matched(a: _Texts, b: _Texts, low: int, high: int, first: np.ndarray, count: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of the rows from ``low`` to ``high``."""
    mine = slice(*np.searchsorted(a.row, [low, high]))
    first, count = first[mine], count[mine]
    i = np.repeat(a.place[mine], count)
    j = places[np.arange(len(i)) + np.repeat(first - (np.cumsum(count) - count), count)]
    # runs: neighbours on a diagonal follow each other
    width = len(a.codes) + 2
    at = (j - i + width) * width + i
    del i, j
    at.sort()
    head = np.flatnonzero(np.diff(at, prepend=-1) != 1)
    size, at = np.diff(head, append=len(at)), at[head]
    i, j = at % width, at // width - width
    j += i
    row = np.searchsorted(a.start[low:high], i, "right") - 1
    order = np.argsort(row, kind="stable")
    i, j, size, block = i[order], j[order], size[order], row[order]
    # the open blocks: the part of a and of b that each covers, and its row
    rows = np.arange(high - low)
    a0, b0 = a.start[low:high], b.start[low:high]
    a1, b1 = a0 + a.size[low:high], b0 + b.size[low:high]
    matched = np.zeros(high - low, np.int64)
    while len(rows):
        heads = np.flatnonzero(np.diff(block, prepend=-1))
        some = block[heads]
        # without a run, difflib still extends from the block's start
        bare = np.ones(len(rows), bool)
        bare[some] = False
        same = _same_ahead(a.codes, b.codes, a0[bare], b0[bare], np.minimum(a1[bare] - a0[bare], b1[bare] - b0[bare]))
        np.add.at(matched, rows[bare], same)
        if not len(heads):
            break
        rows, a0, a1, b0, b1 = rows[some], a0[some], a1[some], b0[some], b1[some]
        of = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(block)))
        # the longest run of each block, of equal ones the first in a, then in b
        most = np.maximum.reduceat(size, heads)
        longest = np.flatnonzero(size == most[of])
        span = len(b.codes) + 1
        best = np.minimum.reduceat(i[longest] * span + j[longest], np.flatnonzero(np.diff(of[longest], prepend=-1)))
        x, y = best // span, best % span
        back = _same_ahead(a.codes, b.codes, x - 1, y - 1, np.minimum(x - a0, y - b0), -1)
        ahead = _same_ahead(a.codes, b.codes, x + most, y + most, np.minimum(a1 - x, b1 - y) - most)
        x, y, most = x - back, y - back, back + most + ahead
        np.add.at(matched, rows, most)
        # the parts of each run before and behind the block's match, clipped to the two sides
        keep = np.minimum(size, np.minimum(x[of] - i, y[of] - j))
        skip = np.maximum(0, np.maximum((x + most)[of] - i, (y + most)[of] - j))
        left, right = np.flatnonzero(keep > 0), np.flatnonzero(skip < size)
        block = np.concatenate([2 * of[left], 2 * of[right] + 1])
        i, j, size = (
            np.concatenate([i[left], (i + skip)[right]]), np.concatenate([j[left], (j + skip)[right]]), np.concatenate([keep[left], (size - skip)[right]])
        )
        order = np.argsort(block, kind="stable")
        i, j, size, block = i[order], j[order], size[order], block[order]
        two = lambda p, q: np.stack([p, q], 1).ravel()
        rows, a0, a1, b0, b1 = two(rows, rows), two(a0, x + most), two(x, a1), two(b0, y + most), two(y, b1)
        # sides with nothing in a or b are closed; they have no runs
        open_ = (a0 < a1) & (b0 < b1)
        block = (np.cumsum(open_) - 1)[block]
        rows, a0, a1, b0, b1 = rows[open_], a0[open_], a1[open_], b0[open_], b1[open_]
    return matched


def _same_ahead(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int = 1) -> np.ndarray:
    """How many characters from a[i] and b[j] on (backwards if ``way`` is -1) are equal, up to ``most``."""
    same = np.zeros(len(i), np.int64)
    left, step = np.flatnonzero(most > 0), 4
    while len(left):
        at = same[left, None] + np.arange(step)
        inside = at < most[left, None]
        at = np.where(inside, at, 0) * way
        equal = inside & (a[i[left, None] + at] == b[j[left, None] + at])
        here = np.where(equal.all(axis=1), step, equal.argmin(axis=1))
        same[left] += here
        left = left[here == step]
        step = min(2 * step, max(4, 1_000_000 // max(1, len(left))))
    return same
