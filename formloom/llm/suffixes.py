"""Suffix arrays by induced sorting, in numpy.

Suffixes are larger (L) or smaller (S) than the suffix that follows them. Only the leftmost smaller ones (an S after an
L) are sorted by comparison: a first pass of inducing sorts the substrings between them, which gives names, and names
are sorted by recursion on pairs of names until all differ. Two sweeps over the buckets of first bytes, one for L and one
for S, then place every other suffix in linear time. A sweep handles all suffixes of a bucket that are known at once.
"""

from __future__ import annotations

import numpy as np


def types_of(codes: np.ndarray) -> np.ndarray:
    """True for S suffixes. A suffix is S if the first different code after it is larger; the end is smallest."""
    n = len(codes)
    differs = np.flatnonzero(codes[1:] != codes[:-1])
    up = np.zeros(n, bool)
    if len(differs):
        rises = codes[differs + 1] > codes[differs]
        up[: differs[-1] + 1] = np.repeat(rises, np.diff(np.concatenate([[-1], differs])))
    return up


def induced(codes: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, given the leftmost smaller ones in the order that they shall have within their buckets."""
    n = len(codes)
    counts = np.bincount(codes, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    present = np.flatnonzero(counts)
    order = seeds[np.argsort(codes[seeds], kind="stable")]
    seed_at = np.searchsorted(codes[order], np.arange(257))
    out = np.full(n, -1, np.int64)
    head = starts.copy()

    def place(found: np.ndarray, back: bool) -> None:
        """Put suffixes at the free ends of their buckets, in the order given."""
        own = codes[found]
        by = np.argsort(own, kind="stable")
        own, found = own[by], found[by]
        many = np.bincount(own, minlength=256)
        rank = np.arange(len(own)) - (np.cumsum(many) - many)[own]
        if back:
            out[tail[own] - 1 - rank] = found
            tail[:] -= many
        else:
            out[head[own] + rank] = found
            head[:] += many

    # L: the last suffix is larger than the empty one, which comes first of all.
    if not small[n - 1]:
        place(np.array([n - 1]), back=False)
    for c in present:
        at = starts[c]
        while at < head[c]:
            new, at = out[at : head[c]], head[c]
            before = new[new > 0] - 1
            place(before[~small[before]], back=False)
        new = order[seed_at[c] : seed_at[c + 1]]
        before = new[new > 0] - 1
        place(before[~small[before]], back=False)
    # S, from the largest bucket down; they fill their buckets from the back.
    tail = ends.copy()
    for c in present[::-1]:
        at = ends[c]
        while at > tail[c]:
            new, at = out[tail[c] : at][::-1], tail[c]
            before = new[new > 0] - 1
            place(before[small[before]], back=True)
        new = out[starts[c] : head[c]][::-1]
        before = new[new > 0] - 1
        place(before[small[before]], back=True)
    return out


def named_order(names: np.ndarray, size: int | None = None) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs get names of their own until all differ, or cover ``size`` names."""
    if len(names) == 0 or names.max() + 1 == len(names):
        return np.argsort(names, kind="stable")
    return _order(names, 1, size or len(names))


def _order(ranks: np.ndarray, step: int, size: int) -> np.ndarray:
    second = np.full(len(ranks), 0, np.int64)
    second[:-step] = ranks[step:] + 1
    key = ranks * (len(ranks) + 2) + second
    by = np.argsort(key, kind="stable")
    new = np.empty(len(ranks), np.int64)
    new[by] = np.cumsum(np.concatenate([[0], key[by][1:] != key[by][:-1]]))
    return by if new.max() + 1 == len(new) or 2 * step >= size else _order(new, 2 * step, size)


def suffix_array(codes: np.ndarray, size: int | None = None) -> np.ndarray:
    """Suffix array of an array of bytes; with ``size``, suffixes that share so many bytes are in any order.

    A substring between leftmost smaller suffixes has two bytes or more, so half as many names cover ``size`` bytes.
    """
    n = len(codes)
    if n < 2:
        return np.arange(n)
    small = types_of(codes)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(left):
        return induced(codes, small, left)
    first = induced(codes, small, left)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    by = first[is_left[first]]
    # Name the substrings from one leftmost smaller suffix to the next: equal ones share a name.
    follow = np.full(n, n, np.int64)
    follow[left[:-1]] = left[1:]
    length = np.minimum(follow[by] + 1, n) - by
    same = length[1:] == length[:-1]
    same &= (follow[by[1:]] < n) & (follow[by[:-1]] < n)
    live = np.flatnonzero(same)
    for k in range(int(length.max())):
        live = live[length[live + 1] > k]
        if not len(live):
            break
        differ = codes[by[live + 1] + k] != codes[by[live] + k]
        same[live[differ]] = False
        live = live[~differ]
    names = np.empty(n, np.int64)
    names[by] = np.cumsum(np.concatenate([[0], ~same]))
    return induced(codes, small, left[named_order(names[left], size and size // 2 + 2)])


def common_at_least(codes: np.ndarray, array: np.ndarray, size: int) -> np.ndarray:
    """Whether each suffix shares ``size`` bytes with the one before it in the array (the first one doesn't).

    Permuted common prefixes: each suffix is compared with its predecessor in the array, in text order, eight bytes at
    a time and no further than ``size``, which is all that is asked.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
    live = np.flatnonzero((before >= 0) & (np.arange(n) + size <= n) & (before + size <= n))
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 and size >= 8 else [])]:
        live = live[eight[live + k] == eight[before[live] + k]]
    long = np.zeros(n, bool)
    long[live] = True
    return long[array]
