"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is larger than the empty suffix."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(n, dtype=bool)
    if len(differs):
        # equal neighbours take the type of the next place where the text changes
        following = np.searchsorted(differs, np.arange(n - 1))
        known = following < len(differs)
        at = differs[np.minimum(following, len(differs) - 1)]
        smaller[:-1] = known & (text[at] < text[at + 1])
    return smaller


def _induce_by_step(text: list[int], small: list[bool], sizes: np.ndarray, leftmost: list[int]) -> list[int]:
    """All suffixes in order, given an order of the leftmost-smaller ones (or of their substrings), one by one."""
    n = len(text)
    ends = np.cumsum(sizes).tolist()
    heads = [0, *ends[:-1]]
    order = [-1] * n
    tails = ends[:]
    for i in reversed(leftmost):
        c = text[i]
        tails[c] -= 1
        order[tails[c]] = i
    # larger suffixes from the left, the one before the empty suffix first
    c = text[n - 1]
    order[heads[c]] = n - 1
    heads[c] += 1
    for i in order:
        if i > 0:
            i -= 1
            if not small[i]:
                c = text[i]
                order[heads[c]] = i
                heads[c] += 1
    # smaller suffixes from the right, in place of the leftmost ones
    tails = ends
    for at in range(n - 1, -1, -1):
        i = order[at]
        if i > 0:
            i -= 1
            if small[i]:
                c = text[i]
                tails[c] -= 1
                order[tails[c]] = i
    return order


#: Up to so many symbols, induction goes bucket by bucket in numpy; beyond, suffix by suffix.
FEW_SYMBOLS = 512


def _append(order: np.ndarray, heads: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put suffixes, in this order, at the open ends of their buckets."""
    by = np.argsort(symbols, kind="stable")
    held = symbols[by]
    count = np.bincount(held, minlength=len(heads))
    first = np.cumsum(count) - count
    order[heads[held] + step * (np.arange(len(held)) - first[held])] = suffixes[by]
    heads += step * count


def _induce_by_bucket(text: np.ndarray, small: np.ndarray, sizes: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The same, a bucket of equal first symbols at a time.

    What a bucket induces into itself (runs of its symbol) follows in further waves.
    """
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order = np.full(n, -1, dtype=np.int64)
    tails = ends - 1
    _append(order, tails, text[leftmost][::-1], leftmost[::-1], -1)
    lowest = tails + 1  # the leftmost-smaller ones of each bucket
    heads = starts.copy()
    order[heads[text[n - 1]]] = n - 1
    heads[text[n - 1]] += 1
    present = np.flatnonzero(sizes).tolist()

    def wave(suffixes: np.ndarray, larger: bool, ends: np.ndarray, step: int) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[small[before] != larger]
        if len(before):
            _append(order, ends, text[before], before, step)

    for c in present:
        done = int(starts[c])
        while done < (stop := int(heads[c])):
            wave(order[done:stop], True, heads, 1)
            done = stop
        wave(order[lowest[c] : ends[c]], True, heads, 1)
    tails = ends - 1
    for c in reversed(present):
        done = int(ends[c]) - 1
        while done > (stop := int(tails[c])):
            wave(order[stop + 1 : done + 1][::-1], False, tails, -1)
            done = stop
        wave(order[starts[c] : heads[c]][::-1], False, tails, -1)
    return order


def _induce(text: np.ndarray, small: np.ndarray, sizes: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    if len(sizes) <= FEW_SYMBOLS and len(text) > 4096:
        return _induce_by_bucket(text, small, sizes, leftmost)
    return np.array(_induce_by_step(text.tolist(), small.tolist(), sizes, leftmost.tolist()))


def _names(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Names of substrings text[start:stop] in order, equal ones with one name; the last of the text is its own."""
    size = stop - start
    same = (size[1:] == size[:-1]) & (stop[1:] < len(text)) & (stop[:-1] < len(text))
    pair = np.flatnonzero(same)
    if len(pair):
        length = size[pair]
        owner = np.repeat(np.arange(len(pair)), length)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        unlike = text[start[pair][owner] + step] != text[start[pair + 1][owner] + step]
        same[pair] = np.bincount(owner[unlike], minlength=len(pair)) == 0
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text (integers from 0) in order; linear in its length."""
    text = np.asarray(text, dtype=np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(text)
    if len(leftmost) < 2:
        return _induce(text, small, sizes, leftmost)
    # Sort the leftmost-smaller substrings, name them, and sort the string of names if names repeat.
    place = np.full(n, -1, dtype=np.int64)
    place[leftmost] = np.arange(len(leftmost))
    order = _induce(text, small, sizes, leftmost)
    order = order[place[order] >= 0]
    ends = np.append(leftmost[1:], n - 1) + 1
    names = _names(text, order, ends[place[order]])
    reduced = np.empty(len(leftmost), dtype=np.int64)
    reduced[place[order]] = names
    ranked = order if names[-1] + 1 == len(leftmost) else leftmost[suffix_array(reduced)]
    return _induce(text, small, sizes, ranked)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, how much it shares with the one before it, at most ``most``.

    Computed in text order (permuted): the value falls by at most one from a suffix to the next.
    """
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    symbols = np.asarray(text).tolist()
    out, shared = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            shared = 0
            continue
        stop = min(most, n - max(i, j))
        while shared < stop and symbols[i + shared] == symbols[j + shared]:
            shared += 1
        out[i] = shared
        if shared:
            shared -= 1
    return np.array(out, dtype=np.int64)[order]
