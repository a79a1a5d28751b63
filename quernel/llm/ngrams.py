"""Hashed n-gram counts of many texts at once."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint32(0x9E3779B1)


def byte_ngrams(text: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashes (0 to 2**bits - 1) of all byte n-grams of the given sizes, in no order."""
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - bits)
    out, code = [], np.zeros(len(data), dtype=np.uint32)
    for size in range(1, max(sizes) + 1):
        if size > len(data):
            break
        code = code[: len(data) - size + 1] * np.uint32(257) + data[size - 1 :] + np.uint32(1)
        if size in sizes:
            out.append((code * MULTIPLIER) >> shift)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)

# What a byte is: 0 white space, 1 punctuation, 2 digit, 3 lower-case letter, 4 capital, 5 part of a letter beyond ASCII.
_KIND = np.ones(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("A") : ord("Z") + 1] = 4
_KIND[128:] = 5
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS = np.array([pow(0x01000193, i, 1 << 32) for i in range(64)], dtype=np.uint32)


def mixed(*codes: np.ndarray) -> np.ndarray:
    """One well-spread 32-bit code of several."""
    out = np.zeros(len(codes[0]), dtype=np.uint32)
    for code in codes:
        out = (out ^ code.astype(np.uint32)) * MULTIPLIER
        out ^= out >> np.uint32(15)
    return out * np.uint32(0x85EBCA6B)


def word_ngrams(text: bytes, bits: int) -> np.ndarray:
    """Hashes (0 to 2**bits - 1) of word n-grams: words and runs of punctuation, alone and in pairs, as
    lower-cased text and by shape (case, digits, length, whether the word repeats one just before)."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint32)
    kind = _KIND[data]
    group = np.minimum(kind, 2)  # white space, punctuation, word
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(data)))
    lower = _LOWER[data]
    place = np.arange(len(data)) - np.repeat(start, size)
    token = np.add.reduceat((lower + np.uint32(1)) * _POWERS[place & 63] + (place >> 6).astype(np.uint32), start, dtype=np.uint32)
    capitals = np.add.reduceat((kind == 4).astype(np.int32), start)
    digits = np.add.reduceat((kind == 2).astype(np.int32), start)
    real = group[start] > 0
    is_word = (group[start] == 2)[real]
    token, size, capitals, digits, first = token[real], size[real], capitals[real], digits[real], kind[start][real]
    if not len(token):
        return np.empty(0, dtype=np.uint32)
    shape = np.where(capitals == 0, 1, np.where((capitals == 1) & (first == 4), 2, 3)) + 4 * (digits > 0) + 8 * np.minimum(size // 4, 5)
    words = np.flatnonzero(is_word)
    again = np.zeros(len(token), dtype=np.int64)
    for back in (1, 2, 3):
        again[words[back:][token[words[back:]] == token[words[:-back]]]] = 1
    shape = np.where(is_word, shape + 64 * again, token.astype(np.int64) | (1 << 31))
    out = [mixed(token, np.full(len(token), 1)), mixed(shape, np.full(len(shape), 2))]
    out.append(mixed(token[:-1], token[1:], np.full(len(token) - 1, 3)))
    out.append(mixed(shape[:-1], shape[1:], np.full(len(shape) - 1, 4)))
    return np.concatenate(out) >> np.uint32(32 - bits)
