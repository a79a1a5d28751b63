"""Exact removal of repeated passages by suffix arrays over shards.

A string of WINDOW bytes that also starts earlier is removed.  Occurrences are ordered by document id, start and
a tag of the text.  To let any two equal windows meet without one array over the whole corpus:

1. Every window is named by its minimiser, the least of its K-grams under a random order (leftmost of equals).
   Consecutive windows with one minimiser are a segment.  Equal windows have equal minimisers at equal
   distances, so they lie in segments of one minimiser and nowhere else.
2. Segments are shuffled by minimiser as numbers only (hashes and places; no text).  One alone is free of
   repeats.  Of segments with equal content all but the first are repeats in full.  Segments
   whose minimiser has several contents remain to be compared.
3. Those are cut from the texts and split by distance from the minimiser; the windows of such a piece share a
   core, which joins the minimiser in the piece's key.  Pieces alone under their key are free of repeats, of equal
   pieces all but the first are repeats.  The rest are gathered into shards, a key's pieces in one.  A shard's suffix
   array (induced sorting) with its permuted common prefixes gives runs of suffixes that share WINDOW bytes; all but
   a run's first occurrence are repeats.  A key with more text than a shard takes is compared window by window instead,
   by the hash of the whole window; and a minimiser of more than HEAVY contents (the border of a very common
   passage) goes that way over the whole cluster, so no task holds a group that grows with the corpus.
4. Repeated ranges meet their texts, which are cut.

Equal segment contents and equal windows are told by 128 bits of hashes (a segment's by two of 64 bits, its minimiser's
and its content's), not byte by byte; only what reaches a shard is compared by its bytes.  The README says how much
each step decides.

Defined cases: a null or empty text has no bytes; null ids come last in order; rows that repeat id and text are
one document and get the same result each; rows that share an id only are told apart by a tag of the text, 64 bits
of its hash; an empty table gives an empty result; of other columns only those that are carried are read, and those that the
result adds replace columns of the same name.  A text is scanned in pieces, but is one cell of a row when it is cut, so
the longest text must fit a worker's memory several times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import lean, written
from quernel.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 100
K = 24
#: Distances from a minimiser that are compared together.
SLOT = 26
SHARD_BYTES = 1 << 19
#: Contents under one minimiser beyond which its windows are compared as a table of their own.
HEAVY = 50_000
#: Texts are scanned in pieces of about this many bytes; short ones together.
PIECE = 1 << 19
#: Equal contents of so many pieces in a row are passed on once.
PIECES = 16
SEED = 17
_NULL_ID = (1 << 63) - 1
_SIZE_BITS = 7

_RANDOM = np.random.default_rng(SEED)
_SYMBOL = _RANDOM.integers(0, 1 << 64, size=256, dtype=np.uint64)
_OTHER = _RANDOM.integers(0, 1 << 64, size=256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _RANDOM.integers(0, 1 << 63, size=8, dtype=np.uint64)]
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 2 * PIECE)
        step = np.full(size, np.uint64(_BASE))
        step[0] = 1
        back = np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)))
        back[0] = 1
        _POWERS[0] = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _POWERS[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[6]
    return x ^ (x >> np.uint64(29))


def _kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram, by doubling."""
    parts, size, out, done = _SYMBOL[data], 1, None, 0
    step = 0
    while size <= k:
        if k & size:
            out = parts if out is None else _mix(out[: len(data) - done - size + 1] * _ODD[0] + parts[done : done + len(data) - done - size + 1])
            done += size
        if 2 * size <= k:
            parts = _mix(parts[:-size] * _ODD[1 + step % 5] + parts[size:])
        size *= 2
        step += 1
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, content hash, start, windows) of each segment of the texts joined in data, text i ending at ends[i]."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none
    hashes = _kgram_hashes(data, k)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(24)
    # the leftmost of the least: a hash's upper bits, then the place
    least = _sliding_least((hashes & ~np.uint64((1 << 24) - 1)) | place, window - k + 1)
    at = (least & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    starts = np.arange(len(at))
    limit = ends[np.searchsorted(ends, starts, side="right")]
    inside = starts + window <= limit
    first = np.concatenate([[True], (at[1:] != at[:-1]) | (limit[1:] != limit[:-1])]) & inside
    begin = np.flatnonzero(first)
    if not len(begin):
        return none, none, none, none
    # windows of a segment: up to the next segment or the end of what fits the text
    count = np.minimum(np.append(begin[1:], len(at)), limit[begin] - window + 1) - begin
    power, inverse = _powers(len(data))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_OTHER[data] * power[: len(data)], dtype=np.uint64)])
    content = (prefix[begin + count + window - 1] - prefix[begin]) * inverse[begin]
    content = _mix(content + count.astype(np.uint64) * _ODD[7])
    return hashes[at[begin]].view(np.int64), content.view(np.int64), begin, count


def tag_of(data: bytes) -> int:
    """64 bits of a text's hash, which tell texts of one id apart."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start << _SIZE_BITS) | count


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> _SIZE_BITS, packed & ((1 << _SIZE_BITS) - 1)


def merged_ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each (doc, tag) without overlap or touch."""
    if not len(doc):
        return doc, tag, start, end
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    # the running end within a document, by lifting each document above all ends before it
    lift = (np.cumsum(new_doc) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    fresh = new_doc.copy()
    fresh[1:] |= start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tag[first], start[first], (reach - lift)[last]


def _scan(window: int, k: int):
    """doc, text -> rows (route, content, doc, packed, tag): segments by minimiser, and with a negative packed
    value the ranges that repeat within a piece (content: the end)."""

    def piece_rows(docs: list[tuple[int, int, int, int]], data: bytes) -> np.ndarray | None:
        """(minimiser, content, doc, packed, tag) of the segments of a piece."""
        joined = np.frombuffer(data, dtype=np.uint8)
        ends = np.cumsum([size for _, _, _, size in docs])
        mini, content, begin, count = segments(joined, ends, window, k)
        if not len(mini):
            return None
        owner = np.searchsorted(ends, begin, side="right")
        doc = np.array([d for d, _, _, _ in docs], dtype=np.int64)[owner]
        tag = np.array([t for _, t, _, _ in docs], dtype=np.int64)[owner]
        start = begin - (ends - np.array([size for _, _, _, size in docs]))[owner] + np.array([at for _, _, at, _ in docs])[owner]
        return np.column_stack([mini, content, doc, _pack(start, count), tag])

    def collapsed(rows: np.ndarray) -> pa.RecordBatch:
        """Of equal contents only the first goes on, the others are ranges; the same row again repeats nothing."""
        rows = rows[np.lexsort(rows.T[::-1])]
        again = np.concatenate([[False], (rows[1:, :2] == rows[:-1, :2]).all(axis=1)])
        lead = rows[np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))]
        rest = rows[again & (rows[:, 2:] != lead[:, 2:]).any(axis=1)]
        start, count = _unpack(rest[:, 3])
        doc, tag, start, end = merged_ranges(rest[:, 2], rest[:, 4], start, start + count + window - 1)
        gone = np.column_stack([doc * np.int64(0x2545F4914F6CDD1D) ^ start, end, doc, -1 - _pack(start, np.zeros_like(start)), tag])
        out = np.vstack([rows[~again], gone])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], names=["route", "content", "doc", "packed", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int]] = []
        parts: list[bytes] = []
        size = 0
        ready: list[np.ndarray] = []  # of the last few pieces: what they share is passed on once

        def scanned() -> Iterator[pa.RecordBatch]:
            nonlocal held, parts, size
            if (rows := piece_rows(held, b"".join(parts))) is not None:
                ready.append(rows)
            held, parts, size = [], [], 0
            if len(ready) >= PIECES:
                yield collapsed(np.vstack(ready))
                ready.clear()

        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_pylist()
            for doc, text in zip(ids, batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                data = text.as_buffer()
                if data.size < window:
                    continue
                whole = memoryview(data)
                tag = tag_of(whole)
                # pieces of a long text overlap by all but one byte of a window
                for at in range(0, len(whole) - window + 1, PIECE):
                    part = whole[at : at + PIECE + window - 1]
                    held.append((doc, tag, at, len(part)))
                    parts.append(bytes(part))
                    size += len(part)
                    if size >= PIECE:
                        yield from scanned()
        if held:
            yield from scanned()
        if ready:
            yield collapsed(np.vstack(ready))

    return run


class _Minimisers:
    """Segments by minimiser as they stream by: those of one content are dropped, few are passed on as kind 1, and more
    than ``heavy`` as kind 2.  No more than ``heavy`` rows wait."""

    def __init__(self, heavy: int):
        self.heavy = heavy
        self.mini: int | None = None
        self.held: list[np.ndarray] = []  # rows (doc, packed, tag) of the minimiser that goes on
        self.waiting = 0
        self.out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, route: np.ndarray, rows: np.ndarray) -> None:
        """First segments of their content, sorted by minimiser."""
        if not len(route):
            return
        cuts = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        ends = np.append(cuts[1:], len(route))
        # minimisers that begin and end here need no waiting
        if route[0] != self.mini:
            self.close()
        elif len(cuts) == 1:
            return self.wait(rows)
        else:
            self.wait(rows[: ends[0]])
            self.close()
            cuts, ends = cuts[1:], ends[1:]
        size = ends - cuts
        whole = size[:-1]
        kind = np.repeat(np.where(whole > self.heavy, 2, np.where(whole > 1, 1, 0)), whole)
        middle = slice(cuts[0], cuts[-1])
        for k in (1, 2):
            mine = kind == k
            if mine.any():
                self.out.append((k, route[middle][mine], rows[middle][mine]))
        self.mini = int(route[-1])
        self.wait(rows[cuts[-1] :])

    def wait(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.waiting += len(rows)
        if self.waiting > self.heavy:
            self.pass_on(2)

    def pass_on(self, kind: int) -> None:
        rows = np.concatenate(self.held) if self.held else np.empty((0, 3), dtype=np.int64)
        if len(rows):
            self.out.append((kind, np.full(len(rows), self.mini, dtype=np.int64), rows))
        self.held = []

    def close(self) -> None:
        if self.waiting > 1:
            self.pass_on(2 if self.waiting > self.heavy else 1)
        self.mini, self.held, self.waiting = None, [], 0


def _first_of_equal(window: int, heavy: int):
    """Rows sorted by (route, content, doc, packed, tag) -> (kind, doc, packed, tag, length, route): kind 0, a range that
    repeats an earlier one in full; kinds 1 and 2, a segment to compare with others of its minimiser, 2 if those are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimisers = _Minimisers(heavy)
        last = None  # minimiser, content, doc, packed and tag of the segment that later rows may repeat

        def ready(ranges: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
            parts = []
            if ranges is not None and len(ranges[0]):
                doc, packed, tag, length = ranges
                parts.append((np.zeros(len(doc), dtype=np.int32), doc, packed, tag, length, np.zeros(len(doc), dtype=np.int64)))
            parts += [(np.full(len(r), k, dtype=np.int32), rows[:, 0], rows[:, 1], rows[:, 2], np.zeros(len(r), dtype=np.int64), r) for k, r, rows in minimisers.out]
            minimisers.out.clear()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(6)], names=["kind", "doc", "packed", "tag", "length", "route"])

        for batch in batches:
            route, content, doc, packed, tag = (batch.column(i).to_numpy() for i in range(5))
            gone = packed < 0
            start, _ = _unpack(-1 - packed[gone])
            ranges = [(doc[gone], _pack(start, np.zeros_like(start)), tag[gone], content[gone] - start)]
            rows = np.column_stack([route, content, doc, packed, tag])[~gone]
            if len(rows):
                if last is not None:
                    rows = np.vstack([last, rows])
                first = np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])
                lead = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
                # the same row again repeats nothing
                rest = rows[~first & np.any(rows[:, 2:] != lead[:, 2:], axis=1)]
                start, count = _unpack(rest[:, 3])
                ranges.append((rest[:, 2], _pack(start, np.zeros_like(start)), rest[:, 4], count + window - 1))
                new = first.copy()
                new[0] = last is None
                minimisers.add(rows[new, 0], rows[new, 2:])
                last = lead[-1]
            yield from ready(tuple(np.concatenate([r[i] for r in ranges]) for i in range(4)))
        minimisers.close()
        yield from ready(None)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, last, as a deflated payload and a tag, so that it crosses the shuffle small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            tags, packed = [], []
            for text in part.column(part.num_columns - 1):
                data = memoryview(text.as_buffer()) if text.is_valid else b""
                tags.append(tag_of(data))
                packed.append(_deflated(data))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(tags, pa.int64()), pa.array(packed, pa.binary())], names=[*part.schema.names[:-1], "__tag", "__z"])


def _deflated(data: bytes | memoryview) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _inflated(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def split_segments(parts: list[bytes], route: np.ndarray, packed: np.ndarray, window: int, k: int, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(key, content hash, row of parts, packed, bytes): each segment's windows by their distance from the minimiser, ``slot``
    distances a piece.  Windows of a slot share a core of window - slot + 1 bytes, whose hash is in the key, so pieces that hold
    an equal window have equal keys."""
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
    firsts = np.cumsum(sizes) - sizes
    hashes = _kgram_hashes(joined, k).view(np.int64)
    # the minimiser is the first of its k-grams in the segment
    hits = np.flatnonzero(hashes == np.repeat(route, sizes)[: len(hashes)])
    owner = np.searchsorted(firsts, hits, side="right") - 1
    _, first_hit = np.unique(owner, return_index=True)
    mark = hits[first_hit] - firsts
    start, count = _unpack(packed)
    power, inverse = _powers(len(joined))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_OTHER[joined] * power[: len(joined)], dtype=np.uint64)])
    content = lambda a, b: _mix((prefix[b] - prefix[a]) * inverse[a])
    keys, contents, rows, places, cuts = [], [], [], [], []
    for number in range(-(-(window - k + 1) // slot)):
        # windows at distance number * slot to (number + 1) * slot - 1 before the minimiser
        lo = np.maximum(mark - (number + 1) * slot + 1, 0)
        hi = np.minimum(mark - number * slot, count - 1)
        at = np.flatnonzero(hi >= lo)
        lo, hi = lo[at], hi[at]
        core = firsts[at] + mark[at] - number * slot
        key = _mix(content(core, core + window - slot + 1) * _ODD[2] + (route[at].view(np.uint64) + np.uint64(number)) * _ODD[3])
        keys.append(key.view(np.int64))
        contents.append(_mix(content(firsts[at] + lo, firsts[at] + hi + window) + (hi - lo).astype(np.uint64) * _ODD[7]).view(np.int64))
        rows.append(at)
        places.append(_pack(start[at] + lo, hi - lo + 1))
        cuts += [parts[i][x : y + window] for i, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    return np.concatenate(keys), np.concatenate(contents), np.concatenate(rows), np.concatenate(places), cuts


def _cut(window: int, k: int, slot: int):
    """doc, tag, z, packed (list), route (list) -> (key, content, doc, packed, tag, bytes) of each segment's pieces."""

    def pieces(parts: list[bytes], docs: list[int], tags: list[int], routes: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
        key, content, row, packed, cuts = split_segments(parts, np.concatenate(routes), np.concatenate(places), window, k, slot)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(np.array(docs, dtype=np.int64)[row]), pa.array(packed), pa.array(np.array(tags, dtype=np.int64)[row]), pa.array(cuts, pa.binary())], names=["route", "content", "doc", "packed", "tag", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, tags, routes, places, size = [], [], [], [], [], 0
        for batch in batches:
            for doc, tag, z, packed, route in zip(*(batch.column(i) for i in range(5)), strict=True):
                data = _inflated(z.as_py())
                place = packed.values.to_numpy()
                start, count = _unpack(place)
                own = [data[a:b] for a, b in zip(start.tolist(), (start + count + window - 1).tolist(), strict=True)]
                parts += own
                docs += [doc.as_py()] * len(own)
                tags += [tag.as_py()] * len(own)
                routes.append(route.values.to_numpy())
                places.append(place)
                size += sum(map(len, own))
                if size >= PIECE:
                    yield pieces(parts, docs, tags, routes, places)
                    parts, docs, tags, routes, places, size = [], [], [], [], [], 0
        if parts:
            yield pieces(parts, docs, tags, routes, places)

    return run


def _cut_windows(window: int):
    """doc, tag, z, packed (list), route (list) -> (h, g, doc, packed, tag): every window of the segments, by 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, z, packed, _ in zip(*(batch.column(i) for i in range(5)), strict=True):
                data = _inflated(z.as_py())
                start, count = _unpack(packed.values.to_numpy())
                at = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                hashes = np.frombuffer(b"".join([hashlib.blake2b(data[i : i + window], digest_size=16).digest() for i in at.tolist()]), dtype=np.int64).reshape(-1, 2)
                place = _pack(at, np.zeros_like(at))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.full(len(at), doc.as_py(), dtype=np.int64)), pa.array(place), pa.array(np.full(len(at), tag.as_py(), dtype=np.int64))], names=["h", "g", "doc", "packed", "tag"])

    return run


def _window_ranges(window: int):
    """(doc, packed, tag) of windows -> ranges, those of a batch merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, _ = _unpack(batch.column(1).to_numpy())
            doc, tag, a, b = merged_ranges(batch.column(0).to_numpy(), batch.column(2).to_numpy(), start, start + window)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(_pack(a, np.zeros_like(a))), pa.array(tag), pa.array(b - a)], names=["doc", "packed", "tag", "length"])

    return run


def _later(groups: np.ndarray, doc: np.ndarray, start: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Which occurrences are not their group's first."""
    order = np.lexsort((tag, start, doc, groups))
    g, d, s, t = groups[order], doc[order], start[order], tag[order]
    first = np.concatenate([[True], g[1:] != g[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    out = np.zeros(len(g), dtype=bool)
    out[order] = (d != d[lead]) | (s != s[lead]) | (t != t[lead])
    return out


def repeated_windows(parts: list[bytes], doc: np.ndarray, start: np.ndarray, tag: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Ranges of the windows in parts that occur earlier, by the suffix array of all parts in a row."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[firsts + sizes] = 0  # between parts: smaller than any byte
    order = suffix_array(text)
    shared = common_prefixes(text, order, window)
    owner = np.searchsorted(firsts, order, side="right") - 1
    offset = order - firsts[owner]
    fits = offset + window <= sizes[owner]
    groups = np.cumsum(shared < window)
    owner, offset, groups = owner[fits], offset[fits], groups[fits]
    at = start[owner] + offset
    late = _later(groups, doc[owner], at, tag[owner])
    return merged_ranges(doc[owner][late], tag[owner][late], at[late], at[late] + window)


def repeated_by_window(parts: list[bytes], doc: np.ndarray, start: np.ndarray, tag: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The same, window by window: for one key with more text than a shard takes."""
    digests = [np.frombuffer(b"".join([hashlib.blake2b(p[i : i + window], digest_size=16).digest() for i in range(len(p) - window + 1)]), dtype=np.int64).reshape(-1, 2) for p in parts]
    counts = np.array([len(d) for d in digests])
    _, groups = np.unique(np.vstack(digests), axis=0, return_inverse=True)
    owner = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = start[owner] + offset
    late = _later(groups.ravel(), doc[owner], at, tag[owner])
    return merged_ranges(doc[owner][late], tag[owner][late], at[late], at[late] + window)


def _shards(window: int, shard_bytes: int):
    """Rows sorted by (key, content, doc, packed, tag), with bytes -> ranges that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, int, bytes]] = []  # doc, packed, tag, bytes of whole keys
        group: list[tuple[int, int, int, bytes]] = []  # of the key at hand, one for each content
        size = group_size = 0
        key = content = None
        ready: list[tuple[np.ndarray, ...]] = []

        def compare(rows: list[tuple[int, int, int, bytes]], find) -> None:
            doc, packed, tag = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
            ready.append(find([r[3] for r in rows], doc, _unpack(packed)[0], tag, window))

        def close() -> None:
            """The key is whole: compared by itself if it is too large, else put into the shard; one content is free of repeats."""
            nonlocal shard, group, size, group_size
            if len(group) > 1:
                if group_size > shard_bytes:
                    compare(group, repeated_by_window)
                else:
                    if size + group_size > shard_bytes:
                        compare(shard, repeated_windows)
                        shard, size = [], 0
                    shard += group
                    size += group_size
            group, group_size = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            for doc, tag, a, b in ready:
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(_pack(a, np.zeros_like(a))), pa.array(tag), pa.array(b - a)], names=["doc", "packed", "tag", "length"])
            ready.clear()

        for batch in batches:
            route, con, ids, pack, tags = (batch.column(i).to_numpy() for i in range(5))
            again = np.concatenate([[route[0] == key and con[0] == content], (route[1:] == route[:-1]) & (con[1:] == con[:-1])]) if len(route) else np.empty(0, dtype=bool)
            # Equal contents: all but the first repeat in full; a row that is there twice repeats nothing.
            if again.any():
                lead = np.maximum.accumulate(np.where(again, -1, np.arange(len(again))))
                known = lead >= 0
                last = group[-1] if group else (0, 0, 0, b"")
                twin = np.where(known, (ids[lead] == ids) & (pack[lead] == pack) & (tags[lead] == tags), (ids == last[0]) & (pack == last[1]) & (tags == last[2]))
                rest = again & ~twin
                start, count = _unpack(pack[rest])
                ready.append(merged_ranges(ids[rest], tags[rest], start, start + count + window - 1))
            data = batch.column(5)
            for i in np.flatnonzero(~again).tolist():
                if route[i] != key:
                    close()
                    key = route[i]
                content = con[i]
                piece = data[i].as_py()
                group.append((int(ids[i]), int(pack[i]), int(tags[i]), piece))
                group_size += len(piece) + 1
            yield from found()
        close()
        if shard:
            compare(shard, repeated_windows)
        yield from found()

    return run


RANGES = "doc long, packed long, tag long, length long"


def repeated_ranges(docs: DataFrame, window: int = WINDOW, k: int = K, slot: int = SLOT, shard_bytes: int = SHARD_BYTES, heavy: int = HEAVY) -> DataFrame:
    """(doc, packed, tag, length) of ranges that repeat, as written tables; they may overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    scanned = rows.mapInArrow(lean(_scan(window, k)), "route long, content long, doc long, packed long, tag long")
    sorted_rows = scanned.repartition("route").sortWithinPartitions("route", "content", "doc", "packed", "tag")
    found = written(spark, sorted_rows.mapInArrow(lean(_first_of_equal(window, heavy)), "kind int, doc long, packed long, tag long, length long, route long"), "segments")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), "text").mapInArrow(lean(_texts), "doc long, `__tag` long, `__z` binary").toDF("doc", "tag", "z")

    def placed(kind: int) -> DataFrame:
        """Texts with the segments of a kind that lie in them."""
        wanted = found.where(F.col("kind") == kind).groupBy("doc", "tag").agg(F.collect_list(F.struct("packed", "route")).alias("s"))
        return texts.join(wanted, ["doc", "tag"]).select("doc", "tag", "z", F.col("s.packed").alias("packed"), F.col("s.route").alias("route"))

    cut = placed(1).mapInArrow(lean(_cut(window, k, slot)), "route long, content long, doc long, packed long, tag long, bytes binary")
    compared = cut.repartition("route").sortWithinPartitions("route", "content", "doc", "packed", "tag").mapInArrow(lean(_shards(window, shard_bytes)), RANGES)
    out = found.where("kind = 0").select("doc", "packed", "tag", "length").unionByName(written(spark, compared, "ranges"))
    if found.where("kind = 2").isEmpty():
        return out
    # Windows of very common minimisers: first occurrences are aggregated before they are shuffled, and joined back
    # as a table of their own, so that a hot window is a skewed join, which Spark splits.
    windows = written(spark, placed(2).mapInArrow(lean(_cut_windows(window)), "h long, g long, doc long, packed long, tag long"), "windows")
    first = windows.groupBy(F.col("h").alias("__h"), F.col("g").alias("__g")).agg(F.min(F.struct("doc", "packed", "tag")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = written(spark, first, "firsts")
    late = windows.join(firsts, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).where(F.struct("doc", "packed", "tag") != F.col("first"))
    return out.unionByName(written(spark, late.select("doc", "packed", "tag").mapInArrow(lean(_window_ranges(window)), RANGES), "heavy"))


def _apply(names: list[str], added: list[str], want_text: bool):
    """..., z, ranges -> the digest columns, or the remaining text, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for z, packed, length in zip(*(part.column(part.num_columns - i) for i in (3, 2, 1)), strict=True):
                    data = _inflated(z.as_py())
                    kept, removed, spans = data, 0, 0
                    if packed.is_valid and len(packed):
                        start = packed.values.to_numpy() >> _SIZE_BITS
                        zero = np.zeros(len(start), dtype=np.int64)
                        _, _, a, b = merged_ranges(zero, zero, start, start + length.values.to_numpy())
                        edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
                        kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                        removed, spans = int((b - a).sum()), len(a)
                    # a cut may fall inside a character, whose other bytes go with it
                    rows.append((kept.decode("utf-8", "ignore"), removed) if want_text else (len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
                kinds = [pa.string(), pa.int64()] if want_text else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *columns], names=[*names, *added])

    return run


def remove_repeats(docs: DataFrame, carry: list[str], want_text: bool = False, named: tuple[str, ...] | None = None, **options) -> DataFrame:
    """The columns of docs in carry, and what is left of each text: kept_text and n_removed, or n_bytes, n_removed, n_spans and
    kept_sha256, or as ``named``; these replace columns of the same name."""
    added = list(named or (("kept_text", "n_removed") if want_text else ("n_bytes", "n_removed", "n_spans", "kept_sha256")))
    carry = [c for c in carry if c not in added]
    ranges = repeated_ranges(docs, **options)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    declared = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    texts = docs.select(*carry, key.alias("__doc"), "text").mapInArrow(lean(_texts), ", ".join([*declared, "`__doc` long", "`__tag` long", "`__z` binary"]))
    gathered = ranges.groupBy(F.col("doc").alias("__d"), F.col("tag").alias("__t")).agg(F.collect_list(F.struct("packed", "length")).alias("__s"))
    joined = texts.join(gathered, (F.col("__doc") == F.col("__d")) & (F.col("__tag") == F.col("__t")), "left")
    rows = joined.select(*carry, "__z", F.col("__s.packed").alias("__packed"), F.col("__s.length").alias("__length"))
    kinds = ["string", "long"] if want_text else ["long", "long", "long", "string"]
    return rows.mapInArrow(lean(_apply(carry, added, want_text)), ", ".join([*declared, *(f"`{n}` {k}" for n, k in zip(added, kinds, strict=True))]))


def op6_suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs, ["doc_id"])


#: Texts as two hexadecimal digits a byte, in blocks from which every window is named by 128 bits of MD5; runs of late windows;
#: what is left, digit by digit.
ORACLE = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), blocks AS (
  SELECT doc_id, n, j, substr(h, 2 * j + 1, 2 * (256 + 99)) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n - 99, 256)) AS j FROM docs WHERE n >= 100)
), places AS (
  SELECT doc_id, j, h, unnest(range(0, least(256, n - 99 - j))) AS i FROM blocks
), named AS (
  SELECT doc_id, j + i AS i, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM places
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM named
), late AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM windows WHERE nth > 1
), numbered AS (
  SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM late
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run
), before AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs
), parts AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head
  FROM before JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN parts USING (doc_id)
"""


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut; a document of which nothing is left goes."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = remove_repeats(docs, others, want_text=True, named=("__kept", "__removed")).where("__kept <> ''").withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
