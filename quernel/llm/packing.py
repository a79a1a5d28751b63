"""Packing token sequences into windows by multiway differencing.

A document is its token ids and an end id.  Documents longer than a window give full windows first; what
remains of each is an item.  Items are gathered in groups of bounded size and partitioned into k windows
by Karmarkar-Karp differencing: partial partitions start as single items, the two with the largest
imbalance are merged with opposing order (largest sum on smallest), until one is left.  If its
largest window exceeds the capacity, k rises.

Windows that come out near-equal but a few ids short of capacity are what padding costs; items longer
than ``cut`` are first cut into equal parts, because more and smaller items level better.

Tokenising dominates.  Words are encoded once and remembered (a bounded cache in each worker): the tokenizer
never joins anything across a space, so a text's ids are those of its space-separated words in a row.

What a task has left when it ends is not a whole group.  Those pieces, numbers only, are dealt evenly to as
many tasks as they make groups and packed there, so padding does not depend on how the input is split.

Sequence ids are ``partition * 2**40 + number``, those of the second step with bit 62 set.  The first step's rows are a
written table, so that what a task that runs again gives is not mixed with what it gave before.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives
an empty result; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quernel.llm.common import lean, written

CAPACITY = 4096
END_ID = 2
GROUP_ITEMS = 4096
CUT = 1024
CACHE_WORDS = 400_000
#: Fixed value: how the tokenizer cuts a word before its merges, for lower-case ASCII.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+").findall
# Byte-level vocabularies write a byte that has no visible character as the next free one from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_TOKENIZERS: dict[str, WordTokenizer] = {}


class _Words(dict):
    """Ids of words; a word that is missing is worked out and kept."""

    def __init__(self, tokenizer, four: list[bytes]):
        self.tokenizer, self.older = tokenizer, {}
        self.model, self.four = tokenizer.model.tokenize, four

    def __missing__(self, word: str) -> bytes:
        ids = dict.get(self.older, word)
        if ids is None:
            if word.isascii() or max(word) < "\u0100":
                # lower-cased as the tokenizer does; these letters have no context
                base = word.lower()
                if base != word and (base in self or base in self.older):
                    ids = self[base]
                elif base.isalpha():
                    ids = self._letters(base)
                elif base[-1:] in ".,!" and base[:-1].isalpha():
                    ids = self._letters(base[:-1]) + self._letters(base[-1])
                elif base.isascii() and base.isprintable() and "<|" not in base:
                    # letters, digits and signs never share a token
                    ids = b"".join([self._letters(part) if part != base else self._one(part) for part in _PARTS(base)])
                else:
                    ids = self._whole(word)
            else:
                ids = self._whole(word)
        self[word] = ids
        return ids

    def _letters(self, part: str) -> bytes:
        """Ids of one pre-token, kept for the words it stands in."""
        ids = self.get(part) or self.older.get(part)
        if ids is None:
            ids = self[part] = self._one(part)
        return ids

    def _one(self, part: str) -> bytes:
        """Ids of one pre-token, which the model takes in its byte alphabet."""
        four = self.four
        return b"".join([four[t.id] for t in self.model(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_ALPHABET))])

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


class WordTokenizer:
    """Ids of whole texts, word by word, with a bounded memory of words in two generations: when the younger
    is full it becomes the older, so words in use stay and rare ones go."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_words // 2
        self.four = [int(i).to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = _Words(self.tokenizer, self.four)

    @staticmethod
    def of(path: str) -> WordTokenizer:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        return _TOKENIZERS[path]

    def forget(self) -> None:
        """Give the memory back; a worker may do other work next."""
        self.known = _Words(self.tokenizer, self.four)

    def encode(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            self.known = _Words(self.tokenizer, self.four)
            self.known.older, known.older = known, {}
            known = self.known
        return np.frombuffer(b"".join(map(known.__getitem__, (text or "").replace("\n", " ").split(" "))), dtype="<u4")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in at most k windows of near-equal sums."""
    if k <= 1 or not sizes:
        return [list(range(len(sizes)))]
    # A partial partition: (imbalance, order, negated sums of its used windows in rising order, their items).
    # A window not yet used counts as sum 0.
    heap = [(-s, i, [-s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, sums, items = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        if len(other) > len(sums):
            sums, items, other, theirs = other, theirs, sums, items
        if len(other) == 1:
            # a single window: on the smallest of the other side
            size, members = other[0], theirs[0]
            if len(sums) == k:
                size += sums.pop()
                members = items.pop() + members
            at = bisect.bisect_right(sums, size)
            sums.insert(at, size)
            items.insert(at, members)
        else:
            # opposing order: the largest of one side meets the smallest of the other
            pairs = list(zip(sums, items, strict=True)) + [(0, [])] * (k - len(sums))
            for i, (size, members) in enumerate(zip(other, theirs, strict=True)):
                there, held = pairs[k - 1 - i]
                pairs[k - 1 - i] = (there + size, held + members)
            pairs = sorted((p for p in pairs if p[1]), key=itemgetter(0))
            sums, items = [p[0] for p in pairs], [p[1] for p in pairs]
        least = sums[-1] if len(sums) == k else 0
        count += 1
        heapq.heappush(heap, (sums[0] - least, count, sums, items))
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes in as few windows as differencing finds, none above capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return found
        k += 1


def pieces(sizes: list[int], capacity: int, cut: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(document, start, length): full windows, and items of at most cut ids."""
    full, items = [], []
    for doc, size in enumerate(sizes):
        whole = size // capacity
        full += [(doc, i * capacity, capacity) for i in range(whole)]
        rest = size - whole * capacity
        if rest:
            parts = -(-rest // cut)
            ends = [rest * (i + 1) // parts for i in range(parts)]
            items += [(doc, whole * capacity + a, b - a) for a, b in zip([0, *ends], ends, strict=False)]
    return full, items


#: Of the rows of pack(), what comes after the document's id.
PLACES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces_of(tokenizer: str, capacity: int, end_id: int, cut: int, group_items: int, with_ids: bool):
    """doc_id, text -> pieces; those of the last group, unless they fill windows, without a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.of(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")
        held: list[tuple] = []  # document id, ids
        id_type = None
        waiting = 0

        def emit(whole: bool) -> pa.RecordBatch:
            nonlocal sequence, waiting
            full, items = pieces([len(ids) for _, ids in held], capacity, cut)
            rows = []
            for doc, start, length in full:
                rows.append((doc, start, length, sequence, 0))
                sequence += 1
            if not whole:
                rows += [(*item, None, None) for item in items]
            for window in windows([n for _, _, n in items], capacity) if whole else ():
                at = 0
                # in document order, and pieces of one document that meet again in theirs
                for doc, start, length in sorted(items[i] for i in window):
                    rows.append((doc, start, length, sequence, at))
                    at += length
                sequence += bool(window)
            ids = [held[d][1][s : s + n] for d, s, n, _, _ in rows]
            columns = [
                pa.array([held[r[0]][0] for r in rows], id_type),
                *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)],
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array([len(held[r[0]][1]) for r in rows], pa.int64()),
                *[pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4)],
            ]
            names = ["doc_id", *(p.split()[0] for p in PLACES.split(", "))]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            held.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.schema.types[0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py())
                held.append((doc_id, np.concatenate([ids, end])))
                waiting += 1 + len(ids) // cut
                if waiting >= group_items:
                    yield emit(True)
        if held:
            yield emit(False)
        coder.forget()

    return run


def _placed(capacity: int, group_items: int):
    """Pieces without a sequence -> the same in sequences, groups of equal size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        found = pa.Table.from_batches(held)
        sequence = 1 << 62 | TaskContext.get().partitionId() << 40
        groups = -(-found.num_rows // group_items)
        for number in range(groups):
            lo, hi = (found.num_rows * i // groups for i in (number, number + 1))
            part = found.slice(lo, hi - lo).combine_chunks()
            sizes = part.column("length").to_pylist()
            places, offsets = [0] * len(sizes), [0] * len(sizes)
            for window in windows(sizes, capacity):
                at = 0
                for i in sorted(window):
                    places[i], offsets[i] = sequence, at
                    at += sizes[i]
                sequence += bool(window)
            for name, values in (("sequence_id", places), ("offset", offsets)):
                part = part.set_column(part.column_names.index(name), name, pa.array(values, pa.int64()))
            yield from part.to_batches()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, cut: int = CUT, group_items: int = GROUP_ITEMS, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document (``doc_id, text``): where it starts in its document, its length, the
    CRC-32 of its ids, its document's length, and its place in a sequence; with_ids also its ids."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PLACES}" + (", ids array<int>" if with_ids else "")
    found = docs.select("doc_id", "text").mapInArrow(lean(_pieces_of(tokenizer, capacity, end_id, cut, group_items, with_ids)), schema)
    found = written(docs.sparkSession, found, "pieces")
    left = found.where("sequence_id IS NULL")
    # dealt round robin: from four to eight groups a task
    dealt = left.repartition(max(1, left.count() // (4 * group_items)))
    return found.where("sequence_id IS NOT NULL").unionByName(dealt.mapInArrow(lean(_placed(capacity, group_items)), schema))


def op10_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids of word_bpe_49k."""
    return pack(docs, tokenizer or tokenizer_path("word_bpe_49k.json"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
