"""SimHash near-dedup with Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: bit i is set if more than half of its shingles' hashes have it.  Equal fingerprints
become one before anything is paired.  The 64 bits are three segments, of 23, 23 and 18 bits (the last padded
to 23).  The binary (23, 12) Golay code is perfect: every 23-bit word is within 3 of one codeword, so a
codeword's 12 data bits name a neighbourhood.  The codewords within 4 of a word are one or six; two words that
differ in at most 2 bits always share one of them (the word halfway has a codeword within 3, which is
within 4 of both).

With at most 4 differing bits, pigeonhole over the errors e1, e2, e3 of the segments leaves three cases:

* e1 <= 2 and e2 <= 2: a codeword of segment 1 and one of segment 2 are shared;
* e1 >= 3: segments 2 and 3 have at most one error between them: segment 2 is equal and a codeword of 3 is
  shared, or segment 3 is equal and one of 2 is shared;
* e2 >= 3: likewise with segments 1 and 3.

So every linked pair meets under one of about 50 keys each.  Fingerprints are shuffled by key; within a
key those at most 4 bits apart are verified and joined into a forest, so a key gives fewer links than it
has fingerprints, however many pairs it holds.

Defined cases: a null or empty text has no shingle and fingerprint zero, which links like any other; a text
of fewer words than a shingle is one shingle; null doc_ids get a fingerprint and a null component, unless an id
shares it; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import lean, spread, written
from quernel.llm.components import components, thinned

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_PIECE = 1 << 16
_STEP = 0x9E3779B97F4A7C15
#: Rows and columns of distances that are worked out together.
_BLOCK, _CHUNK = 256, 1 << 15


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle, in pieces of bounded size; none for a text without a word."""
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces only, as wanted
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined, ends = b" ".join(found), list(itertools.accumulate([len(w) + 1 for w in found]))
    n = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    count = len(found) - n + 1
    for at in range(0, count, _PIECE):
        stop = min(count, at + _PIECE)
        yield np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at:stop], ends[at + n - 1 : stop + n - 1], strict=True)], dtype=np.uint64)


def _widened(hashes: np.ndarray, word: int) -> np.ndarray:
    """64 more bits of each hash; word 0 is the hash itself."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * _STEP % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _add_counts(total: np.ndarray, owner: list[int], parts: list[np.ndarray]) -> None:
    """Add to each owner's row how many of its hashes set each bit, the least significant first."""
    sizes = np.array([len(p) for p in parts])
    hashes = np.concatenate(parts)
    # eight counters of a byte each live in 64 bits, so no run may be longer than 255
    runs = -(-sizes // 255)
    first = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    rows = np.repeat(np.array(owner), runs)
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    for word in range(total.shape[1] // 64):
        wide = _widened(hashes, word)
        for bit in range(8):
            lanes = np.add.reduceat((wide >> np.uint64(bit)) & np.uint64(0x0101010101010101), first).astype("<u8").view(np.uint8).reshape(-1, 8)
            # lane k counts bit 8 k + bit
            total[rows[begin], 64 * word + bit : 64 * word + 64 : 8] += np.add.reduceat(lanes.astype(np.int64), begin, axis=0)


def bit_counts(texts: Iterable[str | None], words: int = SHINGLE_WORDS, width: int = 1, seed: int = HASH_SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how many of them set each of 64 * width bits) of every text."""
    texts = list(texts)
    size, total = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), 64 * width), dtype=np.int64)
    owner, parts, waiting = [], [], 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, words, seed):
            size[i] += len(hashes)
            owner.append(i)
            parts.append(hashes)
            waiting += len(hashes)
            if waiting >= 4 * _PIECE:
                _add_counts(total, owner, parts)
                owner, parts, waiting = [], [], 0
    if parts:
        _add_counts(total, owner, parts)
    return size, total


def majority(size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words: a bit is 1 if more than half of the shingles set it."""
    return np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64 bits over the text's word shingles, unsigned."""
    return int(majority(*bit_counts([text], shingle_words, 1, seed))[0, 0])


class Golay:
    """Codewords near a 23-bit word, by the syndrome of the perfect (23, 12) code."""

    #: Fixed value: the code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
    GENERATOR = 0b101011100011

    def __init__(self) -> None:
        remainder = np.zeros(23, dtype=np.int64)
        for i in range(23):
            r = 1 << i
            for top in range(22, 10, -1):
                if r >> top & 1:
                    r ^= self.GENERATOR << (top - 11)
            remainder[i] = r
        # syndromes of the lower 12 and the upper 11 bits
        self.low, self.high = (self._sums(remainder[:12]), self._sums(remainder[12:]))
        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for places in itertools.combinations(range(23), weight):
                syndrome, mask = 0, 0
                for p in places:
                    syndrome ^= int(remainder[p])
                    mask |= 1 << p
                patterns[syndrome].append(mask)
        self.size = np.array([len(p) for p in patterns], dtype=np.int64)
        self.errors = np.zeros((2048, self.size.max()), dtype=np.int64)
        for i, p in enumerate(patterns):
            self.errors[i, : len(p)] = p

    @staticmethod
    def _sums(parts: np.ndarray) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for part in parts:
            out = np.concatenate([out, out ^ part])
        return out

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, data bits) of every codeword within 4 of each word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        count = self.size[syndrome]
        rows = np.repeat(np.arange(len(words)), count)
        which = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        return rows, (words[rows] ^ self.errors[syndrome[rows], which]) >> 11


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint (uint64); keys of different kinds differ in their top bits."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    code = golay()
    near = [code.near(p) for p in parts]
    count = [np.bincount(r, minlength=len(prints)) for r, _ in near]
    rows, out = [], []

    def exact(kind: int, equal: int, fuzzy: int) -> None:
        at, data = near[fuzzy]
        rows.append(at)
        out.append(kind << 60 | parts[equal][at] << 12 | data)

    # case 1: all pairs of a codeword of segment 1 and one of segment 2
    at, data = near[0]
    times = count[1][at]
    left = np.repeat(np.arange(len(at)), times)
    first = np.cumsum(count[1]) - count[1]
    which = first[at[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    rows.append(at[left])
    out.append(data[left] << 12 | near[1][1][which])
    exact(1, 1, 2)
    exact(2, 2, 1)
    exact(3, 0, 2)
    exact(4, 2, 0)
    return np.concatenate(rows), np.concatenate(out)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = majority(*bit_counts(t.as_py() for t in batch.column(batch.num_columns - 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints[:, 0].view(np.int64))], names=[*batch.schema.names[:-1], "print"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            rows, key = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows].view(np.int64))], names=["key", "print"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words lie in the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def within(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Indices of a forest over distinct fingerprints (a row of words each) that joins all that are linked.

    Pairs that are connected already are not compared, so a large group of near copies costs little more than
    its links; a block of distances is held at a time.
    """
    n, out = len(prints), []
    group = np.arange(n)
    for at in range(0, n, _BLOCK):
        for lo in range(at, n, _CHUNK):
            rows, cols = np.arange(at, min(at + _BLOCK, n)), np.arange(lo, min(lo + _CHUNK, n))
            if (group[cols] == group[cols[0]]).all():
                rows = rows[group[rows] != group[cols[0]]]
            if not len(rows):
                continue
            near = _apart(prints[rows, None], prints[None, cols]) <= max_bits
            for row, linked in zip(rows.tolist(), near, strict=True):
                there = cols[linked]
                there = there[(there > row) & (group[there] != group[row])]
                if len(there):
                    merged, first = np.unique(group[there], return_index=True)
                    out += [(row, j) for j in there[first].tolist()]
                    group[np.isin(group, merged)] = group[row]
    return out


def linked_prints(key: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, sorted by key, of fingerprints that share a key and are linked; a forest of each key with many."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    # small keys at once, by the distance between rows
    few = np.repeat(size <= 16, size)
    for step in range(1, min(16, len(key))):
        same = np.flatnonzero((key[step:] == key[:-step]) & few[step:])
        if not len(same):
            break
        near = same[_apart(prints[same], prints[same + step]) <= max_bits]
        a.append(near)
        b.append(near + step)
    for at, n in zip(start[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        found = np.array(within(prints[at : at + n], max_bits), dtype=np.int64).reshape(-1, 2)
        a.append(at + found[:, 0])
        b.append(at + found[:, 1])
    return np.concatenate(a), np.concatenate(b)


def linker(max_bits: int, vertex: Callable[[np.ndarray], np.ndarray]):
    """Rows (key, words of the print) sorted by all columns -> links (a, b) of equal keys, as vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the key that may go on

        def links() -> Iterator[pa.RecordBatch]:
            key, prints = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            # a print may be there twice: copies that were not met before
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (prints[1:] == prints[:-1]).all(axis=1)])
            key, prints = key[~again], prints[~again]
            a, b = linked_prints(key, prints, max_bits)
            if len(a):
                pairs = np.unique(np.column_stack([vertex(prints[a]), vertex(prints[b])]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            prints = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)]).view(np.uint64)
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut or (held and held[-1][0][-1] != key[-1]):
                held.append((key[:cut], prints[:cut]))
                yield from links()
                held.clear()
            held.append((key[cut:], prints[cut:]))
        if held:
            yield from links()

    return run


def _same(prints: np.ndarray) -> np.ndarray:
    """A fingerprint of one word is its own vertex."""
    return prints[:, 0].view(np.int64)


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in carry and ``print``, the fingerprint's 64 bits as a long."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "print long"])
    return docs.select(*carry, F.col(text).alias("__text")).mapInArrow(lean(_fingerprints), schema)


def print_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """id (a fingerprint), component of the fingerprints that are linked to another."""
    if max_bits > 4:
        raise ValueError("the keys find at most 4 differing bits")
    # each row becomes about 50, so the rows are dealt out for what they become, not for what they are
    distinct = prints.select("print").distinct().repartition(spread(prints.sparkSession), "print")
    keyed = distinct.mapInArrow(lean(_key_rows), "key long, print long").repartition("key").sortWithinPartitions("key", "print")
    find = linker(max_bits, _same)
    # in one Python worker: a second one beside it would double what a task needs
    return components(keyed.mapInArrow(lean(lambda batches: thinned(find(batches))), "a long, b long"), stars=True)


def group_ids(spark: SparkSession, least: DataFrame, linked: DataFrame) -> DataFrame:
    """vertex, component_id (the least ``least`` among the vertices reachable), component, for vertices with a link.

    least: vertex, least; linked: id, component.  Both tables that meet on the component are plain ones, so that Spark
    splits the join of a component with very many vertices."""
    named = written(spark, linked.select(F.col("id").alias("__id"), F.col("component").alias("__component")).join(least, F.col("__id") == F.col("vertex")).select("vertex", "least", "__component"), "vertices")
    lowest = written(spark, named.groupBy(F.col("__component").alias("__c")).agg(F.min("least").alias("component_id")), "groups")
    return named.join(lowest, F.col("__component") == F.col("__c")).select("vertex", "component_id", F.col("__component").alias("component"))


def near_duplicates(docs: DataFrame, carry: list[str] | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """The columns in carry (doc_id among them), ``print`` and ``component_id``, the least doc_id of the group."""
    spark = docs.sparkSession
    rows = written(spark, fingerprints(docs, carry or ["doc_id"]), "prints")
    # one row for each fingerprint, its least id: what copies share never meets again
    least = written(spark, rows.groupBy(F.col("print").alias("vertex")).agg(F.min("doc_id").alias("least")), "least")
    groups = group_ids(spark, least, print_components(rows, max_bits))
    by_print = least.join(groups.withColumnRenamed("vertex", "__v"), F.col("vertex") == F.col("__v"), "left").select(F.col("vertex").alias("__print"), F.when(F.col("__v").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # A table of its own, so that the join of a print that very many copies share is one that Spark splits.
    return rows.join(written(spark, by_print, "groups"), F.col("print") == F.col("__print")).drop("__print")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
