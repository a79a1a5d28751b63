import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import suffix_array as sa
from quernel.llm.suffix_dedup import _Minimisers, op6_suffix_dedup, remove_repeats, repeated_by_window, repeated_windows, segments, without_repeats
from tests.llm.fixtures import DOCS, brute_repeats, documents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.booleans())
def test_suffix_array_and_prefixes(symbols, by_bucket):
    text = np.array(symbols, dtype=np.int64)
    if by_bucket and len(text) > 1:
        small = sa._types(text)
        leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        ranked = np.array(sorted(leftmost.tolist(), key=lambda i: symbols[i:]), dtype=np.int64)
        order = sa._induce_by_bucket(text, small, np.bincount(text), ranked)
    else:
        order = sa.suffix_array(text)
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert order.tolist() == want
    shared = sa.common_prefixes(text, order, 9).tolist()
    for x in range(1, len(want)):
        a, b = symbols[want[x - 1] :], symbols[want[x] :]
        same = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert shared[x] == min(same, 9)


def test_suffix_array_of_a_long_text():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(0, 4, 9000), np.full(3000, 2), rng.integers(0, 300, 4000), np.tile([1, 2, 3], 800)])
    order = sa.suffix_array(text)
    symbols = text.tolist()
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([2, 30]))
def test_every_window_is_in_one_segment_and_equal_windows_share_a_minimiser(seed, texts, letters):
    rng = random.Random(seed)
    passage = bytes(rng.randrange(97, 97 + letters) for _ in range(40))
    parts = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randint(0, 50))) + rng.choice([passage, b""]) for _ in range(texts)]
    data, ends = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])
    mini, _, begin, count = segments(data, ends, window=16, k=6)
    seen, by_window = [], {}
    for m, b, c in zip(mini.tolist(), begin.tolist(), count.tolist()):
        for at in range(b, b + c):
            seen.append(at)
            by_window.setdefault(bytes(data[at : at + 16]), set()).add(m)
    wanted, at = [], 0
    for p in parts:
        wanted += range(at, at + len(p) - 15)
        at += len(p)
    assert sorted(seen) == wanted
    assert all(len(v) == 1 for v in by_window.values())


@pytest.mark.parametrize("find", [repeated_windows, repeated_by_window])
def test_shard(find):
    parts = [b"abcdefgh", b"xxcdefyy", b"cdef", b"cd"]
    doc, start, tag = np.array([5, 2, 9, 1]), np.array([0, 10, 0, 0]), np.zeros(4, dtype=np.int64)
    got = sorted(zip(*(x.tolist() for x in find(parts, doc, start, tag, 4))))
    assert got == [(5, 0, 2, 6), (9, 0, 0, 4)]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(tuple(r) for r in remove_repeats(df, ["doc_id"], **options).collect())
    want = sorted(brute_repeats(sorted((r[0], (r[1] or "").encode()) for r in rows)))
    assert got == want
    return want


def test_documents_against_brute_repeats(spark):
    rows = [r for r in documents(120) if r[0] is not None]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    want = check(spark, rows)
    assert sum(w[2] for w in want) > 4000
    check(spark, rows, shard_bytes=300)  # large keys go window by window
    check(spark, rows, k=40, slot=7)
    check(spark, rows, heavy=1)  # every minimiser by the table of windows
    check(spark, rows, heavy=3)


def test_periodic_and_shifted_texts(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(150))
    texts = ["a" * 700, "ab" * 300, passage, "x" + passage, passage[1:101], passage[:99], "é" * 60 + passage[20:140] + "é" * 60, passage + passage, "abc " * 200, "", None, "q" * 99, "q" * 100, "q" * 101]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    check(spark, rows)
    check(spark, rows, heavy=2)


def test_minimisers_stream_in_any_batches():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 8, 40)
    route = np.repeat(np.arange(40) * 3 - 50, sizes)
    rows = np.column_stack([np.arange(len(route)), np.arange(len(route)) * 2])
    want = {0: set(), 1: set(), 2: set()}
    at = 0
    for size in sizes.tolist():
        want[0 if size == 1 else 1 if size <= 4 else 2] |= set(range(at, at + size))
        at += size
    for step in (1, 2, 3, 7, 50, 1000):
        held = _Minimisers(4)
        for i in range(0, len(route), step):
            held.add(route[i : i + step], rows[i : i + step])
        held.close()
        got = {1: [], 2: []}
        for kind, r, part in held.out:
            got[kind] += part[:, 0].tolist()
            assert (route[part[:, 0]] == r).all()
        assert sorted(got[1]) == sorted(want[1]) and sorted(got[2]) == sorted(want[2])


def test_repeated_ids_nulls_and_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefghij ", k=300))
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (None, long, "en", "s", 0), (2, long[50:250], "en", "s", 0)]
    got = sorted(((r.doc_id or 99, r.n_bytes, r.n_removed, r.n_spans) for r in op6_suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()))
    # rows that repeat id and text are one document; a null id is last
    assert got == [(1, 300, 0, 0), (1, 300, 0, 0), (2, 200, 200, 1), (99, 300, 300, 1)]
    assert op6_suffix_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_repeated_rows_of_one_scanned_piece(spark):
    rng = random.Random(4)
    long, other = ("".join(rng.choices("abcdefghij ", k=300)) for _ in range(2))
    rows = [(1, long, "en", "s", 0)] * 2 + [(None, other, "en", "s", 0)] * 3 + [(2, long, "en", "s", 0)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, DOCS).repartition(parts) if parts > 1 else spark.createDataFrame(rows, DOCS).coalesce(1)
        got = sorted((r.doc_id or 99, r.n_removed) for r in op6_suffix_dedup(df).collect())
        assert got == [(1, 0), (1, 0), (2, 300), (99, 0), (99, 0), (99, 0)]


def test_many_texts_of_one_null_id_keep_their_own_bytes(spark):
    rng = random.Random(6)
    # 3,000 texts of one id: some two share any 20 bits of a checksum
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120)) for _ in range(3000)]
    a, b = next((i, j) for seen in [{}] for j, t in enumerate(texts) if (i := seen.setdefault(zlib.crc32(t.encode()) & 0xFFFFF, j)) != j)
    rows = [(None, t, "en", "s", 0) for t in texts] + [(1, texts[a], "en", "s", 0)]
    got = {r.text: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), ["doc_id", "text"]).where("doc_id is null").collect()}
    assert got == {t: 120 if t == texts[a] else 0 for t in texts}
    assert texts[b] != texts[a]


def test_texts_without_repeats(spark):
    passage = "ñandú größer " + "".join(random.Random(2).choices("abcdéfgh", k=200))
    rows = [(1, passage, "es", "s", 1), (2, "before " + passage + " after", "es", "s", 1), (3, passage, "es", "s", 1)]
    out = without_repeats(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == passage and got[2].text == "before  after" and 3 not in got
    assert got[2].n_chars == len(got[2].text)


def test_clashing_columns(spark):
    long = "".join(random.Random(3).choices("abcdefghij ", k=300))
    rows = [(1, long, "t", 5, 6), (2, long, "t", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, packed int, n_bytes int")
    assert sorted((r.doc_id, r.n_removed) for r in op6_suffix_dedup(df).collect()) == [(1, 0), (2, 300)]
    out = without_repeats(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [rows[0]]


def test_texts_of_several_pieces(spark, monkeypatch):
    """Repeats that lie across the places where a long text is cut to be scanned."""
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefghijklmnop ", k=1_300_000))
    rows = [(1, long, "en", "s", 0), (2, long[524_200:524_400] + "".join(rng.choices("xyz", k=50)) + long[1_048_500:1_048_700], "en", "s", 0)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in op6_suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (0, 0), 2: (400, 2)}
