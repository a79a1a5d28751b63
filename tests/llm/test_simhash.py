import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm.components import Forest
from quernel.llm.simhash import bit_counts, fingerprint, golay, keys, op8_simhash, within
from tests.llm.fixtures import DOCS, documents


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    forest = Forest()
    prints = [brute_print(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                forest.join(rows[i][0], rows[j][0])
    return [(r[0], f"{p:016x}", forest.root(r[0])) for r, p in zip(rows, prints)]


def test_the_code_is_perfect():
    code = golay()
    words = np.arange(1 << 23, dtype=np.int64)[::997]
    rows, data = code.near(words)
    assert set(np.bincount(rows).tolist()) == {1, 6}
    # each codeword is within 4, and the syndrome of word ^ error is 0
    assert code.size.sum() == 277 + 6 * 1771


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_prints_that_link_share_a_key(print_, flipped):
    other = print_ ^ sum(1 << b for b in flipped)
    _, a = keys(np.array([print_], dtype=np.uint64))
    _, b = keys(np.array([other], dtype=np.uint64))
    assert set(a.tolist()) & set(b.tolist())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbéÉ \t\n\x0b\x1c .", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == brute_print(text)


def test_within_is_a_forest_of_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, size=3, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for b in base]))
    pairs = within(prints[:, None], 4)
    forest, want = Forest(), Forest()
    for a, b in pairs:
        assert forest.join(a, b)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    for i, j in zip(*np.nonzero(near)):
        want.join(int(i), int(j))
    assert [forest.root(i) for i in range(len(prints))] == [want.root(i) for i in range(len(prints))]


def test_documents_against_brute_force(spark):
    rows = [r for r in documents(150) if r[0] is not None]
    got = sorted(tuple(r) for r in op8_simhash(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert got == sorted(brute_components(rows))
    assert len({c for _, _, c in got}) < len({r[0] for r in rows}) - 5


def test_very_long_texts_are_counted_whole():
    text = " ".join(f"w{i * i % 7001}" for i in range(70_000))  # more shingles than are hashed at once
    words = text.split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], dtype=np.uint64)
    size, total = bit_counts([text, None, "a b"], 4, 2)
    assert size.tolist() == [len(hashes), 0, 1]
    assert total[0, :64].tolist() == [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert not total[1].any() and set(total[2].tolist()) == {0, 1}


def test_a_large_group_of_near_prints_is_joined(spark):
    rng = np.random.default_rng(3)
    flips = rng.integers(0, 64, size=(3000, 2), dtype=np.uint64)
    prints = np.unique(np.uint64(0x1234567890ABCDEF) ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1]))
    forest = Forest()
    for a, b in within(prints[:, None], 4):
        forest.join(a, b)
    assert {forest.root(i) for i in range(len(prints))} == {0}


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 7), (2, "a b c d e f", "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string, component_id long")
    assert sorted(tuple(r) for r in op8_simhash(docs).collect()) == [(1, f"{brute_print(rows[0][1]):016x}", 1), (2, f"{brute_print(rows[0][1]):016x}", 1)]


def test_nulls_and_empty_table(spark):
    assert op8_simhash(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e", "en", "s", 1), (4, None, "en", "s", 1), (3, "", "en", "s", 1), (None, "z y x", "en", "s", 1), (9, "z  Y\tx", "en", "s", 1)]
    got = op8_simhash(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, None), (4, 3), (3, 3), (None, 9), (9, 9)], key=str)
