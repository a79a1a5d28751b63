import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernel.llm.packing import WordTokenizer, differencing, op10_packing, pack, pieces, windows
from tests.llm.fixtures import DOCS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAéÉß.,!' \n\t's12ñ́Σ日-½ª<|"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert WordTokenizer.of(PATH).encode(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_ids_with_a_small_memory():
    rng = random.Random(1)
    coder = WordTokenizer(PATH, cache_words=20)
    for _ in range(200):
        text = " ".join(rng.choice(["The", "the.", "cat,", "it's", "É!", "x1", "über.", "##"]) + str(rng.randint(0, 30)) for _ in range(5)) + " the. The"
        assert coder.encode(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
    text = "<|endoftext|> a<|startoftext|>b"
    assert coder.encode(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 9))
def test_differencing_partitions(sizes, k):
    found = differencing(sizes, k)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert len(found) <= k


def test_differencing_levels():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(600)]
    sums = [sum(sizes[i] for i in w) for w in differencing(sizes, 40)]
    assert max(sums) - min(sums) <= 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=40))
def test_windows_and_pieces(sizes):
    full, items = pieces(sizes, 100, 30)
    covered = defaultdict(list)
    for doc, start, length in [*full, *items]:
        assert length == 100 or 0 < length <= 30
        covered[doc].append((start, length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == size
    for window in windows([n for _, _, n in items], 100):
        assert sum(items[i][2] for i in window) <= 100


def verify(rows, docs, capacity=4096):
    ids = defaultdict(list)
    for i, t, *_ in docs:
        ids[i].append(REFERENCE.encode(t or "", add_special_tokens=False).ids + [2])
    tokens = defaultdict(int)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        matches = [d for d in ids[r.doc_id] if len(d) == r.doc_tokens and zlib.crc32(np.array(d[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32]
        assert matches
        tokens[r.doc_id] += r.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert tokens == {i: sum(map(len, d)) for i, d in ids.items()}
    return sum(tokens.values()), by_sequence


def test_round_trip_and_padding(spark):
    docs = documents(150)
    df = spark.createDataFrame(docs, DOCS).coalesce(2)
    rows = op10_packing(df).collect()
    total, sequences = verify(rows, docs)
    padded = sum(4096 if (n := sum(x for _, x in p)) & (n - 1) else n for p in sequences.values())
    assert padded <= 1.06 * total + 2 * 4096
    assert sorted(map(str, op10_packing(df).collect())) == sorted(map(str, rows))


def test_with_ids_and_small_windows(spark):
    docs = documents(40)
    df = spark.createDataFrame(docs, DOCS)
    rows = pack(df, PATH, capacity=64, cut=16, group_items=50, with_ids=True).collect()
    total, sequences = verify(rows, docs, 64)
    assert total / (64 * len(sequences)) > 0.9
    assert all(len(r.ids) == r.length for r in rows)


def test_empty(spark):
    assert op10_packing(spark.createDataFrame([], DOCS)).collect() == []
    only = op10_packing(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS)).first()
    assert (only.doc_id, only.start, only.length, only.doc_tokens, only.offset) == (1, 0, 1, 1, 0)
    assert only.ids_crc32 == zlib.crc32((2).to_bytes(4, "little"))


def test_padding_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for parts in (1, 211):
        rows = op10_packing(docs.repartition(parts)).collect()
        used = sum(r.length for r in rows)
        assert 4096 * len({r.sequence_id for r in rows}) <= 1.02 * used, parts
    verify(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_left_over_pieces_of_many_tasks(spark):
    docs = documents(80)
    df = spark.createDataFrame(docs, DOCS).repartition(9)
    rows = pack(df, PATH, capacity=64, cut=16, group_items=20, with_ids=True).collect()
    total, sequences = verify(rows, docs, 64)
    assert total / (64 * len(sequences)) > 0.9 and all(len(r.ids) == r.length for r in rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", 9)], "doc_id long, text string, start long, sequence_id string, ids int")
    assert [r.length for r in op10_packing(df).collect()] == [len(REFERENCE.encode("a b", add_special_tokens=False).ids) + 1]
