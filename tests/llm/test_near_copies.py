import random

import numpy as np
import pytest

from quernel.llm.components import Forest
from quernel.llm.near_copies import MAX_BITS, codewords, kept_documents, margins, soft_keys
from quernel.llm.simhash import bit_counts, majority
from tests.llm.fixtures import DOCS, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def wide(texts):
    return majority(*bit_counts(texts, 5, 4))


def brute_kept(rows):
    """(ids of a document a group if all links are found, groups by index) by comparing every pair."""
    prints, forest = wide([r[1] for r in rows]), Forest()
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]).sum(axis=1) <= MAX_BITS).tolist():
            forest.join(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(forest.root(i), []).append(i)
    return groups


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def edited(rng, words, share):
    return " ".join(rng.choice(["changed", "other", "word", "here", "now"]) + str(rng.randint(0, 999)) if rng.random() < share else w for w in words)


def test_codewords_are_seven_apart():
    code = codewords()
    product = code @ code.T
    np.fill_diagonal(product, -23)
    assert code.shape == (4096, 23) and (23 - product.max()) / 2 == 7


def test_equal_texts_have_equal_keys_and_none_is_there_twice():
    size, total = bit_counts(["a b c d e f g h", "A b c  d e f g\th", "", None], 5, 4)
    keys = soft_keys(margins(size, total))
    assert (keys[0] == keys[1]).all() and (keys[2] == keys[3]).all()
    assert all(len(set(row)) == len(row) for row in keys.tolist())


@pytest.mark.parametrize(("share", "least"), [(0.01, 0.99), (0.02, 0.9)])
def test_recall_of_near_copies(share, least):
    """Pairs of similarity 0.8 and more share a key and are within the bound."""
    rng = random.Random(4)
    texts = [[f"v{rng.randint(0, 20_000)}" for _ in range(300)] for _ in range(250)]
    pairs = [(" ".join(t), edited(rng, t, share)) for t in texts]
    pairs = [(a, b) for a, b in pairs if jaccard(a, b) >= 0.8]
    left, right = bit_counts([a for a, _ in pairs], 5, 4), bit_counts([b for _, b in pairs], 5, 4)
    meet = [bool(set(a) & set(b)) for a, b in zip(soft_keys(margins(*left)).tolist(), soft_keys(margins(*right)).tolist(), strict=True)]
    near = np.bitwise_count(majority(*left) ^ majority(*right)).sum(axis=1) <= MAX_BITS
    assert len(pairs) > 100 and (np.array(meet) & near).mean() >= least


def test_one_of_each_group_is_kept(spark):
    rng = random.Random(9)
    rows = [r for r in documents(150) if r[0] is not None]
    base = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
    rows += [(1000 + i, edited(rng, base, 0.01), "en", "s", 1) for i in range(60)]
    out = kept_documents(spark.createDataFrame(rows, DOCS).repartition(3))
    assert out.columns == COLUMNS
    kept = [tuple(r) for r in out.collect()]
    groups = brute_kept(rows)
    # nothing is dropped that no link drops: each group keeps one at least, and nearly all keep one only
    places = {}
    for i, row in enumerate(rows):
        places.setdefault(row, []).append(i)
    for members in groups.values():
        assert min(rows[i][0] for i in members) in {r[0] for r in kept}
    assert len(groups) <= len(kept) <= len(groups) + 3
    assert len({r[1] or "" for r in kept}) == len(kept)
    assert sum(r[0] >= 1000 for r in kept) <= 2


def test_nulls_repeated_rows_and_empty_table(spark):
    assert kept_documents(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e", "en", "s", 1), (4, None, "en", "s", 1), (3, "", "en", "s", 1), (None, "z y x", "en", "s", 1), (9, "z  Y\tx", "en", "s", 1), (None, "a b c d e", "en", "t", 1), (9, "z  Y\tx", "en", "s", 1)]
    kept = [tuple(r) for r in kept_documents(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_clashing_columns(spark):
    names = "doc_id long, text string, __row long, __id long, p0 string, soft string, component_id long"
    rows = [(1, "a b c d e f", 5, 6, "p", "s", 7), (2, "a b c d e f", 5, 6, "p", "s", 7), (3, "other words", 5, 6, "p", "s", 7)]
    out = kept_documents(spark.createDataFrame(rows, names))
    assert out.columns == [n.split()[0] for n in names.split(", ")]
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]


def test_files_are_not_copied(spark, tmp_path):
    """Rows of a table of files are named by their place; the same documents stay."""
    rows = [r for r in documents(60) if r[0] is not None]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = kept_documents(docs)
    assert {f.rsplit("/", 2)[1] for f in out.inputFiles()} > {"docs"} and not any("numbered" in f for f in out.inputFiles())
    kept = [tuple(r) for r in out.collect()]
    other = [tuple(r) for r in kept_documents(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted({r[0] for r in kept}) == sorted({r[0] for r in other}) and len(kept) == len(other)
