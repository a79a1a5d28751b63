import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm.vector_search import ApproximationFile, op1_top_k, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in whole:
        if q % 50:
            continue
        best = {}
        for i, v in whole:
            if i != q and len(v) == len(qv):
                best[i] = max(best.get(i, -(10**18)), sum(a * b for a, b in zip(qv, v)))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(ranked)]
    return sorted(out)


def test_against_brute_force_with_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(400)]
    rows += [(400, None, 1), (450, [], 1), (500, [None] * 8, 1), (550, [float("nan")] * 8, 1), (600, [float("inf")] * 8, 1), (None, rows[0][1], 1), (650, [1.0, 2.0], 1), (651, [3.0, 1.0], 1), (700, [0.0] * 8, 1)]
    rows += [(701, rows[50][1], 2), (702, rows[50][1], 2), (703, rows[50][1], 2)]  # ties
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in op1_top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)
    # many small groups give the same
    again = top_k(df, df.where("vec_id % 50 = 0"), group_rows=16)
    assert sorted(tuple(r) for r in again.select("query_id", "rank", "vec_id", "score").collect()) == got


def test_an_id_repeated_more_than_k_times_takes_one_place(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(60)]
    rows += [(1, [x * (1 + j / 50) for x in rows[0][1]], 1) for j in range(6)] + [(2, rows[50][1], 1)] * 6
    for group_rows in (1000, 8):
        df = spark.createDataFrame(rows, SCHEMA)
        found = top_k(df, df.where("vec_id % 50 = 0"), group_rows=group_rows).select("query_id", "rank", "vec_id", "score")
        assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    file = ApproximationFile(np.array([7] * 9 + [8]), np.array([[5.0]] * 9 + [[1.0]]), 6)
    assert [(i.tolist(), s.tolist()) for _, i, s in file.search(np.array([-1]), np.array([[1.0]]), 3)] == [([7, 8], [5, 1])]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op1_top_k(empty).collect() == []
    named = spark.createDataFrame([(0, [1.0, 0.5], 3, 4, 5), (1, [0.5, 0.5], 3, 4, 5)], "vec_id long, embedding array<float>, rank int, score int, group int")
    assert [tuple(r) for r in op1_top_k(named).collect()] == [(0, 1, 1, 256 * 128 + 128 * 128)]


def test_scores_beyond_a_long(spark):
    """They are the greatest or the least long; ties go to smaller ids, and the others keep their order."""
    big = 3.0e38
    vectors = {0: [big, 1.0], 9: [big, 0.0], 3: [big, 5.0], 5: [-big, 0.0], 2: [-big, 1.0], 4: [0.0, 1.0], 7: [0.0, 2.0], 8: [1e-30, 3.0]}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)
    scaled = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    scores = {i: clip(sum(a * b for a, b in zip(v, scaled[0]))) for i, v in scaled.items() if i}
    want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    for k in (2, 5, 7):
        found = top_k(df, df.where("vec_id = 0"), k=k).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in found] == want[:k]
    doubles = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e306, 1.0]), (2, [1e200, 1.0]), (3, [-1e200, 1.0]), (50, [1e150, 0.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in op1_top_k(doubles).collect()}
    # 256 times the first two is no number any more: they take no part
    assert found == {(50, 1): (2, 2**63 - 1), (50, 2): (3, -(2**63))}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([1, 300, 10**9]), st.integers(1, 7))
def test_bounds_hold_and_search_is_exact(seed, n, size, bits):
    rng = np.random.default_rng(seed)
    exact = np.floor(rng.normal(size=(n, 5)) * size)
    file = ApproximationFile(np.arange(n), exact, bits)
    queries = np.floor(rng.normal(size=(3, 5)) * size)
    lower, upper = file.bounds(queries)
    for q in range(3):
        scores = [sum(int(a) * int(b) for a, b in zip(row, queries[q])) for row in exact]
        assert all(lo <= s <= up for lo, s, up in zip(lower[q], scores, upper[q]))
    for (_, ids, scores), query in zip(file.search(np.full(3, -1), queries, 4), queries):
        want = sorted(((-sum(int(a) * int(b) for a, b in zip(row, query)), i) for i, row in enumerate(exact)))[:4]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want


def test_a_file_gives_scores_beyond_a_long_exactly():
    """The case that test_bounds_hold_and_search_is_exact found; and components whose products are no doubles."""
    for size, extra in ((10**9, []), (2.0**62, []), (2.0**62, [[1e300, -1e300, 1.0, 0.0, 0.0]])):
        rng = np.random.default_rng(1689)
        exact = np.vstack([np.floor(rng.normal(size=(25, 5)) * size), *extra, *[[-x for x in e] for e in extra]])
        queries = np.vstack([np.floor(rng.normal(size=(3, 5)) * size), *extra])
        for k in (4, 30):
            file = ApproximationFile(np.arange(len(exact)), exact, 1)
            beyond = 0
            for (_, ids, scores), query in zip(file.search(np.full(len(queries), -1), queries, k), queries, strict=True):
                want = sorted(((-sum(int(a) * int(b) for a, b in zip(row, query)), i) for i, row in enumerate(exact)))[:k]
                assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want
                beyond += sum(abs(s) >= 2**63 for s, _ in want)
            assert beyond
