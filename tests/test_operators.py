import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions import exprs
from quernel.functions.membership import MembershipFilter
from quernel.operators import graph, relational as rel, vector


def test_lookup_join_takes_the_newest(spark):
    build = spark.createDataFrame([(1, 10, "old"), (1, 11, "new"), (2, 5, "two"), (None, 1, "x")], "k int, seq int, v string")
    probe = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (3, "s"), (None, "t")], "k int, n string")
    assert sorted(tuple(r) for r in rel.lookup_join(probe, build, "k", "k", "seq", ["v"]).collect()) == [(1, "p", "new"), (1, "q", "new"), (2, "r", "two")]
    assert rel.semi_filter(probe, build, "k", "k").count() == 3


def test_shared_counts_are_one_pass(spark):
    rows = spark.range(1000).withColumn("val", F.col("id").cast("int"))
    got = {r.threshold: r.cnt for r in rel.shared_threshold_counts(rows, "val", [800, 500, 100]).collect()}
    assert got == {800: 199, 500: 499, 100: 899}
    assert {r.name: r.cnt for r in rel.shared_counts(rows, {"even": F.col("id") % 2 == 0, "none": F.col("id") < 0}).collect()} == {"even": 500, "none": 0}


def test_ranked_rows_keeps_every_row(spark):
    rows = [(i * 7919 % 1000, i) for i in range(3000)]
    for order, key in (([F.col("a"), F.col("b")], lambda r: r), ([F.col("a").desc(), F.col("b")], lambda r: (-r[0], r[1]))):
        got = rel.ranked_rows(spark.createDataFrame(rows, "a int, b int").repartition(5), order).collect()
        assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rn)] == sorted(rows, key=key)
        assert sorted(r.rn for r in got) == list(range(1, 3001))
    assert rel.ranked_rows(spark.createDataFrame([], "a int"), [F.col("a")]).collect() == []


def test_full_sorts_return_the_whole_table(spark):
    from quernel.plans import catalog

    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    for name in ("sort_asc", "sort_desc"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.01").count() == orders > 200


def test_full_search_follows_every_order_and_line(spark):
    from quernel.plans import catalog

    folder = "/root/testdata/sf0.001"
    pairs = {(3 * r[0], 3 * r[1] + 1) for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", "o_orderkey").collect()}
    pairs |= {(3 * r[0] + 1, 3 * r[1] + 2) for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    edges = {tuple(r) for r in catalog.queries()["graph_projection"](spark, folder).select("src", "dst").collect()}
    assert edges == pairs | {(b, a) for a, b in pairs}
    start = min(a for a in near if a % 3 == 0)
    want, queue = {start: 0}, [start]
    for at in queue:
        for to in near[at]:
            if to not in want:
                want[to] = want[at] + 1
                queue.append(to)
    assert {r.node_id: r.distance for r in catalog.queries()["bfs_distance"](spark, folder).collect()} == want
    assert max(want.values()) > 2


def test_scalar_aggregates_of_nothing(spark):
    row = rel.scalar_aggregates(spark.range(0), {"n": ("count", "*"), "s": ("sum", "id"), "a": ("avg", "id")}).first()
    assert tuple(row) == (0, None, None)


def test_arithmetic_and_nulls(spark):
    df = spark.createDataFrame([(7, -7, None, ""), (2**31 - 1, 0, 0, "x")], "a int, b int, c int, s string")
    kind = T.IntegerType()
    row = df.select(
        exprs.arithmetic("a", "/", 2, kind).alias("x"), exprs.arithmetic("b", "/", 2, kind).alias("y"), exprs.arithmetic("a", "/", 0, kind).alias("z"), exprs.arithmetic("a", "+", 1, kind).alias("o"), exprs.squared("a").alias("q"), exprs.negated("a").alias("n"), exprs.absolute("b").alias("m")
    ).collect()
    assert tuple(row[0]) == (3, -3, 7, 8, 49, -7, 7)
    assert tuple(row[1]) == (2**30 - 1, 0, 2**31 - 1, None, (2**31 - 1) ** 2, -(2**31 - 1), 0)
    assert [tuple(r) for r in df.select(exprs.null_like("c", kind), exprs.null_like("s", T.StringType())).collect()] == [(True, True), (True, False)]


def test_cosine_and_ties(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = [(r.id, round(r.score, 6)) for r in vector.vector_search(df, "id", "v", [1, 0], -1.0).collect()]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.707107), (7, -1.0)]
    assert [r.id for r in vector.vector_search(df, "id", "v", [1, 0], 0.5, 2).collect()] == [1, 3]
    assert df.select(exprs.vector_signature("v").alias("h")).distinct().count() == 7


def test_bfs_against_python(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, size=(90, 2))]
    df = spark.createDataFrame(edges, "s int, d int")
    want, frontier = {0: 0}, [0]
    while frontier:
        fresh = {b for a, b in edges if a in frontier and b not in want}
        want |= {x: max(want.values()) + 1 for x in fresh}
        frontier = list(fresh)
    assert {r.node: r.distance for r in graph.bfs_distance(df, 0, "s", "d").collect()} == want
    assert graph.bfs_distance(df.limit(0), 0, "s", "d").collect() == []


def test_dictionary(spark):
    df = spark.createDataFrame([(2, "b"), (1, "c"), (3, "b"), (4, None), (5, "a")], "id int, v string")
    known = rel.dictionary(df, "v", "id")
    assert {r.value: r.id for r in known.collect()} == {"c": 0, "b": 1, "a": 2}
    coded = rel.encode(df, "v", known, "code")
    assert {r.id: r.code for r in coded.collect()} == {1: 0, 2: 1, 3: 1, 4: None, 5: 2}
    assert {r.id: r.back for r in rel.decode(coded, "code", known, "back").collect()} == {1: "c", 2: "b", 3: "b", 4: None, 5: "a"}


def test_membership_filter(tmp_path):
    rng = np.random.default_rng(7)
    keys = rng.integers(-(2**62), 2**62, 5000)
    held = MembershipFilter(5000)
    assert held.insert_all(keys.tolist()) == 5000
    assert held.contains_all(keys.tolist()).all()
    others = rng.integers(-(2**62), 2**62, 20000)
    assert held.contains_all(others.tolist()).mean() < 0.01
    held.save(str(tmp_path / "f"))
    again = MembershipFilter.load(str(tmp_path / "f"))
    assert again.contains_all(keys.tolist()).all() and again.count == 5000
    assert again.remove(int(keys[0])) and not again.remove(12345)
    tiny = MembershipFilter(1)
    stored = [k for k in range(100) if tiny.insert(k)]
    assert len(stored) < 100 and tiny.contains_all(stored).all()


def test_unknown_column_is_an_error(spark):
    with pytest.raises(Exception):
        rel.project(spark.range(1), {"x": "nope"}).collect()
