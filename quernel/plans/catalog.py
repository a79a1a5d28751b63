"""The engine's own queries by name, each with the SQL that checks it.

A query takes a session and a folder of Parquet tables.  Those of the relational operators are DataFrame
compositions; those of DML run statements on a scratch table and return what it holds then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions import exprs
from quernel.operators import graph, relational as rel, vector
from quernel.plans.engine import Engine
from quernel.session import shared_folder, ship
from quernel.sources import arrow
from quernel.sources.files import Store
from quernel.sources.table import Table
from quernel.streaming.ingest import stream_into

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        _ORACLES[function.__name__] = " ".join(oracle.split())
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, df: DataFrame, name: str = "t") -> tuple[Engine, Table]:
    """An engine with one table that holds df's rows."""
    engine = Engine(spark, scratch_folder(spark))
    table = Table.create(spark, engine._path(name), T.StructType([T.StructField(f.name.lower(), f.dataType) for f in df.schema.fields]))
    table.append(df)
    engine.tables[name] = table
    return engine, table


def done(engine: Engine, *statements: str) -> None:
    for statement in statements:
        result = engine.execute(statement)
        if result.is_error:
            raise RuntimeError(result.message)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten suppliers with the most units beyond the second line of an order."""
    rows = read(spark, sf_dir, "lineitem").where(rel.compare("l_linenumber", ">", 2))
    units = F.sum(F.col("l_quantity").cast("long"))
    return rel.grouped(rows, ["l_suppkey"], {"q": units}, F.col("q") > 100, [F.col("q").desc(), F.col("l_suppkey")], 10)


# Scans and projections


@query("SELECT * FROM nation")
def scan_full(spark, d):
    return read(spark, d, "nation")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_two_columns(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("SELECT o.o_custkey AS cust, o.o_orderkey AS id FROM orders o")
def project_reorder_alias(spark, d):
    return rel.project(read(spark, d, "orders"), {"cust": "o_custkey", "id": "o_orderkey"})


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return rel.point_lookup(read(spark, d, "orders"), "o_orderkey", 7)


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def filtered_keys(spark, d):
    return rel.filtered_keys(read(spark, d, "part"), "p_partkey", rel.compare("p_size", ">", 40))


@query("SELECT p_partkey, ABS(CAST(p_size AS BIGINT) - 25) AS a, -CAST(p_size AS BIGINT) AS n, CAST(p_size AS BIGINT) * p_size AS s FROM part")
def scalar_abs_negate_square(spark, d):
    return read(spark, d, "part").select("p_partkey", exprs.absolute(F.col("p_size") - 25).alias("a"), exprs.negated("p_size").alias("n"), exprs.squared("p_size").alias("s"))


# Filters


def _sized(sign: str):
    def run(spark, d):
        return read(spark, d, "part").where(rel.compare("p_size", sign, 25)).select("p_partkey", "p_size")

    return run


for _name, _sign in (("eq", "="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("ne", "<>")):
    _run = _sized(_sign)
    _run.__name__ = f"filter_{_name}"
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {_sign} 25")(_run)


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20 AND p_retailprice >= 950")
def filter_and(spark, d):
    return read(spark, d, "part").where((F.col("p_size") > 10) & (F.col("p_size") < 20) & (F.col("p_retailprice") >= 950)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45 AND p_retailprice < 1000")
def filter_or(spark, d):
    return read(spark, d, "part").where((F.col("p_size") < 5) | (F.col("p_size") > 45) & (F.col("p_retailprice") < 1000)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND p_retailprice < 1000")
def filter_paren(spark, d):
    return read(spark, d, "part").where(((F.col("p_size") < 5) | (F.col("p_size") > 45)) & (F.col("p_retailprice") < 1000)).select("p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 99)")
def filter_in_int(spark, d):
    return read(spark, d, "nation").where(F.col("n_nationkey").isin(1, 3, 5, 99)).select("n_nationkey", "n_name")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')")
def filter_in_str(spark, d):
    return read(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 3, 5) AND n_name NOT LIKE '%A'")
def filter_not_in_not_like(spark, d):
    return read(spark, d, "nation").where(~F.col("n_nationkey").isin(1, 3, 5) & ~F.col("n_name").like("%A")).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def filter_in_subquery(spark, d):
    few = read(spark, d, "customer").where("c_nationkey < 5")
    return rel.semi_filter(read(spark, d, "orders"), few, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 2) OR o_totalprice > 400000")
def filter_in_subquery_or(spark, d):
    engine = Engine(spark, scratch_folder(spark))
    for name in ("orders", "customer"):
        engine.register(name, read(spark, d, name))
    return engine.query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 2) OR o_totalprice > 400000")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ro%'")
def filter_like(spark, d):
    return read(spark, d, "part").where(F.col("p_name").like("%ro%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_2'")
def filter_like_underscore(spark, d):
    return read(spark, d, "part").where(F.col("p_brand").like("Brand#_2")).select("p_partkey", "p_brand")


def _with_gaps(spark, d) -> DataFrame:
    size = F.when(F.col("p_partkey") % 3 == 0, None).when(F.col("p_partkey") % 3 == 1, 0).otherwise(F.col("p_size"))
    name = F.when(F.col("p_partkey") % 4 == 0, None).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", size.alias("size"), name.alias("name"))


_GAPS = """WITH gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size END AS size,
    CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE p_name END AS name FROM part)"""


@query(_GAPS + " SELECT p_partkey FROM gaps WHERE (size IS NULL OR size = 0) AND (name IS NULL OR name = '')")
def is_null_equiv(spark, d):
    rows = _with_gaps(spark, d)
    return rows.where(exprs.null_like("size", rows.schema["size"].dataType) & exprs.null_like("name", rows.schema["name"].dataType)).select("p_partkey")


@query(_GAPS + " SELECT p_partkey FROM gaps WHERE NOT (size IS NULL OR size = 0) AND NOT (name IS NULL OR name = '')")
def is_not_null_equiv(spark, d):
    rows = _with_gaps(spark, d)
    return rows.where(~exprs.null_like("size", rows.schema["size"].dataType) & ~exprs.null_like("name", rows.schema["name"].dataType)).select("p_partkey")


# Counts


@query("SELECT COUNT(*) AS cnt FROM lineitem WHERE l_quantity > 25")
def count_gt(spark, d):
    return rel.count_matching(read(spark, d, "lineitem"), F.col("l_quantity") > 25)


@query("SELECT COUNT(*) AS cnt FROM part WHERE p_size = 15")
def count_eq_int(spark, d):
    return rel.count_matching(read(spark, d, "part"), F.col("p_size") == 15)


@query("SELECT COUNT(*) AS cnt FROM events WHERE event_type = 'click'")
def count_eq_str(spark, d):
    return rel.count_matching(read(spark, d, "events"), F.col("event_type") == "click")


@query("SELECT CAST(t AS BIGINT) AS threshold, (SELECT COUNT(*) FROM orders WHERE o_custkey > t) AS cnt FROM (VALUES (0), (10), (100), (500), (1000), (5000)) v(t)")
def shared_scan_counts(spark, d):
    return rel.shared_threshold_counts(read(spark, d, "orders"), "o_custkey", [0, 10, 100, 500, 1000, 5000])


# Aggregates


@query(
    """SELECT COUNT(*) AS n, CAST(SUM(CAST(o_custkey AS BIGINT)) AS BIGINT) AS s, MIN(o_custkey) AS lo, MAX(o_custkey) AS hi,
    CAST(SUM(CAST(o_custkey AS BIGINT)) AS DOUBLE) / COUNT(*) AS mean FROM orders"""
)
def agg_scalar_all(spark, d):
    return rel.scalar_aggregates(read(spark, d, "orders"), {"n": ("count", "*"), "s": ("sum", "o_custkey"), "lo": ("min", "o_custkey"), "hi": ("max", "o_custkey"), "mean": ("avg", "o_custkey")})


@query(
    """SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi, CAST(SUM(p_size) AS DOUBLE) / COUNT(*) AS mean
    FROM part WHERE p_size > 10"""
)
def agg_scalar_filtered(spark, d):
    return rel.scalar_aggregates(read(spark, d, "part"), {"n": ("count", "*"), "s": ("sum", "p_size"), "lo": ("min", "p_size"), "hi": ("max", "p_size"), "mean": ("avg", "p_size")}, F.col("p_size") > 10)


@query("SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi, AVG(p_size) AS mean FROM part WHERE p_size > 100000")
def agg_empty(spark, d):
    return rel.scalar_aggregates(read(spark, d, "part"), {"n": ("count", "*"), "s": ("sum", "p_size"), "lo": ("min", "p_size"), "hi": ("max", "p_size"), "mean": ("avg", "p_size")}, F.col("p_size") > 100000)


@query("SELECT COUNT(*) AS n FROM orders LIMIT 5")
def agg_then_limit(spark, d):
    return rel.scalar_aggregates(read(spark, d, "orders"), {"n": ("count", "*")}).limit(5)


@query("SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_suppkey")
def groupby_sum(spark, d):
    return rel.grouped(read(spark, d, "lineitem"), ["l_suppkey"], {"q": F.sum(F.col("l_quantity").cast("long"))})


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def groupby_count(spark, d):
    return rel.grouped(read(spark, d, "orders"), ["o_custkey"], {"n": F.count(F.lit(1))})


@query("SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s FROM events GROUP BY event_type")
def groupby_dict(spark, d):
    return rel.grouped(read(spark, d, "events"), ["event_type"], {"n": F.count(F.lit(1)), "s": F.sum("user_id")})


@query(
    """SELECT o_custkey, COUNT(*) AS n, CAST(SUM(CAST(o_orderkey AS BIGINT)) AS BIGINT) AS s FROM orders GROUP BY o_custkey
    HAVING COUNT(*) >= 12 AND (o_custkey < 500 OR SUM(o_orderkey) > 100000)"""
)
def groupby_having(spark, d):
    keep = (F.col("n") >= 12) & ((F.col("o_custkey") < 500) | (F.col("s") > 100000))
    return rel.grouped(read(spark, d, "orders"), ["o_custkey"], {"n": F.count(F.lit(1)), "s": F.sum("o_orderkey")}, keep)


@query("SELECT l_partkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 15")
def groupby_order_limit(spark, d):
    return rel.grouped(read(spark, d, "lineitem"), ["l_partkey"], {"q": F.sum(F.col("l_quantity").cast("long"))}, order=[F.col("q").desc(), F.col("l_partkey")], limit=15)


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def groupby_two_keys(spark, d):
    return rel.grouped(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "q": F.sum(F.col("l_quantity").cast("long"))})


@query("SELECT o.o_custkey AS cust, COUNT(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey > 12 GROUP BY o.o_custkey")
def groupby_where_join(spark, d):
    few = read(spark, d, "customer").where("c_nationkey > 12").select("c_custkey")
    joined = rel.star_join(read(spark, d, "orders").select("o_custkey"), [(few, "o_custkey", "c_custkey")])
    return joined.groupBy(F.col("o_custkey").alias("cust")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_linenumber > 2
    GROUP BY l_suppkey HAVING SUM(CAST(l_quantity AS BIGINT)) > 100 ORDER BY q DESC, l_suppkey LIMIT 10"""
)
def flagship_query(spark, d):
    return flagship(spark, d)


# Joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(spark, d):
    joined = rel.star_join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), [(read(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey")])
    return joined.select("o_orderkey", "c_name")


@query("SELECT COUNT(*) AS cnt FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def join_match_count(spark, d):
    joined = rel.star_join(read(spark, d, "lineitem").select("l_orderkey"), [(read(spark, d, "orders").select("o_orderkey"), "l_orderkey", "o_orderkey")])
    return joined.agg(F.count(F.lit(1)).alias("cnt"))


@query(
    """SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c
    JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) o ON c.c_custkey = o.o_custkey AND o.rn = 1"""
)
def join_lookup_last(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.lookup_join(read(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query(
    """SELECT o.o_orderkey, a.q, c.c_name FROM orders o
    JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey) a ON o.o_orderkey = a.l_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey"""
)
def join_star_preagg(spark, d):
    units = rel.grouped(read(spark, d, "lineitem"), ["l_orderkey"], {"q": F.sum(F.col("l_quantity").cast("long"))})
    joined = rel.star_join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), [(units, "o_orderkey", "l_orderkey"), (read(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey")])
    return joined.select("o_orderkey", "q", "c_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def sip_semi(spark, d):
    return rel.semi_filter(read(spark, d, "lineitem"), read(spark, d, "part").where("p_size = 10"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


# Sorting


def _ranked(order: str, limit: str = "") -> str:
    return f"SELECT o_orderkey, o_custkey, CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INTEGER) AS rn FROM orders {limit}"


@query(_ranked("o_custkey, o_orderkey"))
def sort_asc(spark, d):
    rows = rel.ranked_rows(read(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_custkey"), F.col("o_orderkey")])
    return rows.withColumn("rn", F.col("rn").cast("int"))


@query(_ranked("o_custkey DESC, o_orderkey"))
def sort_desc(spark, d):
    rows = rel.ranked_rows(read(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_custkey").desc(), F.col("o_orderkey")])
    return rows.withColumn("rn", F.col("rn").cast("int"))


@query("SELECT n_nationkey, n_name, CAST(ROW_NUMBER() OVER (ORDER BY n_name DESC, n_nationkey) AS INTEGER) AS rn FROM nation ORDER BY rn LIMIT 7")
def topk(spark, d):
    return rel.top_rows(read(spark, d, "nation").select("n_nationkey", "n_name"), [F.col("n_name").desc(), F.col("n_nationkey")], 7)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 3 ORDER BY n_nationkey LIMIT 0")
def limit_zero(spark, d):
    return read(spark, d, "nation").where("n_nationkey >= 3").select("n_nationkey").orderBy("n_nationkey").limit(0)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 3 ORDER BY n_nationkey LIMIT 1000")
def limit_over(spark, d):
    return read(spark, d, "nation").where("n_nationkey >= 3").select("n_nationkey").orderBy("n_nationkey").limit(1000)


# Vectors


def _query_vector(spark, d) -> list[float]:
    return read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_SCORED = """WITH scored AS (SELECT e.*, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings e),
    best AS (SELECT vec_id FROM scored WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 100)"""


@query(_SCORED + " SELECT vec_id, ROUND(s, 6) AS score FROM scored WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 100")
def vector_topk(spark, d):
    return vector.vector_search(read(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 0.1).select("vec_id", F.round("score", 6).alias("score"))


@query(_SCORED + " SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM best)")
def vector_search(spark, d):
    return vector.vector_matches(read(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 0.1).select("vec_id", "label")


def _vector_sql(spark, d, rest: str) -> DataFrame:
    engine = Engine(spark, scratch_folder(spark))
    engine.register("embeddings", read(spark, d, "embeddings"))
    return engine.query(f"SELECT vec_id, label FROM embeddings WHERE VECTOR_SEARCH(embedding, '{_query_vector(spark, d)}', 0.1) = 1 {rest}")


@query(_SCORED + " SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM best) AND label < 4")
def vector_search_and(spark, d):
    return _vector_sql(spark, d, "AND label < 4")


@query(_SCORED + " SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM best) OR label = 7")
def vector_search_or(spark, d):
    return _vector_sql(spark, d, "OR label = 7")


@query("SELECT CAST(MAX(n) AS BIGINT) AS most, COUNT(*) AS kinds FROM (SELECT embedding, COUNT(*) AS n FROM embeddings GROUP BY embedding)")
def vector_signature_groups(spark, d):
    groups = read(spark, d, "embeddings").groupBy(exprs.vector_signature("embedding").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds"))


# Graphs


# Customers, orders and parts as one graph: ids of three kinds, told apart modulo 3; edges go both ways.
_LINKS = """SELECT DISTINCT CAST(o_custkey AS BIGINT) * 3 AS a, CAST(o_orderkey AS BIGINT) * 3 + 1 AS b FROM orders
    UNION SELECT DISTINCT CAST(l_orderkey AS BIGINT) * 3 + 1, CAST(l_partkey AS BIGINT) * 3 + 2 FROM lineitem"""


def _both_ways(spark, d) -> DataFrame:
    kind = lambda column, n: (F.col(column).cast("long") * 3 + n)
    links = read(spark, d, "orders").select(kind("o_custkey", 0).alias("a"), kind("o_orderkey", 1).alias("b"))
    links = links.unionByName(read(spark, d, "lineitem").select(kind("l_orderkey", 1).alias("a"), kind("l_partkey", 2).alias("b")))
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


@query(
    f"""WITH RECURSIVE links AS ({_LINKS}), edges AS MATERIALIZED (SELECT a AS src, b AS dst FROM links UNION SELECT b, a FROM links),
    walk(node, distance) USING KEY (node) AS (SELECT MIN(CAST(o_custkey AS BIGINT)) * 3, 0 FROM orders
    UNION SELECT DISTINCT e.dst, w.distance + 1 FROM walk w JOIN edges e ON w.node = e.src ANTI JOIN recurring.walk r ON r.node = e.dst)
    SELECT node AS node_id, CAST(distance AS INTEGER) AS distance FROM walk"""
)
def bfs_distance(spark, d):
    start = read(spark, d, "orders").agg(F.min("o_custkey")).first()[0] * 3
    engine = Engine(spark, scratch_folder(spark))
    engine.register("edges", _both_ways(spark, d))
    return engine.query(f"SELECT BFS_DISTANCE({start}, a, b) FROM edges")


@query(f"WITH links AS ({_LINKS}) SELECT a AS src, b AS dst FROM links UNION SELECT b, a FROM links")
def graph_projection(spark, d):
    return graph.edges_of(_both_ways(spark, d), "a", "b")


# DML: what a table holds afterwards


def _parts(spark, d) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", "p_name", "p_size")


@query(
    """SELECT p_partkey, p_name, CAST(CASE WHEN p_size > 25 THEN p_size + 7 ELSE p_size END AS INTEGER) AS p_size FROM part"""
)
def update_math(spark, d):
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "UPDATE t SET p_size = p_size + 7 WHERE p_size > 25")
    return table.snapshot()


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 'it''s small' ELSE p_name END AS p_name, p_size FROM part")
def update_literal(spark, d):
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "UPDATE t SET p_name = 'it''s small' WHERE p_size IN (1, 2, 3)")
    return table.snapshot()


@query(
    """SELECT p_partkey, CASE WHEN p_partkey < 100 THEN 'x' ELSE p_name END AS p_name, CAST(CASE WHEN p_partkey < 100 THEN p_size * 3 ELSE p_size END AS INTEGER) AS p_size FROM part"""
)
def update_mixed(spark, d):
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "UPDATE t SET p_name = 'x', p_size = p_size * 3 WHERE t.p_partkey < 100")
    return table.snapshot()


@query("SELECT p_partkey, p_name, CAST(-p_size // 4 AS INTEGER) AS p_size FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, p_name, CAST(-(p_size // 4) AS INTEGER) FROM part WHERE p_size % 4 <> 0")
def update_div_zero(spark, d):
    """Division truncates toward zero, division by zero leaves the value."""
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "UPDATE t SET p_size = p_size * -1", "UPDATE t SET p_size = p_size / 0", "UPDATE t SET p_size = p_size / 4")
    return table.snapshot()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE NOT (p_size < 10 OR p_name LIKE '%gear')")
def delete_where(spark, d):
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "DELETE FROM t WHERE p_size < 10 OR p_name LIKE '%gear'")
    return table.snapshot()


@query("SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s FROM part WHERE p_size <= 30")
def delete_then_count(spark, d):
    engine, _ = scratch_table(spark, _parts(spark, d))
    done(engine, "DELETE FROM t WHERE p_size > 30")
    return engine.query("SELECT COUNT(*) AS n, SUM(p_size) AS s FROM t")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, '', 0 UNION ALL SELECT 101, 'NOWHERE', 0 UNION ALL SELECT -5, '', 2")
def insert_partial(spark, d):
    engine, table = scratch_table(spark, read(spark, d, "nation"))
    done(engine, "INSERT INTO t (n_nationkey) VALUES (100)", "INSERT INTO t (n_name, n_nationkey) VALUES ('NOWHERE', 101)", "INSERT INTO t (n_nationkey, n_regionkey) VALUES (-5, 2)")
    return table.snapshot()


@query("SELECT CAST(7 AS INTEGER) AS n_nationkey, 'SEVEN' AS n_name, CAST(0 AS INTEGER) AS n_regionkey UNION ALL SELECT 8, 'EIGHT', 0")
def insert_returning(spark, d):
    engine, _ = scratch_table(spark, read(spark, d, "nation"))
    return engine.query("INSERT INTO t (n_nationkey, n_name) VALUES (7, 'SEVEN'), (8, 'EIGHT') RETURNING *")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey + 10 AS INTEGER) AS n_regionkey FROM nation WHERE n_nationkey < 4")
def update_returning(spark, d):
    engine, _ = scratch_table(spark, read(spark, d, "nation"))
    return engine.query("UPDATE t SET n_regionkey = n_regionkey + 10 WHERE n_nationkey < 4 RETURNING *")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'NEW' ELSE n_name END AS n_name FROM nation")
def upsert_latest(spark, d):
    """Inserts append; of rows with one key the last inserted is read by its sequence."""
    rows = read(spark, d, "nation").select("n_nationkey", "n_name", F.lit(0).alias("seq"))
    _, table = scratch_table(spark, rows)
    table.append(rows.where("n_nationkey < 5").select("n_nationkey", F.lit("NEW").alias("n_name"), F.lit(1).alias("seq")))
    return table.snapshot().groupBy("n_nationkey").agg(F.max_by("n_name", "seq").alias("n_name"))


@query("SELECT n_nationkey, n_name, n_regionkey, CAST(0 AS INTEGER) AS score, '' AS note FROM nation UNION ALL SELECT 50, 'FIFTY', 1, 9, 'late'")
def alter_add_backfill(spark, d):
    engine, table = scratch_table(spark, read(spark, d, "nation"))
    done(engine, "ALTER TABLE t ADD score INT", "ALTER TABLE t ADD COLUMN note STRING", "INSERT INTO t VALUES (50, 'FIFTY', 1, 9, 'late')")
    return table.snapshot()


@query("SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_size <= 40")
def compact_roundtrip(spark, d):
    engine, table = scratch_table(spark, _parts(spark, d).repartition(6))
    done(engine, "DELETE FROM t WHERE p_size > 40", "UPDATE t SET p_size = 0 WHERE p_partkey % 5 = 0")
    table.compact()
    table.vacuum()
    return table.snapshot()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size <> 7 UNION ALL SELECT 999999, 'flushed', 1 UNION ALL SELECT 1000000, 'waiting', 1")
def recover_roundtrip(spark, d):
    """A restart has every row that was acknowledged, flushed or not."""
    engine, _ = scratch_table(spark, _parts(spark, d))
    done(engine, "DELETE FROM t WHERE p_size = 7", "INSERT INTO t VALUES (999999, 'flushed', 1)", "FLUSH t", "INSERT INTO t VALUES (1000000, 'waiting', 1)")
    return Engine(spark, engine.root).table("t").snapshot()


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'x' ELSE p_name END AS p_name, p_size FROM part WHERE p_size <= 40")
def delete_qualified_literal(spark, d):
    """A literal that looks like a qualified column stays a literal."""
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "UPDATE t SET p_name = 't.x' WHERE t.p_size > 40", "UPDATE t SET p_name = 'x' WHERE t.p_size < 10", "DELETE FROM t WHERE t.p_name = 't.x'")
    return table.snapshot()


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT 999998, 'flushed', 1 UNION ALL SELECT 999999, 'waiting', 2")
def flush_mixed(spark, d):
    engine, table = scratch_table(spark, _parts(spark, d))
    done(engine, "INSERT INTO t VALUES (999998, 'flushed', 1)", "FLUSH t", "INSERT INTO t VALUES (999999, 'waiting', 2)")
    return table.snapshot()


@query("SELECT vec_id, label FROM (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) WHERE s >= 0.1")
def vector_search_repeated_key(spark, d):
    """Rows are chosen by their own score, though many share a key."""
    rows = read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    engine, _ = scratch_table(spark, rows)
    return engine.query(f"SELECT t.vec_id, t.label FROM t WHERE VECTOR_SEARCH(t.embedding, '{_query_vector(spark, d)}', 0.1, {rows.count() + 1})")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 77")
def table_point_lookup(spark, d):
    _, table = scratch_table(spark, _parts(spark, d).repartitionByRange(4, "p_partkey"))
    return table.point_lookup(77)


@query("SELECT r_regionkey, r_name FROM region")
def create_insert_select(spark, d):
    engine = Engine(spark, scratch_folder(spark))
    engine.register("region", read(spark, d, "region"))
    done(engine, "CREATE TABLE copy (r_regionkey INT, r_name TEXT)", "INSERT INTO copy SELECT r_regionkey, r_name FROM region")
    return engine.query("SELECT * FROM copy")


# Dictionaries, Arrow and streams


@query(
    """WITH firsts AS (SELECT event_type AS value, MIN(event_id) AS f FROM events GROUP BY event_type)
    SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY f, value) - 1 AS INTEGER) AS id FROM firsts"""
)
def dictionary_ids(spark, d):
    return rel.dictionary(read(spark, d, "events"), "event_type", "event_id")


@query("SELECT event_id, event_type FROM events")
def dictionary_roundtrip(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type")
    known = rel.dictionary(events, "event_type", "event_id")
    return rel.decode(rel.encode(events, "event_type", known, "code").select("event_id", "code"), "code", known, "event_type").select("event_id", "event_type")


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS content, CAST(0 AS INTEGER) AS missing_col FROM nation")
def arrow_bulk_realign(spark, d):
    """Columns arrive in another order and one is missing."""
    engine = Engine(spark, scratch_folder(spark))
    done(engine, "CREATE TABLE t (id INT, content STRING, missing_col INT)")
    nation = arrow.to_arrow(read(spark, d, "nation").select("n_name", "n_nationkey"))
    arrow.bulk_load(engine.table("t"), pa.table({"content": nation["n_name"], "id": nation["n_nationkey"], "extra": nation["n_nationkey"]}))
    return engine.table("t").snapshot()


@query("SELECT event_id, event_type, CAST(0 AS INTEGER) AS missing_col FROM events")
def stream_ingest_pad(spark, d):
    events = read(spark, d, "events")
    folder = scratch_folder(spark)
    engine = Engine(spark, folder)
    done(engine, "CREATE TABLE t (event_id BIGINT, event_type STRING, missing_col INT)")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*").parquet(f"{d}/events.parquet*")
    stream_into(stream, engine.table("t"), f"{folder}/checkpoint").awaitTermination()
    return engine.table("t").snapshot()


@query("SELECT event_id, event_type FROM events")
def stream_replay(spark, d):
    """A batch that runs again, since the stream stopped before it could note the batch as done, is there once."""
    events = read(spark, d, "events")
    folder = scratch_folder(spark)
    engine = Engine(spark, folder)
    done(engine, "CREATE TABLE t (event_id BIGINT, event_type STRING)")
    stream = lambda: spark.readStream.schema(events.schema).option("pathGlobFilter", "*").parquet(f"{d}/events.parquet*")
    stream_into(stream(), engine.table("t"), f"{folder}/checkpoint").awaitTermination()
    Store(spark, f"{folder}/checkpoint/commits").delete()
    stream_into(stream(), Engine(spark, folder).table("t"), f"{folder}/checkpoint").awaitTermination()
    return Engine(spark, folder).table("t").snapshot()
