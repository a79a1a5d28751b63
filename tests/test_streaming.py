import shutil
import time

import pyarrow as pa
import pytest

from quernel.plans.engine import Engine
from quernel.sources.arrow import record_batches
from quernel.streaming.ingest import CountFusion, Writer, count_eq, count_gt, stream_into


@pytest.fixture
def engine(spark, tmp_path):
    out = Engine(spark, str(tmp_path / "db"))
    assert not out.execute("CREATE TABLE t (val INT, name STRING)").is_error
    return out


def test_stream_is_appended_once(spark, tmp_path, engine):
    table = engine.table("t")
    spark.range(50).selectExpr("id AS val", "'x' AS other").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("val long, other string").parquet(str(tmp_path / "in"))
    stream_into(stream(), table, str(tmp_path / "ck")).awaitTermination()
    assert table.snapshot().count() == 50
    assert {r.name for r in table.snapshot().select("name").distinct().collect()} == {""}
    spark.range(50, 60).selectExpr("id AS val", "'x' AS other").write.mode("append").parquet(str(tmp_path / "in"))
    stream_into(stream(), table, str(tmp_path / "ck")).awaitTermination()
    assert table.snapshot().count() == 60
    # a batch that runs again is told by its number
    stream_into(stream(), table, str(tmp_path / "ck")).awaitTermination()
    assert table.snapshot().count() == 60


def test_a_batch_that_runs_again_is_appended_once(spark, tmp_path, engine):
    table, root = engine.table("t"), str(tmp_path / "ck")
    spark.range(20).selectExpr("id AS val").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("val long").parquet(str(tmp_path / "in"))
    stream_into(stream(), table, root).awaitTermination()
    # the stream stopped after the append and before the batch was noted as done
    shutil.rmtree(tmp_path / "ck" / "commits")
    stream_into(stream(), Engine(spark, engine.root).table("t"), root).awaitTermination()
    assert Engine(spark, engine.root).table("t").snapshot().count() == 20
    # another stream's batches are others
    stream_into(stream(), table, str(tmp_path / "ck2")).awaitTermination()
    assert table.snapshot().count() == 40


def test_a_failed_append_leaves_nothing_behind(spark, tmp_path, engine, monkeypatch):
    table = engine.table("t")
    spark.range(20).selectExpr("id AS val").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("val long").parquet(str(tmp_path / "in"))
    whole = table._commit

    def crash(*_, **__):
        raise RuntimeError("crash before the manifest")

    monkeypatch.setattr(table, "_commit", crash)
    with pytest.raises(Exception):
        stream_into(stream(), table, str(tmp_path / "ck")).awaitTermination()
    assert Engine(spark, engine.root).table("t").snapshot().count() == 0
    monkeypatch.setattr(table, "_commit", whole)
    stream_into(stream(), table, str(tmp_path / "ck")).awaitTermination()
    assert Engine(spark, engine.root).table("t").snapshot().count() == 20


def test_a_future_means_durable(spark, engine):
    writer = Writer(engine.table("t"))
    writer.insert((1, "a")).result(60)
    assert [tuple(r) for r in Engine(spark, engine.root).table("t").snapshot().collect()] == [(1, "a")]
    writer.close()


def test_writes_are_fused(engine):
    table = engine.table("t")
    writer = Writer(table)
    futures = [writer.insert((i, "a")) for i in range(300)]
    last = writer.flush()
    last.result(60)
    writer.close()
    assert sum(f.result() is not None for f in futures) == 300
    assert writer.batches < 300 and table.snapshot().count() == 300 and not table.pending
    failing = Writer(table)
    bad = failing.insert((1, "a", "b"))
    with pytest.raises(Exception):
        bad.result(60)
    failing.close()


def test_counts_are_fused(engine, spark):
    table = engine.table("t")
    table.append(spark.range(1000).selectExpr("id AS val"))
    fusion = CountFusion(table, "val")
    asked = {t: fusion.count_gt(t) for t in range(0, 900, 6)}
    fusion.run()
    assert fusion.passes == 2
    assert all(f.result() == 999 - t for t, f in asked.items())
    assert count_gt(table.snapshot(), "val", 800) == 199 and count_eq(table.snapshot(), "val", 5) == 1


def test_counts_are_answered_as_they_come(engine, spark):
    table = engine.table("t")
    table.append(spark.range(100).selectExpr("id AS val"))
    with CountFusion(table, "val") as fusion:
        assert [fusion.count_gt(t).result(60) for t in (10, 98, 1000)] == [89, 1, 0]
    broken = CountFusion(table, "nope")
    asked = broken.count_gt(1)
    broken.run()
    with pytest.raises(Exception):
        asked.result(0)


def test_maintenance(engine, spark):
    from quernel.plans.maintenance import Maintenance

    table = engine.table("t")
    for i in range(4):
        table.append(spark.createDataFrame([(i, "x")], "val int, name string"))
    table.insert([(9, "y")])
    with Maintenance(engine, interval=0.05, small_files=3, retain_seconds=-1) as keeper:
        deadline = time.time() + 60
        while not keeper.turns and time.time() < deadline:
            time.sleep(0.05)
    assert not keeper.errors and not table.pending and len(table.version.files) == 1
    assert table.snapshot().count() == 5


def test_flight_server(engine):
    flight = pytest.importorskip("pyarrow.flight")
    from quernel.sources.flight import FORMAT_HEADER, Server

    with Server(engine) as server:
        client = flight.connect(f"grpc://127.0.0.1:{server.port}")
        writer, _ = client.do_put(flight.FlightDescriptor.for_path("t"), pa.schema([("name", pa.string()), ("val", pa.int32())]))
        writer.write_batch(pa.record_batch([pa.array(["a", "b"]), pa.array([1, 2], pa.int32())], names=["name", "val"]))
        writer.close()
        out = client.do_get(flight.Ticket(b"SELECT val, name FROM t ORDER BY val")).read_all()
        assert out.to_pydict() == {"val": [1, 2], "name": ["a", "b"]}
        info = client.get_flight_info(flight.FlightDescriptor.for_command(b"SELECT val FROM t"))
        assert info.schema.names == ["val"]
        text = client.do_get(flight.Ticket(b"SELECT val FROM t ORDER BY val"), flight.FlightCallOptions(headers=[(FORMAT_HEADER.encode(), b"string")])).read_all()
        assert text.to_pydict() == {"result": ["val\n1\n2"]}
        assert [r.body.to_pybytes() for r in client.do_action(flight.Action("execute", b"DELETE FROM t WHERE val = 1"))] == [b"1"]
        with pytest.raises(flight.FlightError):
            client.do_get(flight.Ticket(b"SELECT * FROM nowhere")).read_all()


def test_results_stream_in_order(spark):
    df = spark.range(0, 25_000, 1, 5).selectExpr("id", "CAST(id AS STRING) AS s", "array(id) AS l")
    schema, parts = record_batches(df)
    table = pa.Table.from_batches(list(parts), schema=schema)
    assert table.column("id").to_pylist() == list(range(25_000)) and table.column("l")[7].as_py() == [7]
    schema, parts = record_batches(df.where("id < 0"))
    assert pa.Table.from_batches(list(parts), schema=schema).num_rows == 0


def test_flight_sql(engine):
    """The messages a Flight SQL client sends, from command to rows."""
    flight = pytest.importorskip("pyarrow.flight")
    from quernel.sources import flight_sql as fs
    from quernel.sources.flight import Server

    with Server(engine) as server:
        client = flight.connect(f"grpc://127.0.0.1:{server.port}")
        command = lambda name, *parts: flight.FlightDescriptor.for_command(fs.any_of(name, b"".join(fs.packed(*p) for p in parts)))

        def update(name, *parts):
            writer, answers = client.do_put(command(name, *parts), pa.schema([]))
            writer.done_writing()
            out = dict(fs.fields(answers.read().to_pybytes()))[1]
            writer.close()
            return out

        def rows(descriptor):
            info = client.get_flight_info(descriptor)
            table = client.do_get(info.endpoints[0].ticket).read_all()
            assert table.schema.names == info.schema.names
            return table.to_pydict()

        assert update("CommandStatementUpdate", (1, b"INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")) == 3
        assert rows(command("CommandStatementQuery", (1, b"SELECT val, name FROM t WHERE val > 1 ORDER BY val"))) == {"val": [2, 3], "name": ["b", "c"]}
        assert rows(command("CommandStatementQuery", (1, b"SELECT BFS_DISTANCE(1, val, val) FROM t"))) == {"node_id": [1], "distance": [0]}
        assert rows(command("CommandGetTables", (3, b"t%"), (5, 1)))["table_name"] == ["t"]
        assert rows(command("CommandGetTables", (3, b"u%")))["table_name"] == []
        assert rows(command("CommandGetCatalogs"))["catalog_name"] == ["quernel"]
        assert rows(command("CommandGetDbSchemas"))["db_schema_name"] == ["main"]
        assert rows(command("CommandGetTableTypes"))["table_type"] == ["TABLE", "VIEW"]
        assert rows(command("CommandGetSqlInfo"))["value"][0] == "quernel"
        # prepared: a query and an update
        def prepared(statement):
            body = fs.any_of("ActionCreatePreparedStatementRequest", fs.packed(1, statement))
            (answer,) = client.do_action(flight.Action(fs.CREATE_PREPARED, body))
            name, message = fs.unpacked(answer.body.to_pybytes())
            assert name == "ActionCreatePreparedStatementResult"
            return message[1]

        handle = prepared(b"SELECT COUNT(*) AS n FROM t")
        assert rows(command("CommandPreparedStatementQuery", (1, handle))) == {"n": [3]}
        assert update("CommandPreparedStatementUpdate", (1, prepared(b"DELETE FROM t WHERE val = 3"))) == 1
        assert rows(command("CommandPreparedStatementQuery", (1, handle))) == {"n": [2]}
        list(client.do_action(flight.Action(fs.CLOSE_PREPARED, fs.any_of("ActionClosePreparedStatementRequest", fs.packed(1, handle)))))
        with pytest.raises(flight.FlightError):
            rows(command("CommandPreparedStatementQuery", (1, handle)))
        with pytest.raises(flight.FlightError):
            rows(command("CommandStatementQuery", (1, b"SELECT * FROM nowhere")))


def test_flight_takes_only_whom_it_knows(engine):
    flight = pytest.importorskip("pyarrow.flight")
    from quernel.sources.flight import Server

    with Server(engine, verify=lambda name, password: (name, password) == ("ann", "secret")) as server:
        client = flight.connect(f"grpc://127.0.0.1:{server.port}")
        ticket = flight.Ticket(b"SELECT COUNT(*) AS n FROM t")
        with pytest.raises(flight.FlightUnauthenticatedError):
            client.do_get(ticket).read_all()
        with pytest.raises(flight.FlightUnauthenticatedError):
            client.authenticate_basic_token("ann", "wrong")
        token = client.authenticate_basic_token("ann", "secret")
        assert client.do_get(ticket, flight.FlightCallOptions(headers=[token])).read_all().to_pydict() == {"n": [0]}
