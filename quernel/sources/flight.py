"""An Arrow Flight server in front of the engine: statements out, record batches in.

A ticket or a command is a statement, bare or as a Flight SQL message (see flight_sql); a put to a path appends the
stream to the table of that name.  Results are sent partition by partition, never held whole.  A server that is
given ``verify`` takes only callers whose name and password it accepts (basic authentication, then the
bearer token that the first answer carries).

Needs pyarrow's flight module; importing this file without it fails, and nothing else imports it.
"""

from __future__ import annotations

import base64
import secrets
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.flight as flight
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.plans.engine import Engine
from quernel.sources import flight_sql
from quernel.sources.arrow import bulk_load, record_batches, text_lines

#: Rows of a stream that are appended together.
PUT_ROWS = 1_000_000
FORMAT_HEADER = "x-quernel-format"
#: Tokens that are remembered; the oldest are forgotten first.
TOKENS = 10_000


class _Headers(flight.ServerMiddleware):
    def __init__(self, as_text: bool):
        self.as_text = as_text


class _HeaderFactory(flight.ServerMiddlewareFactory):
    """Reads whether a call wants its result as one text cell."""

    def start_call(self, info, headers):
        wanted = [v for k, values in headers.items() if k.lower() == FORMAT_HEADER for v in values]
        return _Headers("string" in wanted)


class _Token(flight.ServerMiddleware):
    def __init__(self, token: str):
        self.token = token

    def sending_headers(self):
        return {"authorization": f"Bearer {self.token}"}


class _Gate(flight.ServerMiddlewareFactory):
    """Lets in who verify(name, password) accepts, and who has the token that such a call was given."""

    def __init__(self, verify: Callable[[str, str], bool]):
        self.verify, self.tokens = verify, {}

    def start_call(self, info, headers):
        sent = next((v[0] for k, v in headers.items() if k.lower() == "authorization" and v), "")
        kind, _, value = sent.partition(" ")
        if kind.lower() == "bearer" and value in self.tokens:
            return _Token(value)
        if kind.lower() == "basic":
            try:
                name, _, password = base64.b64decode(value).decode().partition(":")
            except ValueError:
                name = password = ""
            if self.verify(name, password):
                token = secrets.token_urlsafe(24)
                self.tokens[token] = name
                while len(self.tokens) > TOKENS:
                    self.tokens.pop(next(iter(self.tokens)))
                return _Token(token)
        raise flight.FlightUnauthenticatedError("a name and password, or a token, are needed")


class _Open(flight.ServerAuthHandler):
    """Takes the handshake by which clients ask for a token; the gate has looked at its headers by then."""

    def authenticate(self, outgoing, incoming):
        pass

    def is_valid(self, token):
        return ""


@contextmanager
def _reported() -> Iterator[None]:
    """A message that cannot be understood is the caller's error, told as Flight tells it."""
    try:
        yield
    except (ValueError, KeyError, IndexError) as error:
        raise flight.FlightServerError(str(error)) from None


class Server(flight.FlightServerBase):
    def __init__(self, engine: Engine, location: str = "grpc://127.0.0.1:0", verify: Callable[[str, str], bool] | None = None, **options):
        middleware = {"format": _HeaderFactory()} | ({"gate": _Gate(verify)} if verify else {})
        if verify:
            options.setdefault("auth_handler", _Open())
        super().__init__(location, middleware=middleware, **options)
        self.engine = engine
        self.prepared: dict[bytes, str] = {}

    def _execute(self, statement: str):
        result = self.engine.execute(statement)
        if result.is_error:
            raise flight.FlightServerError(result.message)
        return result

    def _stream(self, statement: str) -> flight.FlightDataStream:
        result = self._execute(statement)
        if result.data is None:
            return flight.RecordBatchStream(pa.table({"affected_rows": pa.array([result.affected_rows or 0], pa.int64()), "message": [result.message]}))
        schema, batches = record_batches(result.data)
        return flight.GeneratorStream(schema, batches)

    def _text(self, statement: str) -> flight.FlightDataStream:
        """The result as text: lines of about a MB a row, an error as its message."""
        result = self.engine.execute(statement)
        schema = pa.schema([("result", pa.string())])
        if result.data is None:
            return flight.RecordBatchStream(pa.table({"result": [result.message]}, schema=schema))

        def cells() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for line in text_lines(result.data):
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)])], schema=schema)
                    held, size = [], 0
                held.append(line)
                size += len(line)
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)])], schema=schema)

        return flight.GeneratorStream(schema, cells())

    def _schema(self, statement: str) -> pa.Schema:
        """Of a query, without running it."""
        if statement.lstrip("( \t\r\n")[:6].upper() in ("SELECT", "VALUES") or statement.lstrip()[:4].upper() == "WITH":
            try:
                return to_arrow_schema(self.engine.infer_schema(statement))
            except Exception as error:
                raise flight.FlightServerError(f"SQL Error: {error}") from None
        return pa.schema([("affected_rows", pa.int64()), ("message", pa.string())])

    def get_flight_info(self, context, descriptor):
        message = flight_sql.unpacked(descriptor.command)
        if message is None:
            statement = descriptor.command.decode()
            return flight.FlightInfo(self._schema(statement), descriptor, [flight.FlightEndpoint(descriptor.command, [])], -1, -1)
        with _reported():
            schema, ticket = flight_sql.planned(self, *message)
        return flight.FlightInfo(schema, descriptor, [flight.FlightEndpoint(ticket, [])], -1, -1)

    def get_schema(self, context, descriptor):
        return flight.SchemaResult(self.get_flight_info(context, descriptor).schema)

    def do_get(self, context, ticket):
        message = flight_sql.unpacked(ticket.ticket)
        if message is not None:
            with _reported():
                found = flight_sql.answered(self, *message)
            if isinstance(found, pa.Table):
                return flight.RecordBatchStream(found)
            statement = found
        else:
            statement = ticket.ticket.decode()
        header = context.get_middleware("format")
        return self._text(statement) if header is not None and header.as_text else self._stream(statement)

    def do_put(self, context, descriptor, reader, writer):
        if descriptor.descriptor_type == flight.DescriptorType.CMD:
            message = flight_sql.unpacked(descriptor.command)
            if message is None:
                raise flight.FlightServerError("a put needs a path or a Flight SQL update")
            with _reported():
                statement = flight_sql.update_statement(self, *message)
            writer.write(flight_sql.update_result(self._execute(statement).affected_rows or 0))
            return
        table = self.engine.table(descriptor.path[0].decode())
        held, rows = [], 0
        for chunk in reader:
            held.append(chunk.data)
            rows += chunk.data.num_rows
            if rows >= PUT_ROWS:
                bulk_load(table, pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            bulk_load(table, pa.Table.from_batches(held))

    def list_actions(self, context):
        return [("execute", "run a statement; the rows it changed"), (flight_sql.CREATE_PREPARED, "Flight SQL"), (flight_sql.CLOSE_PREPARED, "Flight SQL")]

    def do_action(self, context, action):
        body = action.body.to_pybytes()
        if action.type == "execute":
            yield flight.Result(str(self._execute(body.decode()).affected_rows or 0).encode())
        elif action.type == flight_sql.CREATE_PREPARED:
            with _reported():
                answer = flight_sql.prepare(self, body)
            yield flight.Result(answer)
        elif action.type == flight_sql.CLOSE_PREPARED:
            flight_sql.close(self, body)
        else:
            raise flight.FlightServerError(f"unknown action {action.type}")
