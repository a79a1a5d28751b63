"""The messages of Arrow Flight SQL that a client of the engine sends, and their answers.

Flight SQL wraps protocol-buffer messages in Flight's commands, tickets and actions.  The few that are needed have
string, bytes, boolean and integer fields only, so they are read and written here field by field:
statements and prepared statements (queries and updates), catalogs, schemas, tables, table types and server information.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.plans import text as sql

# Names and field numbers of the Flight SQL protocol.
PREFIX = "type.googleapis.com/arrow.flight.protocol.sql."
CREATE_PREPARED, CLOSE_PREPARED = "CreatePreparedStatement", "ClosePreparedStatement"
INFO_NAME, INFO_VERSION, INFO_ARROW, INFO_READ_ONLY = 0, 1, 2, 3
CATALOG = "quernel"
SCHEMA = "main"


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            if at + size > len(data):
                raise ValueError("a field ends early")
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 in (1, 5):
            at += 8 if tag & 7 == 1 else 4
        else:
            raise ValueError("not a message")


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def packed(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def any_of(name: str, message: bytes) -> bytes:
    return packed(1, (PREFIX + name).encode()) + packed(2, message)


def unpacked(data: bytes | None) -> tuple[str, dict[int, bytes | int]] | None:
    """(name, fields) of a wrapped Flight SQL message; None if it is something else, such as a statement."""
    try:
        outer = dict(fields(data or b""))
        url = outer[1].decode()
        return (url.removeprefix(PREFIX), dict(fields(outer.get(2, b"")))) if url.startswith(PREFIX) else None
    except (ValueError, KeyError, IndexError, AttributeError):
        return None


def _prepared(server, handle: bytes) -> str:
    try:
        return server.prepared[handle]
    except KeyError:
        raise ValueError("no such prepared statement") from None


def planned(server, name: str, message: dict) -> tuple[pa.Schema, bytes]:
    """Schema and ticket of a command."""
    if name == "CommandStatementQuery":
        return server._schema(message[1].decode()), any_of("TicketStatementQuery", packed(1, message[1]))
    if name == "CommandPreparedStatementQuery":
        statement = _prepared(server, message[1])
        return server._schema(statement), any_of("TicketStatementQuery", packed(1, statement.encode()))
    found = catalog(server, name, message)
    return found.schema, any_of(name, b"".join(packed(n, v) for n, v in message.items()))


def answered(server, name: str, message: dict) -> str | pa.Table:
    """The statement, or the rows, that a ticket stands for."""
    if name == "TicketStatementQuery":
        return message[1].decode()
    if name == "CommandPreparedStatementQuery":
        return _prepared(server, message[1])
    return catalog(server, name, message)


def update_statement(server, name: str, message: dict) -> str:
    if name == "CommandStatementUpdate":
        return message[1].decode()
    if name == "CommandPreparedStatementUpdate":
        return _prepared(server, message[1])
    raise ValueError(f"{name} is not an update")


def update_result(count: int) -> bytes:
    return packed(1, count)


def prepare(server, body: bytes) -> bytes:
    """The answer to CreatePreparedStatement: a handle and the schema of the rows, if there are any."""
    _, message = unpacked(body) or ("", {})
    statement = message[1].decode()
    if sql.statements(statement)[0].split(None, 1)[0].upper() in ("SELECT", "WITH", "VALUES"):
        schema = server._schema(statement)
    else:
        schema = pa.schema([])
    handle = secrets.token_bytes(12)
    server.prepared[handle] = statement
    return any_of("ActionCreatePreparedStatementResult", packed(1, handle) + packed(2, schema.serialize().to_pybytes()) + packed(3, pa.schema([]).serialize().to_pybytes()))


def close(server, body: bytes) -> None:
    _, message = unpacked(body) or ("", {})
    server.prepared.pop(message.get(1), None)


def _like(pattern: bytes | None, name: str) -> bool:
    """SQL's LIKE, as the protocol's filters take it."""
    if pattern is None:
        return True
    import re

    expression = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.decode())
    return re.fullmatch(expression, name, re.S) is not None


def catalog(server, name: str, message: dict) -> pa.Table:
    engine = server.engine
    if name == "CommandGetCatalogs":
        return pa.table({"catalog_name": pa.array([CATALOG], pa.string())})
    if name == "CommandGetDbSchemas":
        shown = [SCHEMA] if _like(message.get(2), SCHEMA) else []
        return pa.table({"catalog_name": pa.array([CATALOG] * len(shown), pa.string()), "db_schema_name": pa.array(shown, pa.string())})
    if name == "CommandGetTableTypes":
        return pa.table({"table_type": pa.array(["TABLE", "VIEW"], pa.string())})
    if name == "CommandGetTables":
        kinds = {n: "TABLE" for n in engine.names()} | {n: "VIEW" for n in engine.views}
        # a repeated field keeps its last value here: a filter of one type
        names = sorted(n for n, kind in kinds.items() if _like(message.get(3), n) and message.get(4, kind.encode()) == kind.encode())
        columns = {
            "catalog_name": pa.array([CATALOG] * len(names), pa.string()),
            "db_schema_name": pa.array([SCHEMA] * len(names), pa.string()),
            "table_name": pa.array(names, pa.string()),
            "table_type": pa.array([kinds[n] for n in names], pa.string()),
        }
        if message.get(5):
            schema = lambda n: to_arrow_schema((engine.views[n] if n in engine.views else engine.table(n)).schema)
            columns["table_schema"] = pa.array([schema(n).serialize().to_pybytes() for n in names], pa.binary())
        return pa.table(columns)
    if name == "CommandGetSqlInfo":
        values = {INFO_NAME: "quernel", INFO_VERSION: "1", INFO_ARROW: pa.__version__, INFO_READ_ONLY: False}
        kinds = [pa.field("string_value", pa.string()), pa.field("bool_value", pa.bool_()), pa.field("bigint_value", pa.int64()), pa.field("int32_bitmask", pa.int32()), pa.field("string_list", pa.list_(pa.string())), pa.field("int32_to_int32_list_map", pa.map_(pa.int32(), pa.list_(pa.int32())))]
        children, types, offsets = [[] for _ in kinds], [], []
        for value in values.values():
            kind = 1 if isinstance(value, bool) else 0
            types.append(kind)
            offsets.append(len(children[kind]))
            children[kind].append(value)
        union = pa.UnionArray.from_dense(pa.array(types, pa.int8()), pa.array(offsets, pa.int32()), [pa.array(c, k.type) for c, k in zip(children, kinds, strict=True)], [k.name for k in kinds])
        return pa.Table.from_arrays([pa.array(list(values), pa.uint32()), union], names=["info_name", "value"])
    raise ValueError(f"{name} is not supported")
