"""Streams into tables, fused small writes, and fused counting queries."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Sequence
from concurrent.futures import Future

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.relational import shared_threshold_counts
from quernel.sources.arrow import aligned
from quernel.sources.files import Store
from quernel.sources.table import Table


def stream_into(stream: DataFrame, table: Table, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream's micro-batches to a table, columns aligned and padded; once: take what is there and stop.

    The manifest that adds a batch's rows names the stream (the id in its checkpoint) and the batch, so a batch that
    runs again after a failure is appended once, wherever the failure was.
    """

    def append(batch: DataFrame, number: int) -> None:
        name = json.loads(Store(table.spark, checkpoint).read("metadata"))["id"]
        table.refresh()
        table.append(aligned(batch, table.schema), stream=name, batch=number)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Writer:
    """A queue of inserts and flushes with one consumer; inserts that wait together become one append.  A Future is done
    once its row stands in the table's log."""

    FUSED = 1000

    def __init__(self, table: Table):
        self.table, self.queue, self.batches = table, queue.Queue(), 0
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def insert(self, row: Sequence) -> Future:
        return self._put(("insert", tuple(row)))

    def flush(self) -> Future:
        return self._put(("flush", None))

    def _put(self, command: tuple) -> Future:
        done: Future = Future()
        self.queue.put((*command, done))
        return done

    def close(self) -> None:
        self.queue.put(None)
        self.thread.join()

    def _run(self) -> None:
        while (first := self.queue.get()) is not None:
            commands = [first]
            while len(commands) < self.FUSED and not self.queue.empty():
                if (more := self.queue.get()) is None:
                    self.queue.put(None)
                    break
                commands.append(more)
            at = 0
            while at < len(commands):
                kind = commands[at][0]
                stop = at + 1
                while stop < len(commands) and commands[stop][0] == kind:
                    stop += 1
                self._apply(kind, commands[at:stop])
                at = stop

    def _apply(self, kind: str, commands: list[tuple]) -> None:
        try:
            if kind == "insert":
                self.table.insert([row for _, row, _ in commands])
                self.batches += 1
            else:
                self.table.flush()
            for *_, done in commands:
                done.set_result(len(commands))
        except Exception as error:
            for *_, done in commands:
                done.set_exception(error)


class CountFusion:
    """Counting queries that are asked together share one scan: at most FUSED thresholds a pass.

    start() has a thread answer them as they come; without it run() answers what was asked.  A scan that fails
    fails its own queries only."""

    FUSED = 100

    def __init__(self, table: Table, column: str):
        self.table, self.column, self.passes = table, column, 0
        self.asked: queue.Queue = queue.Queue()
        self.thread: threading.Thread | None = None

    def count_gt(self, threshold: int) -> Future:
        done: Future = Future()
        self.asked.put((threshold, done))
        return done

    def start(self) -> CountFusion:
        self.thread = threading.Thread(target=self._serve, daemon=True)
        self.thread.start()
        return self

    def close(self) -> None:
        """Answer what was asked and end the thread."""
        if self.thread is not None:
            self.asked.put(None)
            self.thread.join()
            self.thread = None

    def __enter__(self) -> CountFusion:
        return self if self.thread is not None else self.start()

    def __exit__(self, *_) -> None:
        self.close()

    def run(self) -> None:
        while part := self._waiting([]):
            self._answer(part)

    def _waiting(self, part: list) -> list:
        """part and what else waits, up to a pass."""
        while len(part) < self.FUSED and not self.asked.empty():
            if (more := self.asked.get()) is None:
                self.asked.put(None)
                break
            part.append(more)
        return part

    def _serve(self) -> None:
        while (first := self.asked.get()) is not None:
            self._answer(self._waiting([first]))

    def _answer(self, part: list[tuple[int, Future]]) -> None:
        try:
            found = {r.threshold: r.cnt for r in shared_threshold_counts(self.table.snapshot(), self.column, sorted({t for t, _ in part})).collect()}
            self.passes += 1
            for threshold, done in part:
                done.set_result(found[threshold])
        except Exception as error:
            for _, done in part:
                if not done.done():
                    done.set_exception(error)


def count_gt(table: DataFrame, column: str, threshold) -> int:
    return table.where(F.col(column) > threshold).count()


def count_eq(table: DataFrame, column: str, value) -> int:
    return table.where(F.col(column) == value).count()
