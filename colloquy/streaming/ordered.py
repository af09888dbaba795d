"""Keyed folds over streams whose rows come in any order, and what runs them.

A fold is written for rows in order of their number; `OrderedFold` sees to the order. Each key's state lives in the state store:
what the fold remembers, the number that is due, and the rows that came too early. A timer by event time
ends keys that were left off, so that no state stays for good.
"""

from __future__ import annotations

import pickle
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.tables import shared_dir

PARTITIONS, PROVIDER = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a task that are packed by key at once.
PACKED = 250_000


def names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def picked(rows: Iterator[Row], columns: list[str]) -> Iterator[tuple]:
    """The columns (two at least) of rows that are alike, as tuples: a row's names are looked up once, and not at each access."""
    rows = iter(rows)
    for first in rows:
        of = itemgetter(*(first.__fields__.index(c) for c in columns))
        yield of(first)
        yield from map(of, rows)


class OrderedFold(StatefulProcessor):
    """A fold over each key's rows by `seq`, from `first` on without gaps, whatever micro-batches they come in.

    A row that comes again is ignored. Rows that come before their turn wait in the state. When the fold ends, what it remembered goes at
    once; a mark that it ended stays until no row has come for `timeout` milliseconds of event time, which also ends a fold
    that is still open. Rows have columns seq and ts, and those of ROW.
    """

    #: Schemas: what the fold remembers, the columns of a row that it reads, and of what it gives (after the key).
    STATE = ROW = OUT = ""
    first = 0
    keys = ("key",)

    def __init__(self, timeout: int = 3_600_000):
        self.timeout = timeout

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: Any) -> tuple[tuple | None, list[tuple]]:
        """(what is remembered now, None at the end; rows given) after the next row."""
        raise NotImplementedError

    def abandoned(self, state: tuple) -> list[tuple]:
        """Rows given when no more rows came."""
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: All of a key's state as one value, as each access to the store is a call to another process: where the fold is, the rows that came early
        #: (pickled as one, which costs less than a call's encoding of each), and what the fold remembers, nulls when it has ended.
        self.kept = handle.getValueState("kept", f"due long, ended boolean, timer long, early binary, {self.STATE}")
        self.columns = ["seq", *names(self.ROW)]
        self.row = namedtuple("OrderedRow", self.columns)
        self.made = Row(*self.keys, *names(self.OUT))

    def _as_row(self, key, rows: list[tuple]) -> Iterator[Row]:
        if rows:
            yield self.made(*key, *map(list, zip(*rows, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.kept.get()
        due, ended, timer, early, *state = kept or (self.first, False, 0, None, *self.begin())
        here, latest, out = {}, None, []
        for ts, *lists in picked(rows, ["ts", *self.columns]):
            latest = ts if latest is None or ts > latest else latest
            for row in zip(*lists, strict=True):
                here.setdefault(row[0], row)
        if not ended:
            state = tuple(state)
            if early:
                here = {row[0]: row for row in pickle.loads(early)} | here
            while due in here and state is not None:
                state, given = self.step(state, self.row(*here.pop(due)))
                out += given
                due += 1
            yield from self._as_row(key, out)
            left = [] if state is None else [row for seq, row in here.items() if seq > due]
            early, ended = pickle.dumps(left) if left else None, state is None
        at = max(int(latest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.timeout
        if at > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        state = [None] * len(names(self.STATE)) if ended else state
        self.kept.update((due, ended, timer, early, *state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.kept.get()
        if kept and not kept[1]:
            yield from self._as_row(key, self.abandoned(tuple(kept[4:])))
        self.kept.clear()

    def close(self) -> None:
        pass


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row by key, the first column: the latest ts, the second column, and lists of the others in order of the rows."""
    table = pa.Table.from_batches(batches).combine_chunks()
    key, ts, *others = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    latest = np.maximum.reduceat(ts.cast(pa.int64()).to_numpy(zero_copy_only=False)[order], starts)
    ends = pa.array(np.append(starts, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, c.take(pa.array(order))) for c in others]
    return pa.RecordBatch.from_arrays([key.take(pa.array(order[starts])), pa.array(latest, ts.type), *lists], names=table.column_names)


def packed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows (key, ts, ...) with one row by key of up to PACKED rows of a task: the latest ts, and the columns as lists.

    Rows go to a stateful fold one by one, and each cell by itself; a packed row costs about as much as a single one. A row that comes later than the
    watermark allows is read where it is packed with one that doesn't.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PACKED:
                yield _packed(held)
                held, n = [], 0
        if n:
            yield _packed(held)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{key} {kind[key]}", "ts timestamp", *(f"{c} array<{kind[c]}>" for c in columns)])
    return rows.select(key, "ts", *columns).repartition(key).mapInArrow(pack, schema)


def folded(rows: DataFrame, key: str, fold: OrderedFold, late: str = "10 minutes") -> DataFrame:
    """The stream of what a fold gives of rows (key, seq, ts, ...)."""
    given = [c.strip().split(" ") for c in fold.OUT.split(",")]
    out = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", *(f"{c} array<{kind}>" for c, kind in given)])
    fold.keys = (key,)
    read = packed(rows, key, ["seq", *names(fold.ROW)])
    found = read.withWatermark("ts", late).groupBy(key).transformWithState(fold, out, "Append", "EventTime")
    return found.select(key, F.inline(F.arrays_zip(*(c for c, _ in given))))


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All input that is there through a stream to Parquet at path; it goes on from the checkpoint.

    A state partition is a store that each micro-batch opens and commits, so that there are no more of them than cores when a query is first started.
    """
    spark = stream.sparkSession
    few = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    wanted = {PROVIDER: ROCKS, PARTITIONS: str(few)}  # Keyed state of several variables is kept by this store only.
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        started = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    started.awaitTermination()


def through(rows: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, batches: int = 3, closing: DataFrame | None = None) -> DataFrame:
    """rows, dealt to so many micro-batches of a stream that `build` makes; its output as a table.

    A micro-batch is as many files as there are cores, so that all of them write and read. closing: rows that come after all others and move the clock on; the stream is started anew for them, from its checkpoint. All
    is written to the shared folder.
    """
    spark: SparkSession = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    width = spark.sparkContext.defaultParallelism
    for k, part in enumerate([rows.repartition(batches * width)] + ([closing] if closing is not None else [])):
        part.write.mode("append").parquet(f"{path}-in")
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", width if k == 0 else 1000).parquet(f"{path}-in")
        stream = build(source)
        run(stream, path, f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(path)
