"""NDJSON as a data source of its own: files that still grow, read as a stream by position, and written with commit and abort.

Spark's file sources take a file as finished when they see it. A model service's log is not: here a stream's offset is how far each file
was read, and a line belongs to the batch in which its end lies, so that an unfinished line waits. `frames.ndjson_chunks` splits the lines into
chunks and rejects. The path is one that the driver and all executors reach by the same name: a mounted folder or a URI that Arrow knows.

Register with `spark.dataSource.register(NdjsonFiles)`; then `format("ndjson_files")` reads (file, position, line) and writes a column `line`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads.
SPLIT = 64 * 2**20
BLOCK = 2**16


@dataclass
class Span(InputPartition):
    """The lines of a file whose ends lie from start on, before end."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    lines: int


def lines_of(store: fs.FileSystem, span: Span) -> Iterator[tuple[str, int, str]]:
    with store.open_input_file(span.file) as f:
        begin = span.start
        while begin > 0:  # back to the end of the line before
            size = min(BLOCK, begin)
            f.seek(begin - size)
            found = f.read(size).rfind(b"\n")
            if found >= 0:
                begin += found + 1 - size
                break
            begin -= size
        f.seek(begin)
        rest, at, left = b"", begin, span.end - begin
        while left > 0 and (block := f.read(min(BLOCK, left))):
            left -= len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                yield span.file, at, line.decode("utf-8", "replace")
                at += len(line) + 1


class _Files:
    def __init__(self, options: dict):
        self.path = options["path"]

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def sizes(self) -> dict[str, int]:
        store, root = self._opened()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {x.path: x.size for x in found if x.type == fs.FileType.File and x.base_name.endswith(".ndjson") and not x.base_name.startswith((".", "_"))}

    def spans(self, start: dict, end: dict) -> list[Span]:
        return [Span(file, a, min(a + SPLIT, size)) for file, size in sorted(end.items()) for a in range(start.get(file, 0), size, SPLIT)]

    def read(self, partition: Span | None) -> Iterator[tuple[str, int, str]]:
        """None stands for a folder without files."""
        return lines_of(self._opened()[0], partition) if partition else iter(())


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans({}, self.sizes())


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start, end)


class _Writer(_Files, DataSourceWriter, DataSourceStreamWriter):
    """Each task writes a hidden file; a commit shows them all by names of the batch, so that a batch that runs again takes its own place."""

    def write(self, iterator) -> Written:
        store, root = self._opened()
        store.create_dir(root)
        file, n = f"{root}/.{uuid.uuid4().hex}.ndjson", 0
        try:
            with store.open_output_stream(file) as f:
                for row in iterator:
                    if row.line is not None:
                        f.write(row.line.encode() + b"\n")
                        n += 1
        except BaseException:
            store.delete_file(file)
            raise
        return Written(file, n)

    def commit(self, messages: list, batchId: int | None = None) -> None:
        store, root = self._opened()
        batch = uuid.uuid4().hex if batchId is None else f"{batchId:010d}"
        for old in [f for f in self.sizes() if f.rsplit("/", 1)[1].startswith(f"batch-{batch}-")]:
            store.delete_file(old)
        for k, message in enumerate(m for m in messages if m is not None):
            if message.lines:
                store.move(message.file, f"{root}/batch-{batch}-{k:06d}.ndjson")
            else:
                store.delete_file(message.file)

    def abort(self, messages: list, batchId: int | None = None) -> None:
        store, _ = self._opened()
        for message in messages:
            if message is not None:
                store.delete_file(message.file)


class NdjsonFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ndjson_files"

    def schema(self) -> str:
        return "file string, position long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options)
