"""A stream source over growing log files, whose offsets are bytes of each file.

``spark.dataSource.register(LogTail)``, then ``spark.readStream.format("log_tail").load(path)``. An offset always stands behind a newline, so
a torn last line waits for its end, and a batch that is run again after a failure reads the same bytes. A file that is shorter
than its offset, or has no newline before it, was rewritten and is read from its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "session_id string, at long, end long, line string"
_ARROW = pa.schema([("session_id", pa.string()), ("at", pa.int64()), ("end", pa.int64()), ("line", pa.string())])
#: Bytes read at a time, backwards for a newline and forwards for lines; and of a partition.
CHUNK, PART = 1 << 16, 64 << 20
#: Files of a partition, files that the driver looks at at once, and rows of a batch.
FILES, LOOKS, ROWS = 256, 16, 10_000


def last_newline(file, size: int, floor: int = 0) -> int:
    """The place behind the last newline of the first ``size`` bytes, or ``floor`` if there is none behind that."""
    at = size
    while at > floor:
        start = max(floor, at - CHUNK)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return floor


class Part(InputPartition):
    """Ranges ``name, start, end, resumed`` of one or more files; a resumed one begins at an offset that the stream keeps."""

    def __init__(self, ranges: list[tuple[str, int, int, bool]]):
        self.ranges = ranges


class LogTailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path if ":/" in path else f"file://{path}"

    def _open(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = self._open()
        files = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith(".jsonl")]

        def end(f: pafs.FileInfo) -> int:
            with fs.open_input_file(f.path) as file:
                return last_newline(file, f.size)

        with ThreadPoolExecutor(LOOKS) as pool:
            return {f.path[len(root) + 1 :]: e for f, e in zip(files, pool.map(end, files)) if e}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for name, upto in sorted(end.items()):
            from_ = start.get(name, 0)
            if from_ == upto:
                continue
            if from_ > upto:
                from_ = 0
            # large ranges are shared out, and small ones put together; a range begins and ends at lines of its own finding
            for at in range(from_, upto, PART):
                to = min(at + PART, upto)
                if held and (size + to - at > PART or len(held) == FILES):
                    parts.append(Part(held))
                    held, size = [], 0
                held.append((name, at, to, 0 < from_ == at))
                size += to - at
        return [*parts, Part(held)] if held else parts

    @staticmethod
    def _at_line(file, at: int) -> bool:
        if not at:
            return True
        file.seek(at - 1)
        return file.read(1) == b"\n"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, root = self._open()
        rows = []
        for name, start, end, resumed in part.ranges:
            session = name.rpartition("/")[2].removesuffix(".jsonl")
            with fs.open_input_file(f"{root}/{name}") as f:
                for at, to, line in self._lines(f, start, end, resumed):
                    rows.append((session, at, to, line))
                    if len(rows) == ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def _lines(self, f, start: int, end: int, resumed: bool) -> Iterator[tuple[int, int, str]]:
        """Lines that begin in a range: their places and texts."""
        at = start
        if not self._at_line(f, at):
            if resumed:
                # the file was rewritten
                at = 0
            else:
                # within a line, which is the range's before it
                f.seek(at)
                while at < end:
                    data = f.read(min(CHUNK, end - at))
                    found = data.find(b"\n")
                    at += found + 1 if found >= 0 else len(data)
                    if found >= 0 or not data:
                        break
        held = b""
        f.seek(at)
        place = at
        while True:
            # beyond the range's end only the line that stands there is read to its end
            if place >= end and (not held or held.endswith(b"\n")):
                break
            data = f.read(CHUNK if place >= end else min(CHUNK, end - place))
            if not data:
                break
            held += data
            place += len(data)
            if place >= end and (cut := held.find(b"\n", max(0, end - at - 1))) >= 0:
                held = held[: cut + 1]
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                yield at, at + len(line) + 1, line.decode("utf-8", "replace")
                at += len(line) + 1
            if at >= end:
                break

    def commit(self, end: dict) -> None:
        """Files are the source of record: nothing is to be let go."""


class LogTail(DataSource):
    """Complete lines of ``*.jsonl`` files under a folder: session_id (the file's name), byte offsets at and end, line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(self.options["path"])
