"""Logs that are still being written, as a Spark data source: ``growing_log``.

A file is known by the fingerprint of its first line, and read up to its last line end; what follows is
left until its line is complete. The offset of a stream holds for each file (fingerprint, bytes read,
mark of the last bytes read). A file with another fingerprint, fewer bytes, or other bytes before the
position than were read there has been replaced, and is read from its start; lines delivered twice that
way are dropped by the idempotent append, as retries are.

Planning reads the head and the tail of the files that changed. Their new bytes are split into ranges
of `range_bytes`, which tasks read on their own, each the lines that start inside its range. Beyond 256
ranges a batch's ranges grow, up to the default size: a range is a task, and small ones cost more than
their bytes.

Files are opened with Arrow's file systems (local and shared folders, hdfs, s3, gs). A file that is
replaced after its range was planned gives no lines from that range: its new content is the next batch's.
The offset has one entry per file that is there, so logs that were taken in should be moved away.

Options: `path` (a folder with all below it, or one file), `range_bytes`. A batch read delivers what the
first batch of a stream would.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "growing_log"
RANGE_BYTES = 64 << 20
RANGES = 256  # of one batch; above, they grow to RANGE_BYTES
HEAD = 4096  # bytes of the first line that tell one file from another
MARK = 256  # bytes before a position that tell whether the file was written anew
CHUNK = 1 << 20

_LINES = pa.schema([("path", pa.string()), ("position", pa.int64()), ("line", pa.string())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _short(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


def _fingerprint(handle: pa.NativeFile, size: int) -> str | None:
    """Of the first line (of its first bytes if it is longer); None while it is unfinished."""
    head = handle.read_at(min(HEAD, size), 0)
    end = head.find(b"\n")
    return _short(head if end < 0 else head[:end]) if end >= 0 or len(head) == HEAD else None


def _mark(handle: pa.NativeFile, position: int) -> str:
    at = max(0, position - MARK)
    return _short(handle.read_at(position - at, at))


def _last_line_end(handle: pa.NativeFile, size: int) -> int:
    """Bytes up to and with the last line end."""
    stop = size
    while stop > 0:
        at = max(0, stop - CHUNK)
        found = handle.read_at(stop - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        stop = at
    return 0


@dataclass
class Range(InputPartition):
    """Lines that start at `low` or later and before `high`; `head`: a line starts at `low`."""

    path: str
    fingerprint: str
    low: int
    high: int
    head: bool
    whole: int  # bytes that the file must still have

    def __post_init__(self) -> None:
        super().__init__((self.path, self.low))


def _split(news: list[tuple[str, str, int, int]], size: int) -> list[Range]:
    """Ranges of the new bytes (file, fingerprint, start, stop) of one batch."""
    total = sum(stop - start for _, _, start, stop in news)
    size = max(size, min(RANGE_BYTES, -(-total // RANGES)))
    return [Range(path, fingerprint, low, min(low + size, stop), low == start, stop)
            for path, fingerprint, start, stop in news for low in range(start, stop, size)]


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    fs, path = _open(part.path)
    try:
        handle = fs.open_input_file(path)
    except FileNotFoundError:
        return
    with handle:
        if handle.size() < part.whole or _fingerprint(handle, handle.size()) != part.fingerprint:
            return
        # a range that starts inside a line begins after that line's end
        at = part.low if part.head else part.low - 1
        skip, held = not part.head, b""
        handle.seek(at)
        while at < part.high:
            left = part.high - handle.tell()
            chunk = handle.read(min(CHUNK, left + HEAD) if left > 0 else CHUNK)
            if not chunk:
                return
            held += chunk
            end = held.rfind(b"\n") + 1
            block, rest = held[:end], held[end:]
            if skip and end:
                first = block.index(b"\n") + 1
                block, at, skip = block[first:], at + first, False
            held = rest
            if not block:
                continue
            starts = list(accumulate([len(line) + 1 for line in block.split(b"\n")[:-1]], initial=at))
            at = starts.pop()
            here = bisect_left(starts, part.high)
            lines = block.decode("utf-8", "replace").split("\n")[:here]
            if b"\r" in block:
                lines = [line.removesuffix("\r") for line in lines]
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part.path, here), pa.array(starts[:here], pa.int64()), pa.array(lines)], schema=_LINES)


class _Files:
    """The files under a path with their fingerprints and complete bytes."""

    def __init__(self, path: str):
        self.path = path
        self.seen: dict[str, tuple] = {}  # file -> (size, time of change, its entry): unchanged ones are not opened

    def entries(self) -> dict[str, list]:
        fs, path = _open(self.path)
        top = fs.get_file_info(path)
        found = [top]
        if top.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        out, seen = {}, {}
        prefix = self.path.rstrip("/") if top.type == pafs.FileType.Directory else None
        for info in found:
            inner = info.path[len(path.rstrip("/")):] if prefix is not None else ""
            if info.type != pafs.FileType.File or re.search(r"(^|/)[._]", inner):
                continue
            name = prefix + inner if prefix is not None else self.path
            stamp = (info.size, info.mtime_ns)
            if self.seen.get(name, (None,))[0] == stamp:
                entry = self.seen[name][1]
            else:
                with fs.open_input_file(info.path) as handle:
                    size = handle.size()
                    fingerprint = _fingerprint(handle, size)
                    stop = _last_line_end(handle, size) if fingerprint else 0
                    entry = [fingerprint, stop, _mark(handle, stop)] if stop else None
            seen[name] = (stamp, entry)
            if entry:
                out[name] = entry
        self.seen = seen
        return out


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        found = _Files(self.path).entries()
        return _split([(name, print_, 0, stop) for name, (print_, stop, _) in sorted(found.items())], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # an empty folder has no ranges
            yield from read_range(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.files = _Files(self.path)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self.files.entries(), sort_keys=True)}

    def _resume(self, name: str, known: list | None, now: list) -> int:
        """Where reading goes on: the position reached, or 0 for a file that was replaced."""
        if known is None or known[0] != now[0] or known[1] > now[1]:
            return 0
        if known[1] == now[1]:
            return known[1] if known[2] == now[2] else 0
        try:
            fs, path = _open(name)
            with fs.open_input_file(path) as handle:
                return known[1] if handle.size() >= known[1] and _mark(handle, known[1]) == known[2] else 0
        except FileNotFoundError:
            return known[1]  # gone since it was planned; its ranges give nothing

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return _split([(name, entry[0], self._resume(name, before.get(name), entry), entry[1])
                       for name, entry in sorted(now.items())], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_range(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, position long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLog)
