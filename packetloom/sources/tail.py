"""Following growing and rotated log files as a stream.

Spark's file source reads a file once.  This source remembers how far each file was read and streams the whole lines that
were added, wherever the file stands: a file is known by its first line (its first ``HEAD`` bytes, if that is longer), so one
that was renamed by rotation is read on from where it was left, and a new file under the old name begins at its
start.  Two files that begin with the same line are taken for one.  Large additions are cut into parts that tasks read
side by side.

    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("path", "file:///var/log/auth.log*").load()
"""

from __future__ import annotations

import fnmatch
import hashlib

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PART_BYTES, HEAD, LOOK_BACK = 32 << 20, 256, 1 << 16


def _system(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def _last_line_end(handle, size: int) -> int:
    """Where the last whole line ends (0 if none does)."""
    end = size
    while end > 0:
        low = max(0, end - LOOK_BACK)
        handle.seek(low)
        found = handle.read(end - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        end = low
    return 0


class _Part(InputPartition):
    def __init__(self, name: str, log: str, low: int, high: int, stop: int):
        self.name, self.log, self.low, self.high, self.stop = name, log, low, high, stop


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.system, pattern = _system(options["path"])
        self.folder, _, self.pattern = pattern.rpartition("/")
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def _files(self) -> dict[str, tuple[str, int]]:
        """Identity of each file: where it is and where its last whole line ends."""
        from pyarrow import fs

        out = {}
        for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                with self.system.open_input_file(info.path) as handle:
                    end = _last_line_end(handle, info.size)
                    handle.seek(0)
                    first = handle.read(min(HEAD, end))
                if end:
                    out[hashlib.sha256(first.split(b"\n", 1)[0][:HEAD]).hexdigest()[:16]] = (info.path, end)
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {log: end for log, (_, end) in self._files().items()}

    def partitions(self, start: dict, end: dict):
        now = self._files()
        parts = []
        for log, stop in sorted(end.items()):
            low = start.get(log, 0)
            if log in now and stop > low:
                for at in range(low, stop, self.part_bytes):
                    parts.append(_Part(now[log][0], log, at, min(at + self.part_bytes, stop), stop))
        return parts or [_Part("", "", 0, 0, 0)]

    def read(self, part: _Part):
        """The lines that begin in [low, high); a part after the first skips the line that the one before it began."""
        if part.high <= part.low:
            return
        with self.system.open_input_file(part.name) as handle:
            begin = part.low
            if begin > 0:
                handle.seek(begin - 1)
                if handle.read(1) != b"\n":
                    while begin < part.stop:
                        handle.seek(begin)
                        block = handle.read(min(LOOK_BACK, part.stop - begin))
                        found = block.find(b"\n")
                        if found >= 0:
                            begin += found + 1
                            break
                        begin += len(block)
            at, rest = begin, b""
            while begin < part.high:
                handle.seek(at)
                block = handle.read(min(1 << 20, part.stop - at))
                at += len(block)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                rows = []
                for line in lines:
                    if begin >= part.high:
                        break
                    rows.append((part.log, begin, line.rstrip(b"\r").decode("utf-8", "replace")))
                    begin += len(line) + 1
                if rows:
                    log, offset, line = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(log, pa.string()), pa.array(offset, pa.int64()), pa.array(line, pa.string())], ["log", "offset", "line"])
                if not block:
                    return

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Lines added to the files of a pattern: (log: identity of the file, offset: where the line begins, line)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "log string, offset bigint, line string"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)
