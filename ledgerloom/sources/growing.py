"""Logs that grow, as a stream: a Python data source whose offset tells, for every file, which content it was and up to which byte it was read.

``spark.dataSource.register(GrowingLogs)``, then ``spark.readStream.format("growing_logs").option("path", folder).load()`` gives
(file, identity, start, value): every new complete line with the byte that it starts at. A line without its end waits. With option ``unfinished`` =
``transcript`` a file is read only up to the first line of a message at its end that has no stop reason yet, so that a message's lines always come in one batch.

A file's identity is a hash of its first line. A file that has another first line, or is shorter than what was read of it, was replaced: it is read anew from its
start, under its new identity. (One replaced by a longer one with the same first line can't be told from one that grew.) A file that is gone is forgotten.

The driver lists the folder and, of files whose size changed, reads the first line and the end, in steps from the back until it knows where to stop; lines are read
by the tasks, a long piece in parts of ``part_bytes`` that begin at the first line that starts in them. Each part of a batch is read by offset, so a lost task is
simply run again. Files are opened through ``pyarrow.fs``, so any of its file systems will do.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, identity string, start bigint, value string"
PART_BYTES, TAIL_BYTES, FIRST_LINE_BYTES = 32 << 20, 1 << 16, 1 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """The lines of a file that start from ``begin`` up to before ``end``; the file is read up to ``last`` at most."""

    file: str
    identity: str
    begin: int
    end: int
    last: int
    first: int  # where the batch's piece of the file starts


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.part_bytes, self.unfinished = int(options.get("part_bytes", PART_BYTES)), options.get("unfinished", "")
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """file -> [identity, byte] of all files with a complete line."""
        from pyarrow import fs

        system, root = _system(self.path)
        out, seen = {}, {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.base_name.endswith(self.suffix) or not info.size:
                continue
            known = self.seen.get(info.path)
            if known is None or known[:2] != (info.size, info.mtime_ns):
                with system.open_input_file(info.path) as f:
                    identity = self._identity(f)
                    known = (info.size, info.mtime_ns, identity, self._stop(f, info.size))
            seen[info.path] = known
            if known[2] is not None:
                out[info.path] = [known[2], known[3]]
        self.seen = seen
        return out

    @staticmethod
    def _identity(f) -> str | None:
        """Hash of the first line (of its first bytes, if it is very long); none before it is complete."""
        f.seek(0)
        head = f.read(FIRST_LINE_BYTES)
        at = head.find(b"\n")
        return None if at < 0 and len(head) < FIRST_LINE_BYTES else f"{zlib.crc32(head[:at] if at >= 0 else head):08x}"

    def _stop(self, f, size: int) -> int:
        """The byte up to which the file can be read: past its last complete line, or before an unfinished message there."""
        begin = size
        while True:
            begin = max(0, begin - TAIL_BYTES if begin == size else begin - (size - begin))
            f.seek(begin)
            tail = f.read(size - begin)
            end = tail.rfind(b"\n") + 1
            if end:
                first = 0 if begin == 0 else tail.find(b"\n") + 1  # the first line that is whole
                stop = end if self.unfinished != "transcript" else _before_unfinished(tail[first:end], begin == 0)
                if stop is not None:
                    return begin + (stop if self.unfinished != "transcript" else first + stop)
            if begin == 0:
                return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for file, (identity, stop) in sorted(end.items()):
            old = start.get(file)
            begin = old[1] if old and old[0] == identity and old[1] <= stop else 0
            parts += [Part(file, identity, at, min(at + self.part_bytes, stop), stop, begin) for at in range(begin, stop, self.part_bytes)]
        return parts

    def read(self, partition: Part):
        """Lines that start in the part: one that began before it belongs to the part before."""
        system, _ = _system(self.path)
        with system.open_input_file(partition.file) as f:
            at = partition.begin
            if at > partition.first:  # is the byte before a line's end?
                f.seek(at - 1)
                at = at - 1 + len(_read_line(f, partition.last))
            f.seek(at)
            while at < partition.end:
                line = _read_line(f, partition.last)
                if not line:
                    break
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.strip():
                    yield partition.file, partition.identity, at, text
                at += len(line)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _read_line(f, last: int) -> bytes:
    """From the file's place up to a line's end, not beyond ``last``."""
    out = []
    while (at := f.tell()) < last:
        block = f.read(min(1 << 16, last - at))
        cut = block.find(b"\n")
        if cut >= 0:
            out.append(block[: cut + 1])
            f.seek(at + cut + 1)
            break
        if not block:
            break
        out.append(block)
    return b"".join(out)


def _before_unfinished(lines: bytes, whole: bool) -> int | None:
    """Where to stop in a file's last lines: before the first line of the last assistant message if that has no stop reason yet. None: what decides lies further up."""
    ends, at, found = [], 0, None
    for line in lines.splitlines(keepends=True):
        ends.append((at, line))
        at += len(line)
    for begin, line in reversed(ends):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if not isinstance(row, dict) or row.get("type") != "assistant" or not isinstance(row.get("message"), dict):
            continue
        own = row["message"].get("id") or row.get("uuid")
        if found is None:
            if row["message"].get("stop_reason"):
                return at
            found = (own, begin)
        elif own == found[0]:
            if row["message"].get("stop_reason"):
                return at
            found = (own, begin)
        else:
            return found[1]
    return (found[1] if found else at) if whole else None
