"""Application logs as a data source: ``ts [level]: message`` records with the lines that follow them, by batch, by stream, or the tail of each file.

``spark.dataSource.register(LogSource)``, then ``spark.read.format("applog").load(path)``; options: ``tail`` (the last so many lines of each file, read from its
end), ``split`` (bytes of a partition). A large file is many partitions: a record belongs to the one that its first line begins in. A stream gives a record out
once the next one has begun, for until then it may still grow; its offsets are bytes by file, so a restart reads nothing twice.

Files are reached through Arrow's file systems, by path or URI. Blank lines are passed over; lines before the first record of a file (or of its tail) belong to none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos long, at string, level string, message string"
HEAD = re.compile(rb"^(\S+(?: \S+)?) \[(\w+)\]: ?(.*)$")
CHUNK, SPLIT, MOST_TAIL = 1 << 16, 32 << 20, 1000


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file or of a folder's files, in order; names that begin with _ or . are passed over."""
    system, root = _system(path)
    found = system.get_file_info(root)
    every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in every if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Span(InputPartition):
    """Bytes of one file: records that begin in them, or the last ``tail`` lines before ``end``."""

    def __init__(self, file: str, begin: int, end: int, tail: int = 0):
        self.file, self.begin, self.end, self.tail = file, begin, end, tail


def _lines(f, begin: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines from a byte on."""
    f.seek(begin)
    rest, at = b"", begin
    while chunk := f.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def _tail_begin(f, size: int, lines: int) -> int:
    """Where the last so many lines that aren't blank begin, read from the end in chunks."""
    at, held = size, b""
    while at > 0:
        step = min(CHUNK, at)
        at -= step
        f.seek(at)
        held = f.read(step) + held
        if sum(bool(x.strip()) for x in held.split(b"\n")[1:]) >= lines:
            break
    marks = [m.start() for m in re.finditer(rb"(?m)^[^\n]*\S[^\n]*$", held)]
    # the first line of what was read may be cut, unless it is the file's first
    marks = marks if at == 0 else [m for m in marks if m > 0]
    return at + marks[-lines] if len(marks) >= lines else at + (marks[0] if marks else len(held))


def records(path: str, span: Span) -> Iterator[tuple]:
    """The records of a span; one that begins in it is read to its own end."""
    system, _ = _system(path)
    with system.open_input_file(span.file) as f:
        begin = _tail_begin(f, span.end, span.tail) if span.tail else span.begin
        if begin and not span.tail:
            # a line that begins at ``begin`` follows a line end
            f.seek(begin - 1)
            lines = _lines(f, begin - 1)
            next(lines, None)
        else:
            lines = _lines(f, begin)
        now = None
        for at, line in lines:
            head = HEAD.match(line.rstrip(b"\r"))
            if head is None:
                if now is not None and line.strip():
                    now[4].append(line.rstrip(b"\r"))
                continue
            if now is not None:
                yield _row(now)
                now = None
            if at >= span.end:
                break
            now = (span.file, at, head[1], head[2].lower(), [head[3]])
        if now is not None:
            yield _row(now)


def _row(r: tuple) -> tuple:
    text = lambda b: b.decode("utf-8", "replace")
    return r[0], r[1], text(r[2]), text(r[3]), text(b"\n".join(r[4]))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.tail = min(MOST_TAIL, max(0, int(options.get("tail", 0))))

    def partitions(self) -> list[Span]:
        if self.tail:
            return [Span(f, 0, size, self.tail) for f, size in _files(self.path)]
        return [Span(f, at, min(size, at + self.split)) for f, size in _files(self.path) for at in range(0, size, self.split)]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from records(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """By file, where its last record begins: that one isn't over yet."""
        out = {}
        for file, size in _files(self.path):
            with _system(self.path)[0].open_input_file(file) as f:
                at, held = size, b""
                while at > 0:
                    step = min(CHUNK, at)
                    at -= step
                    f.seek(at)
                    held = f.read(step) + held
                    heads = [m.start() for m in re.finditer(rb"(?m)^\S+(?: \S+)? \[\w+\]:", held) if m.start() or not at]
                    if heads:
                        out[file] = at + heads[-1]
                        break
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(f, start.get(f, 0), to) for f, to in sorted(end.items()) if to > start.get(f, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from records(self.path, partition)


class LogSource(DataSource):
    """``applog``: see the module."""

    @classmethod
    def name(cls) -> str:
        return "applog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def selected(found: DataFrame, level: str | None = None, contains: str | None = None) -> DataFrame:
    """Records of a level whose message contains a text, whatever its case."""
    if level:
        found = found.where(F.col("level") == level.lower())
    return found.where(F.contains(F.lower("message"), F.lit(contains.lower()))) if contains else found


def statistics(found: DataFrame, day: Column | None = None) -> DataFrame:
    """(level, n, oldest, newest) of the records, or of those of a day (``yyyy-MM-dd``)."""
    rows = found if day is None else found.where(F.substring("at", 1, 10) == day)
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


def recent_errors(found: DataFrame, most: int = 10) -> DataFrame:
    """(at, message) of the newest errors."""
    return found.where("level = 'error'").orderBy(F.desc("at"), F.desc("file"), F.desc("pos")).limit(most).select("at", "message")
