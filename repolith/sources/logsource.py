"""Exported commit logs as a data source of Spark: ``spark.read.format("commit_log").load(path)``."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

COMMIT_MARK = "---COMMIT---"
FIELD_MARK = "\x1e"
FIELDS = 7
SCHEMA = (
    "repo_id STRING, position BIGINT, commit_id STRING, author STRING, email STRING, date STRING, committed_at TIMESTAMP_NTZ, "
    "subject STRING, body STRING, is_merge BOOLEAN, stats ARRAY<STRING>, _corrupt STRING"
)
SPLIT_BYTES = 64 << 20
#: Small splits are read several to a task, up to so many bytes; to open a file counts as some bytes.
TASK_BYTES, OPEN_BYTES = 16 << 20, 16 << 10
_READ, _BATCH = 1 << 20, 2_000
_DATE = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [+-]\d{4}")
_MARK, _FIELD = COMMIT_MARK.encode(), FIELD_MARK.encode()


@dataclass
class LogSplit(InputPartition):
    """Records whose front border, the end of the mark before them, lies in [start, end) of a file."""

    root: str
    path: str
    start: int
    end: int


@dataclass
class LogSplits(InputPartition):
    """Splits that one task reads, one after the other."""

    splits: list[LogSplit]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, for a plain path or any URI that Arrow knows."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(root: str) -> list[fs.FileInfo]:
    """Files at or below ``root`` by path; names that start with a dot or an underscore are not data."""
    system, path = file_system(root)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    data = [i for i in found if i.type == fs.FileType.File and not re.search(r"/[._][^/=]*$", i.path)]
    return sorted(data, key=lambda i: i.path)


def repository_of(path: str) -> str:
    """The folder ``repo_id=...`` a file lies in, else its base name without its extension."""
    folder = re.search(r"(?:^|/)repo_id=([^/]+)/", path)
    return unquote(folder[1]) if folder else re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])


class _Window:
    """Bytes of a file from some place on, read as far as asked."""

    def __init__(self, stream, at: int, ask: int = _READ):
        self.stream, self.at, self.ask, self.data, self.done = stream, at, ask, bytearray(), False

    def find(self, token: bytes, begin: int) -> int:
        """Index in ``data`` of the next ``token``, -1 at the end of the file."""
        while True:
            found = self.data.find(token, begin)
            if found >= 0 or self.done:
                return found
            begin = max(begin, len(self.data) - len(token) + 1)
            more = self.stream.read(self.ask)
            self.done = not more
            self.data += more

    def drop(self, n: int) -> None:
        self.at += n
        del self.data[:n]


def records(stream, start: int, end: int) -> Iterator[tuple[int, bytes | None, bytes]]:
    """Position, header and statistics of the records of a split.

    What stands between two marks is the statistics of one record and the header of the next, which starts with
    the first line that has a field mark. A record belongs to the split that holds the end of the mark in front
    of it. It is read to its end, however far beyond the split; nothing is ever read in front of it.
    """
    begin = max(0, start - len(_MARK))
    if begin:
        stream.seek(begin)
    window, here = _Window(stream, begin, min(_READ, max(1 << 12, end - begin))), 0
    if start:
        mark = window.find(_MARK, 0)
        if mark < 0:
            return
        here = mark + len(_MARK)
    while window.at + here < end:
        mark = window.find(_MARK, here)
        unit = bytes(window.data[here : mark if mark >= 0 else len(window.data)])
        header, stats = _header(unit), b""
        if mark >= 0:
            after = mark + len(_MARK)
            following = window.find(_MARK, after)
            tail = bytes(window.data[after : following if following >= 0 else len(window.data)])
            stats = tail[: len(tail) - len(_header(tail) or b"")]
        if header is not None:
            yield window.at + here + len(unit) - len(header), header, stats
        if mark < 0:
            return
        here = mark + len(_MARK)
        if here > _READ:
            window.drop(here)
            here = 0


def _header(unit: bytes) -> bytes | None:
    field = unit.find(_FIELD)
    return None if field < 0 else unit[unit.rfind(b"\n", 0, field) + 1 :]


def _row(repo: str, position: int, header: bytes, stats: bytes) -> dict:
    text = header.decode("utf-8", "replace").strip(" \t\r\n\f\v")
    parts = text.split(FIELD_MARK)
    row = {"repo_id": repo, "position": position, "stats": stats.decode("utf-8", "replace").split("\n")}
    if len(parts) < FIELDS:
        return row | {"_corrupt": text}
    when = None
    if _DATE.fullmatch(parts[3]):
        try:
            when = dt.datetime.fromisoformat(parts[3].replace(" +", "+").replace(" -", "-")).astimezone(dt.UTC).replace(tzinfo=None)
        except (ValueError, OverflowError):
            when = None
    row |= dict(zip(("commit_id", "author", "email", "date", "subject", "body"), parts, strict=False))
    return row | {
        "body": parts[5].strip(" \t\r\n\f\v"),
        "committed_at": when,
        "is_merge": " " in parts[6],
        "_corrupt": text if when is None else None,
    }


def _read(split: LogSplit, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of a split, only the columns of ``schema``."""
    if split.end <= split.start:
        return
    arrow = to_arrow_schema(schema)
    system, _ = file_system(split.root)
    packed = split.path.endswith((".gz", ".zst", ".bz2"))
    stream = system.open_input_stream(split.path) if packed else system.open_input_file(split.path)
    repo, rows = repository_of(split.path), []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    with stream:
        for position, header, stats in records(stream, split.start, split.end):
            rows.append(_row(repo, position, header, stats))
            if len(rows) == _BATCH:
                yield batch()
                rows = []
    if rows:
        yield batch()


class CommitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root, self.schema = options["path"], schema
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.repos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Conditions on the repository choose files; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("repo_id",):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repos = chosen if self.repos is None else self.repos & chosen
            else:
                yield f

    def partitions(self) -> Sequence[LogSplits]:
        files = [f for f in list_files(self.root) if self.repos is None or repository_of(f.path) in self.repos]
        return packed(splits(self.root, files, self.split_bytes), self.tasks)

    def read(self, partition: LogSplits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            yield from _read(split, self.schema)


def splits(root: str, files: list[fs.FileInfo], size: int) -> list[LogSplit]:
    out = []
    for f in files:
        if f.path.endswith((".gz", ".zst", ".bz2")):  # cannot be entered in the middle
            out.append(LogSplit(root, f.path, 0, 1 << 62))
        else:
            out += [LogSplit(root, f.path, at, min(at + size, f.size)) for at in range(0, f.size, size)]
    # a plan needs one split at least
    return out or [LogSplit(root, "", 0, 0)]


def packed(found: list[LogSplit], tasks: int) -> list[LogSplits]:
    """Splits in their order, as many to a task as fit ``TASK_BYTES``, but enough of these for ``tasks``."""
    weight = [OPEN_BYTES + min(s.end - s.start, TASK_BYTES) for s in found]
    most = min(TASK_BYTES, -(-sum(weight) // max(1, tasks)))
    out, room = [], 0
    for split, w in zip(found, weight):
        if not out or w > room:
            out.append(LogSplits([]))
            room = most
        out[-1].splits.append(split)
        room -= w
    return out


class CommitLogStreamReader(DataSourceStreamReader):
    """New files by the time they were written; the offset is the last such time and the files of that time."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root, self.schema = options["path"], schema
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        files = list_files(self.root)
        at = max((f.mtime_ns for f in files), default=-1)
        return {"at": at, "files": [f.path for f in files if f.mtime_ns == at]}

    def partitions(self, start: dict, end: dict) -> Sequence[LogSplit]:
        new = [f for f in list_files(self.root) if _after(f, start) and not _after(f, end)]
        return splits(self.root, new, self.split_bytes)

    def read(self, partition: LogSplit) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema)


def _after(f: fs.FileInfo, offset: dict) -> bool:
    return f.mtime_ns > offset["at"] or (f.mtime_ns == offset["at"] and f.path not in offset["files"])


class CommitLogSource(DataSource):
    """Commit logs below ``path``, one repository to a file or a folder ``repo_id=...``.

    ``splitBytes`` bounds a split; a task reads one that is large, or several small ones, and ``tasks`` says for how many
    tasks there should be splits. A schema of fewer columns parses and sends those only; a condition
    on ``repo_id`` leaves other files unopened. ``position`` is the place of the record in its file, in bytes. A
    record that cannot be read whole has its text in ``_corrupt``: with too few fields nothing else is set, with a
    date that is none only the time is missing.
    """

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> CommitLogReader:
        return CommitLogReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> CommitLogStreamReader:  # noqa: N802
        return CommitLogStreamReader(self.options, schema)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLogSource)
    return spark
