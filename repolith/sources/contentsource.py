"""Files of exported repositories as a data source of Spark: ``spark.read.format("repo_files").load(root)``."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from repolith.sources.logsource import file_system

SCHEMA = "repo_id STRING, path STRING, size BIGINT, text STRING"
#: What one task reads.
SPLIT_BYTES, SPLIT_FILES = 32 << 20, 2_000
_BATCH_BYTES = 4 << 20


@dataclass
class Files(InputPartition):
    """Files of one task: (repository, path in it, path in the file system, size)."""

    root: str
    files: list[tuple[str, str, str, int]]


class ContentReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.root, self.schema = options["path"], schema
        self.glob = options.get("glob")
        self.repos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Conditions on the repository choose folders; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("repo_id",):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repos = chosen if self.repos is None else self.repos & chosen
            else:
                yield f

    def _files(self) -> Iterator[tuple[str, str, str, int]]:
        system, root = file_system(self.root)
        root = root.rstrip("/")
        for folder in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            repo = folder.path[len(root) + 1 :]
            if folder.type != fs.FileType.Directory or (self.repos is not None and repo not in self.repos):
                continue
            for f in system.get_file_info(fs.FileSelector(folder.path, recursive=True)):
                if f.type == fs.FileType.File and (not self.glob or fnmatch.fnmatchcase(f.base_name, self.glob)):
                    yield repo, f.path[len(folder.path) + 1 :], f.path, f.size or 0

    def partitions(self) -> Sequence[Files]:
        out, size = [Files(self.root, [])], 0
        for f in self._files():
            if size + f[3] > SPLIT_BYTES or len(out[-1].files) >= SPLIT_FILES:
                out.append(Files(self.root, []))
                size = 0
            out[-1].files.append(f)
            size += f[3]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        wants_text = "text" in arrow.names
        system, _ = file_system(partition.root)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

        for repo, path, at, size in partition.files:
            text = None
            if wants_text:
                try:
                    with system.open_input_stream(at, compression=None) as stream:
                        text = stream.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    text = None
            rows.append({"repo_id": repo, "path": path, "size": size, "text": text})
            held += size
            if held >= _BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class ContentSource(DataSource):
    """Files below ``path/<repo_id>/``, those whose names start with a dot too, which Spark's own readers leave out.

    ``glob`` prunes files by name and a condition on ``repo_id`` prunes folders before any content is read; a schema without
    ``text`` opens no file at all. ``text`` is null for a file that cannot be read or is not UTF-8.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ContentReader:
        return ContentReader(self.options, schema)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContentSource)
    return spark
