"""Landed page files as a Spark data source, for batch and stream alike.

``spark.dataSource.register(LandedPages)`` makes ``spark.read.format("landed_pages").load(folder)`` and the same with ``readStream``. Every page has its place in one
total order, the same both ways: time of landing, file, position in the file. A source's mapper gets (ingested_at, file, position, body).

Options: ``lines`` (true: each line is a page; false, the default: each file is one), ``glob`` (a file name pattern), ``split_mb`` (files
read by one task). Folders are listed by Arrow's file systems, so a path may be local, on a shared mount, or a URI such as ``s3://``.
Hidden files and markers (names that start with ``.`` or ``_``) are no pages. A stream's offset is the (time, file) of the last one taken, so
files must land under their final name with a time that doesn't fall behind; those of one instant are ordered by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "ingested_at TIMESTAMP, file STRING, position BIGINT, body STRING"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Folder:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.lines = options.get("lines", "false").lower() == "true"
        self.glob = options.get("glob", "*")
        self.split = int(float(options.get("split_mb", "64")) * (1 << 20))

    def _store(self):
        from pyarrow import fs

        if "://" in self.root:
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root.removeprefix("file:")

    def landed(self) -> list[tuple[int, str, int]]:
        """(time in microseconds, file, size) of all pages, in order."""
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        pages = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch(f.base_name, self.glob)]
        return sorted((f.mtime_ns // 1000, f.path, f.size) for f in pages)

    def split_up(self, files: list[tuple[int, str, int]]) -> list[_Files]:
        parts, held = [], 0
        for time, path, size in files:
            if not parts or held + size > self.split:
                parts.append([])
                held = 0
            parts[-1].append((time, path))
            held += size
        return [_Files(p) for p in parts]

    def rows(self, part: _Files) -> Iterator[tuple]:
        store, _ = self._store()
        for time, path in part.files:
            when = datetime.fromtimestamp(time / 1_000_000, timezone.utc)
            with store.open_input_stream(path) as file:
                if not self.lines:
                    yield when, path, 0, file.read().decode("utf-8", "replace")
                    continue
                position, rest = 0, b""
                while block := file.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    for line in whole:
                        yield when, path, position, line.decode("utf-8", "replace")
                        position += 1
                if rest:
                    yield when, path, position, rest.decode("utf-8", "replace")


class _Reader(DataSourceReader, _Folder):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)

    def partitions(self) -> list[_Files]:
        return self.split_up(self.landed()) or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.rows(partition)


class _StreamReader(DataSourceStreamReader, _Folder):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        pages = self.landed()
        return {"time": pages[-1][0], "file": pages[-1][1]} if pages else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        after, upto = ((o["time"], o["file"]) for o in (start, end))
        return self.split_up([f for f in self.landed() if after < f[:2] <= upto]) or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
