"""Zipped index files as a Spark data source: one input partition per archive member."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ROWS_PER_BATCH = 10_000


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        super().__init__((archive, name))
        self.archive, self.name = archive, name


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of a URI that Arrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def day_of(name: str) -> str | None:
    """The first eight-digit run of a file name."""
    found = re.search(r"(?<![0-9])[0-9]{8}(?![0-9])", name)
    return found and found[0]


class IndexArchives(DataSource):
    """Tab-separated lines without header, of every member of every .zip file of a folder.

    Options: `path`; `columns`, as "0:date,4:locations"; `start` and `stop`, days as
    YYYYMMDD: archives whose names carry an earlier day, or `stop` or a later one,
    are not opened. Names without a day are read.
    """

    @classmethod
    def name(cls) -> str:
        return "index_archives"

    def kept(self) -> dict[int, str]:
        pairs = (p.split(":", 1) for p in self.options["columns"].split(","))
        return {int(i): name for i, name in pairs}

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in self.kept().values()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(dict(self.options), self.kept())


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kept: dict[int, str]):
        self.path, self.kept = options["path"], kept
        self.start, self.stop = options.get("start"), options.get("stop")

    def wanted(self, name: str) -> bool:
        day = day_of(name)
        return day is None or not (self.start and day < self.start or self.stop and day >= self.stop)

    def partitions(self) -> list[InputPartition]:
        """Reads the directories of the archives only."""
        files, folder = opened(self.path)
        found = files.get_file_info(folder)
        inside = files.get_file_info(fs.FileSelector(folder)) if found.type == fs.FileType.Directory else [found]
        out: list[InputPartition] = []
        for info in sorted(inside, key=lambda i: i.path):
            if info.type == fs.FileType.File and info.path.endswith(".zip") and self.wanted(info.base_name):
                with files.open_input_file(info.path) as source, zipfile.ZipFile(source) as archive:
                    out += [Member(info.path, m.filename) for m in archive.infolist() if not m.is_dir()]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        """Inflates one member as a stream and holds one batch of its lines."""
        files, _ = opened(self.path)
        names, places = list(self.kept.values()), list(self.kept)
        block: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block)], names)

        with files.open_input_file(partition.archive) as source, zipfile.ZipFile(source) as archive:
            with archive.open(partition.name) as member:
                for line in io.TextIOWrapper(member, "utf-8", errors="replace", newline="\n"):
                    fields = line.rstrip("\r\n").split("\t")
                    block.append([fields[i] or None if i < len(fields) else None for i in places])
                    if len(block) == ROWS_PER_BATCH:
                        yield batch()
                        block = []
        if block:
            yield batch()
