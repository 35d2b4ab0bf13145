"""A landing folder as an ordered stream: files by the number in their name, each once all before it have come.

``spark.readStream.format("numbered_files")`` offers the files from the next number on for as far as there is no gap; a
file that comes early waits in the folder, not in any state, and the offset is one number.  Tasks read the
contents, a range of numbers each.  A file called ``_end`` says that no more will come: what is left then
goes out in order, gaps and all, and ``follow`` ends the query.

Numbers are the last run of digits before the suffix; other files are not part of the stream.  Of files with
one number that which sorts first counts.
"""

from __future__ import annotations

import posixpath
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sink import opened, parts_of

SCHEMA = "index long, path string, content binary"
END = "_end"
FILES_A_TASK = 256
_NUMBER = re.compile(r"(\d+)[^\d/]*$")


class Range(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files


def listed(path: str) -> tuple[dict[int, str], bool]:
    """The files by number, and whether the end is there."""
    store, root = opened(path)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return {}, False
    parts = parts_of(store, root)
    found: dict[int, str] = {}
    for folder in [root] if parts is None else [root, *(f"{root}/{p}" for p in parts)]:
        for x in store.get_file_info(fs.FileSelector(folder)):
            name = posixpath.basename(x.path)
            number = _NUMBER.search(name)
            if x.type == fs.FileType.File and number and not name.startswith(("_", ".")):
                i = int(number[1])
                found[i] = min(x.path, found.get(i, x.path))
    return found, store.get_file_info(f"{root}/{END}").type == fs.FileType.File


class NumberedReader(DataSourceStreamReader):
    def __init__(self, path: str, files_a_task: int) -> None:
        self.path, self.files_a_task = path, files_a_task
        self.next = 0

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files, ended = listed(self.path)
        if ended:
            self.next = max([self.next - 1, *files]) + 1
        else:
            while self.next in files:
                self.next += 1
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files, _ = listed(self.path)
        due = sorted((i, p) for i, p in files.items() if start["next"] <= i < end["next"])
        return [Range(due[k : k + self.files_a_task]) for k in range(0, len(due), self.files_a_task)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for i, path in partition.files:
            with store.open_input_stream(path) as f:
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([path]), pa.array([f.read()], pa.binary())], names=["index", "path", "content"])

    def commit(self, end: dict) -> None:
        """Nothing to forget: the files stay where they are."""


class NumberedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> NumberedReader:  # noqa: N802
        return NumberedReader(self.options["path"], int(self.options.get("filesATask", FILES_A_TASK)))


def stream(spark: SparkSession, path: str, files_a_task: int = FILES_A_TASK) -> DataFrame:
    """(index, path, content) of the folder's files in the order of their numbers, batch by batch."""
    spark.dataSource.register(NumberedFiles)
    return spark.readStream.format("numbered_files").option("filesATask", files_a_task).load(path)


def finish(path: str) -> None:
    """Say that no more files will come."""
    store, root = opened(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{END}"):
        pass


def follow(query: StreamingQuery, path: str, timeout_s: float = 600, poll_s: float = 0.2) -> tuple[bool, str]:
    """Wait until the end has come and all before it has gone through; (ok, message)."""
    until = time.monotonic() + timeout_s
    while query.isActive and time.monotonic() < until:
        if listed(path)[1]:
            query.processAllAvailable()
            query.stop()
            return True, "done"
        time.sleep(poll_s)
    error = query.exception()
    if query.isActive:
        query.stop()
    return False, str(error) if error else f"stopped after {timeout_s:g} s"
