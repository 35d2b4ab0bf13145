"""Writers of whole files as Spark data sources, committed as one.

A task writes into a folder of its own and tells the driver its name; a task that runs again
writes another, and only what the driver heard of counts.  The commit moves the tasks'
folders to their place and then replaces the manifest, which lists the folders of the table: readers
see all of a job or nothing of it.  An aborted job's folders go.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def parts_of(store: fs.FileSystem, root: str) -> list[str] | None:
    """The folders that the manifest lists, null without one."""
    at = f"{root}/{MANIFEST}"
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        return json.loads(f.read())["parts"]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder and how many files are in it."""

    folder: str
    files: int


class FolderWriter(DataSourceArrowWriter):
    """Rows to files; ``put`` writes those of a task into its folder and returns their number."""

    def __init__(self, path: str, overwrite: bool, put: Callable[[fs.FileSystem, str, Iterator[pa.RecordBatch]], int]) -> None:
        self.path, self.overwrite, self.put = path, overwrite, put
        self.job = uuid.uuid4().hex

    def _jobs_own(self, root: str) -> str:
        return f"{root}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        folder = f"{self._jobs_own(root)}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        return Written(folder, self.put(store, folder, iterator))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        before = parts_of(store, root) or []
        names = []
        for message in messages:
            if isinstance(message, Written) and message.files:
                names.append(f"part-{self.job}-{len(names)}")
                store.move(message.folder, f"{root}/{names[-1]}")
        kept = names if self.overwrite else before + names
        staged = f"{root}/_manifest-{self.job}"
        with store.open_output_stream(staged) as f:
            f.write(json.dumps({"parts": kept}).encode())
        store.move(staged, f"{root}/{MANIFEST}")  # from here on the new files are the table
        for name in before if self.overwrite else []:
            store.delete_dir(f"{root}/{name}")
        self._tidy(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy(*opened(self.path))

    def _tidy(self, store: fs.FileSystem, root: str) -> None:
        """Folders of tasks that ran again or failed."""
        if store.get_file_info(self._jobs_own(root)).type == fs.FileType.Directory:
            store.delete_dir(self._jobs_own(root))


def put_files(store: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
    """Each (name, content) under its name; a null content is no file."""
    n = 0
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if content.is_valid:
                at = f"{folder}/{name}"
                if "/" in name:
                    store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(content.as_buffer())
                n += 1
    return n


class Files(DataSource):
    """``df.write.format("whole_files")``: rows of (name, content) as files below the path."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], overwrite, put_files)


def write_files(rows: DataFrame, folder: str, name_col: str = "name", content_col: str = "content", mode: str = "append") -> None:
    """Write every row's content under its name, all or nothing."""
    rows.sparkSession.dataSource.register(Files)
    rows.selectExpr(f"`{name_col}` AS name", f"`{content_col}` AS content").write.format("whole_files").mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the files that committed jobs wrote."""
    store, root = opened(folder)
    parts = parts_of(store, root)
    if not parts:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder.rstrip('/')}/{p}" for p in parts]).select("path", "length", "content")
