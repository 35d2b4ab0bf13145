"""Where intermediate tables go: the folder that every executor shares."""

from __future__ import annotations

import contextlib
import threading
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path, shared_dir

__all__ = ["Scratch", "drop", "keep", "new_path", "shared_dir"]
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


class _Open(threading.local):
    """The steps that are under way in this thread; another thread's tables are none of theirs."""

    def __init__(self) -> None:
        self.steps: list[list[str]] = []


_open = _Open()


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for made in _open.steps:
        made.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``keep`` wrote; only once all that is made of them has been written too."""
    for df in tables:
        if path := _paths.pop(df, None):
            _remove(df.sparkSession, path)


class Scratch:
    """The tables that a step of a job leaves behind, removed when the next step begins.

    For steps that each read only what the one before has written in full.
    """

    def __init__(self) -> None:
        self.left: list[str] = []

    def forget(self) -> None:
        """Begin another job; what the one before left stays where it is."""
        self.left = []

    @contextlib.contextmanager
    def step(self, spark: SparkSession) -> Iterator[None]:
        for path in self.left:
            _remove(spark, path)
        self.left = []
        _open.steps.append(self.left)
        try:
            yield
        finally:
            _open.steps.remove(self.left)
