"""Scans over media files and the checks that go with them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as M
from ..operators import ordering


def files(spark: SparkSession, path: str, suffix: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, content, kind): binary content is read only if a plan uses it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(path).withColumn("kind", M.classify(F.col("path")))


def stream_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same as a stream over a landing folder; ``max_files`` a batch bounds what is in flight."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def split_by_kind(paths: DataFrame, path_col: str = "path", order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, videos) in one classification; other kinds are in neither.

    With ``order_col`` each side has its place among its kind (``at``, from 1) in that order.
    """
    kinds = paths.withColumn("kind", M.classify(F.col(path_col)))
    sides = [kinds.where(F.col("kind") == k) for k in ("image", "video")]
    if order_col:
        sides = [ordering.row_numbers(x, order_col, "at") for x in sides]
    return sides[0], sides[1]


def first_frames(frames: DataFrame, order_col: str = "frame_num") -> DataFrame:
    """The first frame of every video only; the filter reaches the scan."""
    return frames.where(F.col(order_col) == 0)


def wait_until_stable(spark: SparkSession, path: str, timeout_s: float = 1.0, poll_s: float = 0.02) -> bool:
    """Whether a file's size is the same, and not 0, at two looks in a row before the timeout."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, until, size = target.getFileSystem(spark._jsc.hadoopConfiguration()), time.monotonic() + timeout_s, -1
    while time.monotonic() < until:
        now = store.getFileStatus(target).getLen() if store.exists(target) else -1
        if now > 0 and now == size:
            return True
        size = now
        time.sleep(poll_s)
    return False


def clean_up(spark: SparkSession, *paths: str, sweep: str | None = None) -> int:
    """Delete files and folders, then the empty folders under ``sweep``; returns how many went."""
    conf, make, gone = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path, 0
    for path in paths:
        target = make(path)
        gone += bool(target.getFileSystem(conf).delete(target, True))
    if sweep:
        root = make(sweep)
        store = root.getFileSystem(conf)

        def empty(folder) -> bool:
            nonlocal gone
            left = 0
            for status in store.listStatus(folder):
                if status.isDirectory() and empty(status.getPath()):
                    gone += bool(store.delete(status.getPath(), False))
                else:
                    left += 1
            return not left

        if store.exists(root):
            empty(root)
    return gone


def frame_count(packets: Column, duration: Column, fps: Column) -> Column:
    """Packets if known, else whole frames in the duration, else null."""
    return F.coalesce(packets.cast("long"), F.floor(duration * fps).cast("long"))


def extraction_status(expected: Column, extracted: Column) -> Column:
    """ok, more, fewer or none: the outcome of taking frames from a video."""
    return (
        F.when(F.coalesce(extracted, F.lit(0)) == 0, "none")
        .when(expected.isNull() | (expected == extracted), "ok")
        .when(extracted < expected, "fewer")
        .otherwise("more")
    )


def extraction_report(headers: DataFrame, frames: DataFrame) -> DataFrame:
    """(video, expected, extracted, status) of every file, from what it declares and the whole frames in it."""
    found = frames.where(F.col("error").isNull()).groupBy("video").agg(F.count("*").alias("extracted"))
    counts = headers.select("video", F.col("n_frames").alias("expected")).join(found, "video", "left")
    return counts.select("video", "expected", F.coalesce("extracted", F.lit(0)).alias("extracted"), extraction_status(F.col("expected"), F.col("extracted")).alias("status"))


def session_names(files: DataFrame, by: str, order_col: str, path_col: str = "path") -> DataFrame:
    """(by, video_name, rename_list) of each session's files in order.

    The name for a video is the stem of the first video, else of the first image, else empty; the list has the stems
    of all files, a line each.  A session is what one user picked, so its files fit a row.
    """
    kinds = files.select(by, order_col, M.stem(F.col(path_col)).alias("stem"), M.classify(F.col(path_col)).alias("kind"))
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("stem")), F.when(F.col("kind") == kind, F.col(order_col)))
    listed = F.array_sort(F.collect_list(F.struct(order_col, "stem")))
    found = kinds.groupBy(by).agg(F.coalesce(first("video"), first("image"), F.lit("")).alias("video_name"), listed.alias("sg"))
    return found.select(by, "video_name", F.array_join(F.transform("sg", lambda x: x["stem"]), "\n").alias("rename_list"))
