"""Raw videos (YUV4MPEG2, three planes of full size) as a Spark data source: 1 to N frames, and N to 1.

``spark.read.format("y4m")`` gives a row a frame.  Files are cut into byte ranges, each a partition,
that give the frames beginning in them, so a long video is many tasks' work and the driver only lists
names and sizes.  Filters on ``frame_num`` reach the reader: frames outside aren't read, and the first
frame of every video costs one short read a file.  ``option("headers", True)`` gives a row a file instead, with
the number of frames that its header declares (a comment of its own, ``XFRAMES=``).

``df.write.format("y4m")`` takes rows in order of (video, frame_num) and streams them to a file a video, so
memory doesn't grow with its length; see ``write_videos``.  A row without pixels is no frame.

Fixed values: the container's signature, its parameters' letters, and the line before a frame.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .sink import FolderWriter, opened, parts_of

SIGNATURE, FRAME, SUFFIX = b"YUV4MPEG2", b"FRAME\n", ".y4m"
FRAMES = "video string, frame_num long, height int, width int, pixels array<double>, error string"
HEADERS = "video string, n_frames long, height int, width int, rate string, error string"
WRITTEN = "video string, frame_num long, n_frames long, height int, width int, pixels array<double>"
SPLIT_BYTES = 64 << 20
_READ_BYTES = 4 << 20
_OPEN_BYTES = 1 << 20  # what opening a file is worth, as if read
_HEAD_BYTES = 1 << 10


@dataclass(frozen=True)
class Split:
    """A byte range of a file."""

    path: str
    low: int
    high: int
    size: int


class Splits(InputPartition):
    """Ranges that one task reads: a part of a long file, or many short files."""

    def __init__(self, splits: list[Split]) -> None:
        self.splits = splits


def header(raw: bytes) -> tuple[dict[str, str], int]:
    """The parameters by letter and where the first frame begins; ValueError for another format."""
    line, end, _ = raw.partition(b"\n")
    if not end or not line.startswith(SIGNATURE + b" "):
        raise ValueError("not a raw video")
    found: dict[str, str] = {}
    for word in line.decode("ascii", "replace").split(" ")[1:]:
        found.setdefault("N" if word.startswith("XFRAMES=") else word[:1], word[8:] if word.startswith("XFRAMES=") else word[1:])
    if found.get("C", "444") != "444" or not (found.get("W", "").isdigit() and found.get("H", "").isdigit()):
        raise ValueError("no planes of full size")
    return found, len(line) + 1


def _name(path: str) -> str:
    return posixpath.basename(path).removesuffix(SUFFIX)


def _files(path: str) -> list[fs.FileInfo]:
    """Of a file, of a table's committed folders, or of any folder."""
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    parts = parts_of(store, root)
    folders = [root] if parts is None else [f"{root}/{p}" for p in parts]
    return [x for f in folders for x in store.get_file_info(fs.FileSelector(f, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(SUFFIX)]


class FrameReader(DataSourceReader):
    def __init__(self, path: str, headers: bool, split_bytes: int) -> None:
        self.path, self.headers, self.split_bytes = path, headers, split_bytes
        self.first, self.end = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if self.headers or getattr(f, "attribute", None) != ("frame_num",):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.end = max(self.first, f.value), min(self.end, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Splits]:
        # a header or a first frame is in a file's first range, and a short read
        short = self.headers or self.end <= 1
        out, room = [], 0
        for x in _files(self.path):
            for low in [0] if short else range(0, max(x.size, 1), self.split_bytes):
                split = Split(x.path, low, min(low + self.split_bytes, x.size), x.size)
                if room <= 0:
                    out.append(Splits([]))
                    room = self.split_bytes
                out[-1].splits.append(split)
                room -= _OPEN_BYTES + (0 if short else split.high - split.low)
        return out

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            yield from self._split(split)

    def _split(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(split.path) as f:
            raw = f.read_at(min(_HEAD_BYTES, split.size), 0)
            try:
                found, at = header(raw)
            except ValueError as e:
                if split.low == 0:
                    yield self._broken(split, str(e))
                return
            height, width = int(found["H"]), int(found["W"])
            if self.headers:
                n = int(found["N"]) if found.get("N", "").isdigit() else None
                yield _batch([[_name(split.path)], [n], [height], [width], [found.get("F")], [None]], HEADERS)
                return
            yield from self._frames(f, split, at, height, width)

    def _frames(self, f: pa.NativeFile, split: Split, at: int, height: int, width: int) -> Iterator[pa.RecordBatch]:
        record = len(FRAME) + 3 * height * width
        low, high = (max(0, -(-(x - at) // record)) for x in (split.low, split.high))
        low, high = max(low, self.first), min(high, self.end)
        video, step = _name(split.path), max(1, _READ_BYTES // record)
        for k in range(low, high, step):
            n = min(step, high - k)
            raw = np.frombuffer(f.read_at(n * record, at + k * record), np.uint8)
            whole = len(raw) // record
            rows = raw[: whole * record].reshape(whole, record)
            good = (rows[:, : len(FRAME)] == np.frombuffer(FRAME, np.uint8)).all(1)
            planes = rows[:, len(FRAME) :].reshape(whole, 3, height * width).transpose(0, 2, 1).reshape(-1)
            pixels = pa.ListArray.from_arrays(pa.array(np.arange(whole + 1, dtype=np.int32) * (3 * height * width)), pa.array(planes / 255.0), mask=pa.array(~good))
            error = pa.array([None if x else "no frame begins here" for x in good.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([video] * whole, pa.string()), pa.array(np.arange(k, k + whole)), pa.array(np.full(whole, height, np.int32)), pa.array(np.full(whole, width, np.int32)), pixels, error], schema=_arrow(FRAMES))
            if whole < n:  # the file ends within a frame
                if len(raw) % record:
                    yield _batch([[video], [k + whole], [height], [width], [None], [f"{len(raw) % record} bytes instead of {record}"]], FRAMES)
                return

    def _broken(self, split: Split, error: str) -> pa.RecordBatch:
        return _batch([[_name(split.path)], [None], [None], [None], [None], [error]], HEADERS if self.headers else FRAMES)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _batch(columns: list[list], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def put_videos(store: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
    """A file a video from rows in order; a video's rows have to be together."""
    now, out, done = None, None, set()
    try:
        for batch in batches:
            pixels = batch.column(5)
            values = np.clip(np.nan_to_num(pixels.values.to_numpy(zero_copy_only=False), nan=0.0, posinf=1.0, neginf=0.0), 0, 1)
            values, offsets = np.rint(values * 255).astype(np.uint8), pixels.offsets.to_numpy()
            for i, (video, _, n, height, width) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if video != now:
                    if video in done:
                        raise ValueError(f"the rows of {video} are not together")
                    if out is not None:
                        out.close()
                    now = video
                    done.add(video)
                    out = store.open_output_stream(f"{folder}/{video}{SUFFIX}")
                    out.write(SIGNATURE + f" W{width} H{height} F24:1 Ip A1:1 C444{'' if n is None else f' XFRAMES={n}'}\n".encode())
                if pixels[i].is_valid:
                    frame = values[offsets[i] : offsets[i + 1]]
                    if len(frame) != 3 * height * width:
                        raise ValueError(f"{len(frame)} values instead of {3 * height * width} in {video}")
                    out.write(FRAME + frame.reshape(-1, 3).T.tobytes())
    finally:
        if out is not None:
            out.close()
    return len(done)


class Videos(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return HEADERS if self._headers() else FRAMES

    def _headers(self) -> bool:
        return str(self.options.get("headers", "false")).lower() == "true"

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"], self._headers(), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], overwrite, put_videos)


def _ready(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Videos)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default
    return spark


def frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row a frame of a file, a folder, or a table that ``write_videos`` wrote; broken ones have an error."""
    return _ready(spark).read.format("y4m").option("splitBytes", split_bytes).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row a file, with what its header declares."""
    return _ready(spark).read.format("y4m").option("headers", "true").load(path)


def first_frames(spark: SparkSession, path: str) -> DataFrame:
    """The first frame of every video; the filter reaches the reader."""
    return frames(spark, path).where(F.col("frame_num") == 0)


def write_videos(rows: DataFrame, folder: str, video: Column, frame_num: Column, height: Column, width: Column, pixels: Column, declared: Column | None = None, mode: str = "append") -> None:
    """N to 1: the frames of each video in order into one file, all videos or none."""
    spark = _ready(rows.sparkSession)
    count = F.lit(None) if declared is None else declared
    columns = zip(WRITTEN.split(", "), (video, frame_num, count, height, width, pixels), strict=True)
    typed = rows.select(*(c.cast(ddl.split(" ")[1]).alias(ddl.split(" ")[0]) for ddl, c in columns))
    dealt = typed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video").sortWithinPartitions("video", "frame_num")
    dealt.write.format("y4m").mode(mode).save(folder)
