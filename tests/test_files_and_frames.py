"""Videos and whole files as data sources: splits, filters, broken input, commits and tasks that run again."""

import json
import os
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.sources import pixels, sink, video

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def clip(n, height=2, width=3, head=None, extra=b""):
    raw = head if head is not None else f"YUV4MPEG2 W{width} H{height} F24:1 C444 XFRAMES={n}\n".encode()
    return raw + b"".join(b"FRAME\n" + bytes([(k * 7 + i) % 256 for i in range(3 * height * width)]) for k in range(n)) + extra


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("clips")
    (at / "one.y4m").write_bytes(clip(1))
    (at / "many.y4m").write_bytes(clip(40))
    (at / "none.y4m").write_bytes(clip(0))
    (at / "cut.y4m").write_bytes(clip(3, extra=b"FRAME\nabc"))
    (at / "other.y4m").write_bytes(b"RIFF not a raw video")
    (at / "half.y4m").write_bytes(clip(1, head=b"YUV4MPEG2 W2 H2 F24:1 C420jpeg\n"))
    (at / "notes.txt").write_bytes(b"no video")
    return f"file://{at}"


@pytest.mark.parametrize("split", [24, 61, 1 << 20])
def test_each_frame_once_however_files_are_cut(spark, folder, split):
    got = video.frames(spark, folder, split).collect()
    numbers = sorted((r["video"], r["frame_num"]) for r in got if r["error"] is None)
    assert numbers == sorted([("one", 0)] + [("many", k) for k in range(40)] + [("cut", k) for k in range(3)])
    errors = {r["video"]: r["error"] for r in got if r["error"] is not None}
    assert errors == {"cut": "9 bytes instead of 24", "other": "not a raw video", "half": "no planes of full size"}
    fifth = next(r for r in got if (r["video"], r["frame_num"]) == ("many", 5))
    planes = np.array([(35 + i) % 256 for i in range(18)]).reshape(3, 6)
    assert (fifth["height"], fifth["width"]) == (2, 3) and np.array_equal(np.rint(np.array(fifth["pixels"]) * 255), planes.T.reshape(-1))


def test_filters_reach_the_reader(spark, folder):
    frames = video.frames(spark, folder, 50)
    inside = frames.where("frame_num >= 3 AND frame_num < 9 AND height = 2")
    plan = spark._jvm.PythonSQLUtils.explainString(inside._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(frame_num,3)" in plan and "LessThan(frame_num,9)" in plan
    assert sorted(r["frame_num"] for r in inside.where("error IS NULL").collect()) == [3, 4, 5, 6, 7, 8]
    assert sorted(r["video"] for r in video.first_frames(spark, folder).collect()) == ["cut", "many", "one"]
    # whole short reads: a range a file, and all in one task
    assert video.first_frames(spark, folder).rdd.getNumPartitions() < frames.rdd.getNumPartitions()
    assert frames.where("frame_num > 2 AND frame_num < 2").count() == 0


def test_headers(spark, folder):
    got = {r["video"]: (r["n_frames"], r["height"], r["error"]) for r in video.headers(spark, folder).collect()}
    assert got == {"one": (1, 2, None), "many": (40, 2, None), "none": (0, 2, None), "cut": (3, 2, None), "other": (None, None, "not a raw video"), "half": (None, None, "no planes of full size")}


def rows(spark, *videos):
    data = [(name, k, 1, 2, [0.0, 0.2, 0.4, 0.6, 0.8, (k % 256) / 255]) for name, n in videos for k in range(n)]
    return spark.createDataFrame(data, "video string, n int, h int, w int, p array<double>")


def write(df, at, mode="append"):
    video.write_videos(df, at, *(F.col(c) for c in ("video", "n", "h", "w", "p")), mode=mode)


def test_frames_come_back_in_order(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    write(rows(spark, ("a", 300), ("b", 2)).repartition(7), at)
    got = video.frames(spark, at).orderBy("video", "frame_num").collect()
    assert [(r["video"], r["frame_num"], round(r["pixels"][5] * 255)) for r in got] == [("a", k, k % 256) for k in range(300)] + [("b", 0, 0), ("b", 1, 1)]
    write(rows(spark, ("c", 1)), at)
    assert {r["video"] for r in video.headers(spark, at).collect()} == {"a", "b", "c"}
    write(rows(spark, ("d", 1)), at, "overwrite")
    assert {r["video"] for r in video.headers(spark, at).collect()} == {"d"}
    assert len(list((tmp_path / "out").iterdir())) == 2  # the manifest and one folder


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    bad = rows(spark, ("a", 3)).withColumn("p", F.when(F.col("n") == 2, F.array(F.lit(0.5))).otherwise(F.col("p")))
    with pytest.raises(Exception, match="instead of 6"):
        write(bad, at)
    assert not list((tmp_path / "out").iterdir())
    write(rows(spark, ("a", 1)), at)
    before = sorted(os.listdir(tmp_path / "out"))
    with pytest.raises(Exception, match="instead of 6"):
        write(bad, at, "overwrite")
    assert sorted(os.listdir(tmp_path / "out")) == before


def test_a_task_that_ran_twice_counts_once(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x.bin"]), pa.array([b"1"])], names=["name", "content"])
    writer = sink.FolderWriter(f"file://{tmp_path}/t", False, sink.put_files)
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.folder != second.folder
    writer.commit([second, None])
    parts = json.loads((tmp_path / "t" / sink.MANIFEST).read_text())["parts"]
    assert len(parts) == 1 and sorted(os.listdir(tmp_path / "t")) == sorted([sink.MANIFEST, *parts])
    other = sink.FolderWriter(f"file://{tmp_path}/t", False, sink.put_files)
    other.write(iter([batch]))
    other.abort([])
    assert sorted(os.listdir(tmp_path / "t")) == sorted([sink.MANIFEST, *parts])


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from sievegrid.session import prepare
from sievegrid.sources import sink
spark = prepare(SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate())
def doomed(batches):
    for batch in batches:
        yield batch
        if 7 in batch.column(2).to_pylist() and not os.path.exists({mark!r}):
            open({mark!r}, "w").close()
            os._exit(1)  # the worker dies after the sink has had the rows
rows = spark.range(0, 40, 1, 4).selectExpr("concat('f', id) AS name", "cast(cast(id AS string) AS binary) AS content", "id")
sink.write_files(rows.mapInArrow(doomed, rows.schema), {out!r})
"""


def test_a_killed_worker_leaves_no_second_file(spark, tmp_path):
    mark, out = str(tmp_path / "mark"), f"file://{tmp_path}/out"
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, mark=mark, out=out)], capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(mark)
    got = sink.read_files(spark, out).selectExpr("regexp_extract(path, '([^/]*)$', 1) AS name", "cast(content AS string) AS text").collect()
    assert sorted((r["name"], r["text"]) for r in got) == sorted((f"f{i}", str(i)) for i in range(40))
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith("_job")]


def test_no_table_is_empty(spark, tmp_path):
    assert sink.read_files(spark, f"file://{tmp_path}/absent").count() == 0
    sink.write_files(spark.createDataFrame([], "name string, content binary"), f"file://{tmp_path}/empty")
    assert sink.read_files(spark, f"file://{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize(("dtype", "top"), [(np.uint8, 255), (np.uint16, 65535)])
def test_png_round_trip(channels, dtype, top):
    values = np.random.default_rng(channels).integers(0, top + 1, (5, 7, channels)).astype(dtype)
    for level in (0, 6, 9):
        raw = pixels.png(values, level)
        height, width, got, error = pixels.parse(raw)
        assert (height, width, error) == (5, 7, None) and np.array_equal(np.rint(np.array(got) * top).astype(dtype).reshape(5, 7, channels), values)
    assert pixels.parse(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:])[3] is not None


def filtered(kinds, rows):
    body = b"".join(bytes([k]) + bytes(r) for k, r in zip(kinds, rows, strict=True))
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    return pixels.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_row_filters():
    got = pixels.parse(filtered([2, 1, 2, 0], [[1, 2, 3], [250, 10, 1], [1, 1, 1], [9, 8, 7]]))
    assert (np.rint(np.array(got[2]) * 255)).tolist() == [1, 2, 3, 250, 4, 5, 251, 5, 6, 9, 8, 7]
    assert pixels.parse(filtered([4], [[1, 2, 3]]))[3] == "row filter 4"


def test_formats_of_rows(spark):
    data = [
        ("a", 1, 2, [0.0, 0.5, 1.0, 0.25, float("nan"), 2.0], "PNG", 0, 16),
        ("b", 1, 1, [1.0, 0.0, 0.0, 0.0], "PPM", None, None),
        ("c", 1, 1, [0.5, 0.5], "PNG", 9, 16),
        ("d", 1, 1, [0.5], "JPEG", None, None),
        ("e", 1, 2, [0.5, 0.5, 0.5], "PNG", 6, 8),
        ("f", 1, 1, None, "PNG", 6, 8),
    ]
    rows = spark.createDataFrame(data, "n string, h int, w int, p array<double>, f string, z int, b int")
    made = pixels.encode_as(rows, *(F.col(c) for c in "nhwpfzb")).collect()
    assert [(r["name"], r["error"]) for r in made] == [("a.png", None), ("b.ppm", None), ("c.png", None), ("d", "no encoder for JPEG"), ("e", "3 values in 1 x 2 pixels"), ("f", "0 values in 1 x 1 pixels")]
    deep = pixels.parse(bytes(made[0]["content"]))
    assert np.rint(np.array(deep[2]) * 65535).tolist() == [0, 32768, 65535, 16384, 0, 65535]
    assert pixels.parse(bytes(made[1]["content"]))[2] == [1.0, 1.0, 1.0]  # alpha 0 over white
    assert made[2]["content"][24] == 8  # 16 bits are for three channels
