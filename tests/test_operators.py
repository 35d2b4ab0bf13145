"""Worked examples and edge cases of the engine's own operators."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import arrays as A
from sievegrid.functions import media as M
from sievegrid.operators import dedupe, fold, kernels, ordering, reassemble, resample, tiles, transform, validate
from sievegrid.sources import catalog
from sievegrid.sources import media as media_source
from sievegrid.sources import pixels
from sievegrid.streaming import first_seen, stages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("h,target,scale,want", [(480, 1080, 2, 2), (1080, 1080, 2, 1), (720, 2160, 2, 2), (480, 1080, 4, 1), (720, 2160, 4, 1), (480, 0, 2, 1), (0, 1080, 2, 1), (480, 1080, 1, 1)])
def test_passes(spark, h, target, scale, want):
    assert one(spark, M.passes(F.lit(h), F.lit(target), scale)) == want


@pytest.mark.parametrize("t,s,want", [(4, 2, 2), (8, 2, 3), (16, 2, 4), (8, 4, 2), (16, 4, 2), (3, 2, 2), (2, 2, 1), (1, 2, 1)])
def test_image_passes(spark, t, s, want):
    assert one(spark, M.image_passes(F.lit(float(t)), F.lit(float(s)))) == want


def test_sizes(spark):
    assert one(spark, M.fit_height(F.lit(3840), F.lit(2160), F.lit(1080))) == 1920
    assert one(spark, M.fit_height(F.lit(2880), F.lit(2160), F.lit(1080))) == 1440
    assert one(spark, M.pre_downscale_width(F.lit(1920), F.lit(1080), F.lit(480))) == 853
    assert [one(spark, M.slots(F.lit(g))) for g in (4, 6, 8, 10, 12)] == [1, 3, 5, 6, 8]
    assert one(spark, M.frame_name(F.lit(7))) == "frame_00007.png"
    with pytest.raises(Exception, match="no frame number"):
        one(spark, M.frame_number(F.lit("none.png"), strict=True))


def test_mapping_and_stats(spark):
    frames = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "A"), (4, "C"), (5, "C")], "n long, k string")
    mapped = dedupe.mapping(frames, "n", F.col("k"))
    assert {r["n"]: r["unique_id"] for r in mapped.collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4}
    assert dedupe.stats(mapped).first().asDict() == {"total": 6, "unique_items": 3, "duplicates": 3, "duplicate_percentage": 50.0}
    assert dedupe.stats(mapped.where("false")).first()["duplicate_percentage"] == 0.0
    assert dedupe.mapping(frames, "n", F.col("k"), detect=False).where("is_duplicate").isEmpty()
    nulls = dedupe.mapping(spark.createDataFrame([(0, None), (1, None)], "n long, k string"), "n", F.col("k"))
    assert nulls.where("is_duplicate").isEmpty()


def test_fallback(spark):
    frames = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "n long, k string")
    mapped = dedupe.mapping(frames, "n", F.col("k"))
    results = spark.createDataFrame([(0, "done")], "unique_id long, r string")
    out = {r["n"]: (r["r"], r["is_missing"]) for r in reassemble.fan_out(mapped, results, ["r"], fallback={"r": F.col("k")}).collect()}
    assert out == {0: ("done", False), 1: ("done", False), 2: ("B", True)}


@pytest.mark.parametrize("ids,n,gone,prefix", [([0, 1, 3, 4, 5], 6, [2], 2), ([], 3, [0, 1, 2], 0), ([2, 0, 1, 3], 4, [], 4)])
def test_gaps(spark, ids, n, gone, prefix):
    rows = spark.createDataFrame([(i,) for i in ids], "n long")
    assert sorted(r["n"] for r in validate.missing(rows, "n", n).collect()) == gone
    assert validate.contiguous_prefix(rows, "n").first()["prefix_length"] == prefix


def test_numeric_order(spark):
    rows = spark.createDataFrame([(100001,), (99998,), (100000,), (99999,)], "n long")
    got = {r["n"]: r["rn"] for r in ordering.row_numbers(rows, "n", blocks=3).collect()}
    assert got == {99998: 1, 99999: 2, 100000: 3, 100001: 4}


def test_flat_and_odd_values(spark):
    flat = spark.createDataFrame([(0, [0.0] * 4), (1, [1.0] * 4)], "n int, v array<double>")
    assert flat.select(A.average_hash(F.col("v"))).distinct().count() == 1
    assert flat.select(A.average_hash(F.col("v"), guard_flat=True)).distinct().count() == 2
    rgb = spark.createDataFrame([([0.0, 5.0, 1.0, 2.0, 3.0, 1.0],)], "v array<double>")
    assert rgb.select(A.average_hash(F.col("v"), 3)).first()[0] == "000100010000"
    halves = spark.createDataFrame([([0.5 / 255, 1.5 / 255, 2.5 / 255],)], "v array<double>")
    assert halves.select(A.quantise(F.col("v"))).first()[0] == [0, 2, 2]


def test_tiles_cover_and_blend_to_identity(spark):
    d = spark.createDataFrame([(10, 600)], "h int, w int")
    assert d.select(F.explode(tiles.starts(F.col("h"), 4, 2))).count() == 5
    with pytest.raises(ValueError):
        tiles.starts(F.col("h"), 4, 4)
    g = tiles.grid(spark.createDataFrame([(600, 700)], "h int, w int"), "h", "w").collect()
    cover = np.zeros((600, 700), bool)
    for t in g:
        cover[t["y"] : t["y_end"], t["x"] : t["x_end"]] = True
    assert cover.all()


def test_kernel_errors_are_rows(spark):
    kernels.register("picky", lambda x: x[:, [2]])
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, None)], "n int, v array<double>")
    got = {r["n"]: (r["result"], r["error"]) for r in kernels.apply(rows, "picky", "n", "v").collect()}
    assert got[1] == ([3.0], None)
    assert got[2][0] is None and "IndexError" in got[2][1]
    assert got[3] == (None, "null input")
    assert "box_down" in kernels.names()


def test_catalogs(spark):
    rows = spark.createDataFrame([("ProRes", "ProRes 422"), ("none", None)], "c string, p string")
    got = {r["c"]: r["pix_fmt"] for r in catalog.with_profile(rows, "c", "p").collect()}
    assert got == {"ProRes": "yuv422p10le", "none": None}
    with pytest.raises(Exception, match="unknown frame format"):
        catalog.with_frame_format(rows, "c", strict=True).collect()
    assert catalog.codecs(spark).count() == 22 and catalog.frame_formats(spark).count() == 5


def test_file_scans(spark, tmp_path):
    for name in ("a.png", "b.txt", "c.mp4"):
        (tmp_path / name).write_bytes(b"xyz")
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in media_source.files(spark, f"file://{tmp_path}").select("path", "kind").collect()}
    assert kinds == {"a.png": "image", "b.txt": None, "c.mp4": "video"}
    images, videos = media_source.split_by_kind(media_source.files(spark, f"file://{tmp_path}").select("path"))
    assert images.count() == videos.count() == 1
    stream = media_source.stream_files(spark, f"file://{tmp_path}", 1)
    q = stream.select("path", "length").writeStream.format("memory").queryName("scanned").trigger(availableNow=True).start()
    assert first_seen.run(q, 60) == (True, "done")
    assert spark.sql("SELECT count(*) FROM scanned").first()[0] == 3


def test_stream_first_seen_over_batches(spark, tmp_path):
    for k, rows in enumerate([[("a", 3), ("b", 1), ("a", 2)], [("a", 1), ("c", 9), ("b", 5)]]):
        spark.createDataFrame(rows, "k string, n long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    stream = spark.readStream.schema("k string, n long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = first_seen.first_seen(stream, "k", "n")
    sink = first_seen.ordered_sink(lambda df, i: seen.append([tuple(r) for r in df.select("k", "n", "unique_id").collect()]), "n")
    q = out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert first_seen.run(q, 120)[0]
    rows = [r for batch in seen for r in batch]
    assert all(batch == sorted(batch, key=lambda r: r[1]) for batch in seen)
    firsts = {}
    for batch in seen:
        for k, n, unique in batch:
            assert unique == firsts.setdefault(k, min(x[1] for x in batch if x[0] == k))
    assert len(rows) == 6
    assert first_seen.statistics(spark.createDataFrame([(False,), (True,)], "is_duplicate boolean")).first()["duplicates"] == 1


def test_stream_stop(spark):
    q = spark.readStream.format("rate").load().writeStream.format("noop").start()
    ok, message = first_seen.run(q, 2, 5)
    assert not ok and "stopped" in message and not q.isActive


def test_naming(spark):
    name = lambda *a: one(spark, M.output_name(*(F.lit(x).cast("string") for x in a)))
    assert name("custom", "v", "", None, "  ") == "v"
    assert name("custom", "v", "", " own ", "s") == "own"
    assert name("suffix", "v", "_up", None, None) == "v_up"
    assert one(spark, M.unwrap(F.lit('{"value": "x"}'), "d")) == "x"
    assert one(spark, M.unwrap(F.lit(None).cast("string"), "d")) == "d"


def test_positions_of_sparse_and_null_ids(spark):
    """Sparse, negative and null order values; no block of one row each, no window over the whole table."""
    ids = [i * i * 1_000_003 - 500 for i in range(300)]
    rows = spark.createDataFrame([(i, "x") for i in ids] + [(None, "y"), (None, "z")], "n long, v string")
    for blocks in (1, 7, 1024):
        got = ordering.row_numbers(rows, "n", blocks=blocks).collect()
        assert sorted((r["n"], r["rn"]) for r in got if r["n"] is not None) == [(i, k + 1) for k, i in enumerate(sorted(ids))]
        assert [r["rn"] for r in got if r["n"] is None] == [None, None]
    assert ordering.row_numbers(rows.where("false"), "n").collect() == []
    plan = ordering.row_numbers(rows, "n", blocks=16)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan and "sg_n" in plan  # only the block totals meet in one task


def test_neighbours_across_blocks(spark):
    """A hot key's rows lie in many blocks; the buffer goes on over their ends, nulls included."""
    rows = [("hot", i * 3, None if i % 5 == 0 else str(i)) for i in range(40)] + [("b", 7, "x"), (None, 1, "p"), (None, 9, "q")]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    for blocks in (1, 6, 64):
        got = {(r["k"], r["n"]): (list(r["buffer"]), r["next"]) for r in ordering.look_ahead(ordering.sliding_buffer(df, "k", "n", "v", 4, blocks=blocks), "k", "n", "v", blocks=blocks).collect()}
        for k in ("hot", "b", None):
            own = sorted((n, v) for kk, n, v in rows if kk == k)
            for i, (n, _) in enumerate(own):
                assert got[(k, n)] == ([v for _, v in own[i : i + 4]], own[i + 1][1] if i + 1 < len(own) else None)


def test_sequences_below_zero_and_null_ids(spark):
    rows = spark.createDataFrame([("a", -3), ("a", 0), ("b", 0), ("b", 2), ("c", -1), ("d", None)], "k string, n long")
    got = {r["k"]: (r["n_missing"], r["is_complete"]) for r in validate.sequence_check(rows, "k", "n").collect()}
    assert got["a"] == (0, False) and got["b"] == (1, False) and got["c"] == (0, False) and got["d"][0] is not True
    mapped = dedupe.mapping(spark.createDataFrame([(None, "A"), (3, "A"), (None, "B")], "n long, k string"), "n", F.col("k"))
    assert sorted(((r["n"] or 0), r["k"], r["is_duplicate"]) for r in mapped.collect()) == [(0, "A", True), (0, "B", False), (3, "A", False)]
    assert dedupe.work_list(mapped).count() == 2
    assert validate.differs(rows, rows.limit(2)).first()["agrees"] is False
    assert {r["part"]: r["n"] for r in validate.total(x=rows, y=rows.limit(1)).collect()} == {"x": 6, "y": 1, "total": 7}


def test_short_arrays(spark):
    short = spark.createDataFrame([([],), ([0.5],), ([0.5, 0.1],), ([0.1, 0.2, 0.9, 0.4, 0.8],)], "v array<double>")
    assert [len(r[0]) for r in short.select(A.gray(F.col("v"))).collect()] == [0, 0, 0, 1]
    assert [r[0] for r in short.select(A.gray_hash(F.col("v"))).collect()] == ["", "0", "1", "14"]
    wide = spark.createDataFrame([([float(i % 7) for i in range(192)],)], "v array<double>")
    assert [len(r) for r in wide.select(A.frame_hash(F.col("v"), 8, 8), A.frame_gray_hash(F.col("v"), 8, 8)).first()] == [1536, 64]


@pytest.mark.parametrize("height,width", [(8, 8), (3, 5), (1, 4), (4, 1)])
@pytest.mark.parametrize("normalised", [False, True])
def test_sharpen_equals_a_plain_stencil(spark, height, width, normalised):
    image = np.random.default_rng(3).random((height, width)) / 9
    padded = np.pad(image, 1)
    around = sum(padded[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    want = np.clip(image * ((1 if normalised else 9) + 8 * 0.5) - around * 0.5, 0, 1)
    got = spark.createDataFrame([(image.ravel().tolist(),)], "v array<double>").select(A.sharpen(F.col("v"), width, 0.5, normalised)).first()[0]
    assert np.allclose(np.array(got).reshape(height, width), want)


def test_dithering_and_post_processing(spark):
    rows = spark.createDataFrame([([0.1, 0.5, 0.9, 0.3],)], "v array<double>")
    noise = A.triangular_noise(F.size("v"), 4)
    got = rows.select(noise.alias("r"), A.dither(F.col("v"), noise).alias("b")).first()
    assert got["b"] == [int(min(max(v * 255 + r - 1, 0), 255)) for v, r in zip([0.1, 0.5, 0.9, 0.3], got["r"])] and all(0 <= r < 2 for r in got["r"])
    assert rows.select(A.post_process(F.col("v"), 2)).first()[0] == [0.1, 0.5, 0.9, 0.3]
    chained = rows.select(A.post_process(F.col("v"), 2, 0.5, 1.2).alias("a"), A.contrast(A.sharpen(F.col("v"), 2, 0.5, True), 1.2).alias("b")).first()
    assert chained["a"] == chained["b"]
    rgba = spark.createDataFrame([([0.1, 0.2, 0.3, 1.0, 0.4, 0.5, 0.6, 0.5],)], "v array<double>")
    colours, alpha = A.split_alpha(F.col("v"))
    assert rgba.select(A.join_alpha(colours, alpha)).first()[0] == [0.1, 0.2, 0.3, 1.0, 0.4, 0.5, 0.6, 0.5]
    doubled = rgba.select(A.with_resized_alpha(F.col("v"), A.resample(colours, 1, 2, 3, 2, 4), 1, 2, 2)).first()[0]
    assert doubled[3::4] == [1.0, 1.0, 0.5, 0.5] * 2


def test_composed_transform_keeps_an_identity(spark):
    """Without a kernel, tiles that overlap blend back to the image; small images are one tile."""
    image = np.random.default_rng(1).random(48)
    df = spark.createDataFrame([(1, image.tolist(), 6, 8)], "n int, v array<double>, h int, w int")
    for tile, overlap in ((4, 1), (5, 2), (64, 8)):
        got = transform.upscale(df, "n", "v", "h", "w", lambda v, y, x: v, 1, tile, overlap).first()["values"]
        assert np.allclose(got, image)
    assert len(transform.upscale(df, "n", "v", "h", "w", lambda v, y, x: v, 1, 4, 1, target=F.lit(3)).first()["values"]) == 9 * 48
    maps = tiles.weight_table(spark.createDataFrame([(4, 5, 2), (4, 5, 2)], "h int, w int, o int"), "h", "w", "o", True).collect()
    assert len(maps) == 1 and len(maps[0]["weights"]) == 20


def test_ordered_fold(spark):
    rows = [("a", i, f"f{i}") for i in reversed(range(10))] + [("b", 0, "x"), ("b", 9, "y")]
    folded = fold.segments(spark.createDataFrame(rows, "k string, n long, v string"), "k", "n", F.col("v"), 4)
    got = {(r["k"], r["segment"]): (r["first"], list(r["values"])) for r in folded.collect()}
    assert got == {("a", 0): (0, ["f0", "f1", "f2", "f3"]), ("a", 1): (4, ["f4", "f5", "f6", "f7"]), ("a", 2): (8, ["f8", "f9"]), ("b", 0): (0, ["x"]), ("b", 2): (9, ["y"])}
    assert {r["k"]: r["n_missing"] for r in fold.gaps(folded, "k").collect()} == {"a": 0, "b": 8}
    holes = spark.createDataFrame([("a", i, "x") for i in (0, 1, 3, 3)] + [("b", i, "x") for i in (-5, -1, 0)] + [("c", 6, "x")], "k string, n long, v string")
    assert {r["k"]: r["n_missing"] for r in fold.gaps(fold.segments(holes, "k", "n", F.col("v"), 4), "k").collect()} == {"a": 1, "b": 0, "c": 6}


def test_raw_images(spark, tmp_path):
    values = spark.createDataFrame([(1, [0.0, 0.5, 1.0, 0.2, 0.4, 0.6])], "n int, v array<double>")
    made = values.select("n", pixels.encode(F.col("v"), 1, 2).alias("content"), F.lit("one.ppm").alias("name"))
    pixels.save(made, f"file://{tmp_path}/out", "name")
    pixels.save(made, f"file://{tmp_path}/out", "name")  # a second attempt replaces the first
    (tmp_path / "out" / "two.ppm").write_bytes(b"P6\n2 1\n255\nxx")
    (tmp_path / "out" / "three.ppm").write_bytes(b"no image")
    files = media_source.files(spark, f"file://{tmp_path}/out", ".ppm").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    got = {r["name"]: r for r in pixels.decode(files, "name").collect()}
    assert (got["one.ppm"]["height"], got["one.ppm"]["width"], got["one.ppm"]["error"]) == (1, 2, None)
    assert [round(x * 255) for x in got["one.ppm"]["pixels"]] == [0, 128, 255, 51, 102, 153]
    assert "2 bytes" in got["two.ppm"]["error"] and got["three.ppm"]["error"] == "not a PPM image"
    probed = {r["name"]: (r["height"], r["width"], r["error"]) for r in pixels.probe(files, "name").collect()}
    assert probed == {"one.ppm": (1, 2, None), "two.ppm": (1, 2, None), "three.ppm": (None, None, "not a PPM or PNG image")}


def test_split_keeps_the_order_and_files_are_tidied(spark, tmp_path):
    paths = spark.createDataFrame([(k, p) for k, p in enumerate(["b.png", "a.mp4", "a.png", "x.txt", "c.gif"])], "i long, path string")
    images, videos = media_source.split_by_kind(paths, order_col="i")
    assert [(r["path"], r["at"]) for r in images.orderBy("at").collect()] == [("b.png", 1), ("a.png", 2), ("c.gif", 3)]
    assert [r["path"] for r in videos.collect()] == ["a.mp4"]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "keep").mkdir()
    (tmp_path / "keep" / "f").write_bytes(b"x")
    (tmp_path / "gone").write_bytes(b"x")
    assert media_source.wait_until_stable(spark, f"file://{tmp_path}/gone") and not media_source.wait_until_stable(spark, f"file://{tmp_path}/none", 0.1)
    assert media_source.clean_up(spark, f"file://{tmp_path}/gone", sweep=f"file://{tmp_path}") == 3
    assert sorted(x.name for x in tmp_path.iterdir()) == ["keep"]
    frames = spark.createDataFrame([(0, "a"), (1, "a"), (0, "b")], "frame_num int, v string")
    assert media_source.first_frames(frames).count() == 2


def test_models(spark):
    made = []
    kernels.register_model(kernels.Model("own_DAT", lambda precision: made.append(precision) or (lambda x: x * 2), 4.0))
    assert kernels.scale_of("own_DAT") == 4.0 and kernels.scale_of("nearest_up") == 2.0
    assert [kernels.precision_of("own_DAT", True), kernels.precision_of("x", None), kernels.precision_of("x", False), kernels.precision_of("x", True, has_half=False)] == ["fp32", "fp16", "fp32", "fp32"]
    first = kernels.loaded(kernels._models["own_DAT"], "fp32")
    assert kernels.loaded(kernels._models["own_DAT"], "fp32") is first and made == ["fp32"]
    kernels.unload()
    assert kernels.loaded(kernels._models["own_DAT"], "fp32") is not first
    assert one(spark, M.with_suffix(F.lit("a.b"), ".png")) == "a.png" and one(spark, M.with_suffix(F.lit("plain"), ".png")) == "plain.png"
    assert one(spark, M.session_folder(F.timestamp_seconds(F.lit(0)))) == "19700101_000000"


def _stream_of(spark, path, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_stream_releases_in_order(spark, tmp_path):
    """Indices out of order over batches wait for those before them; repeats after release are dropped."""
    batches = [[("a", 2, "a2"), ("a", 0, "a0"), ("b", 1, "b1")], [("a", 1, "a1"), ("a", 0, "again"), ("b", 3, "b3")], [("b", 0, "b0"), ("a", 4, "a4"), ("b", None, "n")]]
    stream, seen = _stream_of(spark, tmp_path, "k string, n long, v string", batches), []
    q = stages.in_order(stream, "k", "n", "v").writeStream.foreachBatch(lambda df, i: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert first_seen.run(q, 120)[0]
    for key, want in (("a", ["a0", "a1", "a2"]), ("b", ["b0", "b1"])):
        assert [(n, v, r) for k, n, v, r in seen if k == key] == [(i, v, i) for i, v in enumerate(want)]


def test_reorder_buffer_keeps_types_and_nulls(spark, tmp_path):
    batches = [[("a", 3, 2.5), ("a", 1, None), ("a", 1, 9.0)], [("a", 5, 5.0), ("a", 3, 7.0)], [("a", 0, 0.5), ("a", 9, 1.0)], [("a", 2, None), ("b", 0, 4.0)]]
    stream, seen = _stream_of(spark, tmp_path, "k string, n long, v double", batches), []
    q = stages.in_order(stream, "k", "n", "v").writeStream.foreachBatch(lambda df, i: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert first_seen.run(q, 120)[0]
    assert sorted(seen) == [("a", 0, 0.5, 0), ("a", 1, None, 1), ("a", 2, None, 2), ("a", 3, 2.5, 3), ("b", 0, 4.0, 0)]


def test_stream_stages(spark, tmp_path):
    stream = stages.with_fingerprint(_stream_of(spark, tmp_path, "n long, v string", [[(i, "x" if i < 3 else str(i)) for i in range(5)]]), "v")
    batched = []
    q = stream.writeStream.foreachBatch(stages.in_batches(lambda df, i: batched.extend((r["n"], r["batch_id"]) for r in df.collect()), "n", 2)).option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start()
    assert first_seen.run(q, 120)[0] and sorted(batched) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    written, rejected = [], []
    results = spark.createDataFrame([(0, "r0"), (3, "r3")], "n long, r string")
    sink = stages.two_pass_sink("n", results, lambda df, what, i: written.extend((what, r["n"], r["r"]) for r in df.collect()), lambda df, i: rejected.extend(r["n"] for r in df.collect()))
    sink(spark.createDataFrame([(0, 0, False), (1, 0, True), (3, 3, False), (4, 4, False)], "n long, unique_id long, is_duplicate boolean"), 0)
    assert written == [("originals", 0, "r0"), ("originals", 3, "r3"), ("copies", 1, "r0")] and rejected == [4]


def test_stream_control(spark, tmp_path):
    """Stop, pause and resumption, progress, and a stream that fails."""
    rate = lambda name: lambda: spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/{name}").start()
    control, reports = stages.Control(), []

    def seen(report):
        reports.append(report["batchId"])
        if len(reports) == 1:
            control.pause.set()
            threading.Timer(1, control.pause.clear).start()
        if len(reports) >= 3:
            control.stop.set()

    assert stages.supervise(rate("a"), control, seen, 60) == (False, "stopped") and len(reports) >= 3
    assert stages.supervise(rate("b"), stages.Control(), timeout_s=1)[1].startswith("stopped after")

    def broken(df, i):
        raise RuntimeError("a broken batch")

    failing = lambda: spark.readStream.format("rate").load().writeStream.foreachBatch(broken).option("checkpointLocation", f"{tmp_path}/c").start()
    ok, message = stages.supervise(failing, stages.Control(), timeout_s=60)
    assert not ok and "broken batch" in message


@pytest.mark.parametrize(("size", "to"), [(8, 16), (16, 8), (5, 5), (7, 3), (1, 4), (100, 9)])
@pytest.mark.parametrize("kind", ["lanczos", "bilinear", "nearest"])
def test_weights_of_filters(kind, size, to):
    w = resample.FILTERS[kind](size, to)
    assert w.shape == (to, size) and np.allclose(w.sum(1), 1)
    for o in range(to):
        scale = size / to
        if kind == "bilinear":
            at = max((o + 0.5) * scale - 0.5, 0)
            want = np.zeros(size)
            want[min(int(at), size - 1)] += 1 - (at - int(at))
            want[min(int(at) + 1, size - 1)] += at - int(at)
        elif kind == "lanczos":
            f = max(scale, 1)
            x = (np.arange(size) - (o + 0.5) * scale + 0.5) / f
            low, high = max(0, int(np.floor((o + 0.5) * scale - 3 * f + 0.5))), min(size, int(np.floor((o + 0.5) * scale + 3 * f + 0.5)))
            want = np.array([np.sinc(d) * np.sinc(d / 3) if low <= i < high and abs(d) < 3 else 0 for i, d in enumerate(x)])
            want = want / want.sum()
        else:
            want = np.eye(size)[o * size // to]
        assert np.allclose(w[o], want)


def test_resize_of_odd_rows(spark):
    flat = [0.5] * 12
    rows = spark.createDataFrame([(1, flat, 2, 2, 4, 4), (2, flat, 2, 2, 2, 2), (3, None, 2, 2, 4, 4), (4, [0.5] * 5, 2, 2, 4, 4), (5, flat, 2, 6, 1, 3), (6, [0.5, None], 1, 2, 2, 4), (7, flat, None, 2, 4, 4), (8, [], 2, 2, 4, 4)], "id int, v array<float>, h int, w int, th int, tw int")
    got = {r["id"]: r for r in resample.resize(rows, "id", *(F.col(c) for c in ("v", "h", "w", "th", "tw"))).collect()}
    assert np.allclose(got[1]["values"], [0.5] * 48) and got[2]["values"] == flat and np.allclose(got[5]["values"], [0.5] * 3)
    assert all(got[i]["values"] is None and got[i]["error"] for i in (3, 4, 6, 7, 8))
    fitted = resample.to_height(rows.where("id = 1"), "id", F.col("v"), F.col("h"), F.col("w"), F.lit(3)).first()
    assert (fitted["height"], fitted["width"], len(fitted["values"])) == (3, 3, 27)
    assert resample.to_height(rows.where("id = 1"), "id", F.col("v"), F.col("h"), F.col("w"), F.lit(0)).first()["values"] == flat
    scaled = resample.to_scale(rows.where("id = 5"), "id", F.col("v"), F.col("h"), F.col("w"), (F.lit(1), F.lit(3)), F.lit(1.5)).first()
    assert (scaled["height"], scaled["width"]) == (1, 4)


def naive_blend(image, kernel, tile, overlap, scale, edge_safe):
    h, w, c = image.shape
    if h * w <= tile * tile:
        return kernel(image, 0, 0)
    total, weight = np.zeros((h * scale, w * scale, c)), np.zeros((h * scale, w * scale, 1))
    for y in range(0, h, tile - overlap):
        for x in range(0, w, tile - overlap):
            part = kernel(image[y : y + tile, x : x + tile], y, x)
            m = transform.weights(*part.shape[:2], overlap * scale, edge_safe)[:, :, None]
            total[y * scale : y * scale + len(part), x * scale : x * scale + part.shape[1]] += part * m
            weight[y * scale : y * scale + len(part), x * scale : x * scale + part.shape[1]] += m
    return total / np.maximum(weight, 1e-8)


@pytest.mark.parametrize(("h", "w", "c", "tile", "overlap", "scale", "edge_safe"), [(9, 7, 1, 4, 1, 1, True), (20, 13, 3, 6, 2, 2, True), (13, 20, 4, 7, 4, 1, False), (5, 5, 3, 8, 2, 3, True), (31, 3, 1, 5, 0, 2, True)])
def test_bands_equal_a_whole_image(spark, h, w, c, tile, overlap, scale, edge_safe):
    def kernel(x, top, left):
        return x.repeat(scale, 0).repeat(scale, 1) * (1 + top / 10 + left / 7)

    r = np.random.default_rng(h)
    images = [r.random((h, w, c)) for _ in range(3)]
    rows = spark.createDataFrame([(i, x.reshape(-1).tolist(), h, w) for i, x in enumerate(images)], "id long, v array<double>, h int, w int")
    bands = transform.single_pass(rows, "id", "v", "h", "w", kernel, tile, overlap, edge_safe, scale)
    got = {r["id"]: r for r in transform.assembled(bands, "id").collect()}
    for i, x in enumerate(images):
        assert (got[i]["height"], got[i]["width"], got[i]["error"]) == (h * scale, w * scale, None)
        assert np.allclose(np.array(got[i]["values"]).reshape(h * scale, w * scale, c), naive_blend(x, kernel, tile, overlap, scale, edge_safe))


def test_tile_weights_equal_the_columns(spark):
    for h, w, o in [(6, 8, 2), (5, 5, 3), (4, 4, 0), (3, 9, 4), (4, 6, 1), (7, 4, 4)]:
        cells = spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
        for safe in (False, True):
            got = cells.select("y", "x", tiles.weight_2d(F.col("y"), F.col("x"), F.lit(h), F.lit(w), F.lit(o), safe).alias("v")).orderBy("y", "x").collect()
            assert np.allclose([r["v"] for r in got], transform.weights(h, w, o, safe).reshape(-1))


def test_failing_tiles_fail_their_image_only(spark):
    def kernel(x, top, left):
        if x.max() > 1 and top:
            raise ValueError("too bright")
        return x

    rows = spark.createDataFrame([(1, [0.5] * 64, 8, 8), (2, [2.0] * 64, 8, 8), (3, [0.5] * 63, 8, 8), (4, None, 8, 8)], "id long, v array<double>, h int, w int")
    got = {r["id"]: r for r in transform.upscale(rows, "id", "v", "h", "w", kernel, 1, 5, 2, passes=2, target=F.lit(2), contrast=1.1).collect()}
    assert got[1]["error"] is None and len(got[1]["values"]) == 256
    assert got[2]["error"] and got[3]["error"] and got[4]["error"] and not any(got[i]["values"] for i in (2, 3, 4))


def test_enhancement():
    r = np.random.default_rng(1)
    x = r.random((6, 5, 3))
    assert np.array_equal(transform.enhanced(x), x)
    soft = x.copy()
    for y in range(1, 5):
        for z in range(1, 4):
            soft[y, z] = (x[y - 1 : y + 2, z - 1 : z + 2].sum((0, 1)) + 4 * x[y, z]) / 13
    assert np.allclose(transform.enhanced(x, sharpness=0.5), np.clip(soft + (x - soft) * 1.5, 0, 1))
    grey = x @ np.array([0.299, 0.587, 0.114])
    assert np.allclose(transform.enhanced(x, contrast=0.7), grey.mean() + (x - grey.mean()) * 0.7)
    assert np.allclose(transform.enhanced(x, colour=0.0), np.repeat(grey[:, :, None], 3, 2))


def test_passes_add_up(spark):
    rows = spark.createDataFrame([(1, [0.25, 0.75], 1, 2)], "id long, v array<double>, h int, w int")
    done = transform.upscale(rows, "id", "v", "h", "w", lambda x, y, z: x.repeat(2, 0).repeat(2, 1), 2, passes=3).first()
    assert (done["height"], done["width"]) == (8, 16) and done["values"][:16] == [0.25] * 8 + [0.75] * 8


def test_words_against_sets(spark):
    r = np.random.default_rng(2)
    for ids in ([], [0], [1], list(range(64)), list(range(63)), list(range(65)), list(range(4096)), list(range(4097)), [i for i in range(5000) if i != 4100], [i for i in range(300) if not 64 <= i < 128], [-1, -64, -65, 0, 1, 3], [1 << 40, 0], r.integers(-50, 400, 200).tolist()):
        rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "n long")
        known = set(ids)
        first = next(i for i in range(10**6) if i not in known)
        assert validate.contiguous_prefix(rows, "n").first()["prefix_length"] == first
        assert sorted(x["n"] for x in validate.missing(rows, "n", 130).collect()) == [i for i in range(130) if i not in known]
        other = spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(None,)], "n long")
        assert sorted(x["n"] for x in validate.extra(rows, "n", other).collect()) == sorted(known - set(range(0, 200, 3)))


def test_completeness_of_keys(spark):
    rows = {"a": [0, 1, 2, 5, 5, 200], "b": list(range(130)), "c": [], "d": [-3, 0, 64, 63, 62], "e": list(range(64)), "f": [1 << 33]}
    df = spark.createDataFrame([(k, i) for k, v in rows.items() for i in v] + [("c", None), (None, 3)], "k string, n long")
    sizes = {"a": 6, "b": 128, "c": 2, "d": 63, "e": 64, "f": 0, "z": 5}
    got = {x["k"]: tuple(x)[1:] for x in validate.completeness(df, spark.createDataFrame(list(sizes.items()), "k string, m int"), "k", "n", "m").collect()}
    for k, m in sizes.items():
        have = set(rows.get(k, []))
        prefix = next(i for i in range(m + 1) if i not in have or i == m)
        assert got[k] == (m - len(have & set(range(m))), len(have - set(range(m))), prefix), k


def test_session_names(spark):
    rows = [("a", 2, "x/two.mp4"), ("a", 1, "one.png"), ("a", 3, "three.MOV"), ("b", 1, "n.txt"), ("b", 2, "p.q.jpg"), ("c", 1, "only.txt"), (None, 1, "z.gif")]
    got = {r["k"]: tuple(r)[1:] for r in media_source.session_names(spark.createDataFrame(rows, "k string, n int, path string"), "k", "n").collect()}
    assert got == {"a": ("two", "one\ntwo\nthree"), "b": ("p.q", "n\np.q"), "c": ("", "only"), None: ("z", "z")}


def test_resized_sums_run_in_ascending_order():
    rng = np.random.default_rng(65)
    for kind, size, to in (("lanczos", 8, 16), ("lanczos", 9, 4), ("bilinear", 8, 16)):
        rows, weight = rng.integers(0, 256, (200, size, 3)).astype(float), resample.FILTERS[kind](size, to)
        want = np.zeros((200, to, 3))
        for i in range(size):
            want += weight[:, i][:, None] * rows[:, i : i + 1]
        assert (resample.weighed(weight, rows) == want).all()


def test_exact_halves_at_a_border_follow_the_sum_in_order():
    # these sums are exactly a half; in the order of the pixels the first two reach it, the others stay below
    rows, ends, halves = [], [], []
    weight = resample.lanczos(8, 16)
    for row, o in (([0, 6, 0, 28, 2, 6, 34, 46], 15), ([222, 212, 254, 249, 250, 210, 238, 250], 15), ([1, 16, 14, 4, 6, 12, 40, 52], 15), ([40, 28, 0, 0, 0, 0, 0, 10], 0)):
        total = 0.0
        for w, v in zip(weight[o].tolist(), row, strict=True):
            total += w * v
        rows.append(row), ends.append(o), halves.append(total)
    got = resample.resized(np.array(rows, float)[:, None, :, None], 1, 16, as_bytes=True)[:, 0, :, 0]
    assert [got[i, o] for i, o in enumerate(ends)] == [float(int(x + 0.5)) for x in halves]


def arrow_run(monkeypatch, df, build):
    """The function that ``build`` hands to ``mapInArrow``."""
    runs = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema, *a: runs.append(run) or self)
    build(df)
    monkeypatch.undo()
    return runs[-1]


def test_images_leave_in_bounded_batches(spark, monkeypatch):
    df = spark.createDataFrame([], "id long, height int, width int, values array<double>, error string, th int, tw int")
    small = [np.random.default_rng(i).random(8 * 8 * 3) if i % 7 else None for i in range(60)]
    sides = [700 if i == 30 else 150 for i in range(60)]  # one is larger than a batch may be
    ints = lambda x: pa.array(x, pa.int32())
    rows = [pa.array(range(60), pa.int64()), pa.array([None if x is None else x.tolist() for x in small], pa.list_(pa.float64())), ints([8] * 60), ints([8] * 60), ints(sides), ints(sides)]
    resize = arrow_run(monkeypatch, df, lambda d: resample.resize(d, "id", *(F.col(c) for c in ("values", "height", "width", "th", "tw"))))
    got = list(resize(iter([pa.RecordBatch.from_arrays(rows, names=["id", "v", "a", "b", "c", "d"])])))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(60))
    assert len(got) > 4 and all(b.num_rows == 1 or len(b.column(3).flatten()) <= 1 << 20 for b in got)
    for b in got:
        for i, x, e in zip(b.column(0).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
            if small[i] is None:
                assert not x.is_valid and e == "0 values in 8 x 8 pixels"
            else:
                want = resample.resized(small[i].reshape(1, 8, 8, 3), sides[i], sides[i])
                assert e is None and np.array_equal(x.values.to_numpy(), want.reshape(-1))

    large = [np.full(400 * 300 * 3, i / 9) if i % 4 else None for i in range(9)]
    rows = [pa.array(range(9), pa.int64()), ints([400] * 9), ints([300] * 9), pa.array([None if x is None else x.tolist() for x in large], pa.list_(pa.float64())), pa.array([None if i % 4 else "e" for i in range(9)])]
    enhance = arrow_run(monkeypatch, df, lambda d: transform.post_process(d, "id", contrast=1.5))
    got = list(enhance(iter([pa.RecordBatch.from_arrays(rows, names=["id", "height", "width", "values", "error"])])))
    assert len(got) > 2 and all(b.num_rows == 1 or len(b.column(3).flatten()) <= 1 << 20 for b in got)
    shown = [(i, None if not x.is_valid else x.values.to_numpy(), e) for b in got for i, x, e in zip(b.column(0).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True)]
    for i, x, e in shown:
        assert (x is None and e == "e") if large[i] is None else np.array_equal(x, transform.enhanced(large[i].reshape(400, 300, 3), contrast=1.5).reshape(-1))
    assert [s[0] for s in shown] == list(range(9))
