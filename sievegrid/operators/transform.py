"""The composed transform: tiles, kernel, weighted recombination, resize, post-processing.

A tile is one row with an array of its pixels, and so is a band of finished pixels; no pixel is a row.  Tiles go
through the kernel wherever they are, are weighted there, and are cut where the bands meet; a band of one image
is summed up in one place, which holds the pixels of that band alone.  So work grows with the pixels, and one large
image is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import lists
from ..functions.memory import lean
from . import resample

Kernel = Callable[[np.ndarray, int, int], np.ndarray]
FLOOR = 1e-8  # fixed value: the least sum of weights
_TILE = "height int, width int, y int, x int, high int, wide int, values array<double>, error string"
_PIECE = "band int, y int, x int, high int, wide int, width int, values array<double>, weights array<double>, error string"
BANDS = "band int, y int, high int, width int, values array<double>, error string"


_FLUSH_VALUES = 1 << 20


class _Rows:
    """Rows that wait to be a batch; columns of arrays become lists."""

    def __init__(self, fields: dict[str, pa.DataType]) -> None:
        self.fields, self.rows, self.values = fields, [], 0

    def add(self, *row: object) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.values += sum(x.size for x in row if isinstance(x, np.ndarray))
        if self.values >= _FLUSH_VALUES or len(self.rows) >= _FLUSH_VALUES >> 4:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(zip(*self.rows, strict=True), self.fields.values(), strict=True)
            yield pa.RecordBatch.from_arrays([lists.column(list(c)) if t == _LIST else pa.array(c, t) for c, t in columns], names=list(self.fields))
        self.rows, self.values = [], 0


_LIST = pa.list_(pa.float64())


def _fields(id_col: str, kind: pa.DataType, ddl: str) -> dict[str, pa.DataType]:
    kinds = {"int": pa.int32(), "array<double>": _LIST, "string": pa.string()}
    return {id_col: kind} | {name: kinds[t] for name, t in (x.split(" ") for x in ddl.split(", "))}


def starts(size: int, tile: int, overlap: int) -> range:
    return range(0, size, tile - overlap)


@lru_cache(64)
def weights(height: int, width: int, overlap: int, edge_safe: bool) -> np.ndarray:
    """The weight of each pixel of a tile: linear ramps at its sides, all ones where the overlap doesn't fit.

    As specified the ramp is 0 at the border; ``edge_safe`` keeps it above 0.  Where both ramps of an axis meet, the
    far one rules across and both multiply down.
    """
    if not 0 < overlap <= min(height, width):
        return np.ones((height, width))
    near = (np.arange(overlap) + 1) / (overlap + 1) if edge_safe else np.linspace(0, 1, overlap) if overlap > 1 else np.zeros(1)
    across, down = np.ones(width), np.ones(height)
    across[:overlap] = near
    across[-overlap:] = near[::-1]
    down[:overlap] = near
    down[-overlap:] *= near[::-1]
    return down[:, None] * across[None, :]


def cut(images: DataFrame, id_col: str, value_col: str, height: str, width: str, tile: int = 512, overlap: int = 32) -> DataFrame:
    """(id, height, width, y, x, high, wide, values, error): a row a tile; a small image is one tile.

    An image that is null or doesn't fit its size is one row with an error.
    """
    if overlap >= tile:
        raise ValueError("the overlap must be smaller than the tile")

    def tiles_of(values: np.ndarray, h: int, w: int) -> Iterator[tuple[int, int, np.ndarray]]:
        image = values.reshape(h, w, -1)
        if h * w <= tile * tile:
            yield 0, 0, image
            return
        for y in starts(h, tile, overlap):
            for x in starts(w, tile, overlap):
                yield y, x, image[y : y + tile, x : x + tile]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(_fields(id_col, batch.column(0).type, _TILE))
            flat, offsets, whole = lists.flat(batch.column(1))
            for i, (key, h, w) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                n = int(offsets[i + 1] - offsets[i])
                if whole[i] and h and w and n and n % (h * w) == 0:
                    for y, x, part in tiles_of(flat[offsets[i] : offsets[i + 1]], h, w):
                        yield from out.add(key, h, w, y, x, *part.shape[:2], part, None)
                else:
                    yield from out.add(key, h or 0, w or 0, 0, 0, 0, 0, None, f"{n if whole[i] else 'no'} values in {h} x {w} pixels")
            yield from out.flush()

    kind = images.schema[id_col].dataType.simpleString()
    rows = images.select(id_col, A.doubles(F.col(value_col)).alias("v"), F.col(height).cast("int").alias("h"), F.col(width).cast("int").alias("w"))
    return rows.mapInArrow(lean(run), f"{id_col} {kind}, {_TILE}")


def blended(tiles: DataFrame, id_col: str, kernel: Kernel, scale: int = 1, tile: int = 512, overlap: int = 32, edge_safe: bool = True, clip: bool = False) -> DataFrame:
    """(id, band, y, high, width, values, error): tiles through the kernel, summed where they overlap.

    ``kernel`` gets a tile (height, width, channels) and its place and returns one ``scale`` times as large.  With
    ``clip`` its NaN and infinities become 0 and 1, and values stay in 0 to 1.  A kernel that fails on a tile fails
    the image, with its error in the band of that tile; other images go on.
    """
    step = (tile - overlap) * scale

    def tidy(x: np.ndarray) -> np.ndarray:
        return np.clip(np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=0.0), 0, 1) if clip else x

    def pieces_of(tile_of: np.ndarray, h: int, w: int, y: int, x: int, high: int, wide: int) -> Iterator[tuple]:
        done = tidy(np.asarray(kernel(tile_of.reshape(high, wide, -1), y, x), float))
        if done.shape[:2] != (high * scale, wide * scale):
            raise ValueError(f"the kernel gave {done.shape} for {high} x {wide} at scale {scale}")
        if (high, wide) == (h, w):  # an image of one tile is one band
            yield 0, 0, 0, *done.shape[:2], w * scale, done, None, None
            return
        weight = weights(*done.shape[:2], overlap * scale, edge_safe)
        part, top = done * weight[:, :, None], y * scale
        for band in range(top // step, (top + len(done) - 1) // step + 1):
            low, end = max(top, band * step), min(top + len(done), (band + 1) * step)
            rows = slice(low - top, end - top)
            yield band, low, x * scale, end - low, done.shape[1], w * scale, part[rows], weight[rows], None

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(_fields(id_col, batch.column(0).type, _PIECE))
            flat, offsets, _ = lists.flat(batch.column(7))
            for i, (key, h, w, y, x, high, wide, error) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 6, 8)), strict=True)):
                pieces: list[tuple] = []
                if error is None:
                    try:
                        pieces = list(pieces_of(flat[offsets[i] : offsets[i + 1]], h, w, y, x, high, wide))
                    except Exception as e:  # a kernel's own failure is data
                        error = f"{type(e).__name__}: {e}"
                for piece in pieces if error is None else [(y * scale // step, 0, 0, 0, 0, w * scale, None, None, error)]:
                    yield from out.add(key, *piece)
            yield from out.flush()

    def summed(band: int, pieces: list[tuple]) -> tuple:
        """The pieces of one band, in the order of their places."""
        errors = sorted({p[-1] for p in pieces if p[-1] is not None})
        y, width = min(p[0] for p in pieces), pieces[0][4]
        if errors:
            return band, y, 0, width, None, "; ".join(errors)
        high = max(p[0] + p[2] for p in pieces) - y
        if pieces[0][6] is None:
            return band, y, high, width, pieces[0][5], None
        total, sums = np.zeros((high, width, pieces[0][5].size // (pieces[0][2] * pieces[0][3]))), np.zeros((high, width, 1))
        for top, x, tall, wide, _, values, weight, _ in pieces:
            spot = slice(top - y, top - y + tall), slice(x, x + wide)
            total[spot] += values.reshape(tall, wide, -1)
            sums[spot] += weight.reshape(tall, wide, 1)
        return band, y, high, width, tidy(total / np.maximum(sums, FLOOR)), None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], None
        for batch in batches:
            out = out or _Rows(_fields(id_col, batch.column(0).type, BANDS))
            values, weight = lists.flat(batch.column(7)), lists.flat(batch.column(8))
            for i, (key, band, y, x, high, wide, width, error) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 6, 9)), strict=True)):
                if now != (key, band) and held:
                    yield from out.add(now[0], *summed(now[1], held))
                    held = []
                now = key, band
                # copies, so that a piece doesn't keep its whole batch
                parts = [f[0][f[1][i] : f[1][i + 1]].copy() if f[2][i] else None for f in (values, weight)]
                held.append((y, x, high, wide, width, *parts, error))
        if held:
            yield from out.add(now[0], *summed(now[1], held))
            yield from out.flush()

    kind = tiles.schema[id_col].dataType.simpleString()
    pieces = tiles.mapInArrow(lean(weigh), f"{id_col} {kind}, {_PIECE}")
    return pieces.repartition(id_col, "band").sortWithinPartitions(id_col, "band", "y", "x").mapInArrow(lean(add), f"{id_col} {kind}, {BANDS}")


def single_pass(images: DataFrame, id_col: str, value_col: str, height: str, width: str, kernel: Kernel, tile: int, overlap: int, edge_safe: bool = True, scale: int = 1, clip: bool = False) -> DataFrame:
    """(id, band, y, high, width, values, error): every tile through the kernel, blended where tiles overlap."""
    return blended(cut(images, id_col, value_col, height, width, tile, overlap), id_col, kernel, scale, tile, overlap, edge_safe, clip)


def assembled(bands: DataFrame, id_col: str, out: str = "values") -> DataFrame:
    """(id, height, width, values, error): the bands of each image, which is a row again."""
    whole = bands.groupBy(id_col).agg(F.sum("high").cast("int").alias("height"), F.max("width").alias("width"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("sg_e"), F.array_sort(F.collect_list(F.struct("band", "values"))).alias("sg"))
    error = F.nullif("sg_e", F.lit(""))
    return whole.select(id_col, "height", "width", F.when(error.isNull(), F.flatten(F.transform("sg", lambda b: b["values"]))).alias(out), error.alias("error"))


def upscale(images: DataFrame, id_col: str, value_col: str, height: str, width: str, kernel: Kernel, scale: int, tile: int = 512, overlap: int = 32, passes: int = 1, target: Column | None = None, sharpness: float = 0.0, contrast: float = 1.0, colour: float = 1.0, clip: bool = False, kind: str = "lanczos") -> DataFrame:
    """(id, height, width, values, error): all passes, post-processing, then the size that ``target`` asks for.

    ``target`` is the multiple of the original size; the default is what the passes give.
    """
    now, v, h, w = images.select(id_col, value_col, height, width), value_col, height, width
    for _ in range(passes):
        now = assembled(single_pass(now, id_col, v, h, w, kernel, tile, overlap, scale=scale, clip=clip), id_col)
        v, h, w = "values", "height", "width"
    done = post_process(now, id_col, sharpness, contrast, colour)
    if target is None:
        return done
    sizes = images.select(F.col(id_col).alias("sg_id"), F.floor(F.col(height) * target).alias("sg_h"), F.floor(F.col(width) * target).alias("sg_w"))
    placed = done.where("error is null").join(sizes, F.col(id_col) == F.col("sg_id"))
    larger = resample.resize(placed, id_col, F.col("values"), F.col("height"), F.col("width"), F.col("sg_h"), F.col("sg_w"), kind)
    return larger.unionByName(done.where("error is not null"))


def enhanced(image: np.ndarray, sharpness: float = 0.0, contrast: float = 1.0, colour: float = 1.0) -> np.ndarray:
    """An image of 0 to 1 moved away from its smoothed, its mean grey and its grey version, in this order.

    Each step is left out at its neutral value.  Fixed values: the smoothing kernel has 5 in the middle of eight
    ones, and leaves the border as it is; grey has the weights of luminance.
    """
    if sharpness and min(image.shape[:2]) > 2:
        soft = image.copy()
        around = sum(image[1 + dy : image.shape[0] - 1 + dy, 1 + dx : image.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        soft[1:-1, 1:-1] = (around + 4 * image[1:-1, 1:-1]) / 13
        image = np.clip(soft + (image - soft) * (1 + sharpness), 0, 1)
    grey = lambda x: x @ np.array(A.LUMA) if x.shape[2] == 3 else x.mean(2)
    if contrast != 1.0:
        middle = grey(image).mean()
        image = np.clip(middle + (image - middle) * contrast, 0, 1)
    if colour != 1.0 and image.shape[2] == 3:
        plain = grey(image)[:, :, None]
        image = np.clip(plain + (image - plain) * colour, 0, 1)
    return image


def post_process(images: DataFrame, id_col: str, sharpness: float = 0.0, contrast: float = 1.0, colour: float = 1.0) -> DataFrame:
    """(id, height, width, values, error) with every image enhanced; neutral values leave all as it is."""
    if not sharpness and contrast == 1.0 and colour == 1.0:
        return images

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, whole = lists.flat(batch.column(3))
            h, w = (batch.column(k).to_pylist() for k in (1, 2))
            for low, high in lists.blocks(np.diff(offsets), _FLUSH_VALUES):
                out = [enhanced(flat[offsets[i] : offsets[i + 1]].reshape(h[i], w[i], -1), sharpness, contrast, colour) if whole[i] else None for i in range(low, high)]
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], lists.column(out), rows.column(4)], names=batch.schema.names)

    return images.select(id_col, "height", "width", "values", "error").mapInArrow(lean(run), images.select(id_col, "height", "width", "values", "error").schema)


def pixels(bands: DataFrame, id_col: str) -> DataFrame:
    """(id, y, x, value) of images of one channel, for reports of single pixels."""
    cells = bands.select(id_col, "y", "width", F.posexplode("values").alias("i", "value"))
    return cells.select(id_col, (F.col("y") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "value")
