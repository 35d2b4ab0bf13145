"""Resizing with separable filters, as sums of weighted pixels over batches of equal size.

``lanczos`` widens its support where an image shrinks, so that no pixel is skipped; ``bilinear`` takes the two
nearest pixels whatever the scale.  Results that depend on fixed values: three lobes, pixel centres at halves,
weights that sum to 1, and, for bytes, halves rounded up after each of the two passes.  Sums run from the first
pixel to the last on any machine: where weights make exact halves, as at a border, the order of a sum decides.
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

LOBES = 3
BATCH_VALUES = 1 << 20  # of the images that are resized and sent on at a time
RESIZED = "height int, width int, values array<double>, error string"


@lru_cache(64)
def lanczos(size: int, to: int) -> np.ndarray:
    """(to, size) weights."""
    scale = size / to
    stretch = max(scale, 1.0)
    centre = (np.arange(to) + 0.5)[:, None] * scale
    place = np.arange(size)[None, :]
    inside = (place >= np.floor(centre - LOBES * stretch + 0.5)) & (place < np.floor(centre + LOBES * stretch + 0.5))
    d = (place - centre + 0.5) / stretch
    turn = np.where(d == 0, 1.0, np.pi * d)  # at 0 the value is 1
    value = np.where(d == 0, 1.0, np.sin(turn) / turn * np.sin(turn / LOBES) / (turn / LOBES))
    weight = np.where(inside & (np.abs(d) < LOBES), value, 0.0)
    return weight / np.cumsum(weight, 1)[:, -1:]


@lru_cache(64)
def bilinear(size: int, to: int) -> np.ndarray:
    """(to, size) weights."""
    at = np.maximum((np.arange(to) + 0.5) * (size / to) - 0.5, 0)
    low = np.minimum(np.floor(at).astype(int), size - 1)
    out = np.zeros((to, size))
    np.add.at(out, (np.arange(to), low), 1 - (at - low))
    np.add.at(out, (np.arange(to), np.minimum(low + 1, size - 1)), at - low)
    return out


@lru_cache(64)
def nearest(size: int, to: int) -> np.ndarray:
    """(to, size) weights."""
    return np.eye(size)[np.arange(to) * size // to]


FILTERS: dict[str, Callable[[int, int], np.ndarray]] = {"lanczos": lanczos, "bilinear": bilinear, "nearest": nearest}


def weighed(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n, to, m) sums of ``rows`` (n, size, m), each over the places that have a weight, in ascending order."""
    used, to = weights != 0, np.arange(len(weights))
    first, last = used.argmax(1), weights.shape[1] - 1 - used[:, ::-1].argmax(1)
    out = np.zeros((len(rows), len(weights), rows.shape[2]))
    for k in range(int((last - first).max()) + 1):
        at = np.minimum(first + k, last)
        out += np.where(first + k <= last, weights[to, at], 0.0)[:, None] * rows[:, at]
    return out


def resized(images: np.ndarray, to_height: int, to_width: int, kind: str = "lanczos", as_bytes: bool = False) -> np.ndarray:
    """Images (n, height, width, channels) at another size; ``as_bytes`` are whole numbers of 0 to 255."""
    n, height, width, channels = images.shape
    settle = (lambda x: np.clip(np.floor(x + 0.5), 0, 255)) if as_bytes else (lambda x: x)
    # rows first, then columns
    wide = settle(weighed(FILTERS[kind](width, to_width), images.reshape(n * height, width, channels)))
    return settle(weighed(FILTERS[kind](height, to_height), wide.reshape(n, height, to_width * channels))).reshape(n, to_height, to_width, channels)


def resize(images: DataFrame, id_col: str, values: Column, height: Column, width: Column, to_height: Column, to_width: Column, kind: str = "lanczos", as_bytes: bool = False) -> DataFrame:
    """(id, height, width, values, error) of row-major images with interleaved channels.

    With ``as_bytes`` values of 0 to 1 become bytes first and the results are bytes by 255, as an
    image library's would be.  An image at its size already is left as it is.  Nulls, and arrays that don't fit
    their size, are errors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, whole = lists.flat(batch.column(1))
            sizes = np.stack([batch.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4, 5)], 1)
            length = np.diff(offsets)
            area = sizes[:, 0] * sizes[:, 1]
            good = whole & (sizes > 0).all(1) & (length > 0) & (length % np.maximum(area, 1) == 0)
            keys = np.concatenate([sizes, length[:, None]], 1)
            made = np.where(good, length / np.maximum(area, 1) * sizes[:, 2] * sizes[:, 3], 0)
            for low, high in lists.blocks(np.maximum(length, made), BATCH_VALUES):
                rows, fit, of = batch.slice(low, high - low), good[low:high], keys[low:high]
                out: list[np.ndarray | None] = [None] * len(of)
                for key in np.unique(of[fit], axis=0):
                    at = np.flatnonzero(fit & (of == key).all(1))
                    h, w, to_h, to_w, n = key.tolist()
                    block = lists.rows_of(flat, offsets, low + at, n).reshape(len(at), h, w, -1)
                    if (h, w) != (to_h, to_w):
                        block = resized(np.rint(np.clip(block, 0, 1) * 255), to_h, to_w, kind, True) / 255 if as_bytes else resized(block, to_h, to_w, kind)
                    for i, x in zip(at.tolist(), block, strict=True):
                        out[i] = x
                error = [None if ok else f"{n} values in {h} x {w} pixels" for ok, (h, w, _, _, n) in zip(fit.tolist(), of.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(4), rows.column(5), lists.column(out), pa.array(error, pa.string())], names=[id_col, "height", "width", "values", "error"])

    kind_of = images.schema[id_col].dataType.simpleString()
    typed = [F.col(id_col), A.doubles(values).alias("sg_v"), *(c.cast("int").alias(f"sg_{i}") for i, c in enumerate((height, width, to_height, to_width)))]
    return images.select(*typed).mapInArrow(lean(run), f"{id_col} {kind_of}, {RESIZED}")


def to_height(images: DataFrame, id_col: str, values: Column, height: Column, width: Column, target: Column, as_bytes: bool = False) -> DataFrame:
    """At a target height and the same ratio; 0 leaves the image as it is."""
    fits = target > 0
    return resize(images, id_col, values, height, width, F.when(fits, target).otherwise(height), F.when(fits, F.floor(target * (width / height))).otherwise(width), as_bytes=as_bytes)


def to_scale(images: DataFrame, id_col: str, values: Column, height: Column, width: Column, original: tuple[Column, Column], scale: Column, as_bytes: bool = False) -> DataFrame:
    """At a multiple of the original (height, width), which need not be the image's own size."""
    return resize(images, id_col, values, height, width, F.floor(original[0] * scale), F.floor(original[1] * scale), as_bytes=as_bytes)


def frame_hashes(frames: DataFrame, id_col: str, values: Column, height: Column, width: Column, guard_flat: bool = False) -> DataFrame:
    """(id, frame_hash, gray_hash) of frames of three channels, both from 16 x 16 pixels.

    The average hash takes the Lanczos filter and bytes, the grey hash the bilinear filter; frames with an error have none.
    """
    side = F.lit(16)
    smooth = resize(frames, id_col, values, height, width, side, side, "lanczos", True)
    plain = resize(frames, id_col, values, height, width, side, side, "bilinear")
    # whole numbers add up exactly in any order
    of_bytes = F.transform("values", lambda x: F.bround(x * 255))
    left = smooth.select(id_col, A.average_hash(of_bytes, 3, guard_flat).alias("frame_hash"))
    right = plain.select(id_col, A.gray_hash(A.gray(F.col("values"))).alias("gray_hash"))
    return left.join(right, id_col)
