"""Overlapping tiles: grid, blending weights, weighted recombination.

Fixed values, which results depend on: the ramps of ``weight_1d`` and the floor of 1e-8 in ``blend``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(size: Column, tile: int, overlap: int) -> Column:
    if overlap >= tile:
        raise ValueError("the overlap must be smaller than the tile")
    return F.sequence(F.lit(0), size - 1, F.lit(tile - overlap))


def grid(rows: DataFrame, height: str, width: str, tile: int = 512, overlap: int = 32) -> DataFrame:
    """A row a tile: (y, x, y_end, x_end); a small image is one tile."""
    small = F.col(height).cast("long") * F.col(width) <= tile * tile
    whole = F.array(F.lit(0))
    ys = rows.withColumn("y", F.explode(F.when(small, whole).otherwise(starts(F.col(height).cast("int"), tile, overlap))))
    xs = ys.withColumn("x", F.explode(F.when(small, whole).otherwise(starts(F.col(width).cast("int"), tile, overlap))))
    end = lambda at, size: F.when(small, F.col(size)).otherwise(F.least(F.col(at) + tile, F.col(size))).cast("int")
    return xs.withColumns({"y_end": end("y", height), "x_end": end("x", width)})


def weight_1d(at: Column, size: Column, overlap: Column, edge_safe: bool = False, multiply: bool = False) -> Column:
    """Linear ramps up and down at both ends; all ones where the overlap doesn't fit.

    As specified the ramp is 0 at the border; ``edge_safe`` keeps it above 0, so that border
    pixels, which no other tile covers, survive.  Where both ramps meet, the far one rules on
    the first axis and both multiply on the second.
    """
    o = overlap.cast("double")
    ramp = lambda d: (d + 1) / (o + 1) if edge_safe else F.when(o > 1, d / F.nullif(o - 1, F.lit(0.0))).otherwise(F.lit(0.0))
    near = F.when(at < overlap, ramp(at)).otherwise(F.lit(1.0))
    far = ramp(size - 1 - at)
    return F.when(at >= size - overlap, near * far if multiply else far).otherwise(near)


def weight_2d(y: Column, x: Column, height: Column, width: Column, overlap: Column, edge_safe: bool = False) -> Column:
    fits = (overlap > 0) & (overlap <= F.least(height, width))
    return F.when(fits, weight_1d(x, width, overlap, edge_safe) * weight_1d(y, height, overlap, edge_safe, True)).otherwise(F.lit(1.0))


def weight_table(sizes: DataFrame, height: str, width: str, overlap: str, edge_safe: bool = False) -> DataFrame:
    """(height, width, overlap, weights): each distinct tile size's map, made once and joined to tiles."""
    h, w, o = F.col(height), F.col(width), F.col(overlap)
    cells = F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: weight_2d(F.floor(i / w), i % w, h, w, o, edge_safe))
    return sizes.select(height, width, overlap).distinct().withColumn("weights", cells)


def blend(values: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of all tiles' values at a place, combined partly in each task."""
    sums = values.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias("sg_v"), F.sum(weight).alias("sg_w"))
    return sums.select(*keys, (F.col("sg_v") / F.greatest(F.col("sg_w"), F.lit(1e-8))).alias(value))
