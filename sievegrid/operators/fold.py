"""Ordered N to 1: the frames of a video in order, in segments of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(frames: DataFrame, by: str, order_col: str, value: Column, size: int = 256) -> DataFrame:
    """(by, segment, first, last, n, n_distinct, values): each segment's values by ascending frame number.

    Segment k holds the numbers k * size to (k + 1) * size - 1, so no key's rows meet in one
    task however long it is; a segment is what an encoder takes at once, and segments are
    joined by their numbers.  Repeated numbers stay, ordered by value; ``n`` counts them all.
    """
    rows = frames.select(by, F.floor(F.col(order_col) / size).alias("segment"), F.struct(F.col(order_col).alias("at"), value.alias("value")).alias("sg"))
    held = rows.groupBy(by, "segment").agg(F.array_sort(F.collect_list("sg")).alias("sg"), F.min("sg.at").alias("first"), F.max("sg.at").alias("last"))
    numbers = F.array_distinct(F.transform("sg", lambda x: x["at"]))
    return held.select(by, "segment", "first", "last", F.size("sg").cast("long").alias("n"), F.size(numbers).cast("long").alias("n_distinct"), F.transform("sg", lambda x: x["value"]).alias("values"))


def gaps(folded: DataFrame, by: str) -> DataFrame:
    """(by, n_missing): numbers from 0 to each key's last that no segment holds; complete keys have 0.

    Numbers below 0 fill none of them.
    """
    sums = folded.where("first >= 0").groupBy(by).agg(F.sum("n_distinct").alias("n"), F.max("last").alias("last"))
    return sums.select(by, (F.col("last") + 1 - F.col("n")).alias("n_missing"))
