"""Compute once for each representative, then fan the results out to all items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dedupe


def fan_out(mapped: DataFrame, results: DataFrame, result_cols: list[str], key: str = "unique_id", fallback: dict[str, Column] | None = None) -> DataFrame:
    """All items with their representative's result.

    ``results`` has (``key``, result columns).  A missing result is null, or the fallback's
    value from the item's own columns; ``is_missing`` tells.
    """
    marked = results.select(key, *result_cols, F.lit(True).alias("sg_hit"))
    out = mapped.join(marked, key, "left").withColumn("is_missing", F.col("sg_hit").isNull()).drop("sg_hit")
    for c, value in (fallback or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), value))
    return out


def compute_once(mapped: DataFrame, compute: Callable[[DataFrame], DataFrame], id_col: str, result_cols: list[str], items: DataFrame | None = None) -> DataFrame:
    """Apply ``compute`` to representatives only and join the results to all items.

    With ``items``, ``mapped`` may be narrow: what the work needs is read from there.
    """
    work = dedupe.work_list(mapped)
    if items is not None:
        work = items.join(work.select(id_col), id_col, "left_semi")
    return fan_out(mapped, compute(work).withColumnRenamed(id_col, "unique_id"), result_cols)
