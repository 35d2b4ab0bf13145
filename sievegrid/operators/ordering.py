"""Positions over a whole ordered table without one task for all rows.

Quantiles of the order column cut the table into blocks of some ``BLOCK_ROWS`` rows, however sparse or
skewed the values are; a window over the block totals (``BLOCKS`` rows at most) gives each block's start, and a
window inside each block the rest.  A table of one block needs no quantiles.  The same blocks cut one key's rows, so
a key that holds a third of the table is many tasks' work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1 << 13
BLOCK_ROWS = 100_000


def _count(rows: DataFrame, order_col: str) -> int:
    return rows.agg(F.count(order_col).alias("n")).first()["n"]


def _blocked(rows: DataFrame, order_col: str, blocks: int | None = None) -> DataFrame:
    """``rows`` with their block (``sg_block``), -1 for a null order value.

    Without ``blocks`` their number follows from that of the rows.
    """
    if blocks is None:
        blocks = min(BLOCKS, math.ceil(_count(rows, order_col) / BLOCK_ROWS))
    known = F.col(order_col).isNotNull()
    bounds = None
    if blocks > 1:
        # a sketch of bounded size; its errors make blocks uneven, not wrong
        points = [i / blocks for i in range(1, blocks)]
        bounds = rows.agg(F.percentile_approx(order_col, points, 50 * blocks).alias("b")).first()["b"]
    if not bounds:
        return rows.withColumn("sg_block", F.when(known, 0).otherwise(-1))
    # the bounds are a column of one row, not constants of the code
    bounds = sorted(set(bounds))
    step = math.isqrt(len(bounds)) + 1
    one = rows.sparkSession.range(1).select(F.array(*map(F.lit, bounds)).alias("sg_fine"))
    one = one.withColumn("sg_coarse", F.filter("sg_fine", lambda _, i: i % step == 0))
    # two short searches: among every n-th bound, then among the n that follow
    passed = lambda found: F.size(F.filter(found, lambda b: b <= F.col(order_col)))
    first = (F.greatest(passed(F.col("sg_coarse")), F.lit(1)) - 1) * step
    block = F.when(F.col(order_col) < F.get("sg_fine", F.lit(0)), 0).otherwise(first + passed(F.slice("sg_fine", first + 1, step)))
    return rows.crossJoin(F.broadcast(one)).withColumn("sg_block", F.when(known, block).otherwise(-1)).drop("sg_fine", "sg_coarse")


def row_numbers(rows: DataFrame, order_col: str, out: str = "rn", blocks: int | None = None) -> DataFrame:
    """``rows`` with their 1-based position by a distinct numeric column; a null order value has no position."""
    # null order values need no order, so they stay where they are
    blocked = _blocked(rows, order_col, blocks).withColumn("sg_salt", F.when(F.col("sg_block") < 0, F.spark_partition_id()).otherwise(0))
    before = Window.orderBy("sg_block").rowsBetween(Window.unboundedPreceding, -1)
    # a window over one row a block
    totals = blocked.where("sg_block >= 0").groupBy("sg_block").agg(F.count("*").alias("sg_n"))
    starts = totals.select("sg_block", F.coalesce(F.sum("sg_n").over(before), F.lit(0)).alias("sg_start"))
    inside = Window.partitionBy("sg_block", "sg_salt").orderBy(order_col)
    return blocked.join(F.broadcast(starts), "sg_block", "left").withColumn(out, F.col("sg_start") + F.row_number().over(inside)).drop("sg_block", "sg_salt", "sg_start")


def micro_batches(rows: DataFrame, order_col: str, size: int, blocks: int | None = None) -> DataFrame:
    """``rows`` with the number of their batch of ``size`` rows in order."""
    return row_numbers(rows, order_col, "sg_rn", blocks).withColumn("batch_id", F.floor((F.col("sg_rn") - 1) / size)).drop("sg_rn")


def every(position: Column, k: int) -> Column:
    """Rows that trigger a periodic action."""
    return position % k == 0


def progress(rows: DataFrame, order_col: str, blocks: int | None = None) -> DataFrame:
    """``rows`` with the completed fraction up to and with each."""
    total = rows.count()
    return row_numbers(rows, order_col, "sg_rn", blocks).withColumn("progress", F.col("sg_rn") / total).drop("sg_rn")


def sliding_buffer(rows: DataFrame, by: str, order_col: str, value: str, k: int, out: str = "buffer", blocks: int | None = None) -> DataFrame:
    """The row's value and the next k - 1 of its key, nulls included; rows without an order value come first.

    Within a block a bounded frame; over its end the first values of the key's next blocks,
    k - 1 of each at most.
    """
    blocked = _blocked(rows, order_col, blocks).withColumn("sg_v", F.struct(F.col(value).alias("v")))
    inside = Window.partitionBy(by, "sg_block").orderBy(order_col)
    heads = blocked.select(by, "sg_block", "sg_v", F.row_number().over(inside).alias("sg_rn")).where(F.col("sg_rn") < k)
    heads = heads.groupBy(by, "sg_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("sg_rn", "sg_v"))), lambda x: x["sg_v"]).alias("sg_head"))
    # a row a block and key
    later = Window.partitionBy(by).orderBy("sg_block").rowsBetween(1, max(1, k - 1))
    after = heads.select(F.col(by).alias("sg_by"), F.col("sg_block").alias("sg_at"), F.slice(F.flatten(F.collect_list("sg_head").over(later)), 1, max(1, k - 1)).alias("sg_after"))
    here = blocked.withColumn("sg_here", F.collect_list("sg_v").over(inside.rowsBetween(0, k - 1)))
    joined = here.join(after, F.col(by).eqNullSafe(F.col("sg_by")) & (F.col("sg_block") == F.col("sg_at")), "left")
    buffer = F.slice(F.when(F.col("sg_after").isNull(), F.col("sg_here")).otherwise(F.concat("sg_here", "sg_after")), 1, k)
    return joined.select(*rows.columns, F.transform(buffer, lambda x: x["v"]).alias(out))


def look_ahead(rows: DataFrame, by: str, order_col: str, value: str, out: str = "next", blocks: int | None = None) -> DataFrame:
    """The value of the key's next row, null after the last."""
    return sliding_buffer(rows, by, order_col, value, 2, "sg_pair", blocks).withColumn(out, F.get("sg_pair", F.lit(1))).drop("sg_pair")


def scale_progress(fraction: Column, start: float, span: float) -> Column:
    return F.lit(start) + fraction * span


def first_rows(rows: DataFrame, order_col: str, n: int) -> DataFrame:
    """A preview: the first n by key, kept by a partial top-n in every task."""
    return rows.orderBy(order_col).limit(n)
