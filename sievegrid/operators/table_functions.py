"""Table functions for SQL: an image's tiles, and the ordered fold of a key's rows.

    SELECT id, t.* FROM images, LATERAL tiles(height, width, 512, 32) t
    SELECT * FROM segments(TABLE(frames), 'video', 'frame_num', 256)

``tiles`` takes Arrow batches; it gives a row a tile and nothing for a null or empty size.  ``segments`` asks
for its table partitioned and ordered, so a key's rows stream through one task in order and a segment is all that is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Tiles:
    """(y, x, y_end, x_end) of every tile; the height and width may be columns, the tile and overlap are constants."""

    @staticmethod
    def analyze(height: AnalyzeArgument, width: AnalyzeArgument, tile: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not (tile.isConstantExpression and overlap.isConstantExpression):
            raise ValueError("the tile and its overlap have to be constants")
        if not 0 <= overlap.value < tile.value:
            raise ValueError("the overlap must be smaller than the tile")
        return AnalyzeResult(StructType([StructField(c, IntegerType()) for c in ("y", "x", "y_end", "x_end")]))

    def eval(self, height: int | None, width: int | None, tile: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
        if not height or not width or height < 0 or width < 0:
            return
        if height * width <= tile * tile:
            yield 0, 0, height, width
            return
        for y in range(0, height, tile - overlap):
            for x in range(0, width, tile - overlap):
                yield y, x, min(y + tile, height), min(x + tile, width)


class Segments:
    """(key, segment, first, last, n, numbers): runs of ``size`` numbers of each key, in order; null numbers are none."""

    def __init__(self) -> None:
        self.key, self.segment, self.numbers = None, None, []

    @staticmethod
    def analyze(table: AnalyzeArgument, by: AnalyzeArgument, order: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in table.dataType.fields} if table.isTable else set()
        if by.value not in names or order.value not in names:
            raise ValueError(f"the table has no columns {by.value} and {order.value}")
        fields = [StructField("key", StringType()), StructField("segment", LongType()), StructField("first", LongType()), StructField("last", LongType()), StructField("n", LongType()), StructField("numbers", ArrayType(LongType()))]
        return AnalyzeResult(StructType(fields), partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(order.value)])

    def _done(self) -> Iterator[tuple]:
        if self.numbers:
            yield self.key, self.segment, self.numbers[0], self.numbers[-1], len(self.numbers), self.numbers
        self.numbers = []

    def eval(self, row: Row, by: str, order: str, size: int) -> Iterator[tuple]:
        number = row[order]
        if number is None:
            return
        if number // size != self.segment:
            yield from self._done()
            self.segment = number // size
        self.key = None if row[by] is None else str(row[by])
        self.numbers.append(number)

    def terminate(self) -> Iterator[tuple]:
        """The last segment of a key."""
        yield from self._done()


def register(spark: SparkSession) -> SparkSession:
    """Make ``tiles`` and ``segments`` known to SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("tiles", udtf(Tiles, useArrow=True))
    spark.udtf.register("segments", udtf(Segments, useArrow=False))
    return spark
