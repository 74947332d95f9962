"""Pages of a long result: sorted once into ranges, of which a page reads one or two."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Pages:
    """A result at path, in order. Write it once with Pages.build(), open it any number of times.

    The rows lie in ranges of their order, a folder for each. Beside them is an index with a row for each range: its number, how
    many rows it has, and its last key. The index is all that the driver holds: as many rows as there are ranges.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path, order
        self.index = sorted(spark.read.parquet(f"{path}/index").collect(), key=lambda r: r["range_"])
        self.ends = list(accumulate(r["n"] for r in self.index))
        self.total = self.ends[-1] if self.ends else 0

    @classmethod
    def build(cls, rows: DataFrame, order: list[str], path: str, ranges: int = 64) -> Pages:
        """order: columns, ascending, that together tell all rows apart; nulls come first."""
        parts = rows.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id())
        parts.sortWithinPartitions(*order).write.partitionBy("range_").parquet(f"{path}/rows")
        written = rows.sparkSession.read.schema(parts.schema).parquet(f"{path}/rows")
        written.groupBy("range_").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last")).coalesce(1).write.parquet(f"{path}/index")
        return cls(rows.sparkSession, path, order)

    def _read(self, first: int, last: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows.where(F.col("range_").between(self.index[first]["range_"], self.index[last]["range_"])).drop("range_").orderBy(*self.order)

    def page(self, size: int, number: int = 0) -> DataFrame:
        """The rows of a page, from number 0; none beyond the end."""
        start, end = size * number, min(size * (number + 1), self.total)
        if start >= end:
            return self.spark.read.parquet(f"{self.path}/rows").drop("range_").limit(0) if self.index else self.spark.createDataFrame([], "none string")
        first, last = bisect_right(self.ends, start), bisect_right(self.ends, end - 1)
        return self._read(first, last).offset(start - (self.ends[first - 1] if first else 0)).limit(end - start)

    def after(self, size: int, key: tuple) -> DataFrame:
        """The first rows behind a key, a value for each column of the order: what comes next, whatever was added before it."""
        lasts = [tuple(r["last"]) for r in self.index]
        first = next((k for k, last in enumerate(lasts) if not _not_after(last, key)), None)
        if first is None:
            return self.page(size, self.total)
        have, last = 0, first
        while last + 1 < len(self.index) and (have := have + self.index[last]["n"]) < size + self.index[first]["n"]:
            last += 1
        return self._read(first, last).where(_behind(self.order, key)).limit(size)


def _not_after(a: tuple, b: tuple) -> bool:
    """a <= b, nulls first."""
    flat = lambda t: [(x is not None, x) if x is not None else (False, 0) for x in t]
    return flat(a) <= flat(b)


def _behind(order: list[str], key: tuple) -> Column:
    out = F.lit(False)
    for c, value in reversed(list(zip(order, key))):
        more = F.col(c).isNotNull() if value is None else F.coalesce(F.col(c) > F.lit(value), F.lit(False))
        out = more | (F.col(c).eqNullSafe(F.lit(value)) & out)
    return out
