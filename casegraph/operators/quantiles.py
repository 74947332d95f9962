"""Quantiles by a sketch that is kept as rows: counts of buckets whose bounds grow by a constant factor.

Bucket i holds the values from g**(i-1), excluded, to g**i, with g = (1 + error) / (1 - error), so its middle is off by at most error times the
value. Sketches of periods, keys or batches merge by adding counts, in any order, and give the same numbers whenever they are built anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ERROR = 0.01
#: The bucket of values that are not above 0; a threshold that falls there is 0.
ZERO = -(2**31) + 1


def bucket_of(value: Column, error: float = ERROR) -> Column:
    width = math.log((1 + error) / (1 - error))
    return F.when(value > 0, F.ceil(F.ln(value) / width).cast("int")).otherwise(ZERO)


def middle_of(bucket: Column, error: float = ERROR) -> Column:
    g = (1 + error) / (1 - error)
    return F.when(bucket == ZERO, 0.0).otherwise(2 * F.pow(F.lit(g), bucket) / (g + 1))


def sketch(rows: DataFrame, value: str, keys: list[str], period: int, error: float = ERROR) -> DataFrame:
    """(keys, period, bucket, n) of the values of each period of so many seconds; counted before anything is shuffled. Null and NaN values are none."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col("epoch").isNotNull())
    return rows.groupBy(*keys, F.floor(F.col("epoch") / period).alias("period"), bucket_of(F.col(value), error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of several over the same keys."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def thresholds(sketched: DataFrame, q: float, keys: list[str], back: int = 7, error: float = ERROR) -> DataFrame:
    """(keys, period, threshold, n): the q-quantile of the values of the back periods before each period, for periods that have any there.

    The threshold is within error, relatively, of a value whose rank among those n values is floor(q * (n - 1)). A key's sort has as many rows
    as a period has buckets: some hundreds for each power of ten and percent of error.
    """
    ahead = sketched.withColumn("period", F.explode(F.sequence(F.col("period") + 1, F.col("period") + back)))
    counts = ahead.groupBy(*keys, "period", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "period")
    up = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"total": F.sum("n").over(whole), "up": F.sum("n").over(up)}).where(F.col("up") > F.floor(q * (F.col("total") - 1)))
    return counts.groupBy(*keys, "period").agg(middle_of(F.min("bucket"), error).alias("threshold"), F.first("total").alias("n"))


def above_earlier(rows: DataFrame, value: str, q: float, keys: list[str], period: int = 86400, back: int = 7, error: float = ERROR) -> DataFrame:
    """Rows whose value is above the threshold that the periods before theirs set for their keys; adds threshold. Rows with nothing before them set off no alarm."""
    limits = thresholds(sketch(rows, value, keys, period, error), q, keys, back, error).select(*keys, "period", "threshold")
    found = rows.withColumn("period", F.floor(F.col("epoch") / period)).join(limits, [*keys, "period"])
    return found.where(F.col(value) > F.col("threshold")).drop("period")
