"""Interval joins without nested loops: intervals are dealt into buckets of time, and rows meet them by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(rows: DataFrame, at: Column, intervals: DataFrame, since: str, before: str, bucket_seconds: int = 86_400, how: str = "inner") -> DataFrame:
    """Rows with the intervals that hold `at` (lower bound closed, upper open).

    An interval goes into as many buckets as it overlaps, a row into one, so nothing is compared with everything. Null bounds
    or instants match nothing; with how='left' rows without an interval are kept. Names of both sides must differ.
    """
    span = F.lit(bucket_seconds * 1_000_000)

    def bucket(x: Column) -> Column:
        return F.floor(F.unix_micros(x) / span).cast("long")

    wide = intervals.where(F.col(since) < F.col(before)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(since)), bucket(F.col(before) - F.expr("interval 1 microsecond")))))
    mine = rows.withColumn("_at", at).withColumn("_bucket", bucket(F.col("_at")))
    on = (mine["_bucket"] == wide["_bucket"]) & (F.col("_at") >= F.col(since)) & (F.col("_at") < F.col(before))
    return mine.join(wide, on, how).drop("_bucket", "_at")
