"""Long ordered heads.  A plain ``orderBy.limit(n)`` sends up to n rows of every
input task to one task; with n in the tens of thousands and many tasks that one
task becomes the bottleneck.  Counting rows per coarse bucket of the leading
order first tells exactly which buckets the head can come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_head(df: DataFrame, bucket: Column, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``.

    ``bucket`` must be non-decreasing along the order and take a bounded number of
    values (dates, digest prefixes): its running count is a window over one row
    per value.
    """
    tally = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("rows"))
    reached = tally.withColumn("seen", F.sum("rows").over(Window.orderBy("b"))).where(F.col("seen") >= n)
    cut = reached.agg(F.min("b")).scalar()
    return df.where(F.coalesce(bucket <= cut, F.lit(True))).orderBy(*order).limit(n)
