"""Exact quantiles of columns of any size.

Values are counted first, so repeats never travel.  The counts are partitioned by
value range and saved; partition totals say in which partition each wanted rank
lies, and only those partitions are sorted and searched.  The driver sees one total
per partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.session import ensure_checkpointing


def _at_ranks(counts: DataFrame, ranks: Sequence[int], before: dict[int, int]) -> dict[int, object]:
    """Values at 0-based ranks; ``before`` has the rows ahead of each partition."""
    where = {r: max((b, p) for p, b in before.items() if b <= r)[1] for r in ranks}
    ahead = F.lit(0).cast("bigint")
    for p in set(where.values()):
        ahead = F.when(F.col("part") == p, F.lit(before[p])).otherwise(ahead)
    within = Window.partitionBy("part").orderBy("v")
    seen = counts.where(F.col("part").isin(*set(where.values()))).select("part", "v", (F.sum("n").over(within) + ahead).alias("seen"))
    row = seen.agg(*[F.min(F.when((F.col("part") == p) & (F.col("seen") > r), F.col("v"))).alias(str(r)) for r, p in where.items()]).first()
    return {r: row[str(r)] for r in ranks}


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values.

    Whole numbers stay whole where nothing is interpolated.  NaN counts as a value
    above all others, as it sorts.
    """
    ensure_checkpointing(df.sparkSession)
    kind = dict(df.select(column).dtypes)[column]
    value = F.col(column) if kind in ("tinyint", "smallint", "int", "bigint") else F.col(column).cast("double")
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(value.alias("v"))
        .agg(F.count("*").alias("n"))
        .repartitionByRange("v")
        .withColumn("part", F.spark_partition_id())
        .checkpoint()
    )
    before, total = {}, 0
    for part, rows in counts.groupBy("part").agg(F.sum("n").alias("rows")).orderBy("part").collect():
        before[part] = total
        total += rows
    if not total:
        return [None] * len(probabilities)
    places = [p * (total - 1) for p in probabilities]
    ranks = sorted({r for place in places for r in (math.floor(place), math.ceil(place))})
    at = _at_ranks(counts, ranks, before)
    low_high = [(at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)) for p in places]
    return [low if low == high or not share else low + (high - low) * share for low, high, share in low_high]
