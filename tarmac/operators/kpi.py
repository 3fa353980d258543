"""Key indicators and trends.  The two aggregate tables are small (one row per
month, or per day and severity); the report functions read those, not the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.functions.predicates import severity_in
from tarmac.functions.severity import count_if, sum_if
from tarmac.model import SEVERITIES

_MEASURES = {"": None, "_casualties": "number_of_casualties", "_vehicles": "number_of_vehicles"}


def kpi_monthly(collision: DataFrame) -> DataFrame:
    """Per month: collisions, casualties and vehicles by severity, plus the
    adjusted severities."""
    severity = F.col("collision_severity")
    measures = []
    for suffix, column in _MEASURES.items():
        for name in SEVERITIES:
            hit = severity == name
            value = count_if(hit) if column is None else sum_if(hit, F.col(column))
            measures.append(value.cast("bigint").alias(name.lower() + suffix))
    return collision.groupBy("year", "month_num", "month").agg(
        *measures,
        count_if(severity == "Fatal").alias("adj_fatal"),
        F.sum("collision_adjusted_severity_serious").alias("adj_serious"),
        F.sum("collision_adjusted_severity_slight").alias("adj_slight"),
    )


def kpi_daily(collision: DataFrame) -> DataFrame:
    return collision.groupBy(F.col("date").cast("date").alias("date"), "year", "month_num", "collision_severity").agg(
        F.count("*").alias("collisions"),
        F.sum("number_of_casualties").alias("casualties"),
        F.sum("number_of_vehicles").alias("vehicles"),
    )


def count_by_severity(collision: DataFrame, part: str) -> DataFrame:
    """Collisions per calendar part (``hour`` or ``day_of_week``) and severity."""
    return (
        collision.where(F.col(part).isNotNull())
        .groupBy(part, "collision_severity")
        .agg(F.count("*").alias("count"))
    )


def _chosen_total(selected: Sequence[str], suffix: str) -> Column:
    """Sum of the chosen severity columns; no choice sums zeros."""
    total = F.lit(0).cast("bigint")
    for name in selected:
        total = total + F.col(name.lower() + suffix)
    return F.sum(total)


def kpi_year(monthly: DataFrame, year: int, selected: Sequence[str]) -> DataFrame:
    """Totals of one whole year; NULL when the year has no rows."""
    return monthly.where(F.col("year") == year).agg(
        _chosen_total(selected, "").alias("total_collisions"),
        _chosen_total(selected, "_casualties").alias("total_casualties"),
        _chosen_total(selected, "_vehicles").alias("total_vehicles"),
    )


def kpi_year_on_year(monthly: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Totals of every year with the change against the year before; the change is
    NULL where that year is absent.  The window runs over one row per year."""
    yearly = monthly.groupBy("year").agg(
        _chosen_total(selected, "").alias("total_collisions"),
        _chosen_total(selected, "_casualties").alias("total_casualties"),
        _chosen_total(selected, "_vehicles").alias("total_vehicles"),
    )
    by_year = Window.orderBy("year")
    follows = F.lag("year").over(by_year) == F.col("year") - 1
    return yearly.select(
        "*",
        *[
            F.when(follows, F.col(f"total_{m}") - F.lag(f"total_{m}").over(by_year)).alias(f"delta_{m}")
            for m in ("collisions", "casualties", "vehicles")
        ],
    )


def kpi_range(daily: DataFrame, start, end, selected: Sequence[str]) -> DataFrame | None:
    """Totals of an inclusive date range; no severity chosen gives no answer."""
    if not selected:
        return None
    return daily.where(_between(start, end) & severity_in(selected)).agg(
        F.sum("collisions").alias("total_collisions"),
        F.sum("casualties").alias("total_casualties"),
        F.sum("vehicles").alias("total_vehicles"),
    )


def _between(start, end) -> Column:
    return F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))


def monthly_trend(monthly: DataFrame, year: int, adjusted: bool = False) -> DataFrame:
    prefix = "adj_" if adjusted else ""
    names = [s.lower() for s in SEVERITIES]
    return (
        monthly.where(F.col("year") == year)
        .select("month_num", "month", *[F.col(prefix + n).alias(n) for n in names])
        .orderBy("month_num")
    )


def trend_long(trend: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Wide trend as (month, severity, count).  No choice keeps every severity."""
    names = [s.lower() for s in SEVERITIES]
    long = trend.unpivot(["month_num", "month"], names, "severity", "count").withColumn(
        "severity", F.initcap("severity")
    )
    return long.where(F.col("severity").isin(*selected)) if selected else long


def daily_trend_month(collision: DataFrame, year: int, month: int) -> DataFrame:
    return (
        collision.where((F.col("year") == year) & (F.month("date") == month))
        .groupBy("date", "collision_severity")
        .agg(F.count("*").alias("count"))
    )


def daily_trend_range(daily: DataFrame, start, end, selected: Sequence[str]) -> DataFrame:
    """Daily counts per severity in a date range; no choice gives an empty result."""
    return (
        daily.where(_between(start, end) & severity_in(selected))
        .groupBy("date", F.col("collision_severity").alias("severity"))
        .agg(F.sum("collisions").alias("count"))
    )


def daily_trend_of_month(daily: DataFrame, year: int, month: int, selected: Sequence[str]) -> DataFrame:
    """Daily counts from the first to the last day of a month."""
    first = f"{year:04d}-{month:02d}-01"
    last = F.last_day(F.lit(first).cast("date"))
    return (
        daily.where(F.col("date").between(F.lit(first).cast("date"), last) & severity_in(selected))
        .groupBy("date", F.col("collision_severity").alias("severity"))
        .agg(F.sum("collisions").alias("count"))
    )


def month_on_month(monthly: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Change of the chosen total against the previous month on record; the window
    runs over one row per month."""
    totals = monthly.groupBy("year", "month_num").agg(_chosen_total(selected, "").alias("total"))
    previous = F.lag("total").over(Window.orderBy("year", "month_num"))
    return totals.withColumns(
        {
            "change": F.col("total") - previous,
            "change_pct": F.round(F.try_divide(F.col("total") - previous, previous) * 100, 6),
        }
    )


def cumulative_in_year(monthly: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Running total within each year (twelve rows per window partition)."""
    totals = monthly.groupBy("year", "month_num").agg(_chosen_total(selected, "").alias("total"))
    running = Window.partitionBy("year").orderBy("month_num").rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn("cumulative", F.sum("total").over(running))
