"""Counts, pivots, shares and summaries over the fact tables.

Every grouping aggregates partially before its shuffle, so a value that holds a
large part of the rows costs one partial row per task.  Grand totals are taken
over already grouped rows, never over facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.functions import dates
from tarmac.functions.predicates import all_of, any_of
from tarmac.functions.severity import count_if
from tarmac.model import FACTORS
from tarmac.operators.quantiles import exact_quantiles



# --- casualties ---------------------------------------------------------------


def demographics(
    casualty: DataFrame,
    collision: DataFrame,
    collision_filter: Column,
    classes: Sequence[str] = (),
    sexes: Sequence[str] = (),
    ages: Sequence[str] = (),
) -> DataFrame:
    """Casualties by type, age group, sex and severity, for the filtered collisions."""
    people = casualty.where(
        all_of(any_of("casualty_class", classes), any_of("sex_of_casualty", sexes), any_of("age_group", ages))
    )
    crashes = collision.where(collision_filter).select("collision_index")
    keys = ["casualty_type", "age_group", "sex_of_casualty", "casualty_severity"]
    return people.join(crashes, "collision_index").groupBy(*keys).agg(F.count("*").alias("count"))


def mode_by_severity(demo: DataFrame) -> DataFrame:
    return demo.groupBy("casualty_type", "casualty_severity").agg(F.sum("count").alias("count"))


def mode_order(demo: DataFrame) -> DataFrame:
    """Casualty types from the least to the most frequent."""
    return demo.groupBy("casualty_type").agg(F.sum("count").alias("count")).orderBy("count", "casualty_type")


def age_by_sex(demo: DataFrame) -> DataFrame:
    return demo.groupBy("age_group", "sex_of_casualty").agg(F.sum("count").alias("count"))


def demographic_subtotals(demo: DataFrame) -> DataFrame:
    """All three roll-ups at once: by type and severity, by type, by age group and sex.

    One pass and one exchange; the columns that a row adds up are NULL, and
    ``grouping`` names the roll-up.
    """
    kind, severity, age, sex = (F.col(c) for c in ("casualty_type", "casualty_severity", "age_group", "sex_of_casualty"))
    tag = F.when(F.grouping("casualty_type") == 1, "age_sex").when(F.grouping("casualty_severity") == 1, "mode").otherwise("mode_severity")
    return demo.groupingSets([[kind, severity], [kind], [age, sex]], kind, severity, age, sex).agg(F.sum("count").alias("count"), tag.alias("grouping"))


# Casualty types counted per collision, with their column names.
MIX = (("Pedestrian", "walking"), ("Cyclist", "cycling"), ("Car occupant", "passenger"))


def casualty_mix(casualty: DataFrame) -> DataFrame:
    """Per collision: all casualties and those on foot, cycling and in cars."""
    return casualty.groupBy("collision_index").agg(
        F.count("*").alias("total"),
        *[count_if(F.col("casualty_type") == kind).alias(name) for kind, name in MIX],
    )


def with_casualty_mix(collision: DataFrame, casualty: DataFrame) -> DataFrame:
    return collision.join(casualty_mix(casualty), "collision_index", "left")


def dominant_mode(walking: Column, cycling: Column, passenger: Column) -> Column:
    """Road user of a collision, the first of walking, cycling and passenger that occurs."""
    return (
        F.when(walking > 0, "Walking").when(cycling > 0, "Cycling").when(passenger > 0, "Passenger").otherwise("Other")
    )


def light_group(light: Column) -> Column:
    return F.when(light == "Daylight", "Daylight").when(light == "Darkness - lights lit", "Lit").otherwise("Other/Unlit")


def casualty_pivot(casualty: DataFrame, types: Sequence[str]) -> DataFrame:
    """Per collision one column per casualty type, 0 where absent, and the row total.

    Conditional counts need one shuffle; a pivot of raw rows would need two.
    """
    kind = F.col("casualty_type")
    return casualty.groupBy("collision_index").agg(
        *[count_if(kind == name).alias(name) for name in types], count_if(kind.isin(*types)).alias("total")
    )


def modes_long(with_mix: DataFrame, key: Column, name: str) -> DataFrame:
    """Walking, cycling and passenger casualties per key, one row per mode."""
    names = [n for _, n in MIX]
    return (
        with_mix.groupBy(key.alias(name))
        .agg(*[F.sum(n).alias(n) for n in names])
        .unpivot([name], names, "mode", "casualties")
    )


# --- road and environment -----------------------------------------------------


def _checked(*columns: str) -> None:
    unknown = set(columns) - set(FACTORS)
    if unknown:
        raise ValueError(f"not a factor: {sorted(unknown)}")


def factor_by_severity(collision: DataFrame, factor: str, condition: Column) -> DataFrame:
    _checked(factor)
    return (
        collision.where(condition)
        .groupBy(factor, "collision_severity")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), factor, "collision_severity")
    )


def all_factors_by_severity(collision: DataFrame, condition: Column, factors: Sequence[str] = FACTORS) -> DataFrame:
    """Several factors at once as (factor, value, collision_severity, count), in one
    pass over the collisions instead of one per factor."""
    _checked(*factors)
    return (
        collision.where(condition)
        .select("collision_severity", *[F.col(f).cast("string").alias(f) for f in factors])
        .unpivot(["collision_severity"], list(factors), "factor", "value")
        .groupBy("factor", "value", "collision_severity")
        .agg(F.count("*").alias("count"))
    )


def factor_interaction(collision: DataFrame, first: str, second: str, condition: Column) -> DataFrame:
    _checked(first, second)
    return collision.where(condition).groupBy(first, second).agg(F.count("*").alias("count"))


def factor_pivot(interaction: DataFrame, first: str, second: str, values: Sequence) -> DataFrame:
    """Two-factor counts as a grid, 0 where a pair does not occur."""
    return interaction.groupBy(first).pivot(second, list(values)).agg(F.sum("count")).fillna(0)


# --- value lists --------------------------------------------------------------


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent non-blank values, ties by value."""
    value = F.col(column)
    return (
        df.where(value.isNotNull() & (F.trim(value.cast("string")) != ""))
        .groupBy(value.alias("v"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "v")
        .limit(n)
    )


def years_on_record(collision: DataFrame) -> DataFrame:
    return collision.select("year").distinct().orderBy(F.desc("year"))


def options(df: DataFrame, column: str, condition: Column) -> DataFrame:
    return df.where(condition).select(column).distinct().orderBy(column)


def date_range(collision: DataFrame) -> DataFrame:
    return collision.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("latitude").alias("mid_lat"), F.avg("longitude").alias("mid_lon"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def dimensions(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


# --- time patterns ------------------------------------------------------------


def by_weekday_and_hour(collision: DataFrame) -> DataFrame:
    """Counts by weekday, by hour and by both; the missing part is NULL."""
    parts = collision.select(
        dates.day_name(F.col("date")).alias("weekday"), dates.clock_hour(F.col("time")).alias("hour")
    )
    weekday, hour = F.col("weekday"), F.col("hour")
    sets = [[weekday, hour], [weekday], [hour]]  # counted in one pass and one exchange
    tag = F.when(F.grouping("hour") == 1, "weekday").when(F.grouping("weekday") == 1, "hour").otherwise("weekday_hour")
    return parts.groupingSets(sets, weekday, hour).agg(F.count("*").alias("n"), tag.alias("grouping"))


def monthly_rounded(collision: DataFrame) -> DataFrame:
    """Counts per nearest month without the first and the last bucket."""
    buckets = (
        collision.groupBy(F.col("date").cast("date").alias("date"))
        .agg(F.count("*").alias("n"))
        .groupBy(dates.nearest_month(F.col("date")).alias("date_month"))
        .agg(F.sum("n").alias("n"))
    )
    return (
        buckets.withColumns({"lo": F.min("date_month").over(Window.partitionBy()), "hi": F.max("date_month").over(Window.partitionBy())})
        .where((F.col("date_month") > F.col("lo")) & (F.col("date_month") < F.col("hi")))
        .drop("lo", "hi")
    )


# --- shares and summaries -----------------------------------------------------


def proportions(df: DataFrame, first: str, second: str) -> DataFrame:
    """Contingency table as shares of all rows, whose number is one scalar."""
    cells = df.groupBy(first, second).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar()).drop("n")


def share_within(df: DataFrame, group: str, category: str, value: Column) -> DataFrame:
    """Each category's percentage of its group's total."""
    cells = df.groupBy(group, category).agg(F.sum(value).alias("value"))
    return cells.withColumn("pc", F.try_divide("value", F.sum("value").over(Window.partitionBy(group))) * 100)


def share_total(df: DataFrame, category: str) -> DataFrame:
    """Rows per category and their percentage of all rows; the window runs over the counts."""
    counts = frequency(df, category)
    return counts.withColumn("pc", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def ratio_by_flag(df: DataFrame, flag: Column, numerator: Column, denominator: Column) -> DataFrame:
    return df.groupBy(flag.alias("flag")).agg(F.try_divide(F.sum(numerator), F.sum(denominator)).alias("ratio"))


def top_with_ties(df: DataFrame, weight: str, n: int) -> DataFrame:
    """Rows whose weight is among the n largest, all ties included.

    The cut-off is the smallest of the n top weights; finding it is a top-k, and
    the filter against it needs no sort.
    """
    cutoff = df.where(F.col(weight).isNotNull()).select(weight).orderBy(F.desc(weight)).limit(n).agg(F.min(weight))
    return df.where(F.col(weight) >= cutoff.scalar())


def above_median(df: DataFrame, column: str) -> DataFrame:
    """Rows above the column's exact median."""
    median = exact_quantiles(df, column, [0.5])[0]
    return df.where(F.col(column) > F.lit(median))


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, maximum (exact, linear interpolation), mean and NULL count."""
    names = ["min", "q1", "median", "q3", "max"]
    points = exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    return df.agg(F.avg(column).alias("mean"), F.count(F.when(F.col(column).isNull(), 1)).alias("n_missing")).select(
        *[F.lit(v).cast("double").alias(n) for n, v in zip(names, points)], "mean", "n_missing"
    )


def column_profile(df: DataFrame, order_by: str) -> DataFrame:
    """Per column: type, distinct values, first value and most common value.

    The table is unpivoted to (column, value) and counted per value first, so the
    step that sees one group per column receives partial results only.
    """
    kinds = df.dtypes
    position = df[order_by]
    long = df.select(position.alias("__pos"), *[F.col(c).cast("string").alias(c) for c, _ in kinds]).unpivot(
        ["__pos"], [c for c, _ in kinds], "name", "value"
    )
    values = long.groupBy("name", "value").agg(F.count("*").alias("n"), F.min("__pos").alias("pos"))
    kind = F.lit(None).cast("string")
    for name, dtype in kinds:
        kind = F.when(F.col("name") == name, dtype).otherwise(kind)
    common = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value"))))
    return values.groupBy("name").agg(
        F.count("*").alias("n_unique"),
        F.min(F.struct("pos", "value"))["value"].alias("first_label"),
        common["value"].alias("most_common_value"),
    ).select("name", kind.alias("class"), "n_unique", "first_label", "most_common_value")


def make_model_by_year(vehicle: DataFrame, year: str, model: str) -> DataFrame:
    """Per year: distinct models, percentage recorded as missing, and the second to
    sixth most frequent models as text (``NA`` where there are fewer)."""
    counts = vehicle.groupBy(F.col(year).alias("year"), F.col(model).alias("model")).agg(F.count("*").alias("n"))
    missing = F.sum(F.when(F.col("model").rlike("missing"), F.col("n")).otherwise(0))
    totals = counts.groupBy("year").agg(
        F.count("*").alias("n_make_model"),
        F.bround(missing / F.sum("n") * 100, 0).cast("bigint").alias("percent_na"),
    )
    # missing models rank last instead of being filtered out, so that both branches
    # read the same shuffled counts
    order = Window.partitionBy("year").orderBy(F.col("model").isNull(), F.desc("n"), "model")
    ranked = counts.withColumn("place", F.row_number().over(order))
    at = [F.coalesce(F.max(F.when(F.col("place") == i, F.col("model"))), F.lit("NA")) for i in range(2, 7)]
    leaders = ranked.where(F.col("place") <= 6).groupBy("year").agg(F.concat_ws(", ", *at).alias("top_5_make_model"))
    nothing = F.lit(", ".join(["NA"] * 5))
    return totals.join(leaders, "year", "left").withColumn(
        "top_5_make_model", F.coalesce("top_5_make_model", nothing)
    )
