"""Tables of a yearly casualty factsheet for one class of road user.

Facts are reduced to one row per collision (or per year, band, hour) by partial
aggregation before anything else happens; shares, indices and ranks run over
those reduced tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.functions import dates
from tarmac.operators.clean import add_vehicle_group

_MEASURES = ("fatal", "serious", "slight")

# Age bands, open below and closed above.
AGE_BANDS = (
    (0, 11, "0-11"),
    (11, 15, "12-15"),
    (15, 19, "16-19"),
    (19, 24, "20-24"),
    (24, 29, "25-29"),
    (29, 39, "30-39"),
    (39, 49, "40-49"),
    (49, 59, "50-59"),
    (59, 69, "60-69"),
    (69, 100, "70+"),
)

# Road classes counted as other than motorway.
OTHER_CLASSES = ("A", "B", "C", "Unclassified", "A(M)")

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")


def last_years(df: DataFrame, target: int, years: int = 5, column: str = "collision_year") -> DataFrame:
    return df.where(F.col(column).between(target - years + 1, target))


def _severity_sums() -> list[Column]:
    return [
        F.count(F.when(F.col("casualty_severity") == "Fatal", 1)).alias("fatal"),
        F.sum(F.coalesce("casualty_adjusted_severity_serious", F.lit(0.0))).alias("serious"),
        F.sum(F.coalesce("casualty_adjusted_severity_slight", F.lit(0.0))).alias("slight"),
    ]


def _all() -> Column:
    return F.col("fatal") + F.col("serious") + F.col("slight")


def _whole_sums() -> list[Column]:
    return [F.bround(F.sum(m), 0).alias(m) for m in _MEASURES]


def casualty_sums(casualty: DataFrame, road_user: str) -> DataFrame:
    """Per collision: fatalities and adjusted serious and slight injuries of a class."""
    return casualty.where(F.col("casualty_class") == road_user).groupBy("collision_index").agg(*_severity_sums())


def base_and_target(casualty: DataFrame, exposure: DataFrame, road_user: str, base: int, target: int) -> DataFrame:
    """Change between two years as words and percentages, in one row.

    Falls are measured against the base year, rises against the target year.
    Whether serious injuries fell is judged by all casualties of the class.
    ``exposure`` is (year, traffic).
    """
    people = casualty.where(
        (F.col("casualty_class") == road_user) & F.col("collision_year").isin(base, target)
    )
    in_year = {"b": F.col("collision_year") == base, "t": F.col("collision_year") == target}
    fatal = F.col("casualty_severity") == "Fatal"
    serious = F.coalesce("casualty_adjusted_severity_serious", F.lit(0.0))
    facts = people.agg(
        *[F.count(F.when(hit & fatal, 1)).alias(f"fatal_{y}") for y, hit in in_year.items()],
        *[F.count(F.when(hit, 1)).alias(f"all_{y}") for y, hit in in_year.items()],
        *[F.sum(F.when(hit, serious)).alias(f"serious_{y}") for y, hit in in_year.items()],
    )
    traffic = exposure.agg(
        F.max(F.when(F.col("year") == base, F.col("traffic"))).alias("traffic_b"),
        F.max(F.when(F.col("year") == target, F.col("traffic"))).alias("traffic_t"),
    )
    change = lambda small, large: (1 - F.try_divide(small, large)) * 100
    fell, rose = F.col("fatal_b") > F.col("fatal_t"), F.col("all_b") > F.col("all_t")
    less = F.col("traffic_t") < F.col("traffic_b")
    # both inputs are one-row aggregates
    return facts.withColumns({c: traffic.select(c).scalar() for c in ("traffic_b", "traffic_t")}).select(
        F.when(fell, "down").otherwise("up").alias("fatal_word"),
        F.when(fell, F.bround(change("fatal_t", "fatal_b"), 0))
        .otherwise(F.bround(change("fatal_b", "fatal_t"), 0))
        .alias("fatal_change_pct"),
        F.when(rose, "decreased").otherwise("increased").alias("serious_word"),
        F.when(rose, F.bround(change("serious_t", "serious_b"), 0))
        .otherwise(F.bround(change("serious_b", "serious_t"), 0))
        .alias("serious_change_pct"),
        F.when(less, "decreased").otherwise("increased").alias("traffic_word"),
        F.when(less, F.try_divide("traffic_b", "traffic_t") - 1)
        .otherwise(F.try_divide("traffic_t", "traffic_b") - 1)
        .alias("traffic_change"),
    )


def weekly_means(casualty: DataFrame, collision: DataFrame, road_user: str) -> DataFrame:
    """Mean fatalities and adjusted serious injuries per ISO week of calendar year."""
    people = casualty.where((F.col("casualty_class") == road_user) & (F.col("casualty_type") == road_user))
    daily = (
        people.join(collision.select("collision_index", "date"), "collision_index")
        .groupBy("date")
        .agg(*_severity_sums(), F.count("*").alias("people"))
    )
    weekly = daily.groupBy(F.weekofyear("date").alias("wk"), F.year("date").alias("yr")).agg(
        F.sum("fatal").alias("fatal"), F.sum("serious").alias("serious")
    )
    # a week without fatalities has no row in the fatal series
    return weekly.agg(
        F.avg(F.when(F.col("fatal") > 0, F.col("fatal"))).alias("fatal_per_week"),
        F.avg("serious").alias("serious_per_week"),
    )


def share_by_category(sums: DataFrame, collision: DataFrame, category: str) -> DataFrame:
    """Percentage of each column's total per category, rounded to one decimal."""
    totals = (
        sums.join(collision.select("collision_index", category), "collision_index", "left")
        .groupBy(category)
        .agg(*[F.sum(m).alias(m) for m in _MEASURES])
        .withColumn("all", _all())
    )
    return totals.select(
        category,
        *[
            F.bround(F.try_divide(m, F.sum(m).over(Window.partitionBy())) * 100, 1).alias(m)
            for m in (*_MEASURES, "all")
        ],
    )


def first_vehicle(vehicle: DataFrame) -> DataFrame:
    """The first listed vehicle of each collision: (collision_index, vehicle_type)."""
    return (
        vehicle.groupBy("collision_index")
        .agg(F.min(F.struct("vehicle_reference", "vehicle_type")).alias("v"))
        .select("collision_index", F.col("v.vehicle_type").alias("vehicle_type"))
    )


def sums_with_vehicle(sums: DataFrame, vehicle: DataFrame, collision: DataFrame) -> DataFrame:
    """Per collision: casualty sums, number of vehicles and group of the first one.

    Vehicles are reduced to one per collision before the join, so no collision
    multiplies on the way.
    """
    return add_vehicle_group(
        sums.join(first_vehicle(vehicle), "collision_index", "left").join(
            collision.select("collision_index", "number_of_vehicles"), "collision_index", "left"
        )
    )


def vehicles_by_group(with_vehicle: DataFrame) -> DataFrame:
    """Casualties by number of vehicles and vehicle group, with each row's
    percentage of all fatalities."""
    return (
        with_vehicle.groupBy("number_of_vehicles", "summary_group")
        .agg(*_whole_sums())
        .withColumn("all", _all())
        .withColumn("pc_fat", F.bround(F.try_divide("fatal", F.sum("fatal").over(Window.partitionBy())) * 100, 1))
    )


def stacked_totals(with_vehicle: DataFrame) -> DataFrame:
    """One-vehicle collisions by group, then two, then three and more, then all;
    with the percentage of casualties that were fatal."""
    n = F.col("number_of_vehicles")
    row = (
        F.when(n == 1, F.concat(F.lit("1 "), F.coalesce("summary_group", F.lit("NA"))))
        .when(n == 2, "2 vehicles involved")
        .when(n > 2, "3 or more other vehicles involved")
    )
    parts = (
        with_vehicle.withColumn("summary_group", row)
        .where(F.col("summary_group").isNotNull())
        .groupBy("summary_group")
        .agg(*_whole_sums())
        .withColumn("all", _all())
    )
    measures = (*_MEASURES, "all")
    # the rows are as many as there are groups; the total adds what they show, so they are aggregated once
    whole = parts.agg(F.collect_list(F.struct("summary_group", *measures)).alias("rows"), *[F.sum(m).alias(m) for m in measures])
    total = F.struct(F.lit("Total").alias("summary_group"), *measures)
    rows = whole.select(F.explode(F.concat("rows", F.array(total))).alias("r")).select("r.*")
    return rows.withColumn("pc_fat", F.bround(F.try_divide("fatal", "all") * 100, 1))


def road_class_share(sums: DataFrame, collision: DataFrame) -> DataFrame:
    """Casualties on motorways and on rural and urban other roads: value and
    percentage within each severity, and the same over all severities."""
    raw = F.col("first_road_class")
    kind = F.when(raw.isin(*OTHER_CLASSES), "Other").when(raw == "Motorway", "Motorway")
    area = F.col("urban_or_rural_area")
    cells = (
        sums.join(
            collision.select("collision_index", "first_road_class", "urban_or_rural_area"), "collision_index", "left"
        )
        .where(area != "Unallocated")
        .groupBy(kind.alias("kind"), area)
        .agg(*_whole_sums())
        .where(F.col("kind").isNotNull())
    )
    classes = (
        cells.withColumn("road_class", F.when(F.col("kind") == "Motorway", F.col("kind")).otherwise(area))
        .groupBy("road_class")
        .agg(*_whole_sums())
        .withColumnsRenamed({m: m.capitalize() for m in _MEASURES})
        .unpivot(["road_class"], [m.capitalize() for m in _MEASURES], "name", "value")
    )
    everything = classes.groupBy("road_class").agg(F.sum("value").alias("value")).withColumn(
        "name", F.lit("All casualties")
    )
    within = Window.partitionBy("name")
    return classes.unionByName(everything).withColumn("pc", F.try_divide("value", F.sum("value").over(within)) * 100)


def ksi_by_sex(casualty: DataFrame, road_user: str) -> DataFrame:
    """Killed or seriously injured by sex and their share of all such casualties."""
    return (
        casualty.where(F.col("casualty_type") == road_user)
        .groupBy("sex_of_casualty")
        .agg(*_severity_sums())
        .withColumn("ksi", F.col("fatal") + F.col("serious"))
        .withColumn("pc_ksi", F.try_divide("ksi", F.sum("ksi").over(Window.partitionBy())))
    )


def annual_series(casualty: DataFrame, exposure: DataFrame, road_user: str, first: int, last: int) -> DataFrame:
    """Casualties per year with the year's traffic (NULL where unknown)."""
    yearly = (
        casualty.where((F.col("casualty_type") == road_user) & F.col("collision_year").between(first, last))
        .groupBy(F.col("collision_year").alias("year"))
        .agg(*_severity_sums())
        .withColumn("all", _all())
    )
    return yearly.join(exposure, "year", "left")


def year_on_year(series: DataFrame) -> DataFrame:
    """The latest year's relative change against the year before it on record."""
    by_year = Window.orderBy("year")
    before = lambda c: F.lag(c).over(by_year)
    changes = series.select(
        "year",
        F.try_divide(F.col("fatal") - before("fatal"), before("fatal")).alias("fatal_change"),
        F.abs(F.try_divide(F.col("traffic") - before("traffic"), before("traffic"))).alias("traffic_change"),
        F.when(F.col("fatal") > before("fatal"), "increased").otherwise("decreased").alias("fatal_word"),
        F.when(F.col("all") > before("all"), "increased").otherwise("fallen").alias("all_word"),
    )
    return changes.orderBy(F.desc("year")).limit(1)


def index_to_base(series: DataFrame, base: int, columns: tuple[str, ...]) -> DataFrame:
    """Long series (year, variable, value) with the base year at 100."""
    # one row per year: the window is as small as the series
    at_base = lambda c: F.max(F.when(F.col("year") == base, F.col(c))).over(Window.partitionBy())
    indexed = series.select(
        "year", *[(F.try_divide(F.col(c).cast("double"), at_base(c)) * 100).alias(c) for c in columns]
    )
    return indexed.unpivot(["year"], list(columns), "variable", "value")


def rates_per_exposure(series: DataFrame) -> DataFrame:
    """Casualties per unit of traffic, to whole numbers."""
    return series.select(
        "year", *[F.bround(F.try_divide(F.col(m).cast("double"), F.col("traffic")), 0).alias(m) for m in (*_MEASURES, "all")]
    )


def age_band(age: Column) -> Column:
    """Factsheet age band; 0 and anything above 100 have none."""
    value = age.try_cast("double")
    band = F.lit(None).cast("string")
    for low, high, label in AGE_BANDS:
        band = F.when((value > low) & (value <= high), label).otherwise(band)
    return band


def age_band_by_sex(casualty: DataFrame, road_user: str) -> DataFrame:
    """Killed or seriously injured by age band for males and females, as percentages
    of all sexes together."""
    return (
        casualty.where(F.col("casualty_type") == road_user)
        .withColumn("age_band", age_band(F.col("age_of_casualty")))
        .where(F.col("age_band").isNotNull())
        .groupBy("sex_of_casualty", "age_band")
        .agg(*_severity_sums())
        .withColumn("all", F.col("fatal") + F.col("serious"))
        .withColumn("pc_ksi", F.try_divide("all", F.sum("all").over(Window.partitionBy())) * 100)
        .where(F.col("sex_of_casualty").isin("Male", "Female"))
    )


def hour_by_daytype(sums: DataFrame, collision: DataFrame) -> DataFrame:
    """Killed or seriously injured per hour for weekdays (daily mean), Saturday and Sunday."""
    when = F.col("datetime")
    day = dates.day_name(when)
    kind = F.when(day.isin(*WEEKDAYS), "Monday to Friday").otherwise(day)
    return (
        sums.join(collision.select("collision_index", "datetime"), "collision_index", "left")
        .groupBy(F.hour(when).alias("collision_hr"), kind.alias("dow"))
        .agg(F.sum(F.col("fatal") + F.col("serious")).alias("ksi"))
        .withColumn("ksi", F.when(F.col("dow") == "Monday to Friday", F.col("ksi") / 5).otherwise(F.col("ksi")))
    )


def peak_hours(by_daytype: DataFrame, top: int = 4) -> DataFrame:
    """First and last of the top hours, for weekdays and for weekends."""
    weekend = F.col("dow").isin("Saturday", "Sunday")
    period = F.when(weekend, "weekend").when(F.col("dow") == "Monday to Friday", "weekday")
    hourly = (
        by_daytype.where(F.col("collision_hr").isNotNull())
        .groupBy(period.alias("period"), "collision_hr")
        .agg(F.sum("ksi").alias("ksi"))
        .where(F.col("period").isNotNull())
    )
    ranked = hourly.withColumn(
        "place", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("ksi"), "collision_hr"))
    )
    return (
        ranked.where(F.col("place") <= top)
        .groupBy("period")
        .agg(F.min("collision_hr").alias("first_hour"), F.max("collision_hr").alias("last_hour"))
    )
