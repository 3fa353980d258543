"""Row-level cleaning and derived columns.  Every function is narrow (no shuffle)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarmac.functions import dates
from tarmac.model import FIRST_YEAR, LAST_YEAR

# Names of coordinate columns.
COORDINATE_NAMES = re.compile("easting|northing|latitude|longitude", re.IGNORECASE)

# Upper ends of the age groups, each closed on the right.
AGE_GROUP_ENDS = ((15, "Child"), (24, "Young Adult"), (64, "Adult"), (120, "Senior"))

# Ordered patterns of vehicle groups, first hit wins.
VEHICLE_PATTERNS = (
    ("motorcycle", "Motorbike"),
    ("car", "Car"),
    ("bus", "Bus"),
    ("cycle", "Cycle"),
    ("goods", "Goods"),
)

# Summary group of each vehicle type.
VEHICLE_GROUPS = (
    ("Pedal cycle", "pedal cycle"),
    ("Motorcycle - unknown cc", "motorcycle"),
    ("Electric motorcycle", "motorcycle"),
    ("Motorcycle 125cc and under", "motorcycle"),
    ("Motorcycle 50cc and under", "motorcycle"),
    ("Motorcycle over 125cc and up to 500cc", "motorcycle"),
    ("Motorcycle over 500cc", "motorcycle"),
    ("Car", "car"),
    ("Agricultural vehicle", "other vehicle"),
    ("Tram", "other vehicle"),
    ("Taxi/Private hire car", "car"),
    ("Bus or coach (17 or more pass seats)", "bus or coach"),
    ("Minibus (8 - 16 passenger seats)", "car"),
    ("Van / Goods 3.5 tonnes mgw or under", "light goods vehicle"),
    ("Goods over 3.5t. and under 7.5t", "heavy goods vehicle"),
    ("Goods 7.5 tonnes mgw and over", "heavy goods vehicle"),
    ("Other vehicle", "other vehicle"),
    ("Unknown vehicle type (self rep only)", "other vehicle"),
    ("Goods vehicle - unknown weight", "other vehicle"),
    ("Mobility scooter", "other vehicle"),
    ("Ridden horse", "other vehicle"),
    ("Data missing or out of range", "other vehicle"),
)

# Approximate extent of the UK on the national grid, in metres.
UK_EASTING = (64950, 655391)
UK_NORTHING = (10235, 1209512)


def parse_dates(df: DataFrame) -> DataFrame:
    """Turn ``date`` text into a date and add ``datetime`` when there is a ``time``."""
    if "date" not in df.columns:
        return df
    df = df.withColumn("date", dates.uk_date(F.col("date")))
    if "time" in df.columns:
        df = df.withColumn("datetime", dates.join_clock(F.col("date"), F.col("time")))
    return df


def add_utc_datetime(df: DataFrame, local: str = "datetime", utc: str = "datetime_utc") -> DataFrame:
    return df.withColumn(utc, dates.london_to_utc(F.col(local)))


def force_numeric_coordinates(df: DataFrame) -> DataFrame:
    """Read every easting, northing, latitude and longitude column as a number."""
    found = {c: F.col(c).try_cast("double") for c in df.columns if COORDINATE_NAMES.search(c)}
    return df.withColumns(found) if found else df


def add_time_features(df: DataFrame) -> DataFrame:
    """Calendar parts of ``datetime``.  Any raw ``day_of_week`` is replaced, and a
    missing ``datetime`` leaves every part NULL."""
    if "datetime" not in df.columns:
        return df
    when = F.col("datetime")
    return df.withColumns(
        {
            "year": F.year(when),
            "month": dates.month_name(when),
            "month_num": F.month(when),
            "hour": F.hour(when),
            "day_of_week": dates.day_name(when),
        }
    )


def age_group(age: Column) -> Column:
    """Age band of a raw age; text, missing and out-of-range ages are ``Unknown``."""
    value = age.try_cast("double")
    band = F.lit("Unknown")
    for end, label in reversed(AGE_GROUP_ENDS):
        band = F.when(value <= end, label).otherwise(band)
    return F.when(value > -1, band).otherwise("Unknown")


def add_age_group(df: DataFrame, age: str = "age_of_casualty") -> DataFrame:
    return df.withColumn("age_group", age_group(F.col(age))) if age in df.columns else df


def keep_years(df: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, removed: Observation | None = None) -> DataFrame:
    """Keep a year range by ``year``, else by ``date``; tables with neither pass whole.

    ``removed`` learns ``n``, the rows that go, as in ``drop_missing_coordinates``.
    """
    keep = F.lit(True)
    if "year" in df.columns:
        keep = F.col("year").between(first, last)
    elif dict(df.dtypes).get("date") in ("date", "timestamp", "timestamp_ntz"):
        keep = F.year("date").between(first, last)
    if removed is not None:
        df = df.observe(removed, F.count_if(~F.coalesce(keep, F.lit(False))).alias("n"))
    return df.where(keep)


def coordinate_columns(columns: Sequence[str], pattern: str = "easting|northing") -> list[str]:
    return [c for c in columns if re.search(pattern, c, re.IGNORECASE)]


def drop_missing_coordinates(df: DataFrame, x: str, y: str, removed: Observation | None = None) -> DataFrame:
    """Rows with both coordinates.  ``removed`` learns ``n``, the rows without, when the result is first written or collected."""
    if removed is not None:
        df = df.observe(removed, F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("n"))
    return df.dropna(subset=[x, y])


def count_missing_coordinates(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: how many rows lack a coordinate and how many are kept."""
    missing = F.col(x).isNull() | F.col(y).isNull()
    return df.agg(
        F.count(F.when(missing, 1)).alias("removed"),
        F.count(F.when(~missing, 1)).alias("kept"),
    )


def clip_to_uk(df: DataFrame, easting: str, northing: str) -> DataFrame:
    """Points of the UK window as ``x``, ``y``; all other columns stay as marks."""
    inside = F.col(easting).between(*UK_EASTING) & F.col(northing).between(*UK_NORTHING)
    return df.where(inside).withColumnsRenamed({easting: "x", northing: "y"})


def null_outliers(col: Column, low, high) -> Column:
    """The value when inside the closed range, else NULL."""
    return F.when(col.between(low, high), col)


def outlier_shares(df: DataFrame, column: str, low, high) -> DataFrame:
    """Shares of all rows above and below the range."""
    value = F.col(column)
    return df.agg(
        (F.count(F.when(value > high, 1)) / F.count("*")).alias("share_too_big"),
        (F.count(F.when(value < low, 1)) / F.count("*")).alias("share_too_small"),
    )


def vehicle_pattern_group(vehicle_type: Column) -> Column:
    group = F.lit("Other")
    for pattern, label in reversed(VEHICLE_PATTERNS):
        group = F.when(vehicle_type.rlike(f"(?i){pattern}"), label).otherwise(group)
    return group


def add_vehicle_group(df: DataFrame, vehicle_type: str = "vehicle_type") -> DataFrame:
    """The group of each vehicle type from the fixed list; types outside it get NULL."""
    groups = F.create_map(*[F.lit(x) for pair in VEHICLE_GROUPS for x in pair])
    return df.withColumn("summary_group", F.try_element_at(groups, F.col(vehicle_type)))


def valid_registration(mark: Column) -> Column:
    """Registration marks are letters and digits only, without spaces."""
    return mark.rlike("^[A-Za-z0-9]+$")


def recode_by_position(col: Column, labels: Sequence[str | None]) -> Column:
    """Label of a 1-based code; codes outside the list become NULL."""
    return F.try_element_at(F.array(*[F.lit(x).cast("string") for x in labels]), F.nullif(col.cast("int"), F.lit(0)))
