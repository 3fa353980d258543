"""Vehicle inspection history.

Two forms are served.  A vehicle document carries its own list of tests and is
summarised in place with array functions (no shuffle).  A long table with one
row per test is summarised with aggregates, so a vehicle with very many tests
never becomes one array or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.model import INSPECTION_DOC
from tarmac.operators.joins import salted_join

# Miles per kilometre, days per year, and the least age in seconds
# of the earlier reading used for a mileage estimate.
MILES_PER_KM = 0.621371
DAYS_PER_YEAR = 365.24
LOOKBACK_SECONDS = 15_552_000


def parse_documents(df: DataFrame, column: str = "doc") -> DataFrame:
    """JSON text as a typed vehicle record; malformed text gives NULL fields."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.from_json(column, INSPECTION_DOC).alias("v")).select(*keep, "v.*")


def explode_tests(vehicles: DataFrame, key: str = "registration") -> DataFrame:
    """One row per test; vehicles without tests keep one row of NULLs."""
    return vehicles.select(key, "registrationDate", F.explode_outer("motTests").alias("t")).select(
        key,
        _day(F.col("registrationDate")).alias("registration_date"),
        _moment(F.col("t.completedDate")).alias("completed"),
        F.col("t.testResult").alias("result"),
        _day(F.col("t.expiryDate")).alias("expiry"),
        F.col("t.odometerValue").try_cast("double").alias("odometer"),
        F.col("t.odometerUnit").alias("unit"),
        F.coalesce(_has_advisory(F.col("t.rfrAndComments")), F.lit(False)).alias("advisory"),
    )


def _day(text: Column) -> Column:
    """Dates come with dots or dashes."""
    return F.try_to_date(F.translate(text, ".", "-"), "yyyy-MM-dd")


def _moment(text: Column) -> Column:
    return F.translate(text, ".", "-").try_cast("timestamp_ntz")


def _has_advisory(comments: Column) -> Column:
    return F.exists(comments, lambda c: c["type"] == "ADVISORY")


def _miles(value: Column, unit: Column) -> Column:
    """Reading in miles; a reading without a unit is unusable."""
    return F.when(unit == "km", value * MILES_PER_KM).when(unit.isNotNull(), value)


def _at_least(later: Column, earlier: Column, seconds: int) -> Column:
    """Whether naive times lie that far apart, whatever the session's time zone."""
    return later - earlier >= F.make_dt_interval(secs=F.lit(seconds))


def manufacture_year(year: Column, date: Column) -> Column:
    return F.coalesce(year.try_cast("int"), F.year(date))


def _with_mileage(df: DataFrame) -> DataFrame:
    """Annual mileage from two readings, or from one and the registration date."""
    days = F.datediff("latest_date", F.coalesce(F.col("prev_date").cast("date"), F.col("registration_date")))
    driven = F.when(F.col("prev_date").isNotNull(), F.col("latest_odometer") - F.col("prev_odometer")).otherwise(
        F.col("latest_odometer")
    )
    df = df.withColumn("annual_mileage", F.try_divide(driven, days.cast("double")) * DAYS_PER_YEAR)
    return df.withColumn(
        "period_years", F.when(F.col("annual_mileage").isNotNull(), days.cast("double") / DAYS_PER_YEAR)
    )


def summarise_documents(vehicles: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS, key: str = "registration") -> DataFrame:
    """Counts, latest values, earlier reading and mileage of each vehicle document.

    Tests are listed newest first: the first is the latest, and the earlier reading
    is the first one old enough.
    """
    tests = F.col("motTests")
    passed = F.filter(tests, lambda t: t["testResult"] == "PASSED")
    latest = F.get(tests, 0)
    when = lambda t: _moment(t["completedDate"])
    old_enough = F.filter(
        F.slice(tests, 2, F.greatest(F.size(tests), F.lit(1))),
        lambda t: _at_least(when(latest), when(t), lookback_seconds),
    )
    prev = F.get(old_enough, 0)
    flat = vehicles.select(
        key,
        manufacture_year(F.col("manufactureYear"), _day(F.col("manufactureDate"))).alias("manufacture_year"),
        _day(F.col("registrationDate")).alias("registration_date"),
        F.size(tests).alias("n_tests"),
        F.size(passed).alias("n_passed"),
        F.size(F.filter(passed, lambda t: F.coalesce(_has_advisory(t["rfrAndComments"]), F.lit(False)))).alias(
            "n_passed_with_advisory"
        ),
        _day(latest["expiryDate"]).alias("latest_expiry"),
        _miles(latest["odometerValue"].try_cast("double"), latest["odometerUnit"]).alias("latest_odometer"),
        when(latest).alias("latest_date"),
        _miles(prev["odometerValue"].try_cast("double"), prev["odometerUnit"]).alias("prev_odometer"),
        when(prev).alias("prev_date"),
    )
    return _with_mileage(flat)


def count_tests(tests: DataFrame, key: str = "vehicle") -> DataFrame:
    passed = F.col("result") == "PASSED"
    return tests.groupBy(key).agg(
        F.count("completed").alias("n_tests"),
        F.count(F.when(passed, 1)).alias("n_passed"),
        F.count(F.when(passed & F.col("advisory"), 1)).alias("n_passed_with_advisory"),
    )


def latest_tests(tests: DataFrame, key: str = "vehicle") -> DataFrame:
    """Values of each vehicle's newest test; equal times are settled by the reading."""
    newest = F.max(
        F.when(F.col("completed").isNotNull(), F.struct("completed", "odometer", "unit", "result", "expiry"))
    )
    return (
        tests.groupBy(key)
        .agg(newest.alias("t"), F.min("registration_date").alias("registration_date"))
        .select(
            key,
            "registration_date",
            F.col("t.expiry").alias("latest_expiry"),
            _miles(F.col("t.odometer"), F.col("t.unit")).alias("latest_odometer"),
            F.col("t.completed").alias("latest_date"),
        )
    )


def asof_lookback(tests: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS, key: str = "vehicle") -> DataFrame:
    """Latest test of each vehicle and the most recent one at least that much older.

    The latest tests are one row per vehicle; they are joined back to the tests with
    salt, so a vehicle with very many tests is spread over tasks, and partial maxima
    collapse it before the second shuffle.
    """
    latest = latest_tests(tests, key)
    old = _at_least(F.col("latest_date"), F.col("completed"), lookback_seconds)
    prev = F.max(F.when(old, F.struct("completed", "odometer", "unit")))
    return (
        salted_join(tests.select(key, "completed", "odometer", "unit"), latest, key, ["completed", "odometer"])
        .groupBy(*latest.columns)
        .agg(prev.alias("t"))
        .select(
            *latest.columns,
            _miles(F.col("t.odometer"), F.col("t.unit")).alias("prev_odometer"),
            F.col("t.completed").alias("prev_date"),
        )
    )


def annual_mileage(tests: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS, key: str = "vehicle") -> DataFrame:
    return _with_mileage(asof_lookback(tests, lookback_seconds, key))
