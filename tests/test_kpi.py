import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.functions.predicates import TimeFilter, all_of, any_of, equal_unless_all, severity_in
from tarmac.operators import breakdown, kpi
from tarmac.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def collision(spark):
    rows = []
    for i in range(400):
        day = dt.date(2019, 1, 1) + dt.timedelta(days=i * 3)
        if day.year == 2020 and day.month in (6, 7):
            continue
        rows.append((i, day, day.year, day.month, day.strftime("%B"), ["Fatal", "Serious", "Slight"][i % 3], 1 + i % 4, 1 + i % 2, 0.25, 0.75))
    return spark.createDataFrame(
        rows,
        "collision_index int, date date, year int, month_num int, month string, collision_severity string, number_of_casualties int, "
        "number_of_vehicles int, collision_adjusted_severity_serious double, collision_adjusted_severity_slight double",
    ).cache()


def test_monthly_adds_up(collision):
    monthly = kpi.kpi_monthly(collision)
    total = monthly.agg(F.sum(F.col("fatal") + F.col("serious") + F.col("slight"))).first()[0]
    assert total == collision.count()
    assert monthly.where(F.col("adj_fatal") != F.col("fatal")).count() == 0


def test_no_selection_differs_by_report(collision):
    monthly, daily = kpi.kpi_monthly(collision), kpi.kpi_daily(collision)
    # year: zero; range: no answer; daily trend: empty; melted trend: everything
    assert tuple(kpi.kpi_year(monthly, 2020, []).first()) == (0, 0, 0)
    assert kpi.kpi_range(daily, "2020-01-01", "2020-12-31", []) is None
    assert kpi.daily_trend_range(daily, "2020-01-01", "2020-12-31", []).count() == 0
    trend = kpi.monthly_trend(monthly, 2020)
    assert kpi.trend_long(trend, []).count() == 3 * trend.count()
    assert {r.severity for r in kpi.trend_long(trend, ["Fatal"]).collect()} == {"Fatal"}


def test_absent_year_gives_null_and_no_delta(collision):
    monthly = kpi.kpi_monthly(collision)
    assert tuple(kpi.kpi_year(monthly, 1990, ["Fatal"]).first()) == (None, None, None)
    gap = monthly.where(F.col("year") != 2020)
    rows = {r.year: r for r in kpi.kpi_year_on_year(gap, ["Fatal"]).collect()}
    assert rows[2021].delta_collisions is None
    whole = {r.year: r for r in kpi.kpi_year_on_year(monthly, ["Fatal", "Serious", "Slight"]).collect()}
    assert whole[2020].delta_collisions == whole[2020].total_collisions - whole[2019].total_collisions


def test_range_is_inclusive(collision):
    daily = kpi.kpi_daily(collision)
    one_day = kpi.kpi_range(daily, "2019-01-01", "2019-01-01", ["Fatal", "Serious", "Slight"]).first()
    assert one_day.total_collisions == 1


def test_december_ends_on_the_last_day(collision):
    daily = kpi.kpi_daily(collision)
    days = [r.date for r in kpi.daily_trend_of_month(daily, 2019, 12, ["Fatal", "Serious", "Slight"]).collect()]
    assert min(days).month == max(days).month == 12 and max(days) == dt.date(2019, 12, 30)


def test_month_changes_skip_missing_months(collision):
    rows = kpi.month_on_month(kpi.kpi_monthly(collision), ["Fatal"]).orderBy("year", "month_num").collect()
    assert rows[0].change is None
    at = {(r.year, r.month_num): r for r in rows}
    assert at[2020, 8].change == at[2020, 8].total - at[2020, 5].total


def test_cumulative_restarts_each_year(collision):
    rows = kpi.cumulative_in_year(kpi.kpi_monthly(collision), ["Fatal", "Slight"]).collect()
    for r in rows:
        if r.month_num == 1:
            assert r.cumulative == r.total


def test_predicates(spark, collision):
    assert collision.where(severity_in([])).count() == 0
    assert collision.where(severity_in(["Fatal"])).count() < collision.count()
    assert any_of("road_type", []) is None and equal_unless_all("road_type", "All") is None
    assert collision.where(all_of(None, None)).count() == collision.count()
    with pytest.raises(ValueError):
        TimeFilter().column()
    month = collision.where(TimeFilter(year=2020, month=2).column())
    assert month.where((F.col("year") != 2020) | (F.month("date") != 2)).count() == 0


def test_factors_are_checked(collision):
    with pytest.raises(ValueError):
        breakdown.factor_by_severity(collision, "date", F.lit(True))


def test_top_values_skip_blanks_and_break_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (" ",), (None,), ("",), ("c",), ("c",)], "v string")
    assert [(r.v, r.n) for r in breakdown.top_values(df, "v", 2).collect()] == [("c", 2), ("a", 1)]


def test_top_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.0), (4, 1.0), (5, None)], "id int, w double")
    assert sorted(r.id for r in breakdown.top_with_ties(df, "w", 2).collect()) == [1, 2, 3]
    assert sorted(r.id for r in breakdown.top_with_ties(df, "w", 1).collect()) == [1]


def test_make_model_pads_with_na(spark):
    rows = [(1990, m) for m in ["a"] * 5 + ["b"] * 3 + ["c"] * 2 + ["Data missing"] * 10] + [(1989, None), (1989, None)]
    df = spark.createDataFrame(rows, "y int, m string")
    got = {r.year: r for r in breakdown.make_model_by_year(df, "y", "m").collect()}
    assert got[1990].top_5_make_model == "a, b, c, NA, NA"
    assert (got[1990].n_make_model, got[1990].percent_na) == (4, 50)
    assert (got[1989].n_make_model, got[1989].percent_na, got[1989].top_5_make_model) == (1, 0, "NA, NA, NA, NA, NA")


def test_profile(spark):
    df = spark.createDataFrame([(3, "x", None), (1, "y", 2.0), (2, "x", None)], "id int, s string, d double")
    got = {r.name: tuple(r)[1:] for r in breakdown.column_profile(df, "id").collect()}
    assert got == {
        "id": ("int", 3, "1", "1"),
        "s": ("string", 2, "y", "x"),
        "d": ("double", 2, "2.0", "2.0"),
    }


def test_exact_quantiles_narrow_to_the_same_values(spark):
    rng = random.Random(11)
    values = [rng.choice([rng.lognormvariate(0, 8), -rng.random(), 7.0, 7.0]) for _ in range(4001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 50, "v double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = np.quantile(values, points)
    np.testing.assert_allclose(exact_quantiles(df, "v", points), want, rtol=1e-12)
    assert exact_quantiles(df.where("v is null"), "v", [0.5]) == [None]


def test_quantiles_of_odd_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (10D), (10D), (double('NaN')) AS t(v)")
    low, high = exact_quantiles(df, "v", [0.0, 1.0])
    assert low == 10.0 and np.isnan(high)
    big = 2**53 + 1
    df = spark.createDataFrame([(big,), (big,), (big + 2,), (None,)], "v long")
    assert exact_quantiles(df, "v", [0.0, 0.5, 1.0]) == [big, big, big + 2]
    hot = spark.range(40_000).select((F.col("id") % 2 * F.col("id")).alias("v"))  # half the rows are one value
    values = [(i % 2) * i for i in range(40_000)]
    np.testing.assert_allclose(exact_quantiles(hot, "v", [0.25, 0.5, 0.75, 0.9]), np.quantile(values, [0.25, 0.5, 0.75, 0.9]))
