import datetime as dt

from pyspark.sql import functions as F

from tarmac.operators import factsheet


def casualties(spark, rows):
    full = [(c, y, k, k, sev, sex, age, ser, sli) for c, y, k, sev, sex, age, ser, sli in rows]
    return spark.createDataFrame(
        full,
        "collision_index string, collision_year int, casualty_class string, casualty_type string, casualty_severity string, sex_of_casualty string, "
        "age_of_casualty string, casualty_adjusted_severity_serious double, casualty_adjusted_severity_slight double",
    )


P = "Pedestrian"


def test_age_bands(spark):
    ages = ["0", "1", "11", "12", "15", "69", "70", "100", "101", "x", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a string")
    got = [r.b for r in df.select("i", factsheet.age_band(F.col("a")).alias("b")).orderBy("i").collect()]
    assert got == [None, "0-11", "0-11", "12-15", "12-15", "60-69", "70+", "70+", None, None, None]


def test_sums_count_missing_as_zero_and_only_the_class(spark):
    df = casualties(
        spark,
        [("a", 2020, P, "Fatal", "Male", "30", None, None), ("a", 2020, P, "Slight", "Male", "30", 0.25, 0.75),
         ("a", 2020, "Passenger", "Fatal", "Male", "30", 9.0, 9.0), ("b", 2020, P, "Slight", "Male", "30", None, 1.0)],
    )
    got = {r.collision_index: tuple(r)[1:] for r in factsheet.casualty_sums(df, P).collect()}
    assert got == {"a": (1, 0.25, 0.75), "b": (0, 0.0, 1.0)}


def test_base_and_target_directions(spark):
    rows = [("x", 2004, P, "Fatal", "Male", "1", 0.5, 0.5)] * 4 + [("x", 2024, P, "Fatal", "Male", "1", 0.25, 0.75)] * 3
    exposure = spark.createDataFrame([(2004, 10.0), (2024, 8.0)], "year int, traffic double")
    down = factsheet.base_and_target(casualties(spark, rows), exposure, P, 2004, 2024).first()
    assert (down.fatal_word, down.fatal_change_pct) == ("down", 25.0)
    assert down.serious_word == "decreased" and down.serious_change_pct == 62.0  # 62.5 rounds to even
    assert down.traffic_word == "decreased" and abs(down.traffic_change - 0.25) < 1e-12
    up = factsheet.base_and_target(casualties(spark, rows), exposure, P, 2024, 2004).first()
    assert (up.fatal_word, up.fatal_change_pct, up.serious_word, up.traffic_word) == ("up", 25.0, "increased", "increased")


def test_weekly_means_use_calendar_years(spark):
    # 1 January 2021 is in ISO week 53, and so is 31 December 2020: two groups
    collision = spark.createDataFrame([("a", dt.date(2020, 12, 31)), ("b", dt.date(2021, 1, 1)), ("c", dt.date(2021, 3, 1))], "collision_index string, date date")
    rows = [("a", 2020, P, "Fatal", "Male", "1", 0.0, 0.0), ("a", 2020, P, "Fatal", "Male", "1", 0.0, 0.0), ("b", 2021, P, "Fatal", "Male", "1", 0.0, 0.0),
            ("c", 2021, P, "Slight", "Male", "1", 0.6, 0.4)]
    row = factsheet.weekly_means(casualties(spark, rows), collision, P).first()
    assert row.fatal_per_week == 1.5 and abs(row.serious_per_week - 0.2) < 1e-12


def test_age_band_share_is_over_all_sexes(spark):
    rows = [("a", 2020, P, "Fatal", s, "30", 0.0, 0.0) for s in ("Male", "Male", "Female", "Unknown")]
    got = {r.sex_of_casualty: r.pc_ksi for r in factsheet.age_band_by_sex(casualties(spark, rows), P).collect()}
    assert got == {"Male": 50.0, "Female": 25.0}


def test_road_classes(spark):
    sums = spark.createDataFrame([(c, 1, 2.0, 1.0) for c in "abcde"], "collision_index string, fatal long, serious double, slight double")
    collision = spark.createDataFrame(
        [("a", "Motorway", "Rural"), ("b", "A", "Rural"), ("c", "Unclassified", "Urban"), ("d", "Other thing", "Urban"), ("e", "A", "Unallocated")],
        "collision_index string, first_road_class string, urban_or_rural_area string",
    )
    got = {(r.road_class, r.name): (r.value, round(r.pc, 4)) for r in factsheet.road_class_share(sums, collision).collect()}
    assert {k[0] for k in got} == {"Motorway", "Rural", "Urban"}
    assert got["Rural", "Fatal"] == (1.0, 33.3333) and got["Rural", "All casualties"] == (4.0, 33.3333)


def test_hours_and_peaks(spark):
    sums = spark.createDataFrame([(str(i), 1, 4.0, 0.0) for i in range(4)] + [("4", 2, 0.0, 0.0)], "collision_index string, fatal long, serious double, slight double")
    times = [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 2, 17), dt.datetime(2024, 1, 6, 9), dt.datetime(2024, 1, 7, 9), dt.datetime(2024, 1, 7, 10)]
    collision = spark.createDataFrame([(str(i), t) for i, t in enumerate(times)], "collision_index string, datetime timestamp_ntz")
    hours = factsheet.hour_by_daytype(sums, collision)
    got = {(r.collision_hr, r.dow): r.ksi for r in hours.collect()}
    assert got == {(8, "Monday to Friday"): 1.0, (17, "Monday to Friday"): 1.0, (9, "Saturday"): 5.0, (9, "Sunday"): 5.0, (10, "Sunday"): 2.0}
    peaks = {r.period: (r.first_hour, r.last_hour) for r in factsheet.peak_hours(hours, top=1).collect()}
    assert peaks == {"weekday": (8, 8), "weekend": (9, 9)}


def test_year_on_year_and_index(spark):
    series = spark.createDataFrame([(2020, 10, 10.0, 5.0), (2021, 15, 20.0, 4.0)], "year int, fatal long, all double, traffic double")
    last = factsheet.year_on_year(series).first()
    assert (last.year, last.fatal_change, last.fatal_word, last.all_word) == (2021, 0.5, "increased", "increased")
    assert abs(last.traffic_change - 0.2) < 1e-12
    indexed = {(r.year, r.variable): r.value for r in factsheet.index_to_base(series, 2020, ("fatal", "traffic")).collect()}
    assert indexed == {(2020, "fatal"): 100.0, (2021, "fatal"): 150.0, (2020, "traffic"): 100.0, (2021, "traffic"): 80.0}
