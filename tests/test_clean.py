import datetime as dt

from pyspark.sql import functions as F

from tarmac.functions import dates, geo, names
from tarmac.operators import clean


def values(df, column):
    return [r[column] for r in df.collect()]


def test_header_names():
    raw = [
        "1st_Road_Class",
        "Pedestrian Crossing-Human Control",
        "Did Police Officer Attend?",
        "Engine Capacity (CC)",
        "2nd Road Number",
        "1?st",
    ]
    assert names.header_names(raw) == [
        "first_road_class",
        "pedestrian_crossing_human_control",
        "did_police_officer_attend",
        "engine_capacity_cc",
        "second_road_number",
        "1st",
    ]


def test_header_names_of_a_column_agree_with_the_list_form(spark):
    raw = ["1st_Road_Class", "Age Band of Driver (new)?", "Engine Capacity (CC)", "LSOA-of Casualty"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = {r.raw: (r.h, r.v) for r in df.select("raw", names.header_name(F.col("raw")).alias("h"), names.variable_name(F.col("raw")).alias("v")).collect()}
    for text, header, variable in zip(raw, names.header_names(raw), names.variable_names(raw)):
        assert got[text] == (header, variable)


def test_variable_names():
    assert names.variable_names(["Engine Capacity (CC)", "Vehicle_Propulsion_Code", "Age of Vehicle (manufacture)"]) == [
        "engine_capacity_cc",
        "propulsion_code",
        "age_of_vehicle",
    ]


def test_dates_and_times(spark):
    rows = [
        (1, "05/04/2020", "13:45"),
        (2, "31/02/2020", "13:45"),
        (3, "", "13:45"),
        (4, "05/04/2020", None),
        (5, "05/04/2020", "24:00"),
        (6, "5/4/2020", "7:05"),
        (7, None, "07:05"),
        (8, "05/04/2020", "noon"),
        (9, "2020-04-05", "07:05"),
    ]
    df = clean.parse_dates(spark.createDataFrame(rows, "id int, date string, time string"))
    got = {r.id: (r.date, r.datetime) for r in df.collect()}
    day = dt.date(2020, 4, 5)
    assert got[1] == (day, dt.datetime(2020, 4, 5, 13, 45))
    assert got[2] == got[3] == got[7] == got[9] == (None, None)
    assert got[4] == got[5] == got[8] == (day, None)
    assert got[6] == (day, dt.datetime(2020, 4, 5, 7, 5))


def test_london_clock_changes(spark):
    rows = [
        (dt.datetime(2020, 1, 15, 12, 0), dt.datetime(2020, 1, 15, 12, 0)),
        (dt.datetime(2020, 7, 15, 12, 0), dt.datetime(2020, 7, 15, 11, 0)),
        (dt.datetime(2020, 3, 29, 3, 0), dt.datetime(2020, 3, 29, 2, 0)),
        (dt.datetime(2020, 10, 25, 3, 0), dt.datetime(2020, 10, 25, 3, 0)),
    ]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, expected timestamp_ntz")
    for r in clean.add_utc_datetime(df).collect():
        assert r.datetime_utc == r.expected


def test_time_features_replace_raw_weekday(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 2, 29, 23, 5), 3), (None, 4)], "datetime timestamp_ntz, day_of_week int"
    )
    full, empty = clean.add_time_features(df).orderBy(F.col("datetime").isNull()).collect()
    assert (full.year, full.month, full.month_num, full.hour, full.day_of_week) == (2024, "February", 2, 23, "Thursday")
    assert (empty.year, empty.month, empty.month_num, empty.hour, empty.day_of_week) == (None,) * 5
    # a table without datetime is left alone
    assert clean.add_time_features(df.drop("datetime")).columns == ["day_of_week"]


def test_age_groups(spark):
    ages = ["-1", "-0.5", "0", "15", "16", "24", "25", "64", "65", "100", "120", "121", "text", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, age_of_casualty string")
    got = values(clean.add_age_group(df).orderBy("i"), "age_group")
    assert got == [
        "Unknown", "Child", "Child", "Child", "Young Adult", "Young Adult", "Adult", "Adult", "Senior", "Senior",
        "Senior", "Unknown", "Unknown", "Unknown",
    ]


def test_year_range_by_year_by_date_and_neither(spark):
    by_year = spark.createDataFrame([(1999,), (2000,), (2024,), (2025,), (None,)], "year int")
    assert sorted(values(clean.keep_years(by_year), "year")) == [2000, 2024]
    by_date = spark.createDataFrame([(dt.date(1999, 12, 31),), (dt.date(2000, 1, 1),), (None,)], "date date")
    assert values(clean.keep_years(by_date), "date") == [dt.date(2000, 1, 1)]
    neither = spark.createDataFrame([("x",)], "collision_index string")
    assert clean.keep_years(neither).count() == 1


def test_missing_coordinates(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None), (None, None)], "easting double, northing double")
    assert clean.drop_missing_coordinates(df, "easting", "northing").count() == 1
    row = clean.count_missing_coordinates(df, "easting", "northing").first()
    assert (row.removed, row.kept) == (3, 1)
    assert clean.coordinate_columns(["a", "Location_Easting_OSGR", "location_northing_osgr"]) == [
        "Location_Easting_OSGR", "location_northing_osgr",
    ]


def test_uk_window_edges(spark):
    df = spark.createDataFrame(
        [(64950.0, 10235.0), (655391.0, 1209512.0), (64949.9, 20000.0), (70000.0, 1209513.0)],
        "easting double, northing double",
    )
    out = clean.clip_to_uk(df, "easting", "northing")
    assert out.columns == ["x", "y"] and out.count() == 2


def test_force_numeric(spark):
    df = spark.createDataFrame([("51.5", "x", "1")], "Latitude string, location_easting_osgr string, other string")
    row = clean.force_numeric_coordinates(df).first()
    assert (row.Latitude, row.location_easting_osgr, row.other) == (51.5, None, "1")


def test_vehicle_groups(spark):
    df = spark.createDataFrame(
        [("Motorcycle 50cc and under",), ("Pedal cycle",), ("Taxi/Private hire CAR",), ("Minibus",), ("Van / Goods",), ("Tram",)],
        "vehicle_type string",
    )
    got = values(df.select(clean.vehicle_pattern_group(F.col("vehicle_type")).alias("g")), "g")
    assert got == ["Motorbike", "Cycle", "Car", "Bus", "Goods", "Other"]
    looked = {r.vehicle_type: r.summary_group for r in clean.add_vehicle_group(df).collect()}
    assert looked["Tram"] == "other vehicle" and looked["Minibus"] is None


def test_registration_and_recode(spark):
    df = spark.createDataFrame([("AB12CDE", 1), ("AB 12", 2), ("AB-12", 0), ("", 9), (None, None)], "m string, c int")
    assert values(df.select(clean.valid_registration(F.col("m")).alias("v")), "v") == [True, False, False, False, None]
    labels = df.select(clean.recode_by_position(F.col("c"), ["a", None, "c"]).alias("l"))
    assert values(labels, "l") == ["a", None, None, None, None]


def test_nearest_month(spark):
    days = [dt.date(2020, 1, 16), dt.date(2020, 1, 17), dt.date(2020, 2, 15), dt.date(2020, 2, 16), dt.date(2020, 4, 1), dt.date(2020, 4, 16)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = values(df.select(dates.nearest_month(F.col("date")).alias("m")), "m")
    # April has 30 days: the 16th is halfway and goes up
    assert [g.month for g in got] == [1, 2, 2, 3, 4, 5]


def test_grid_projection_against_published_point(spark):
    # worked example of the Ordnance Survey guide, shifted to WGS84
    df = spark.createDataFrame([(651409.903, 313177.270)], "e double, n double")
    row = geo.with_lonlat(df, "e", "n").first()
    assert abs(row.latitude - 52.657977) < 2e-5
    assert abs(row.longitude - 1.716038) < 2e-5
    back = geo.with_grid(geo.with_lonlat(df, "e", "n"), "latitude", "longitude").first()
    assert abs(back.easting - 651409.903) < 1e-3 and abs(back.northing - 313177.270) < 1e-3


def test_point_text(spark):
    df = spark.createDataFrame([(-0.000123, 51.5), (-2.0, 100.0), (None, 1.0)], "x double, y double")
    got = values(df.select(geo.point_wkt(F.col("x"), F.col("y")).alias("w")), "w")
    assert got == ["POINT (-0.000123 51.5)", "POINT (-2 100)", None]


def test_haversine_poles_and_self(spark):
    df = spark.createDataFrame([(51.5074, -0.1278), (-51.5074, 179.8722)], "lat double, lon double")
    near, far = values(df.select(geo.haversine_miles(F.col("lat"), F.col("lon"), 51.5074, -0.1278).alias("d")), "d")
    assert near == 0.0
    assert abs(far - 3958.8 * 3.141592653589793) < 1e-3
