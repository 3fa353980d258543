"""Factsheet queries: pedestrians, base year 1996, target year 2000."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.roles import casualty, collision, exposure, vehicle, with_roles
from tarmac.operators import factsheet
from tarmac.operators.clean import VEHICLE_GROUPS

catalogue = Catalogue()
add = catalogue.add

_USER, _BASE, _TARGET = "Pedestrian", 1996, 2000


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_PEOPLE = "SELECT * FROM casualty WHERE collision_year BETWEEN 1996 AND 2000"
_MEASURES = (
    "count(*) FILTER (casualty_severity = 'Fatal') AS fatal, "
    "sum(coalesce(casualty_adjusted_severity_serious, 0)) AS serious, "
    "sum(coalesce(casualty_adjusted_severity_slight, 0)) AS slight"
)
_SUMS = f"SELECT collision_index, {_MEASURES} FROM people WHERE casualty_class = 'Pedestrian' GROUP BY 1"


def _sql(body, *roles, **extra):
    roles = ("casualty", *roles)
    return with_roles(body, *roles, people=_PEOPLE, sums=_SUMS, **extra)


def _people(spark, d):
    return factsheet.last_years(casualty(spark, d), _TARGET)


def _sums(spark, d):
    return factsheet.casualty_sums(_people(spark, d), _USER)


@add("casualty_sums", _sql("SELECT collision_index, fatal, round(serious, 6) AS serious, round(slight, 6) AS slight FROM sums"))
def _(spark, d):
    return _rounded(_sums(spark, d), "serious", "slight")


@add(
    "last_five_years",
    _sql("SELECT collision_year, count(*) AS n FROM people GROUP BY 1"),
)
def _(spark, d):
    return _people(spark, d).groupBy("collision_year").agg(F.count("*").alias("n"))


@add(
    "base_vs_target",
    with_roles(
        ", f AS (SELECT count(*) FILTER (collision_year = 1996 AND casualty_severity = 'Fatal') AS fb, "
        "count(*) FILTER (collision_year = 2000 AND casualty_severity = 'Fatal') AS ft, "
        "count(*) FILTER (collision_year = 1996) AS ab, count(*) FILTER (collision_year = 2000) AS att, "
        "CAST(sum(casualty_adjusted_severity_serious) FILTER (collision_year = 1996) AS DOUBLE) AS sb, "
        "CAST(sum(casualty_adjusted_severity_serious) FILTER (collision_year = 2000) AS DOUBLE) AS st, "
        "(SELECT traffic FROM exposure WHERE year = 1996) AS tb, (SELECT traffic FROM exposure WHERE year = 2000) AS tt "
        "FROM casualty WHERE casualty_class = 'Pedestrian') "
        "SELECT CASE WHEN fb > ft THEN 'down' ELSE 'up' END AS fatal_word, "
        "round_even(CASE WHEN fb > ft THEN 1 - ft / CAST(fb AS DOUBLE) ELSE 1 - fb / CAST(ft AS DOUBLE) END * 100, 0) AS fatal_change_pct, "
        "CASE WHEN ab > att THEN 'decreased' ELSE 'increased' END AS serious_word, "
        "round_even(CASE WHEN ab > att THEN 1 - st / sb ELSE 1 - sb / st END * 100, 0) AS serious_change_pct, "
        "CASE WHEN tt < tb THEN 'decreased' ELSE 'increased' END AS traffic_word, "
        "round(CASE WHEN tt < tb THEN tb / tt ELSE tt / tb END - 1, 6) AS traffic_change FROM f",
        "casualty",
        "exposure",
    ),
)
def _(spark, d):
    change = factsheet.base_and_target(casualty(spark, d), exposure(spark, d), _USER, _BASE, _TARGET)
    return _rounded(change, "traffic_change")


@add(
    "weekly_mean",
    _sql(
        ", weekly AS (SELECT weekofyear(date) AS wk, year(date) AS yr, "
        f"{_MEASURES} FROM people JOIN collision USING (collision_index) WHERE casualty_class = 'Pedestrian' AND casualty_type = 'Pedestrian' GROUP BY 1, 2) "
        "SELECT round(avg(fatal) FILTER (fatal > 0), 6) AS fatal_per_week, round(avg(serious), 6) AS serious_per_week FROM weekly",
        "collision",
    ),
)
def _(spark, d):
    means = factsheet.weekly_means(_people(spark, d), collision(spark, d), _USER)
    return _rounded(means, "fatal_per_week", "serious_per_week")


@add(
    "share_by_category",
    _sql(
        ", t AS (SELECT junction_detail, CAST(sum(fatal) AS DOUBLE) AS f, sum(serious) AS s, sum(slight) AS l FROM sums LEFT JOIN collision USING (collision_index) GROUP BY 1) "
        "SELECT junction_detail, CAST(round_even(f / sum(f) OVER () * 100, 1) AS DOUBLE) AS fatal, CAST(round_even(s / sum(s) OVER () * 100, 1) AS DOUBLE) AS serious, "
        "CAST(round_even(l / sum(l) OVER () * 100, 1) AS DOUBLE) AS slight, CAST(round_even((f + s + l) / sum(f + s + l) OVER () * 100, 1) AS DOUBLE) AS \"all\" FROM t",
        "collision",
    ),
)
def _(spark, d):
    return factsheet.share_by_category(_sums(spark, d), collision(spark, d), "junction_detail")


_GROUPS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{g}')" for k, g in VEHICLE_GROUPS) + ") AS t(vehicle_type, summary_group)"
_WITH_VEHICLE = (
    "SELECT s.*, v.vehicle_type, k.number_of_vehicles, g.summary_group FROM sums s LEFT JOIN (SELECT * FROM vehicle "
    "QUALIFY row_number() OVER (PARTITION BY collision_index ORDER BY vehicle_reference, vehicle_type) = 1) v USING (collision_index) "
    "LEFT JOIN collision k USING (collision_index) LEFT JOIN groups g ON g.vehicle_type = v.vehicle_type"
)
_ROUNDED_SUMS = (
    "CAST(sum(fatal) AS BIGINT) AS fatal, round_even(sum(serious), 0) AS serious, round_even(sum(slight), 0) AS slight"
)


def _with_vehicle(spark, d):
    return factsheet.sums_with_vehicle(_sums(spark, d), vehicle(spark, d), collision(spark, d))


def _vehicle_sql(body):
    return _sql(body, "vehicle", "collision", groups=_GROUPS, joined=_WITH_VEHICLE)


@add(
    "collision_vehicle_group",
    _vehicle_sql(
        "SELECT collision_index, vehicle_type, summary_group, number_of_vehicles, fatal FROM joined"
    ),
)
def _(spark, d):
    return _with_vehicle(spark, d).select(
        "collision_index", "vehicle_type", "summary_group", "number_of_vehicles", "fatal"
    )


@add(
    "vehicles_by_group",
    _vehicle_sql(
        f", t AS (SELECT number_of_vehicles, summary_group, {_ROUNDED_SUMS} FROM joined GROUP BY 1, 2) "
        "SELECT *, fatal + serious + slight AS \"all\", CAST(round_even(fatal / CAST(sum(fatal) OVER () AS DOUBLE) * 100, 1) AS DOUBLE) AS pc_fat FROM t"
    ),
)
def _(spark, d):
    return factsheet.vehicles_by_group(_with_vehicle(spark, d))


@add(
    "stacked_totals",
    _vehicle_sql(
        f", parts AS (SELECT '1 ' || coalesce(summary_group, 'NA') AS summary_group, {_ROUNDED_SUMS} FROM joined WHERE number_of_vehicles = 1 GROUP BY 1 "
        f"UNION ALL SELECT '2 vehicles involved', {_ROUNDED_SUMS} FROM joined WHERE number_of_vehicles = 2 GROUP BY 1 "
        f"UNION ALL SELECT '3 or more other vehicles involved', {_ROUNDED_SUMS} FROM joined WHERE number_of_vehicles > 2 GROUP BY 1), "
        "everything AS (SELECT * FROM parts UNION ALL SELECT 'Total', CAST(sum(fatal) AS BIGINT), sum(serious), sum(slight) FROM parts) "
        "SELECT *, fatal + serious + slight AS \"all\", CAST(round_even(fatal / (fatal + serious + slight) * 100, 1) AS DOUBLE) AS pc_fat FROM everything"
    ),
)
def _(spark, d):
    return factsheet.stacked_totals(_with_vehicle(spark, d))


@add(
    "road_class_share",
    _sql(
        ", cells AS (SELECT CASE WHEN first_road_class = 'Motorway' THEN 'Motorway' WHEN first_road_class IN ('A', 'B', 'C', 'Unclassified', 'A(M)') THEN 'Other' END AS kind, "
        f"urban_or_rural_area, {_ROUNDED_SUMS} FROM sums LEFT JOIN collision USING (collision_index) WHERE urban_or_rural_area <> 'Unallocated' GROUP BY 1, 2), "
        "classes AS (SELECT CASE WHEN kind = 'Motorway' THEN kind ELSE urban_or_rural_area END AS road_class, "
        "CAST(sum(fatal) AS DOUBLE) AS fatal, sum(serious) AS serious, sum(slight) AS slight FROM cells WHERE kind IS NOT NULL GROUP BY 1), "
        "long AS (SELECT road_class, 'Fatal' AS name, fatal AS value FROM classes UNION ALL SELECT road_class, 'Serious', serious FROM classes "
        "UNION ALL SELECT road_class, 'Slight', slight FROM classes UNION ALL SELECT road_class, 'All casualties', fatal + serious + slight FROM classes) "
        "SELECT *, round(value / sum(value) OVER (PARTITION BY name) * 100, 6) AS pc FROM long",
        "collision",
    ),
)
def _(spark, d):
    return _rounded(factsheet.road_class_share(_sums(spark, d), collision(spark, d)), "pc")


@add(
    "ksi_by_sex",
    _sql(
        f", t AS (SELECT sex_of_casualty, {_MEASURES} FROM people WHERE casualty_type = 'Pedestrian' GROUP BY 1) "
        "SELECT sex_of_casualty, fatal, round(serious, 6) AS serious, round(slight, 6) AS slight, round(fatal + serious, 6) AS ksi, "
        "round((fatal + serious) / sum(fatal + serious) OVER (), 6) AS pc_ksi FROM t"
    ),
)
def _(spark, d):
    return _rounded(factsheet.ksi_by_sex(_people(spark, d), _USER), "serious", "slight", "ksi", "pc_ksi")


_SERIES = (
    f"SELECT y.*, y.fatal + y.serious + y.slight AS \"all\", e.traffic FROM (SELECT collision_year AS year, {_MEASURES} FROM casualty "
    "WHERE casualty_type = 'Pedestrian' AND collision_year BETWEEN 1996 AND 2001 GROUP BY 1) y LEFT JOIN exposure e USING (year)"
)


def _series(spark, d):
    return factsheet.annual_series(casualty(spark, d), exposure(spark, d), _USER, _BASE, 2001)


def _series_sql(body):
    return with_roles(body, "casualty", "exposure", series=_SERIES)


@add(
    "annual_series",
    _series_sql("SELECT year, fatal, round(serious, 6) AS serious, round(slight, 6) AS slight, round(\"all\", 6) AS \"all\", traffic FROM series"),
)
def _(spark, d):
    return _rounded(_series(spark, d), "serious", "slight", "all")


@add(
    "yoy_change",
    _series_sql(
        "SELECT b.year, round((b.fatal - a.fatal) / CAST(a.fatal AS DOUBLE), 6) AS fatal_change, round(abs(b.traffic - a.traffic) / a.traffic, 6) AS traffic_change, "
        "CASE WHEN b.fatal > a.fatal THEN 'increased' ELSE 'decreased' END AS fatal_word, "
        "CASE WHEN b.\"all\" > a.\"all\" THEN 'increased' ELSE 'fallen' END AS all_word FROM series a, series b WHERE a.year = 2000 AND b.year = 2001"
    ),
)
def _(spark, d):
    return _rounded(factsheet.year_on_year(_series(spark, d)), "fatal_change", "traffic_change")


def _index_sql(columns, source):
    return " UNION ALL ".join(
        f"SELECT year, '{c}' AS variable, round(\"{c}\" / CAST((SELECT \"{c}\" FROM {source} WHERE year = 1996) AS DOUBLE) * 100, 6) AS value FROM {source}"
        for c in columns
    )


@add("index_base", _series_sql(_index_sql(("fatal", "serious", "slight", "traffic"), "series")))
def _(spark, d):
    indexed = factsheet.index_to_base(_series(spark, d), _BASE, ("fatal", "serious", "slight", "traffic"))
    return _rounded(indexed, "value")


# exposure is scaled down so that whole-number rates stay informative
_RATES = (
    "SELECT year, round_even(fatal / (traffic / 100), 0) AS fatal, round_even(serious / (traffic / 100), 0) AS serious, "
    "round_even(slight / (traffic / 100), 0) AS slight, round_even(\"all\" / (traffic / 100), 0) AS \"all\" FROM series"
)


@add(
    "rate_per_exposure",
    with_roles(_index_sql(("fatal", "serious", "slight", "all"), "rates"), "casualty", "exposure", series=_SERIES, rates=_RATES),
)
def _(spark, d):
    series = _series(spark, d).withColumn("traffic", F.col("traffic") / 100)
    rates = factsheet.rates_per_exposure(series)
    return _rounded(factsheet.index_to_base(rates, _BASE, ("fatal", "serious", "slight", "all")), "value")


_BANDS = " ".join(
    f"WHEN age_of_casualty > {low} AND age_of_casualty <= {high} THEN '{label}'" for low, high, label in factsheet.AGE_BANDS
)


@add(
    "age_band_sex",
    _sql(
        f", t AS (SELECT sex_of_casualty, CASE {_BANDS} END AS age_band, {_MEASURES} FROM people WHERE casualty_type = 'Pedestrian' GROUP BY 1, 2), "
        "s AS (SELECT sex_of_casualty, age_band, fatal, round(serious, 6) AS serious, round(slight, 6) AS slight, round(fatal + serious, 6) AS \"all\", "
        "round((fatal + serious) / sum(fatal + serious) OVER () * 100, 6) AS pc_ksi FROM t WHERE age_band IS NOT NULL) "
        "SELECT * FROM s WHERE sex_of_casualty IN ('Male', 'Female')"
    ),
)
def _(spark, d):
    return _rounded(factsheet.age_band_by_sex(_people(spark, d), _USER), "serious", "slight", "all", "pc_ksi")


_DAYTYPE = (
    "SELECT CAST(hour(datetime) AS INT) AS collision_hr, CASE WHEN dayname(datetime) IN ('Saturday', 'Sunday') THEN dayname(datetime) "
    "ELSE 'Monday to Friday' END AS dow, sum(fatal + serious) / CASE WHEN dayname(any_value(datetime)) IN ('Saturday', 'Sunday') THEN 1 ELSE 5 END AS ksi "
    "FROM sums LEFT JOIN collision USING (collision_index) GROUP BY 1, 2"
)


@add(
    "hour_daytype",
    _sql("SELECT collision_hr, dow, round(ksi, 6) AS ksi FROM daytype", "collision", daytype=_DAYTYPE),
)
def _(spark, d):
    return _rounded(factsheet.hour_by_daytype(_sums(spark, d), collision(spark, d)), "ksi")


@add(
    "peak_hours",
    _sql(
        ", t AS (SELECT CASE WHEN dow = 'Monday to Friday' THEN 'weekday' ELSE 'weekend' END AS period, collision_hr, sum(ksi) AS ksi FROM daytype GROUP BY 1, 2), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY ksi DESC, collision_hr) AS place FROM t) "
        "SELECT period, min(collision_hr) AS first_hour, max(collision_hr) AS last_hour FROM r WHERE place <= 4 GROUP BY 1",
        "collision",
        daytype=_DAYTYPE,
    ),
)
def _(spark, d):
    return factsheet.peak_hours(factsheet.hour_by_daytype(_sums(spark, d), collision(spark, d)))
