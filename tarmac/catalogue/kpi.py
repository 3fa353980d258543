"""Indicator, trend and map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.roles import collision, timed, with_roles
from tarmac.functions import dates
from tarmac.functions.predicates import TimeFilter, all_of, any_of, equal_unless_all, severity_in
from tarmac.functions.severity import colour
from tarmac.operators import breakdown, hotspots, kpi

catalogue = Catalogue()
add = catalogue.add

_TWO = ("Fatal", "Serious")

def _monthly_columns() -> str:
    """Conditional counts and sums per severity, with filter clauses."""
    columns = []
    for name in ("Fatal", "Serious", "Slight"):
        only = f"FILTER (collision_severity = '{name}')"
        low = name.lower()
        columns.append(f"count(*) {only} AS {low}")
        for what in ("casualties", "vehicles"):
            columns.append(f"CAST(coalesce(sum(number_of_{what}) {only}, 0) AS BIGINT) AS {low}_{what}")
    columns.append("count(*) FILTER (collision_severity = 'Fatal') AS adj_fatal")
    columns += [f"sum(collision_adjusted_severity_{low}) AS adj_{low}" for low in ("serious", "slight")]
    return ", ".join(columns)


_MONTHLY_SQL = f"SELECT year, month_num, month, {_monthly_columns()} FROM collision GROUP BY ALL"

_DAILY_SQL = """
SELECT date, year, month_num, collision_severity, count(*) AS collisions,
  CAST(sum(number_of_casualties) AS BIGINT) AS casualties, CAST(sum(number_of_vehicles) AS BIGINT) AS vehicles
FROM collision GROUP BY date, year, month_num, collision_severity
"""


def _monthly_sql(body: str) -> str:
    return with_roles(body, "collision", kpi_monthly=_MONTHLY_SQL)


def _daily_sql(body: str) -> str:
    return with_roles(body, "collision", kpi_daily=_DAILY_SQL)


@add("kpi_monthly", _monthly_sql("SELECT * FROM kpi_monthly"))
def _(spark, d):
    return kpi.kpi_monthly(collision(spark, d))


@add("kpi_daily", _daily_sql("SELECT * FROM kpi_daily"))
def _(spark, d):
    return kpi.kpi_daily(collision(spark, d))


@add(
    "by_hour",
    with_roles(
        "SELECT CAST(hour(datetime) AS INT) AS hour, collision_severity, count(*) AS count FROM timed GROUP BY 1, 2",
        "timed",
    ),
)
def _(spark, d):
    return kpi.count_by_severity(timed(spark, d).withColumn("hour", F.hour("datetime")), "hour")


@add(
    "by_dow",
    with_roles(
        "SELECT dayname(date) AS day_of_week, collision_severity, count(*) AS count FROM collision GROUP BY 1, 2",
        "collision",
    ),
)
def _(spark, d):
    return kpi.count_by_severity(
        collision(spark, d).withColumn("day_of_week", dates.day_name(F.col("date"))), "day_of_week"
    )


@add(
    "kpi_year",
    _monthly_sql(
        "SELECT CAST(sum(fatal + serious) AS BIGINT) AS total_collisions, "
        "CAST(sum(fatal_casualties + serious_casualties) AS BIGINT) AS total_casualties, "
        "CAST(sum(fatal_vehicles + serious_vehicles) AS BIGINT) AS total_vehicles FROM kpi_monthly WHERE year = 1998"
    ),
)
def _(spark, d):
    return kpi.kpi_year(kpi.kpi_monthly(collision(spark, d, 1998, 1998)), 1998, _TWO)


@add(
    "kpi_yoy",
    _monthly_sql(
        ", y AS (SELECT year, CAST(sum(fatal + serious) AS BIGINT) AS total_collisions, "
        "CAST(sum(fatal_casualties + serious_casualties) AS BIGINT) AS total_casualties, "
        "CAST(sum(fatal_vehicles + serious_vehicles) AS BIGINT) AS total_vehicles FROM kpi_monthly GROUP BY year) "
        "SELECT a.*, a.total_collisions - b.total_collisions AS delta_collisions, "
        "a.total_casualties - b.total_casualties AS delta_casualties, "
        "a.total_vehicles - b.total_vehicles AS delta_vehicles FROM y a LEFT JOIN y b ON b.year = a.year - 1"
    ),
)
def _(spark, d):
    return kpi.kpi_year_on_year(kpi.kpi_monthly(collision(spark, d)), _TWO)


@add(
    "kpi_range",
    _daily_sql(
        "SELECT CAST(sum(collisions) AS BIGINT) AS total_collisions, CAST(sum(casualties) AS BIGINT) AS total_casualties, "
        "CAST(sum(vehicles) AS BIGINT) AS total_vehicles FROM kpi_daily "
        "WHERE date BETWEEN '1997-03-15' AND '1998-02-10' AND collision_severity IN ('Fatal', 'Slight')"
    ),
)
def _(spark, d):
    return kpi.kpi_range(kpi.kpi_daily(collision(spark, d, 1997, 1998)), "1997-03-15", "1998-02-10", ["Fatal", "Slight"])


@add(
    "monthly_trend_original",
    _monthly_sql("SELECT month_num, month, fatal, serious, slight FROM kpi_monthly WHERE year = 1999"),
)
def _(spark, d):
    return kpi.monthly_trend(kpi.kpi_monthly(collision(spark, d, 1999, 1999)), 1999)


@add(
    "monthly_trend_adjusted",
    _monthly_sql(
        "SELECT month_num, month, adj_fatal AS fatal, adj_serious AS serious, adj_slight AS slight "
        "FROM kpi_monthly WHERE year = 1999"
    ),
)
def _(spark, d):
    return kpi.monthly_trend(kpi.kpi_monthly(collision(spark, d, 1999, 1999)), 1999, adjusted=True)


@add(
    "trend_long",
    _monthly_sql(
        "SELECT month_num, month, upper(severity[1]) || severity[2:] AS severity, count FROM ("
        "UNPIVOT (SELECT month_num, month, fatal, serious, slight FROM kpi_monthly WHERE year = 1999) "
        "ON fatal, serious, slight INTO NAME severity VALUE count) WHERE severity IN ('fatal', 'slight')"
    ),
)
def _(spark, d):
    return kpi.trend_long(kpi.monthly_trend(kpi.kpi_monthly(collision(spark, d, 1999, 1999)), 1999), ["Fatal", "Slight"])


@add(
    "daily_trend_month",
    with_roles(
        "SELECT date, collision_severity, count(*) AS count FROM collision WHERE year = 1998 AND month(date) = 2 "
        "GROUP BY 1, 2",
        "collision",
    ),
)
def _(spark, d):
    return kpi.daily_trend_month(collision(spark, d, 1998, 1998), 1998, 2)


@add(
    "daily_trend_range",
    _daily_sql(
        "SELECT date, collision_severity AS severity, CAST(sum(collisions) AS BIGINT) AS count FROM kpi_daily "
        "WHERE date BETWEEN '1998-11-20' AND '1999-01-15' AND collision_severity = 'Serious' GROUP BY 1, 2"
    ),
)
def _(spark, d):
    return kpi.daily_trend_range(kpi.kpi_daily(collision(spark, d, 1998, 1999)), "1998-11-20", "1999-01-15", ["Serious"])


@add(
    "daily_trend_december",
    _daily_sql(
        "SELECT date, collision_severity AS severity, CAST(sum(collisions) AS BIGINT) AS count FROM kpi_daily "
        "WHERE date >= '1999-12-01' AND date < '2000-01-01' GROUP BY 1, 2"
    ),
)
def _(spark, d):
    return kpi.daily_trend_of_month(kpi.kpi_daily(collision(spark, d, 1999, 1999)), 1999, 12, ["Fatal", "Serious", "Slight"])


_TOTALS = (
    ", t AS (SELECT year, month_num, CAST(sum(fatal + serious) AS BIGINT) AS total FROM kpi_monthly GROUP BY 1, 2) "
)


@add(
    "mom_change",
    _monthly_sql(
        _TOTALS + "SELECT year, month_num, total, total - lag(total) OVER w AS change, "
        "round((total - lag(total) OVER w) / CAST(lag(total) OVER w AS DOUBLE) * 100, 6) AS change_pct "
        "FROM t WINDOW w AS (ORDER BY year, month_num)"
    ),
)
def _(spark, d):
    return kpi.month_on_month(kpi.kpi_monthly(collision(spark, d)), _TWO)


@add(
    "cumulative_year",
    _monthly_sql(
        _TOTALS + "SELECT year, month_num, total, CAST(sum(total) OVER (PARTITION BY year ORDER BY month_num "
        "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM t"
    ),
)
def _(spark, d):
    return kpi.cumulative_in_year(kpi.kpi_monthly(collision(spark, d)), _TWO)


# --- filters ------------------------------------------------------------------


@add(
    "severity_filter",
    with_roles(
        "SELECT collision_severity, count(*) AS n FROM collision WHERE collision_severity IN ('Fatal', 'Serious') GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    return breakdown.frequency(collision(spark, d).where(severity_in(_TWO)), "collision_severity")


@add(
    "time_filter_month",
    with_roles(
        "SELECT collision_severity, count(*) AS n FROM collision WHERE year = 1997 AND month(date) = 5 GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    return breakdown.frequency(
        collision(spark, d, 1997, 1997).where(TimeFilter(year=1997, month=5).column()), "collision_severity"
    )


@add(
    "time_filter_range",
    with_roles(
        "SELECT collision_severity, count(*) AS n FROM collision WHERE date BETWEEN '1996-02-29' AND '1996-12-31' GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    return breakdown.frequency(
        collision(spark, d, 1996, 1996).where(TimeFilter(start="1996-02-29", end="1996-12-31").column()), "collision_severity"
    )


@add(
    "condition_filter",
    with_roles(
        "SELECT road_type, weather_conditions, count(*) AS n FROM collision "
        "WHERE weather_conditions IN ('Snowing', 'Fog or mist') AND light_conditions = 'Daylight' GROUP BY 1, 2",
        "collision",
    ),
)
def _(spark, d):
    condition = all_of(
        any_of("weather_conditions", ["Snowing", "Fog or mist"]),
        any_of("road_type", []),
        equal_unless_all("light_conditions", "Daylight"),
        equal_unless_all("road_type", "All"),
    )
    chosen = collision(spark, d).where(condition)
    return chosen.groupBy("road_type", "weather_conditions").agg(F.count("*").alias("n"))


@add(
    "weekday_hour_filter",
    with_roles(
        "SELECT collision_index, date, time FROM collision WHERE day(date) < 7 AND dayname(date) = 'Monday' "
        "AND CAST(substr(time, 1, 2) AS INT) > 15 AND CAST(substr(time, 1, 2) AS INT) < 19",
        "collision",
    ),
)
def _(spark, d):
    hour = dates.clock_hour(F.col("time"))
    return (
        collision(spark, d)
        .where((F.dayofmonth("date") < 7) & (dates.day_name(F.col("date")) == "Monday") & (hour > 15) & (hour < 19))
        .select("collision_index", "date", "time")
    )


@add(
    "birth_year",
    with_roles(
        "SELECT collision_year - age_of_casualty AS birth_year, count(*) AS n FROM casualty "
        "WHERE collision_year - age_of_casualty > 1969 GROUP BY 1",
        "casualty",
    ),
)
def _(spark, d):
    from tarmac.catalogue.roles import casualty

    born = casualty(spark, d).withColumn("birth_year", F.col("collision_year") - F.col("age_of_casualty"))
    return born.where(F.col("birth_year") > 1969).groupBy("birth_year").agg(F.count("*").alias("n"))


@add(
    "regex_filter",
    with_roles(
        "SELECT collision_severity, speed_limit, light_conditions, count(*) AS n FROM collision "
        "WHERE regexp_matches(light_conditions, 'lit|unlit') GROUP BY ALL",
        "collision",
    ),
)
def _(spark, d):
    df = collision(spark, d).where(F.col("light_conditions").rlike("lit|unlit"))
    named = df.select(df.colRegex("`(?i)(?!.*adjusted).*(severity|speed|light).*`"))
    return named.groupBy(*named.columns).agg(F.count("*").alias("n"))


# --- map ----------------------------------------------------------------------


@add(
    "collision_geopoints",
    with_roles(
        "SELECT latitude, longitude, year, month_num, collision_severity, date, time, number_of_casualties, "
        "number_of_vehicles, road_type, weather_conditions, light_conditions FROM collision "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
        "collision",
    ),
)
def _(spark, d):
    return hotspots.geopoints(collision(spark, d))


_EVENTS_SQL = (
    "SELECT latitude, longitude, date, year, month_num, collision_severity, weather_conditions, light_conditions, "
    "road_type, number_of_casualties AS casualties, number_of_vehicles AS vehicles FROM collision "
    "WHERE latitude IS NOT NULL AND longitude IS NOT NULL"
)


@add("geo_events_raw", with_roles(_EVENTS_SQL, "collision"))
def _(spark, d):
    return hotspots.geo_events(collision(spark, d))


@add(
    "map_points",
    with_roles(
        "SELECT latitude, longitude, collision_severity, date, time, number_of_casualties, number_of_vehicles "
        "FROM collision WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND date BETWEEN '1996-01-01' AND '2000-12-31' "
        "AND collision_severity IN ('Fatal', 'Serious') AND road_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') "
        "ORDER BY date, latitude, longitude, collision_severity, time, number_of_casualties, number_of_vehicles LIMIT 50000",
        "collision",
    ),
)
def _(spark, d):
    condition = all_of(
        TimeFilter(start="1996-01-01", end="2000-12-31").column(),
        severity_in(_TWO),
        any_of("road_type", ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
        any_of("weather_conditions", []),
    )
    return hotspots.map_points(hotspots.geopoints(collision(spark, d, 1996, 2000)), condition, 50000)


@add(
    "map_centroid",
    with_roles(
        "SELECT round(avg(latitude), 6) AS mid_lat, round(avg(longitude), 6) AS mid_lon FROM collision "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND year = 1998",
        "collision",
    ),
)
def _(spark, d):
    points = hotspots.geopoints(collision(spark, d, 1998, 1998)).where(TimeFilter(year=1998).column())
    mid = breakdown.centroid(points)
    return mid.select(*[F.round(c, 6).alias(c) for c in mid.columns])


@add(
    "severity_color",
    with_roles(
        "SELECT collision_severity, CASE collision_severity WHEN 'Fatal' THEN 255 WHEN 'Serious' THEN 255 ELSE 0 END AS r, "
        "CASE collision_severity WHEN 'Fatal' THEN 0 WHEN 'Serious' THEN 165 ELSE 128 END AS g, "
        "CASE collision_severity WHEN 'Fatal' THEN 0 WHEN 'Serious' THEN 0 ELSE 255 END AS b, 160 AS a, count(*) AS n "
        "FROM collision GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    shade = F.col("shade")
    return (
        collision(spark, d)
        .withColumn("shade", colour(F.col("collision_severity")))
        .groupBy("collision_severity", *[shade[i].alias(c) for i, c in enumerate("rgba")])
        .agg(F.count("*").alias("n"))
    )


# --- hotspots -----------------------------------------------------------------

# risk weights come from a joined list of values
_CELLS = (
    "SELECT gx || '_' || gy AS cell_id, (gx + CAST(0.5 AS DOUBLE)) / {scale} AS grid_lat, (gy + CAST(0.5 AS DOUBLE)) / {scale} AS grid_lon, "
    "count(*) AS collisions, CAST(sum(casualties) AS BIGINT) AS casualties, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS risk_score "
    "FROM (SELECT *, CAST(floor(latitude * {scale}) AS BIGINT) AS gx, CAST(floor(longitude * {scale}) AS BIGINT) AS gy FROM geo_events WHERE {where}) "
    "LEFT JOIN (VALUES ('Fatal', 3), ('Serious', 2), ('Slight', 1)) AS w(severity, weight) ON severity = collision_severity GROUP BY gx, gy"
)


def _chord_sql(lat: str, lon: str) -> str:
    """Distance from the centre through the chord between unit vectors."""
    at = "cos(radians({0})) * cos(radians({1})), cos(radians({0})) * sin(radians({1})), sin(radians({0}))"
    squares = " + ".join(
        f"pow({a} - {b}, 2)"
        for a, b in zip(at.format(lat, lon).split(", "), at.format("51.5074", "-0.1278").split(", "))
    )
    return f"2 * 3958.8 * asin(least(1, sqrt({squares}) / 2))"


_DISTANCE = _chord_sql("grid_lat", "grid_lon")


def _hotspot_sql(scale: int, where: str, tail: str) -> str:
    return with_roles(
        f"SELECT cell_id, round(grid_lat, 6) AS grid_lat, round(grid_lon, 6) AS grid_lon, collisions, casualties, "
        f"risk_score, round(distance_miles, 6) AS distance_miles FROM (SELECT *, {_DISTANCE} AS distance_miles FROM cells) {tail}",
        "collision",
        geo_events=_EVENTS_SQL,
        cells=_CELLS.format(scale=scale, where=where),
    )


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def hotspot_query(spark, d):
    """The flagship: riskiest cells of a year with their distance from the centre."""
    events = hotspots.geo_events(collision(spark, d, 1998, 1998))
    condition = all_of(TimeFilter(year=1998).column(), severity_in(["Fatal", "Serious", "Slight"]))
    top = hotspots.hotspots(events, 20, condition, "risk_score", 20)
    return _rounded(top, "grid_lat", "grid_lon", "distance_miles")


add(
    "hotspots", _hotspot_sql(20, "year = 1998", "ORDER BY risk_score DESC, cell_id LIMIT 20")
)(hotspot_query)


@add(
    "hotspots_radius",
    _hotspot_sql(
        50,
        "weather_conditions = 'Snowing' OR weather_conditions = 'Fine no high winds'",
        "WHERE distance_miles <= 60 ORDER BY casualties DESC, cell_id LIMIT 50",
    ),
)
def _(spark, d):
    events = hotspots.geo_events(collision(spark, d))
    condition = any_of("weather_conditions", ["Snowing", "Fine no high winds"])
    top = hotspots.hotspots(events, 50, condition, "casualties", 50, radius_miles=60)
    return _rounded(top, "grid_lat", "grid_lon", "distance_miles")


@add("grid_bin", _hotspot_sql(100, "TRUE", ""))
def _(spark, d):
    cells = hotspots.cell_summary(hotspots.geo_events(collision(spark, d)), 100)
    from tarmac.functions.geo import haversine_miles

    distance = haversine_miles(F.col("grid_lat"), F.col("grid_lon"), *hotspots.DEFAULT_CENTRE)
    return _rounded(cells.withColumn("distance_miles", distance), "grid_lat", "grid_lon", "distance_miles")


@add(
    "haversine",
    with_roles(
        "SELECT collision_index, round("
        + _chord_sql("latitude", "longitude")
        + ", 6) AS miles FROM collision WHERE latitude IS NOT NULL",
        "collision",
    ),
)
def _(spark, d):
    from tarmac.functions.geo import haversine_miles

    miles = haversine_miles(F.col("latitude"), F.col("longitude"), *hotspots.DEFAULT_CENTRE)
    located = collision(spark, d).where(F.col("latitude").isNotNull())
    return located.select("collision_index", F.round(miles, 6).alias("miles"))


@add(
    "condition_hotspots",
    with_roles(
        "SELECT cell_id, round(grid_lat, 6) AS grid_lat, round(grid_lon, 6) AS grid_lon, collisions, casualties, risk_score "
        "FROM cells ORDER BY collisions DESC, cell_id LIMIT 20",
        "collision",
        geo_events=_EVENTS_SQL,
        cells=_CELLS.format(
            scale=20, where="year = 1999 AND light_conditions IN ('Daylight', 'Darkness - lights lit') AND road_type IN ('5-LOW')"
        ),
    ),
)
def _(spark, d):
    condition = all_of(
        F.col("year") == 1999,
        any_of("light_conditions", ["Daylight", "Darkness - lights lit"]),
        any_of("road_type", ["5-LOW"]),
        any_of("weather_conditions", []),
    )
    events = hotspots.geo_events(collision(spark, d, 1999, 1999))
    return _rounded(hotspots.condition_hotspots(20, events, condition, "collisions", 20), "grid_lat", "grid_lon")


_CELL_ROWS = (
    "FROM (SELECT *, CAST(floor(latitude * 2) AS BIGINT) AS gx, CAST(floor(longitude * 2) AS BIGINT) AS gy FROM geo_events) "
    "WHERE gx = 103 AND gy = -7"
)


@add(
    "cell_drilldown",
    with_roles(
        f"SELECT collision_severity, count(*) AS collisions, CAST(sum(casualties) AS BIGINT) AS casualties {_CELL_ROWS} GROUP BY 1",
        "collision",
        geo_events=_EVENTS_SQL,
    ),
)
def _(spark, d):
    return hotspots.cell_severities(hotspots.geo_events(collision(spark, d)), 2, F.lit(True), "103_-7")


@add(
    "cell_page",
    with_roles(
        f"SELECT date, year, month_num, latitude, longitude, collision_severity, casualties, vehicles, weather_conditions, "
        f"light_conditions, road_type {_CELL_ROWS} ORDER BY date, year, month_num, latitude, longitude, collision_severity, "
        "casualties, vehicles, weather_conditions, light_conditions, road_type LIMIT 5 OFFSET 2",
        "collision",
        geo_events=_EVENTS_SQL,
    ),
)
def _(spark, d):
    events = hotspots.geo_events(collision(spark, d))
    return hotspots.cell_page(events, 2, F.lit(True), "103_-7", "date", limit=5, offset=2)


@add(
    "cell_page_after",
    with_roles(
        f"SELECT date, year, month_num, latitude, longitude, collision_severity, casualties, vehicles, weather_conditions, "
        f"light_conditions, road_type, CAST(row_number() OVER (PARTITION BY date, year, month_num, latitude, longitude, collision_severity, casualties, "
        f"vehicles, weather_conditions, light_conditions, road_type) AS INT) AS copy {_CELL_ROWS} ORDER BY casualties, date, year, month_num, latitude, "
        "longitude, collision_severity, vehicles, weather_conditions, light_conditions, road_type LIMIT 5 OFFSET 10",
        "collision",
        geo_events=_EVENTS_SQL,
    ),
)
def _(spark, d):
    events, last = hotspots.geo_events(collision(spark, d)), None
    for _ in range(2):  # two pages of five, then the page that follows
        shown = hotspots.cell_page_after(events, 2, F.lit(True), "103_-7", "casualties", 5, last).collect()
        last = shown[-1] if shown else last
    return hotspots.cell_page_after(events, 2, F.lit(True), "103_-7", "casualties", 5, last)


@add(
    "cell_decode",
    with_roles(
        "SELECT cell_id, gx, gy, collisions FROM (SELECT CAST(floor(latitude * 50) AS BIGINT) AS gx, "
        "CAST(floor(longitude * 50) AS BIGINT) AS gy, count(*) AS collisions, "
        "concat(CAST(floor(latitude * 50) AS BIGINT), '_', CAST(floor(longitude * 50) AS BIGINT)) AS cell_id FROM geo_events GROUP BY ALL)",
        "collision",
        geo_events=_EVENTS_SQL,
    ),
)
def _(spark, d):
    cells = hotspots.cell_summary(hotspots.geo_events(collision(spark, d)), 50)
    return hotspots.decode_cells(cells).select("cell_id", "gx", "gy", "collisions")


@add(
    "stable_sample",
    with_roles(
        "SELECT collision_index, collision_severity FROM collision "
        "ORDER BY md5('42|' || CAST(collision_index AS VARCHAR)), collision_index LIMIT 8000",
        "collision",
    ),
)
def _(spark, d):
    rows = collision(spark, d).select("collision_index", "collision_severity")
    return hotspots.stable_sample(rows, ["collision_index"], 8000, 42)
