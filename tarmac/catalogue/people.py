"""Demographic, factor, share and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.roles import casualty, collision, table, vehicle, with_roles, zones
from tarmac.functions import dates
from tarmac.functions.predicates import TimeFilter, all_of, severity_in
from tarmac.operators import breakdown, clean

catalogue = Catalogue()
add = catalogue.add


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- demographics -------------------------------------------------------------

_DEMO_SQL = (
    "SELECT casualty_type, age_group, sex_of_casualty, casualty_severity, count(*) AS count FROM casualty JOIN collision USING (collision_index) "
    "WHERE year = 1998 AND collision_severity IN ('Fatal', 'Serious') AND casualty_class IN ('Driver or rider', 'Passenger', 'Pedestrian') "
    "AND sex_of_casualty IN ('Male', 'Female') GROUP BY ALL"
)


def _demo(spark, d):
    return breakdown.demographics(
        casualty(spark, d),
        collision(spark, d, 1998, 1998),
        all_of(TimeFilter(year=1998).column(), severity_in(["Fatal", "Serious"])),
        classes=["Driver or rider", "Passenger", "Pedestrian"],
        sexes=["Male", "Female"],
    )


def _demo_sql(body):
    return with_roles(body, "casualty", "collision", demo=_DEMO_SQL)


@add("demographics", _demo_sql("SELECT * FROM demo"))
def _(spark, d):
    return _demo(spark, d)


@add(
    "demographic_filters",
    with_roles(
        "SELECT casualty_type, age_group, sex_of_casualty, casualty_severity, count(*) AS count FROM casualty JOIN collision USING (collision_index) "
        "WHERE date BETWEEN '1997-01-01' AND '1999-06-30' AND casualty_class = 'Pedestrian' "
        "AND age_group IN ('Child', 'Senior', 'Unknown') GROUP BY ALL",
        "casualty",
        "collision",
    ),
)
def _(spark, d):
    return breakdown.demographics(
        casualty(spark, d),
        collision(spark, d, 1997, 1999),
        TimeFilter(start="1997-01-01", end="1999-06-30").column(),
        classes=["Pedestrian"],
        ages=["Child", "Senior", "Unknown"],
    )


@add(
    "mode_severity",
    _demo_sql("SELECT casualty_type, casualty_severity, CAST(sum(count) AS BIGINT) AS count FROM demo GROUP BY 1, 2"),
)
def _(spark, d):
    return breakdown.mode_by_severity(_demo(spark, d))


@add(
    "mode_order",
    _demo_sql("SELECT casualty_type, CAST(sum(count) AS BIGINT) AS count FROM demo GROUP BY 1 ORDER BY 2, 1"),
)
def _(spark, d):
    return breakdown.mode_order(_demo(spark, d))


@add(
    "demographic_subtotals",
    _demo_sql(
        "SELECT casualty_type, casualty_severity, NULL AS age_group, NULL AS sex_of_casualty, CAST(sum(count) AS BIGINT) AS count, 'mode_severity' AS grouping FROM demo GROUP BY 1, 2 "
        "UNION ALL SELECT casualty_type, NULL, NULL, NULL, CAST(sum(count) AS BIGINT), 'mode' FROM demo GROUP BY 1 "
        "UNION ALL SELECT NULL, NULL, age_group, sex_of_casualty, CAST(sum(count) AS BIGINT), 'age_sex' FROM demo GROUP BY 3, 4"
    ),
)
def _(spark, d):
    return breakdown.demographic_subtotals(_demo(spark, d))


@add(
    "age_sex",
    _demo_sql("SELECT age_group, sex_of_casualty, CAST(sum(count) AS BIGINT) AS count FROM demo GROUP BY 1, 2"),
)
def _(spark, d):
    return breakdown.age_by_sex(_demo(spark, d))


@add("age_group", with_roles("SELECT age_group, age_of_casualty, count(*) AS n FROM casualty GROUP BY 1, 2", "casualty"))
def _(spark, d):
    return casualty(spark, d).groupBy("age_group", "age_of_casualty").agg(F.count("*").alias("n"))


_MIX_SQL = (
    "SELECT collision_index, count(*) AS total, count(*) FILTER (casualty_type = 'Pedestrian') AS walking, "
    "count(*) FILTER (casualty_type = 'Cyclist') AS cycling, count(*) FILTER (casualty_type = 'Car occupant') AS passenger "
    "FROM casualty GROUP BY 1"
)


def _mixed_sql(body):
    return with_roles(
        body,
        "casualty",
        "collision",
        mix=_MIX_SQL,
        cj="SELECT c.*, m.total, m.walking, m.cycling, m.passenger FROM collision c LEFT JOIN mix m USING (collision_index)",
    )


def _mixed(spark, d):
    return breakdown.with_casualty_mix(collision(spark, d), casualty(spark, d))


@add(
    "casualty_mix",
    _mixed_sql("SELECT collision_index, collision_severity, speed_limit, total, walking, cycling, passenger FROM cj"),
)
def _(spark, d):
    return _mixed(spark, d).select(
        "collision_index", "collision_severity", "speed_limit", "total", "walking", "cycling", "passenger"
    )


@add(
    "road_user_type",
    _mixed_sql(
        "SELECT CASE WHEN walking > 0 THEN 'Walking' WHEN cycling > 0 THEN 'Cycling' WHEN passenger > 0 THEN 'Passenger' "
        "ELSE 'Other' END AS type, CASE light_conditions WHEN 'Daylight' THEN 'Daylight' WHEN 'Darkness - lights lit' "
        "THEN 'Lit' ELSE 'Other/Unlit' END AS light, collision_severity, count(*) AS n FROM cj "
        "WHERE collision_severity <> 'Slight' GROUP BY 1, 2, 3"
    ),
)
def _(spark, d):
    kind = breakdown.dominant_mode(F.col("walking"), F.col("cycling"), F.col("passenger"))
    light = breakdown.light_group(F.col("light_conditions"))
    return (
        _mixed(spark, d)
        .where(F.col("collision_severity") != "Slight")
        .groupBy(kind.alias("type"), light.alias("light"), "collision_severity")
        .agg(F.count("*").alias("n"))
    )


@add(
    "casualty_pivot",
    with_roles(
        'SELECT collision_index, count(*) FILTER (casualty_type = \'Pedestrian\') AS "Pedestrian", '
        'count(*) FILTER (casualty_type = \'Cyclist\') AS "Cyclist", '
        'count(*) FILTER (casualty_type = \'Car occupant\') AS "Car occupant", '
        'count(*) FILTER (casualty_type = \'Motorcycle rider\') AS "Motorcycle rider", '
        'count(*) FILTER (casualty_type = \'Bus occupant\') AS "Bus occupant", count(*) AS total FROM casualty GROUP BY 1',
        "casualty",
    ),
)
def _(spark, d):
    types = ["Pedestrian", "Cyclist", "Car occupant", "Motorcycle rider", "Bus occupant"]
    return breakdown.casualty_pivot(casualty(spark, d), types)


_UNPIVOT = (
    "SELECT {key}, 'walking' AS mode, CAST(sum(walking) AS BIGINT) AS casualties FROM cj GROUP BY 1 UNION ALL "
    "SELECT {key}, 'cycling', CAST(sum(cycling) AS BIGINT) FROM cj GROUP BY 1 UNION ALL "
    "SELECT {key}, 'passenger', CAST(sum(passenger) AS BIGINT) FROM cj GROUP BY 1"
)


@add("mode_by_date", _mixed_sql(_UNPIVOT.format(key="date")))
def _(spark, d):
    return breakdown.modes_long(_mixed(spark, d), F.col("date"), "date")


@add("mode_by_hour", _mixed_sql(_UNPIVOT.format(key="CAST(substr(time, 1, 2) AS INT) AS hour")))
def _(spark, d):
    return breakdown.modes_long(_mixed(spark, d), dates.clock_hour(F.col("time")), "hour")


# --- factors ------------------------------------------------------------------


@add(
    "factor_severity",
    with_roles(
        "SELECT weather_conditions, collision_severity, count(*) AS count FROM collision WHERE year = 1999 "
        "AND collision_severity IN ('Fatal', 'Slight') GROUP BY 1, 2 ORDER BY 3 DESC",
        "collision",
    ),
)
def _(spark, d):
    condition = all_of(TimeFilter(year=1999).column(), severity_in(["Fatal", "Slight"]))
    return breakdown.factor_by_severity(collision(spark, d, 1999, 1999), "weather_conditions", condition)


@add(
    "factor_all",
    with_roles(
        " UNION ALL ".join(
            f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS value, collision_severity, count(*) AS count "
            "FROM collision WHERE year = 1999 AND month(date) = 6 GROUP BY 2, 3"
            for f in (
                "speed_limit",
                "road_type",
                "weather_conditions",
                "light_conditions",
                "road_surface_conditions",
                "junction_detail",
                "urban_or_rural_area",
            )
        ),
        "collision",
    ),
)
def _(spark, d):
    return breakdown.all_factors_by_severity(
        collision(spark, d, 1999, 1999), TimeFilter(year=1999, month=6).column()
    )


_PAIR_SQL = (
    "SELECT road_surface_conditions, urban_or_rural_area, count(*) AS count FROM collision WHERE year = 1999 GROUP BY 1, 2"
)


def _pair(spark, d):
    return breakdown.factor_interaction(
        collision(spark, d, 1999, 1999), "road_surface_conditions", "urban_or_rural_area", TimeFilter(year=1999).column()
    )


@add("factor_interaction", with_roles(_PAIR_SQL, "collision"))
def _(spark, d):
    return _pair(spark, d)


@add(
    "factor_pivot",
    with_roles(
        'SELECT road_surface_conditions, CAST(coalesce(sum(count) FILTER (urban_or_rural_area = \'Urban\'), 0) AS BIGINT) AS "Urban", '
        'CAST(coalesce(sum(count) FILTER (urban_or_rural_area = \'Rural\'), 0) AS BIGINT) AS "Rural", '
        'CAST(coalesce(sum(count) FILTER (urban_or_rural_area = \'Unallocated\'), 0) AS BIGINT) AS "Unallocated" FROM pair GROUP BY 1',
        "collision",
        pair=_PAIR_SQL,
    ),
)
def _(spark, d):
    return breakdown.factor_pivot(
        _pair(spark, d), "road_surface_conditions", "urban_or_rural_area", ["Urban", "Rural", "Unallocated"]
    )


# --- value lists --------------------------------------------------------------


@add(
    "top_values",
    "SELECT p_name AS v, count(*) AS n FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> '' GROUP BY 1 "
    "ORDER BY n DESC, v LIMIT 30",
)
def _(spark, d):
    return breakdown.top_values(table(spark, d, "part"), "p_name", 30)


@add("years", with_roles("SELECT DISTINCT year FROM collision ORDER BY year DESC", "collision"))
def _(spark, d):
    return breakdown.years_on_record(collision(spark, d))


@add("date_range", with_roles("SELECT min(date) AS min_date, max(date) AS max_date FROM collision", "collision"))
def _(spark, d):
    return breakdown.date_range(collision(spark, d))


@add(
    "condition_options",
    with_roles("SELECT DISTINCT light_conditions FROM collision WHERE year = 1998 ORDER BY 1", "collision"),
)
def _(spark, d):
    return breakdown.options(collision(spark, d, 1998, 1998), "light_conditions", F.col("year") == 1998)


@add("frequency", with_roles("SELECT casualty_type, count(*) AS n FROM casualty GROUP BY 1", "casualty"))
def _(spark, d):
    return breakdown.frequency(casualty(spark, d), "casualty_type")


@add("dimensions", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(spark, d):
    return breakdown.dimensions(table(spark, d, "lineitem"))


# --- time patterns ------------------------------------------------------------


@add(
    "weekday_hour",
    with_roles(
        "SELECT dayname(date) AS weekday, CAST(substr(time, 1, 2) AS INT) AS hour, count(*) AS n, 'weekday_hour' AS grouping "
        "FROM collision GROUP BY 1, 2 UNION ALL SELECT dayname(date), NULL, count(*), 'weekday' FROM collision GROUP BY 1 "
        "UNION ALL SELECT NULL, CAST(substr(time, 1, 2) AS INT), count(*), 'hour' FROM collision GROUP BY 2",
        "collision",
    ),
)
def _(spark, d):
    return breakdown.by_weekday_and_hour(collision(spark, d))


@add(
    "monthly_rounded",
    with_roles(
        ", b AS (SELECT CAST(CASE WHEN date - date_trunc('month', date)::DATE < (date_trunc('month', date) + INTERVAL 1 MONTH)::DATE - date "
        "THEN date_trunc('month', date) ELSE date_trunc('month', date) + INTERVAL 1 MONTH END AS DATE) AS date_month, "
        "count(*) AS n FROM collision GROUP BY 1) SELECT date_month, n FROM b "
        "WHERE date_month > (SELECT min(date_month) FROM b) AND date_month < (SELECT max(date_month) FROM b)",
        "collision",
    ),
)
def _(spark, d):
    return breakdown.monthly_rounded(collision(spark, d))


# --- shares and summaries -----------------------------------------------------

_GROUP_SQL = (
    "CASE WHEN regexp_matches(vehicle_type, '(?i)motorcycle') THEN 'Motorbike' WHEN regexp_matches(vehicle_type, '(?i)car') "
    "THEN 'Car' WHEN regexp_matches(vehicle_type, '(?i)bus') THEN 'Bus' WHEN regexp_matches(vehicle_type, '(?i)cycle') "
    "THEN 'Cycle' WHEN regexp_matches(vehicle_type, '(?i)goods') THEN 'Goods' ELSE 'Other' END"
)


def _typed_vehicles(spark, d):
    return (
        vehicle(spark, d)
        .join(collision(spark, d).select("collision_index", "collision_severity"), "collision_index")
        .withColumn("vehicle_type2", clean.vehicle_pattern_group(F.col("vehicle_type")))
    )


@add(
    "prop_table",
    with_roles(
        ", va AS (SELECT " + _GROUP_SQL + " AS vehicle_type2, collision_severity FROM vehicle JOIN collision USING (collision_index)) "
        "SELECT vehicle_type2, collision_severity, round(count(*) / CAST((SELECT count(*) FROM va) AS DOUBLE), 6) AS share "
        "FROM va GROUP BY 1, 2",
        "vehicle",
        "collision",
    ),
)
def _(spark, d):
    return _rounded(breakdown.proportions(_typed_vehicles(spark, d), "vehicle_type2", "collision_severity"), "share")


@add(
    "share_within",
    with_roles(
        "SELECT urban_or_rural_area, collision_severity, CAST(sum(number_of_casualties) AS BIGINT) AS value, "
        "round(sum(number_of_casualties) / CAST(sum(sum(number_of_casualties)) OVER (PARTITION BY urban_or_rural_area) AS DOUBLE) * 100, 6) AS pc "
        "FROM collision GROUP BY 1, 2",
        "collision",
    ),
)
def _(spark, d):
    return _rounded(
        breakdown.share_within(
            collision(spark, d), "urban_or_rural_area", "collision_severity", F.col("number_of_casualties")
        ),
        "pc",
    )


@add(
    "share_total",
    with_roles(
        "SELECT road_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS pc "
        "FROM collision GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    return _rounded(breakdown.share_total(collision(spark, d), "road_type"), "pc")


@add(
    "ratio_by_flag",
    "SELECT c_acctbal > 500 AS flag, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) / "
    "CAST(count(*) AS DOUBLE), 6) AS ratio FROM customer GROUP BY 1",
)
def _(spark, d):
    building = F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    ratios = breakdown.ratio_by_flag(table(spark, d, "customer"), F.col("c_acctbal") > 500, building, F.lit(1))
    return _rounded(ratios, "ratio")


@add(
    "top_ratio",
    ("SELECT l_suppkey, pc FROM (SELECT *, rank() OVER (ORDER BY pc DESC) AS r FROM (SELECT l_suppkey, "
     "round(count(*) FILTER (l_returnflag = 'A') / CAST(count(*) AS DOUBLE), 3) AS pc FROM lineitem GROUP BY 1)) WHERE r <= 3"),
)
def _(spark, d):
    fatal = F.count(F.when(F.col("l_returnflag") == "A", 1))
    ratios = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(fatal / F.count("*"), 3).alias("pc"))
    return breakdown.top_with_ties(ratios, "pc", 3)


@add(
    "above_median",
    "SELECT p_partkey, p_size FROM part WHERE p_size > (SELECT quantile_cont(p_size, 0.5) FROM part)",
)
def _(spark, d):
    return breakdown.above_median(table(spark, d, "part").select("p_partkey", "p_size"), "p_size")


@add(
    "summary_stats",
    with_roles(
        "SELECT CAST(min(e) AS DOUBLE) AS min, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, "
        "quantile_cont(e, 0.75) AS q3, CAST(max(e) AS DOUBLE) AS max, round(avg(e), 6) AS mean, "
        "count(*) FILTER (e IS NULL) AS n_missing FROM (SELECT CASE WHEN engine_capacity_cc BETWEEN 300 AND 5000 "
        "THEN engine_capacity_cc END AS e FROM vehicle)",
        "vehicle",
    ),
)
def _(spark, d):
    cc = clean.null_outliers(F.col("engine_capacity_cc"), 300, 5000)
    return _rounded(breakdown.five_numbers(vehicle(spark, d).select(cc.alias("cc")), "cc"), "mean")


@add(
    "column_profile",
    "WITH long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, p_partkey AS pos FROM part"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    ) + "), counts AS (SELECT name, value, count(*) AS n, min(pos) AS pos FROM long GROUP BY 1, 2) "
    "SELECT name, CASE name WHEN 'p_partkey' THEN 'bigint' WHEN 'p_size' THEN 'int' ELSE 'string' END AS class, "
    "count(*) AS n_unique, first(value ORDER BY pos, value) AS first_label, "
    "first(value ORDER BY n DESC, value) AS most_common_value FROM counts GROUP BY 1",
)
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return breakdown.column_profile(parts, "p_partkey")


@add(
    "make_model_year",
    with_roles(
        ", m AS (SELECT v.collision_year AS year, CASE WHEN p.p_type = 'PROMO' THEN 'Data missing or out of range' "
        "ELSE upper(p.p_brand) || ' ' || p.p_type END AS model FROM vehicle v JOIN part p ON v.l_partkey = p.p_partkey), "
        "c AS (SELECT year, model, count(*) AS n, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, model) AS r "
        "FROM m GROUP BY 1, 2) "
        "SELECT year, count(*) AS n_make_model, CAST(round_even(sum(CASE WHEN regexp_matches(model, 'missing') THEN n ELSE 0 END) "
        "/ CAST(sum(n) AS DOUBLE) * 100, 0) AS BIGINT) AS percent_na, "
        "string_agg(model, ', ' ORDER BY r) FILTER (r BETWEEN 2 AND 6) AS top_5_make_model FROM c GROUP BY 1",
        "vehicle",
    ),
)
def _(spark, d):
    parts = table(spark, d, "part")
    model = F.when(F.col("p_type") == "PROMO", "Data missing or out of range").otherwise(
        F.concat_ws(" ", F.upper("p_brand"), "p_type")
    )
    named = vehicle(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("model", model)
    return breakdown.make_model_by_year(named, "collision_year", "model")


@add(
    "regex_group",
    with_roles(f"SELECT {_GROUP_SQL} AS vehicle_type2, vehicle_type, count(*) AS n FROM vehicle GROUP BY 1, 2", "vehicle"),
)
def _(spark, d):
    return (
        vehicle(spark, d)
        .groupBy(clean.vehicle_pattern_group(F.col("vehicle_type")).alias("vehicle_type2"), "vehicle_type")
        .agg(F.count("*").alias("n"))
    )


_LOOKUP_SQL = (
    "(VALUES "
    + ", ".join(f"('{kind}', '{group}')" for kind, group in clean.VEHICLE_GROUPS)
    + ") AS g(vehicle_type, summary_group)"
)


@add(
    "group_lookup",
    with_roles(
        f"SELECT v.vehicle_type, g.summary_group, count(*) AS n FROM vehicle v LEFT JOIN {_LOOKUP_SQL} "
        "ON v.vehicle_type = g.vehicle_type GROUP BY 1, 2",
        "vehicle",
    ),
)
def _(spark, d):
    return (
        clean.add_vehicle_group(vehicle(spark, d))
        .groupBy("vehicle_type", "summary_group")
        .agg(F.count("*").alias("n"))
    )


@add(
    "zone_density",
    with_roles(
        "SELECT zone_id, population, round((x1 - x0) * (y1 - y0), 6) AS area, "
        "round(population / ((x1 - x0) * (y1 - y0)), 6) AS density FROM zone",
        "zone",
    ),
)
def _(spark, d):
    from tarmac.operators.spatial import zone_density

    return _rounded(zone_density(zones(spark, d), "population", 1.0).drop("ring"), "area", "density")
