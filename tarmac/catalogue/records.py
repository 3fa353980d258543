"""Cleaning, decoding, join and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.roles import casualty, collision, table, vehicle, with_roles
from tarmac.functions import dates, geo, names
from tarmac.model import CODE_MAP
from tarmac.operators import clean, decode, joins, kpi, quality

catalogue = Catalogue()
add = catalogue.add

# --- code map -----------------------------------------------------------------

# duplicate, unknown and shared codes are all present
_CODES = [
    (1, "orders", "o_orderstatus", "F", "Finished (old)", None, "character"),
    (2, "orders", "o_orderstatus", "F", "Fatal", None, "character"),
    (3, "orders", "o_orderstatus", "O", "Serious", None, "character"),
    (4, "orders", "o_orderpriority", "1-URGENT", "Single carriageway", None, "character"),
    (5, "orders", "o_orderpriority", "2-HIGH", "Dual carriageway", None, "character"),
    (6, "customer", "c_nationkey", "0", "Avon", None, "integer"),
    (7, "customer", "c_nationkey", "01", "Bedfordshire", None, "integer"),
    (8, "customer", "c_nationkey", "2.0", "Kent (old)", None, "integer"),
    (9, "customer", "c_nationkey", "2", "Kent", None, "integer"),
    (10, "customer", "c_nationkey", "-1", "Missing", None, "integer"),
    (11, "supplier", "c_nationkey", "3", "7", None, "integer"),
    (12, "supplier", "c_mktsegment", "BUILDING", "Works", None, "character"),
    (13, "customer", "c_mktsegment", "BUILDING", "Construction", None, "character"),
]


def code_map(spark):
    return spark.createDataFrame(_CODES, CODE_MAP)


@add(
    "decode_label",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'Fatal' WHEN 'O' THEN 'Serious' ELSE o_orderstatus END AS o_orderstatus, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Single carriageway' WHEN '2-HIGH' THEN 'Dual carriageway' "
    "ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(spark, d):
    decoded = decode.decode_labels(
        table(spark, d, "orders"), code_map(spark), "orders", ["o_orderstatus", "o_orderpriority"]
    )
    return decoded.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@add(
    "decode_label_numeric",
    "SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'Avon' WHEN 1 THEN 'Bedfordshire' WHEN 2 THEN 'Kent' "
    "ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return decode.decode_labels(customers, code_map(spark), "customer", ["c_nationkey", "c_mktsegment"])


@add(
    "decode_typed",
    "SELECT c_custkey, CASE WHEN c_nationkey IN (0, 1, 2) THEN NULL WHEN c_nationkey = 3 THEN 7 ELSE c_nationkey END AS c_nationkey, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'Works' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return decode.decode_typed(customers, code_map(spark), ["c_nationkey", "c_mktsegment"])


# --- names, dates, text -------------------------------------------------------


@add(
    "name_normalise",
    "SELECT raw, replace(replace(replace(replace(replace(replace(replace(lower(raw), ' ', '_'), '(', ''), ')', ''), "
    "'1st', 'first'), '2nd', 'second'), '-', '_'), '?', '') AS name, count(*) AS n "
    "FROM (SELECT '1st ' || p_name || ' 2nd-' || p_type || ' (CC)?' AS raw FROM part) GROUP BY 1",
)
def _(spark, d):
    raw = F.concat(F.lit("1st "), "p_name", F.lit(" 2nd-"), "p_type", F.lit(" (CC)?"))
    return (
        table(spark, d, "part")
        .groupBy(raw.alias("raw"))
        .agg(F.count("*").alias("n"))
        .withColumn("name", names.header_name(F.col("raw")))
    )


# a header for every rewrite, and the variable that it gives; $ stands for a type of part
_VARIABLES = [
    ("$ Null if not known", "$"), ("$ DD/MM/YYYY", "$"), ("$ HH:MM", "$"), ("Highway Authority - ONS code $", "highway_$"),
    ("Lower Super Ouput Area $", "lsoa_$"), ("$ England & Wales Only", "$"), ("$ (CC)", "$"), ("Vehicle Propulsion Code $", "propulsion_code_$"),
    ("Pedestrian Road Maintenance Worker from 2011 $", "pedestrian_road_maintenance_worker_$"), ("Engine Capacity (CC) $", "engine_capacity_cc_$"),
    ("Age of Vehicle_manufacture $", "age_of_vehicle_$"),
]


@add(
    "variable_normalise",
    "SELECT DISTINCT replace(raw, '$', p_type) AS raw, replace(variable, '$', replace(lower(p_type), ' ', '_')) AS variable FROM part, (VALUES "
    + ", ".join(f"('{raw}', '{variable}')" for raw, variable in _VARIABLES)
    + ") AS v(raw, variable)",
)
def _(spark, d):
    patterns = F.explode(F.array(*[F.lit(raw) for raw, _ in _VARIABLES])).alias("pattern")
    raw = table(spark, d, "part").select("p_type", patterns).select(F.expr("replace(pattern, '$', p_type)").alias("raw"))
    return raw.distinct().withColumn("variable", names.variable_name(F.col("raw")))


_RAW_DATES = (
    "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS good, "
    "CASE WHEN o_orderstatus = 'P' THEN '31/02/' || CAST(year(o_orderdate) AS VARCHAR) "
    "ELSE strftime(o_orderdate, '%d/%m/%Y') END AS raw_date, "
    "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN '24:00' "
    "ELSE lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS raw_time FROM orders"
)


def _raw_dates(spark, d):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string")))
        .otherwise(text)
        .alias("date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", None)
        .when(F.col("o_orderpriority") == "2-HIGH", "24:00")
        .otherwise(
            F.concat(
                F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"),
                F.lit(":"),
                F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"),
            )
        )
        .alias("time"),
    )


_PARSED = (
    "SELECT o_orderkey, CAST(try_strptime(raw_date, '%d/%m/%Y') AS DATE) AS date, raw_time AS time, "
    "try_strptime(raw_date || ' ' || raw_time, '%d/%m/%Y %H:%M') AS datetime FROM raw"
)


@add("parse_datetime", f"WITH raw AS ({_RAW_DATES}) {_PARSED}")
def _(spark, d):
    return clean.parse_dates(_raw_dates(spark, d))


@add(
    "time_features",
    f"WITH raw AS ({_RAW_DATES}), parsed AS ({_PARSED}) SELECT o_orderkey, CAST(year(datetime) AS INT) AS year, "
    "monthname(datetime) AS month, CAST(month(datetime) AS INT) AS month_num, CAST(hour(datetime) AS INT) AS hour, "
    "dayname(datetime) AS day_of_week FROM parsed",
)
def _(spark, d):
    return clean.add_time_features(clean.parse_dates(_raw_dates(spark, d))).drop("date", "time", "datetime")


@add(
    "london_time",
    with_roles(
        # a time the clocks pass twice is taken as the first pass
        "SELECT collision_index, CASE WHEN timezone('Europe/London', timezone('UTC', datetime - INTERVAL 1 HOUR)) = datetime "
        "THEN datetime - INTERVAL 1 HOUR ELSE timezone('UTC', timezone('Europe/London', datetime)) END AS datetime_utc FROM collision",
        "collision",
    ),
)
def _(spark, d):
    return clean.add_utc_datetime(collision(spark, d).select("collision_index", "datetime")).drop("datetime")


@add(
    "year_range",
    with_roles("SELECT year, count(*) AS n FROM collision WHERE year BETWEEN 2000 AND 2024 GROUP BY 1", "collision"),
)
def _(spark, d):
    return clean.keep_years(collision(spark, d)).groupBy("year").agg(F.count("*").alias("n"))


@add(
    "date_functions",
    "SELECT CAST(o_orderdate AS DATE) AS date, CAST(day(o_orderdate) AS INT) AS day, CAST(dayofyear(o_orderdate) AS INT) AS yday, "
    "CAST(month(o_orderdate) AS INT) AS month, CAST(dayofweek(o_orderdate) + 1 AS INT) AS wday, dayname(o_orderdate) AS weekday, "
    "CAST(weekofyear(o_orderdate) AS INT) AS isoweek, last_day(CAST(o_orderdate AS DATE)) AS month_end, "
    "CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n FROM orders GROUP BY ALL",
)
def _(spark, d):
    date = F.col("date")
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.count("*").alias("n"))
        .select(
            "date",
            F.dayofmonth(date).alias("day"),
            F.dayofyear(date).alias("yday"),
            F.month(date).alias("month"),
            F.dayofweek(date).alias("wday"),
            dates.day_name(date).alias("weekday"),
            F.weekofyear(date).alias("isoweek"),
            F.last_day(date).alias("month_end"),
            F.trunc(date, "month").alias("month_start"),
            "n",
        )
    )


@add(
    "string_functions",
    "SELECT p_partkey, upper(p_name) AS upper, upper(p_name[1]) || p_name[2:] AS capital, substr(p_brand, 1, 5) AS head, "
    "regexp_replace(p_brand, '#', '_') AS replaced, regexp_matches(p_type, 'ARG|PRO') AS matched, "
    "trim('  ' || p_name || ' ') AS trimmed, concat_ws('-', p_brand, p_type) AS joined FROM part",
)
def _(spark, d):
    first = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.upper("p_name").alias("upper"),
        first.alias("capital"),
        F.substring("p_brand", 1, 5).alias("head"),
        F.regexp_replace("p_brand", "#", "_").alias("replaced"),
        F.col("p_type").rlike("ARG|PRO").alias("matched"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.concat_ws("-", "p_brand", "p_type").alias("joined"),
    )


@add(
    "validate_ids",
    "SELECT c_custkey, regexp_full_match(mark, '[A-Za-z0-9]+') AS valid FROM (SELECT c_custkey, CASE WHEN c_nationkey < 5 "
    "THEN 'AB 12' WHEN c_nationkey < 10 THEN c_name ELSE 'AB12' || CAST(c_custkey AS VARCHAR) END AS mark FROM customer)",
)
def _(spark, d):
    nation = F.col("c_nationkey")
    mark = (
        F.when(nation < 5, "AB 12")
        .when(nation < 10, F.col("c_name"))
        .otherwise(F.concat(F.lit("AB12"), F.col("c_custkey").cast("string")))
    )
    return table(spark, d, "customer").select("c_custkey", clean.valid_registration(mark).alias("valid"))


# --- coordinates --------------------------------------------------------------


@add(
    "geo_points",
    with_roles("SELECT collision_index, longitude, latitude FROM collision WHERE longitude IS NOT NULL AND latitude IS NOT NULL", "collision"),
)
def _(spark, d):
    from tarmac.plans.etl import locate

    return locate(collision(spark, d).select("collision_index", "longitude", "latitude")).drop("geometry")


@add(
    "wkt_export",
    with_roles(
        "SELECT collision_index, CASE WHEN longitude IS NULL OR latitude IS NULL THEN NULL ELSE 'POINT (' || "
        "regexp_replace(CAST(CAST(longitude AS DECIMAL(18,10)) AS VARCHAR), '\\.?0+$', '') || ' ' || "
        "regexp_replace(CAST(CAST(latitude AS DECIMAL(18,10)) AS VARCHAR), '\\.?0+$', '') || ')' END AS geometry FROM collision",
        "collision",
    ),
)
def _(spark, d):
    point = geo.point_wkt(F.col("longitude"), F.col("latitude"))
    return collision(spark, d).select("collision_index", point.alias("geometry"))


@add(
    "drop_null_coords",
    with_roles(
        "SELECT count(*) FILTER (location_easting_osgr IS NULL OR location_northing_osgr IS NULL) AS removed, "
        "count(*) FILTER (location_easting_osgr IS NOT NULL AND location_northing_osgr IS NOT NULL) AS kept FROM collision",
        "collision",
    ),
)
def _(spark, d):
    return clean.count_missing_coordinates(
        collision(spark, d), "location_easting_osgr", "location_northing_osgr"
    )


@add(
    "uk_window",
    with_roles(
        "SELECT collision_index, x, y, collision_severity FROM (SELECT collision_index, collision_severity, "
        "location_easting_osgr * 1.3 AS x, location_northing_osgr * 1.4 - 100000 AS y FROM collision) "
        "WHERE x BETWEEN 64950 AND 655391 AND y BETWEEN 10235 AND 1209512",
        "collision",
    ),
)
def _(spark, d):
    moved = collision(spark, d).select(
        "collision_index",
        "collision_severity",
        (F.col("location_easting_osgr") * F.lit(1.3)).alias("easting"),
        (F.col("location_northing_osgr") * F.lit(1.4) - 100000).alias("northing"),
    )
    return clean.clip_to_uk(clean.drop_missing_coordinates(moved, "easting", "northing"), "easting", "northing")


@add(
    "bng_roundtrip",
    with_roles(
        "SELECT collision_index, location_easting_osgr AS easting, location_northing_osgr AS northing FROM collision "
        "WHERE location_easting_osgr IS NOT NULL",
        "collision",
    ),
)
def _(spark, d):
    points = clean.drop_missing_coordinates(
        collision(spark, d), "location_easting_osgr", "location_northing_osgr"
    ).select("collision_index", "location_easting_osgr", "location_northing_osgr")
    back = geo.with_grid(
        geo.with_lonlat(points, "location_easting_osgr", "location_northing_osgr"), "latitude", "longitude"
    )
    return back.select("collision_index", F.round("easting", 2).alias("easting"), F.round("northing", 2).alias("northing"))


def _bng_sql() -> str:
    """Textbook inverse projection and datum shift, written out for SQL."""
    a, b, f0 = "6377563.396e0", "6356256.909e0", "0.9996012717e0"
    series = (
        "({x} + (-1.5e0*n + 9e0/16*n**3)*sin(2*{x}) + (15e0/16*n**2 - 15e0/32*n**4)*sin(4*{x}) "
        "- 35e0/48*n**3*sin(6*{x}) + 315e0/512*n**4*sin(8*{x}))"
    )
    arc = f"{a}*{f0}/(1+n)*(1+n**2/4+n**4/64)*({series.format(x='phi')} - {series.format(x='phi0')})"
    consts = f"CAST(({a}-{b})/({a}+{b}) AS DOUBLE) AS n, radians(49) AS phi0, CAST(1-({b}*{b})/({a}*{a}) AS DOUBLE) AS e2"
    steps = [
        f"s0 AS (SELECT collision_index, location_easting_osgr - 400000 AS dx, location_northing_osgr AS nn, {consts}, "
        f"radians(49) + (location_northing_osgr + 100000) / ({a} * {f0}) AS phi FROM collision WHERE location_easting_osgr IS NOT NULL)"
    ]
    for i in range(1, 8):
        steps.append(f"s{i} AS (SELECT * REPLACE (phi + (nn + 100000 - {arc}) / ({a} * {f0}) AS phi) FROM s{i - 1})")
    steps += [
        f"c AS (SELECT *, {a}*{f0}/sqrt(1-e2*sin(phi)**2) AS nu, {a}*{f0}*(1-e2)/pow(1-e2*sin(phi)**2, 1.5e0) AS rho, tan(phi) AS t FROM s7)",
        "g AS (SELECT collision_index, phi - t/(2*rho*nu)*dx**2 + t/(24*rho*nu**3)*(5+3*t**2+(nu/rho-1)-9*t**2*(nu/rho-1))*dx**4 "
        "- t/(720*rho*nu**5)*(61+90*t**2+45*t**4)*dx**6 AS phi, "
        "radians(-2) + dx/(cos(phi)*nu) - dx**3/(cos(phi)*6*nu**3)*(nu/rho+2*t**2) + dx**5/(cos(phi)*120*nu**5)*(5+28*t**2+24*t**4) "
        "- dx**7/(cos(phi)*5040*nu**7)*(61+662*t**2+1320*t**4+720*t**6) AS lam, e2 FROM c)",
        f"x AS (SELECT collision_index, {a}/sqrt(1-e2*sin(phi)**2)*cos(phi)*cos(lam) AS x, {a}/sqrt(1-e2*sin(phi)**2)*cos(phi)*sin(lam) AS y, "
        f"{a}/sqrt(1-e2*sin(phi)**2)*(1-e2)*sin(phi) AS z FROM g)",
        "h AS (SELECT collision_index, 446.448e0 + (1-20.4894e-6)*x - radians(0.8421e0/3600)*y + radians(0.2470e0/3600)*z AS x, "
        "-125.157e0 + radians(0.8421e0/3600)*x + (1-20.4894e-6)*y - radians(0.1502e0/3600)*z AS y, "
        "542.060e0 - radians(0.2470e0/3600)*x + radians(0.1502e0/3600)*y + (1-20.4894e-6)*z AS z FROM x)",
        "w0 AS (SELECT *, sqrt(x*x+y*y) AS p, CAST(1-(6356752.3141e0/6378137.0e0)**2 AS DOUBLE) AS e2, "
        "atan2(z, sqrt(x*x+y*y)*(1-(1-(6356752.3141e0/6378137.0e0)**2))) AS phi FROM h)",
    ]
    for i in range(1, 6):
        steps.append(
            f"w{i} AS (SELECT * REPLACE (atan2(z + e2*6378137.0e0/sqrt(1-e2*sin(phi)**2)*sin(phi), p) AS phi) FROM w{i - 1})"
        )
    tail = "SELECT collision_index, round(degrees(phi), 6) AS latitude, round(degrees(atan2(y, x)), 6) AS longitude FROM w5"
    return with_roles(", " + ", ".join(steps) + " " + tail, "collision")


@add("bng_to_wgs84", _bng_sql())
def _(spark, d):
    points = clean.drop_missing_coordinates(
        collision(spark, d), "location_easting_osgr", "location_northing_osgr"
    ).select("collision_index", "location_easting_osgr", "location_northing_osgr")
    placed = geo.with_lonlat(points, "location_easting_osgr", "location_northing_osgr")
    return placed.select(
        "collision_index", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude")
    )


# --- values -------------------------------------------------------------------


@add(
    "null_outliers",
    with_roles(
        "SELECT round(count(*) FILTER (engine_capacity_cc > 5000) / CAST(count(*) AS DOUBLE), 6) AS share_too_big, "
        "round(count(*) FILTER (engine_capacity_cc < 300) / CAST(count(*) AS DOUBLE), 6) AS share_too_small FROM vehicle",
        "vehicle",
    ),
)
def _(spark, d):
    shares = clean.outlier_shares(vehicle(spark, d), "engine_capacity_cc", 300, 5000)
    return shares.select(*[F.round(c, 6).alias(c) for c in shares.columns])


@add(
    "conditional_update",
    "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 61 ELSE p_size END AS p_size, "
    "CASE p_size % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS label FROM part WHERE p_size IS NOT NULL",
)
def _(spark, d):
    parts = table(spark, d, "part").dropna(subset=["p_size"])
    return parts.select(
        "p_partkey",
        F.when(F.col("p_type") == "PROMO", 61).otherwise(F.col("p_size")).alias("p_size"),
        clean.recode_by_position(F.col("p_size") % 5, ["a", "b", "c"]).alias("label"),
    )


# --- joins --------------------------------------------------------------------

_KEPT_SQL = "SELECT * FROM collision WHERE year BETWEEN 2000 AND 2024 AND latitude IS NOT NULL AND longitude IS NOT NULL"


def _kept(spark, d):
    """Collisions after the year filter and the coordinate drop, in that order."""
    located = clean.drop_missing_coordinates(
        clean.keep_years(collision(spark, d)), "latitude", "longitude"
    )
    return located


@add(
    "fk_cascade",
    with_roles(
        "SELECT 'vehicle' AS child, count(*) AS n FROM vehicle WHERE collision_index IN (SELECT collision_index FROM kept) "
        "UNION ALL SELECT 'casualty', count(*) FROM casualty WHERE collision_index IN (SELECT collision_index FROM kept)",
        "collision",
        "vehicle",
        "casualty",
        kept=_KEPT_SQL,
    ),
)
def _(spark, d):
    parent = _kept(spark, d)
    counts = [
        joins.keep_children(child, parent).agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
        for name, child in (("vehicle", vehicle(spark, d)), ("casualty", casualty(spark, d)))
    ]
    return counts[0].unionByName(counts[1])


@add(
    "fk_orphans",
    with_roles(
        "SELECT 'vehicle' AS child, count(*) AS n_orphans FROM vehicle v LEFT JOIN kept k USING (collision_index) "
        "WHERE k.date IS NULL UNION ALL SELECT 'casualty', count(*) FROM casualty c LEFT JOIN kept k USING (collision_index) "
        "WHERE k.date IS NULL",
        "collision",
        "vehicle",
        "casualty",
        kept=_KEPT_SQL,
    ),
)
def _(spark, d):
    return quality.orphan_counts(_kept(spark, d), vehicle=vehicle(spark, d), casualty=casualty(spark, d))


@add(
    "casualty_collision",
    with_roles(
        "SELECT c.collision_index, c.vehicle_reference, c.casualty_type, c.age_of_casualty, k.date, k.road_type, k.latitude "
        "FROM casualty c LEFT JOIN kept k USING (collision_index)",
        "collision",
        "casualty",
        kept=_KEPT_SQL,
    ),
)
def _(spark, d):
    both = joins.casualty_with_collision(casualty(spark, d), _kept(spark, d))
    return both.select(
        "collision_index", "vehicle_reference", "casualty_type", "age_of_casualty", "date", "road_type", "latitude"
    )


@add(
    "master",
    with_roles(
        "SELECT c.collision_index, c.vehicle_reference, c.casualty_class, c.casualty_severity, c.collision_year, k.year, "
        "k.collision_severity, k.speed_limit, v.vehicle_type, v.engine_capacity_cc, v.collision_year AS collision_year_veh "
        "FROM casualty c LEFT JOIN kept k USING (collision_index) "
        "LEFT JOIN (SELECT * FROM vehicle WHERE vehicle_type <> 'Tram') v "
        "ON v.collision_index = c.collision_index AND v.vehicle_reference = c.vehicle_reference",
        "collision",
        "vehicle",
        "casualty",
        kept=_KEPT_SQL,
    ),
)
def _(spark, d):
    vehicles = vehicle(spark, d).where(F.col("vehicle_type") != "Tram")
    whole = joins.master(_kept(spark, d), vehicles, casualty(spark, d))
    return whole.select(
        "collision_index",
        "vehicle_reference",
        "casualty_class",
        "casualty_severity",
        "collision_year",
        "year",
        "collision_severity",
        "speed_limit",
        "vehicle_type",
        "engine_capacity_cc",
        "collision_year_veh",
    )


@add(
    "semi_region",
    with_roles(
        "SELECT casualty_type, count(*) AS n FROM casualty WHERE collision_index IN (SELECT k.collision_index FROM collision k "
        "JOIN nation ON n_nationkey = police_force JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') GROUP BY 1",
        "collision",
        "casualty",
    ),
)
def _(spark, d):
    europe = (
        table(spark, d, "nation")
        .join(table(spark, d, "region").where(F.col("r_name") == "EUROPE"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("police_force"))
    )
    crashes = joins.keep_children(collision(spark, d), europe, "police_force")
    return joins.keep_children(casualty(spark, d), crashes).groupBy("casualty_type").agg(F.count("*").alias("n"))


@add(
    "natural_join",
    with_roles(
        ", a AS (SELECT collision_index, year, CASE WHEN light_conditions = 'Daylight' THEN NULL ELSE light_conditions END AS light FROM collision), "
        "b AS (SELECT CAST(collision_year AS INT) AS year, collision_index, CASE WHEN sex_of_casualty = 'Male' THEN NULL ELSE 'Darkness - no lighting' END AS light, "
        "casualty_type FROM casualty) SELECT a.collision_index, a.year, a.light, b.casualty_type FROM a JOIN b "
        "ON a.collision_index IS NOT DISTINCT FROM b.collision_index AND a.year IS NOT DISTINCT FROM b.year AND a.light IS NOT DISTINCT FROM b.light",
        "collision",
        "casualty",
    ),
)
def _(spark, d):
    light = F.col("light_conditions")
    left = collision(spark, d).select(
        "collision_index", "year", F.when(light != "Daylight", light).alias("light")
    )
    right = casualty(spark, d).select(
        F.col("collision_year").alias("year"),
        "collision_index",
        F.when(F.col("sex_of_casualty") != "Male", "Darkness - no lighting").alias("light"),
        "casualty_type",
    )
    return joins.natural_join(left, right)


@add(
    "other_vehicle",
    with_roles(
        "SELECT c.collision_index, c.vehicle_reference, c.age_of_casualty, v.vehicle_reference AS other_vehicle_reference, "
        "v.vehicle_type AS other_vehicle_type FROM casualty c JOIN vehicle v ON v.collision_index = c.collision_index "
        "JOIN (SELECT collision_index FROM vehicle GROUP BY 1 HAVING count(*) = 2) t ON t.collision_index = c.collision_index "
        "WHERE v.vehicle_reference <> c.vehicle_reference AND c.casualty_type = 'Cyclist'",
        "vehicle",
        "casualty",
    ),
)
def _(spark, d):
    riders = (
        casualty(spark, d)
        .where(F.col("casualty_type") == "Cyclist")
        .select("collision_index", "vehicle_reference", "age_of_casualty")
    )
    return joins.other_vehicle(riders, vehicle(spark, d), ["vehicle_type"])


@add(
    "exposure_join",
    with_roles(
        "SELECT a.year, a.n, e.traffic FROM (SELECT collision_year AS year, count(*) AS n FROM casualty GROUP BY 1) a "
        "LEFT JOIN (SELECT * FROM exposure WHERE year <> 1997) e USING (year)",
        "casualty",
        "exposure",
    ),
)
def _(spark, d):
    from tarmac.catalogue.roles import exposure

    yearly = casualty(spark, d).groupBy(F.col("collision_year").alias("year")).agg(F.count("*").alias("n"))
    return joins.left_lookup(yearly, exposure(spark, d).where(F.col("year") != 1997), "year")


@add(
    "area_lookup",
    with_roles(
        "SELECT k.collision_index, n.n_name, k.collision_severity FROM collision k LEFT JOIN "
        "(SELECT * FROM nation WHERE n_nationkey < 20) n ON n.n_nationkey = k.police_force",
        "collision",
    ),
)
def _(spark, d):
    areas = (
        table(spark, d, "nation")
        .where(F.col("n_nationkey") < 20)
        .select(F.col("n_nationkey").alias("police_force"), "n_name")
    )
    joined = joins.left_lookup(collision(spark, d), areas, "police_force")
    return joined.select("collision_index", "n_name", "collision_severity")


@add(
    "first_per_key",
    "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
    "l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1",
)
def _(spark, d):
    return joins.first_per_key(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"])


@add(
    "union_years",
    with_roles(
        "SELECT year, collision_severity, count(*) AS n, CAST(NULL AS BIGINT) AS casualties FROM collision WHERE year < 1998 GROUP BY 1, 2 "
        "UNION ALL SELECT year, collision_severity, count(*), CAST(sum(number_of_casualties) AS BIGINT) FROM collision WHERE year >= 1998 GROUP BY 1, 2",
        "collision",
    ),
)
def _(spark, d):
    base = collision(spark, d)
    # every year is in one of the two: tables of the earlier years lack a column
    old = base.where(F.col("year") < 1998).groupBy("year", "collision_severity").agg(F.count("*").alias("n"))
    new = (
        base.where(F.col("year") >= 1998)
        .groupBy("collision_severity", "year")
        .agg(F.sum("number_of_casualties").alias("casualties"), F.count("*").alias("n"))
    )
    return joins.union_tables(old, new)


# --- quality ------------------------------------------------------------------


@add(
    "bad_severity",
    "SELECT o_orderpriority AS collision_severity, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('Fatal', 'Serious', 'Slight') GROUP BY 1",
)
def _(spark, d):
    # priorities are no severities, so every one must be reported
    return quality.unknown_severities(
        table(spark, d, "orders").select(F.col("o_orderpriority").alias("collision_severity"))
    )


@add(
    "bad_severity_clean",
    with_roles(
        "SELECT collision_severity, count(*) AS n FROM collision WHERE collision_severity NOT IN ('Fatal', 'Serious', 'Slight') GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    return quality.unknown_severities(collision(spark, d))


@add(
    "date_mismatch",
    "SELECT count(*) AS n_mismatch FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) <> year(o_orderdate)",
)
def _(spark, d):
    dated = (
        table(spark, d, "lineitem")
        .select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("year"))
        .join(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date")), "o_orderkey")
    )
    return quality.date_mismatches(dated)


@add(
    "coord_violations",
    with_roles(
        "SELECT count(*) AS n_violations FROM (SELECT latitude + 4 AS latitude, longitude + 2 AS longitude FROM collision) "
        "WHERE latitude < 49 OR latitude > 61 OR longitude < -8 OR longitude > 2",
        "collision",
    ),
)
def _(spark, d):
    moved = collision(spark, d).select(
        (F.col("latitude") + 4).alias("latitude"), (F.col("longitude") + 2).alias("longitude")
    )
    return quality.coordinate_violations(moved)


@add(
    "kpi_reconcile",
    with_roles(
        "SELECT year, count(*) AS raw_total, CAST(sum(CASE WHEN collision_severity IN ('Fatal', 'Serious', 'Slight') THEN 1 ELSE 0 END) AS BIGINT) AS kpi_total "
        "FROM collision GROUP BY 1",
        "collision",
    ),
)
def _(spark, d):
    facts = collision(spark, d)
    return quality.reconcile_with_monthly(facts, kpi.kpi_monthly(facts))


@add(
    "invalid_labels",
    "SELECT 'o_orderstatus' AS variable, o_orderstatus AS label, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('Finished (old)', 'Fatal', 'Serious') GROUP BY 2 "
    "UNION ALL SELECT 'o_orderpriority', CASE o_orderpriority WHEN '1-URGENT' THEN 'Single carriageway' ELSE o_orderpriority END, count(*) FROM orders "
    "WHERE o_orderpriority <> '1-URGENT' GROUP BY 2",
)
def _(spark, d):
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "Single carriageway").otherwise(F.col("o_orderpriority"))
    labelled = table(spark, d, "orders").withColumn("o_orderpriority", label)
    return quality.invalid_labels(labelled, code_map(spark), "orders", ["o_orderstatus", "o_orderpriority"])


@add(
    "null_counts",
    with_roles(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing FROM casualty"
            for c in (
                "collision_index",
                "vehicle_reference",
                "casualty_type",
                "casualty_adjusted_severity_serious",
                "casualty_adjusted_severity_slight",
            )
        ),
        "casualty",
    ),
)
def _(spark, d):
    return quality.null_counts(
        casualty(spark, d).select(
            "collision_index",
            "vehicle_reference",
            "casualty_type",
            "casualty_adjusted_severity_serious",
            "casualty_adjusted_severity_slight",
        )
    )


@add(
    "required_tables",
    "SELECT 'orders' AS table_name, TRUE AS present, count(*) AS n_rows FROM orders UNION ALL "
    "SELECT 'lineitem', TRUE, count(*) FROM lineitem UNION ALL SELECT 'contributory_factor', FALSE, NULL",
)
def _(spark, d):
    for name in ("orders", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(name)
    return quality.table_sizes(spark, ["orders", "lineitem", "contributory_factor"])
