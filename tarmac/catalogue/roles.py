"""The driver's tables in the roles of the collision data.

The given tables hold orders, order lines and events, so each collision column
is a stated expression over one of them.  The same expression text is used by
Spark (``selectExpr``) and inside the SQL counterparts, which keeps both sides
on identical inputs; everything computed from the roles is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- declared layouts (reading them needs no footer inference job) ------------

_I, _L, _D, _S, _TS = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _layout(spec: str) -> T.StructType:
    kinds = {"i": _I, "l": _L, "d": _D, "s": _S, "t": _TS}
    pairs = [item.split(":") for item in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


LAYOUTS = {
    "region": _layout("r_regionkey:i r_name:s"),
    "nation": _layout("n_nationkey:i n_name:s n_regionkey:i"),
    "customer": _layout("c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s"),
    "supplier": _layout("s_suppkey:l s_name:s s_nationkey:i s_acctbal:d"),
    "part": _layout("p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d"),
    "orders": _layout("o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s"),
    "lineitem": _layout(
        "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d "
        "l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t"
    ),
    "events": _layout("event_id:l ts:t user_id:l event_type:s value:d props:s"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(expression: str, *labels: str) -> str:
    """CASE that turns 0, 1, 2 ... into labels."""
    arms = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE CAST({expression} AS INT) {arms} END"


_HOUR = "(o_orderkey * 5 + o_custkey) % 24"
_MINUTE = "o_custkey % 60"
_NO_PLACE = "o_orderpriority = '4-NOT SPECIFIED'"

# a collision record per order; orders of unspecified priority have no position
COLLISION = (
    "o_orderkey AS collision_index",
    "CAST(o_orderdate AS DATE) AS date",
    f"LPAD(CAST({_HOUR} AS STRING), 2, '0') || ':' || LPAD(CAST({_MINUTE} AS STRING), 2, '0') AS time",
    "CAST(YEAR(o_orderdate) AS INT) AS year",
    "CAST(MONTH(o_orderdate) AS INT) AS month_num",
    _pick(
        "MONTH(o_orderdate) - 1", "January", "February", "March", "April", "May", "June", "July", "August",
        "September", "October", "November", "December",
    )
    + " AS month",
    "CASE o_orderstatus WHEN 'F' THEN 'Fatal' WHEN 'O' THEN 'Serious' WHEN 'P' THEN 'Slight' END AS collision_severity",
    "CAST(1 + o_orderkey % 4 AS INT) AS number_of_casualties",
    "CAST(1 + o_custkey % 3 AS INT) AS number_of_vehicles",
    "CAST(o_custkey % 64 AS DOUBLE) / CAST(64 AS DOUBLE) AS collision_adjusted_severity_serious",
    "CAST(64 - o_custkey % 64 AS DOUBLE) / CAST(64 AS DOUBLE) AS collision_adjusted_severity_slight",
    "o_orderpriority AS road_type",
    _pick(
        "o_custkey % 6", "Fine no high winds", "Raining no high winds", "Raining + high winds", "Fine + high winds",
        "Snowing", "Fog or mist",
    )
    + " AS weather_conditions",
    _pick(
        "(o_custkey + o_orderkey) % 4", "Daylight", "Darkness - lights lit", "Darkness - lights unlit",
        "Darkness - no lighting",
    )
    + " AS light_conditions",
    _pick("o_custkey % 5", "Dry", "Wet or damp", "Snow", "Frost or ice", "Flood") + " AS road_surface_conditions",
    _pick(
        "o_orderkey % 4", "Not at junction or within 20 metres", "Roundabout", "Crossroads", "T or staggered junction"
    )
    + " AS junction_detail",
    _pick("o_custkey % 7", "Urban", "Urban", "Urban", "Urban", "Rural", "Rural", "Unallocated")
    + " AS urban_or_rural_area",
    "CAST(20 + 10 * (o_orderkey % 6) AS INT) AS speed_limit",
    _pick("o_custkey % 6", "Motorway", "A(M)", "A", "B", "C", "Unclassified") + " AS first_road_class",
    f"CASE WHEN {_NO_PLACE} THEN NULL ELSE 50 + CAST(o_orderkey * 7 % 800 AS DOUBLE) / CAST(100 AS DOUBLE) END AS latitude",
    f"CASE WHEN {_NO_PLACE} THEN NULL ELSE -6 + CAST(o_orderkey * 13 % 700 AS DOUBLE) / CAST(100 AS DOUBLE) END AS longitude",
    f"CASE WHEN {_NO_PLACE} THEN NULL ELSE CAST(100000 + o_orderkey * 37 % 500000 AS DOUBLE) END AS location_easting_osgr",
    f"CASE WHEN {_NO_PLACE} THEN NULL ELSE CAST(50000 + o_orderkey * 91 % 900000 AS DOUBLE) END AS location_northing_osgr",
    "CAST(o_custkey % 25 AS INT) AS police_force",
)

_VEHICLE_TYPES = (
    "Pedal cycle", "Motorcycle 50cc and under", "Motorcycle over 500cc", "Car", "Taxi/Private hire car",
    "Bus or coach (17 or more pass seats)", "Minibus (8 - 16 passenger seats)", "Van / Goods 3.5 tonnes mgw or under",
    "Goods 7.5 tonnes mgw and over", "Agricultural vehicle", "Tram", "Hovercraft",
)

_VEHICLE_SOURCE = ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")

# a vehicle record per (order, line number)
VEHICLE = (
    "l_orderkey AS collision_index",
    "l_linenumber AS vehicle_reference",
    _pick(f"l_partkey % {len(_VEHICLE_TYPES)}", *_VEHICLE_TYPES) + " AS vehicle_type",
    "CAST(l_partkey * 3 % 6000 AS INT) AS engine_capacity_cc",
    "CAST(CAST(l_quantity AS INT) + l_suppkey % 60 AS INT) AS age_of_driver",
    "CAST(YEAR(l_shipdate) AS INT) AS collision_year",
    "l_partkey",
)

# a casualty record per order line
CASUALTY = (
    "l_orderkey AS collision_index",
    "l_linenumber AS vehicle_reference",
    "CAST(YEAR(l_shipdate) AS INT) AS collision_year",
    _pick("l_suppkey % 3", "Driver or rider", "Passenger", "Pedestrian") + " AS casualty_class",
    _pick("l_partkey % 5", "Pedestrian", "Cyclist", "Car occupant", "Motorcycle rider", "Bus occupant")
    + " AS casualty_type",
    "CASE WHEN l_suppkey % 10 = 0 THEN 'Data missing or out of range' WHEN l_linestatus = 'F' THEN 'Male' "
    "ELSE 'Female' END AS sex_of_casualty",
    "CAST(CAST(l_quantity AS INT) + l_partkey % 90 - 3 AS INT) AS age_of_casualty",
    "CASE l_returnflag WHEN 'A' THEN 'Fatal' WHEN 'N' THEN 'Serious' WHEN 'R' THEN 'Slight' END AS casualty_severity",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS casualty_adjusted_severity_serious",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS casualty_adjusted_severity_slight",
)

# a timed collision per event
TIMED = (
    "event_id AS collision_index",
    "ts AS datetime",
    "CASE event_type WHEN 'error' THEN 'Fatal' WHEN 'purchase' THEN 'Serious' ELSE 'Slight' END AS collision_severity",
    "event_type AS weather_conditions",
    "value AS amount",
)

# an inspection per event; the earliest clicks lack a unit, views are in km
TESTS = (
    "user_id AS vehicle",
    "DATE '2023-06-01' AS registration_date",
    "ts AS completed",
    "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'PASSED' END AS result",
    "CAST(ts AS DATE) AS expiry",
    "value AS odometer",
    "CASE event_type WHEN 'view' THEN 'km' WHEN 'signup' THEN NULL ELSE 'mi' END AS unit",
    "event_type = 'purchase' AS advisory",
)

# an axis-parallel rectangle per nation, with gaps between neighbours
ZONE_BOX = (
    "n_nationkey AS zone_id",
    "-6 + (n_nationkey % 5) * CAST(1.4 AS DOUBLE) AS x0",
    "-6 + (n_nationkey % 5) * CAST(1.4 AS DOUBLE) + CAST(1.2 AS DOUBLE) AS x1",
    "50 + FLOOR(n_nationkey / 5) * CAST(1.6 AS DOUBLE) AS y0",
    "50 + FLOOR(n_nationkey / 5) * CAST(1.6 AS DOUBLE) + CAST(1.3 AS DOUBLE) AS y1",
    "CAST(1000 + n_nationkey * 37 AS DOUBLE) AS population",
)

# a straight road per supplier on the national grid
ROAD = (
    "s_suppkey AS road_id",
    "CAST(100000 + s_suppkey * 7919 % 500000 AS DOUBLE) AS x1",
    "CAST(50000 + s_suppkey * 104729 % 900000 AS DOUBLE) AS y1",
    "CAST(100000 + s_suppkey * 7919 % 500000 + s_suppkey * 31 % 20000 AS DOUBLE) AS x2",
    "CAST(50000 + s_suppkey * 104729 % 900000 + s_suppkey * 53 % 20000 AS DOUBLE) AS y2",
)


def collision(spark: SparkSession, sf_dir: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Collisions, optionally of a span of years only.

    A stored collision table is partitioned by year.  Here the year is computed from
    the order date, so a query that filters on years states them again as a range
    on the raw column, which the Parquet reader can use to skip row groups.
    """
    df = table(spark, sf_dir, "orders")
    if first_year is not None:
        when = F.col("o_orderdate")
        df = df.where(
            (when >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
            & (when < F.lit(f"{last_year + 1}-01-01").cast("timestamp_ntz"))
        )
    df = df.selectExpr(*COLLISION)
    return df.withColumn("datetime", F.expr(_DATETIME_SPARK))


_DATETIME_SPARK = (
    "make_timestamp_ntz(year(date), month(date), day(date), int(substr(time, 1, 2)), int(substr(time, 4, 2)), 0)"
)
_DATETIME_SQL = (
    "CAST(date AS TIMESTAMP) + to_hours(CAST(substr(time, 1, 2) AS INT)) + to_minutes(CAST(substr(time, 4, 2) AS INT))"
)


def vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (collision, vehicle reference): repeats keep the least value of each
    attribute, as partial minima before the shuffle."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return lines.agg(*[F.min(c).alias(c) for c in _VEHICLE_SOURCE]).selectExpr(*VEHICLE)


def casualty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.operators.clean import add_age_group

    return add_age_group(table(spark, sf_dir, "lineitem").selectExpr(*CASUALTY))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*TIMED)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*TESTS)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = table(spark, sf_dir, "nation").selectExpr(*ZONE_BOX)
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return boxes.select("zone_id", "population", ring.alias("ring"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*ROAD)


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly series standing in for traffic: order value in whole millions."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"))
        .agg(F.round(F.sum("o_totalprice") / 1e6, 3).alias("traffic"))
    )


def _sql(columns, source: str) -> str:
    return "SELECT " + ", ".join(columns) + f" FROM {source}"


_AGE_GROUP_SQL = (
    "CASE WHEN age_of_casualty > -1 AND age_of_casualty <= 15 THEN 'Child' "
    "WHEN age_of_casualty > 15 AND age_of_casualty <= 24 THEN 'Young Adult' "
    "WHEN age_of_casualty > 24 AND age_of_casualty <= 64 THEN 'Adult' "
    "WHEN age_of_casualty > 64 AND age_of_casualty <= 120 THEN 'Senior' ELSE 'Unknown' END AS age_group"
)

_VIEWS = {
    "collision": f"SELECT *, {_DATETIME_SQL} AS datetime FROM ({_sql(COLLISION, 'orders')})",
    "vehicle": _sql(
        VEHICLE,
        "(SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"min({c}) AS {c}" for c in _VEHICLE_SOURCE)
        + " FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    ),
    "casualty": f"SELECT *, {_AGE_GROUP_SQL} FROM ({_sql(CASUALTY, 'lineitem')})",
    "timed": _sql(TIMED, "events"),
    "tests": _sql(TESTS, "events"),
    "zone": _sql(ZONE_BOX, "nation"),
    "road": _sql(ROAD, "supplier"),
    "exposure": "SELECT CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice) / 1000000.0, 3) AS traffic "
    "FROM orders GROUP BY 1",
}


def with_roles(body: str, *names: str, **extra: str) -> str:
    """SQL text with the named roles (and extra views) in front."""
    views = {n: _VIEWS[n] for n in names} | extra
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in views.items()) + " " + body
