"""Source and sink queries.  Files go to fresh paths in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.kpi import _EVENTS_SQL, _MONTHLY_SQL
from tarmac.catalogue.roles import _VEHICLE_TYPES, casualty, collision, table, vehicle, with_roles, zones
from tarmac.model import CODE_MAP
from tarmac.operators import clean, decode, hotspots, kpi, matching
from tarmac.plans import etl
from tarmac.session import scratch_path, side_by_side
from tarmac.sources import geojson, records, tables

catalogue = Catalogue()
add = catalogue.add


def raw_collisions(spark, d):
    """Collisions as a raw file has them: coded, with untidy headers and text dates."""
    return (
        collision(spark, d)
        .withColumn("code", F.expr("CASE collision_severity WHEN 'Fatal' THEN 1 WHEN 'Serious' THEN 2 ELSE 3 END"))
        .select(
            F.col("collision_index").cast("string").alias("Collision Index"),
            F.date_format("date", "dd/MM/yyyy").alias("Date"),
            F.col("time").alias("Time"),
            F.col("longitude").alias("Longitude"),
            F.col("latitude").alias("Latitude"),
            F.col("code").alias("Collision-Severity"),
            F.col("number_of_casualties").alias("Number of Casualties"),
            F.col("number_of_vehicles").alias("Number of Vehicles"),
            F.col("collision_adjusted_severity_serious").alias("Collision Adjusted Severity (Serious)"),
            F.col("collision_adjusted_severity_slight").alias("Collision Adjusted Severity (Slight)"),
            F.col("road_type").alias("1st Road Name?"),
            F.lit(9).alias("Road Type"),
            F.lit(-1).alias("Weather Conditions"),
            F.lit(1).alias("Light Conditions"),
        )
    )


_CODES = [
    (1, "collision", "collision_severity", "1", "Fatal", None, "integer"),
    (2, "collision", "collision_severity", "2", "Serious", None, "integer"),
    (3, "collision", "collision_severity", "3", "Slight", None, "integer"),
    (4, "collision", "light_conditions", "1", "Daylight", None, "integer"),
    (5, "collision", "weather_conditions", "-1", "Data missing or out of range", None, "integer"),
]


@add(
    "typed_scan",
    with_roles(
        "SELECT CAST(collision_index AS VARCHAR) AS collision_index, date, time, datetime, longitude, latitude, "
        "CASE collision_severity WHEN 'Fatal' THEN 1 WHEN 'Serious' THEN 2 ELSE 3 END AS collision_severity, "
        "number_of_casualties, collision_adjusted_severity_serious, road_type AS first_road_name FROM collision",
        "collision",
    ),
)
def _(spark, d):
    path = scratch_path(spark, "raw-collision")
    tables.write_csv(raw_collisions(spark, d), path)
    return records.read_collisions(spark, path).select(
        "collision_index",
        "date",
        "time",
        "datetime",
        "longitude",
        "latitude",
        "collision_severity",
        "number_of_casualties",
        "collision_adjusted_severity_serious",
        "first_road_name",
    )


@add(
    "csv_round_trip",
    "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
)
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = scratch_path(spark, "part-csv")
    tables.write_csv(parts, path)
    types = {"p_partkey": T.LongType(), "p_size": T.IntegerType(), "p_retailprice": T.DoubleType()}
    return records.read_csv(spark, path, types)


@add(
    "table_sink",
    with_roles("SELECT year, collision_severity, count(*) AS n FROM collision WHERE year = 1999 GROUP BY 1, 2", "collision"),
)
def _(spark, d):
    stored = tables.materialise(
        collision(spark, d).select("collision_index", "year", "date", "collision_severity"),
        scratch_path(spark, "collision"),
        ["year"],
    )
    # only the directory of the year is read
    return stored.where(F.col("year") == 1999).groupBy("year", "collision_severity").agg(F.count("*").alias("n"))


@add(
    "page_export",
    with_roles(
        "SELECT date, latitude, longitude, collision_severity, casualties FROM (SELECT *, CAST(floor(latitude * 2) AS BIGINT) AS gx, "
        "CAST(floor(longitude * 2) AS BIGINT) AS gy FROM geo_events) WHERE gx = 103 AND gy = -7 "
        "ORDER BY casualties, date, year, month_num, latitude, longitude, collision_severity, vehicles, weather_conditions, light_conditions, road_type LIMIT 10",
        "collision",
        geo_events=_EVENTS_SQL,
    ),
)
def _(spark, d):
    page = hotspots.cell_page(
        hotspots.geo_events(collision(spark, d)), 2, F.lit(True), "103_-7", "casualties", limit=10,
        columns=["date", "latitude", "longitude", "collision_severity", "casualties"],
    )
    path = scratch_path(spark, "page")
    tables.write_csv(page, path)
    return spark.read.schema(page.schema).option("header", True).csv(path)


_FILE_OF = "'dft-road-casualty-statistics-' || kind || '-' || CAST(y AS VARCHAR) || '.csv'"


@add(
    "file_select",
    "SELECT name, count(*) AS n FROM (SELECT year(o_orderdate) + 22 AS y, kind, " + _FILE_OF + " AS name FROM orders, "
    "(VALUES ('collision'), ('casualty'), ('vehicle')) AS k(kind)) WHERE y = 2021 AND kind = 'casualty' GROUP BY 1",
)
def _(spark, d):
    # each order belongs to one file per kind; the selection keeps those of one file
    kinds = F.explode(F.array(*[F.lit(k) for k in records.KINDS]))
    listing = (
        table(spark, d, "orders")
        .select((F.year("o_orderdate") + 22).cast("string").alias("y"), kinds.alias("kind"))
        .select(F.concat(F.lit(records.FILE_STEM + "-"), "kind", F.lit("-"), "y", F.lit(".csv")).alias("name"))
    )
    chosen = listing.groupBy("name").agg(F.count("*").alias("n"))
    return chosen.where(records.file_filter(F.col("name"), 2021, "cas"))


@add(
    "schema_diff",
    "WITH o AS (SELECT * FROM (VALUES ('orderkey'), ('custkey'), ('orderstatus'), ('totalprice'), ('orderdate'), ('orderpriority')) t(column_name)), "
    "l AS (SELECT * FROM (VALUES ('orderkey'), ('partkey'), ('suppkey'), ('linenumber'), ('quantity'), ('extendedprice'), ('discount'), ('tax'), "
    "('returnflag'), ('linestatus'), ('shipdate')) t(column_name)), "
    "no AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS n FROM orders), nl AS (SELECT count(*) FILTER (l_orderkey IS NULL) AS n FROM lineitem) "
    "SELECT coalesce(o.column_name, l.column_name) AS column_name, CASE WHEN o.column_name IS NOT NULL THEN (SELECT n FROM no) END AS old_missing, "
    "CASE WHEN l.column_name IS NOT NULL THEN (SELECT n FROM nl) END AS new_missing, "
    "CASE WHEN o.column_name IS NULL THEN 'added' WHEN l.column_name IS NULL THEN 'removed' ELSE 'kept' END AS status "
    "FROM o FULL JOIN l ON o.column_name = l.column_name",
)
def _(spark, d):
    bare = lambda df: df.toDF(*[c.split("_", 1)[1] for c in df.columns])
    return matching.schema_drift(bare(table(spark, d, "orders")), bare(table(spark, d, "lineitem")))


@add(
    "fuzzy_join",
    "WITH a AS (SELECT DISTINCT p_name AS old_name FROM part), b AS (SELECT DISTINCT substr(p_name, 2, 1) || substr(p_name, 1, 1) || "
    "substr(p_name, 3) || CASE WHEN p_size % 2 = 1 THEN 's' ELSE '_retired' END AS new_name FROM part) "
    "SELECT old_name, new_name, CAST(damerau_levenshtein(old_name, new_name) AS INT) AS distance FROM a FULL JOIN b "
    "ON damerau_levenshtein(old_name, new_name) <= 2",
)
def _(spark, d):
    parts = table(spark, d, "part")
    swapped = F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.expr("substr(p_name, 3)"))
    ending = F.when(F.col("p_size") % 2 == 1, "s").otherwise("_retired")
    old = parts.select(F.col("p_name").alias("old_name")).distinct()
    new = parts.select(F.concat(swapped, ending).alias("new_name")).distinct()
    return matching.fuzzy_full_join(old, new, "old_name", "new_name")


@add(
    "geojson_zones",
    with_roles("SELECT zone_id, population, 4 AS corners, x0 AS first_x, y1 AS third_y FROM zone", "zone"),
)
def _(spark, d):
    features = geojson.polygon_features(zones(spark, d), ["zone_id", "population"])
    path = scratch_path(spark, "zones")
    geojson.write_features(features, path)
    properties = T.StructType([T.StructField("zone_id", T.IntegerType()), T.StructField("population", T.DoubleType())])
    back = geojson.parse_features(spark.read.text(path).toDF("feature"), "Polygon", properties)
    ring = F.col("rings")[0]
    return back.select(
        "zone_id",
        "population",
        F.size(ring).alias("corners"),
        ring[0]["x"].alias("first_x"),
        ring[2]["y"].alias("third_y"),
    )


@add(
    "etl_run",
    with_roles(
        "SELECT * FROM kpi_monthly",
        "collision",
        located="SELECT * FROM collision WHERE latitude IS NOT NULL AND year BETWEEN 2000 AND 2024",
        kpi_monthly=_MONTHLY_SQL.replace("FROM collision", "FROM located"),
    ),
)
def _(spark, d):
    raw = scratch_path(spark, "raw")
    tables.write_csv(raw_collisions(spark, d), raw)
    result = etl.run(spark, {"collision": raw}, spark.createDataFrame(_CODES, CODE_MAP), scratch_path(spark, "etl"))
    return result["kpi_monthly"]


@add(
    "cached_overview",
    with_roles(
        "SELECT CAST(sum(fatal + serious) AS BIGINT) AS total_collisions, "
        "CAST(sum(fatal_casualties + serious_casualties) AS BIGINT) AS total_casualties, "
        "CAST(sum(fatal_vehicles + serious_vehicles) AS BIGINT) AS total_vehicles FROM kpi_monthly WHERE year = 1999",
        "collision",
        kpi_monthly=_MONTHLY_SQL,
    ),
)
def _(spark, d):
    monthly = tables.materialise(kpi.kpi_monthly(collision(spark, d)), scratch_path(spark, "kpi-monthly"))
    return kpi.kpi_year(monthly, 1999, ["Fatal", "Serious"])



# --- the whole run on three raw files -----------------------------------------


_LABELS = {
    ("vehicle", "vehicle_type"): _VEHICLE_TYPES,
    ("casualty", "casualty_class"): ("Driver or rider", "Passenger", "Pedestrian"),
    ("casualty", "casualty_severity"): ("Fatal", "Serious", "Slight"),
}
_ALL_CODES = _CODES + [
    (100 * k + i, kind, variable, str(i), label, None, "integer")
    for k, ((kind, variable), labels) in enumerate(_LABELS.items(), 1)
    for i, label in enumerate(labels, 1)
]


def _built(spark, d):
    """All tables of the cleaning run over the given tables as raw, coded CSV files."""
    raw = scratch_path(spark, "raw")
    coded = lambda kind, c: F.array_position(F.array(*map(F.lit, _LABELS[kind, c])), F.col(c)) if (kind, c) in _LABELS else F.col(c)
    headers = {
        "collision_index": "Collision Index", "vehicle_reference": "Vehicle Reference", "vehicle_type": "Vehicle Type",
        "engine_capacity_cc": "Engine Capacity (CC)", "casualty_class": "Casualty Class", "casualty_severity": "Casualty Severity",
    }
    sources = {
        "vehicle": (vehicle(spark, d), ["collision_index", "vehicle_reference", "vehicle_type", "engine_capacity_cc"]),
        "casualty": (casualty(spark, d), ["collision_index", "vehicle_reference", "casualty_class", "casualty_severity"]),
    }
    with side_by_side(spark, 3) as start:
        start(tables.write_csv, raw_collisions(spark, d), f"{raw}/collision")
        for kind, (df, columns) in sources.items():
            start(tables.write_csv, df.select(*[coded(kind, c).alias(headers[c]) for c in columns]), f"{raw}/{kind}")
    files = {kind: f"{raw}/{kind}" for kind in ("collision", "vehicle", "casualty")}
    return etl.run(spark, files, spark.createDataFrame(_ALL_CODES, CODE_MAP), scratch_path(spark, "etl"))


_KEPT = "SELECT * FROM collision WHERE latitude IS NOT NULL AND year BETWEEN 2000 AND 2024"


@add(
    "etl_vehicles",
    with_roles(
        "SELECT CAST(collision_index AS VARCHAR) AS collision_index, CAST(vehicle_reference AS VARCHAR) AS vehicle_reference, vehicle_type, "
        "CAST(engine_capacity_cc AS VARCHAR) AS engine_capacity_cc FROM vehicle WHERE collision_index IN (SELECT collision_index FROM kept)",
        "vehicle",
        "collision",
        kept=_KEPT,
    ),
)
def _(spark, d):
    return _built(spark, d)["vehicle"].select(
        "collision_index", F.col("vehicle_reference").cast("string").alias("vehicle_reference"), "vehicle_type",
        F.col("engine_capacity_cc").cast("string").alias("engine_capacity_cc"),
    )


@add(
    "etl_casualties",
    with_roles(
        "SELECT CAST(collision_index AS VARCHAR) AS collision_index, CAST(vehicle_reference AS VARCHAR) AS vehicle_reference, casualty_class, "
        "casualty_severity FROM casualty WHERE collision_index IN (SELECT collision_index FROM kept)",
        "casualty",
        "collision",
        kept=_KEPT,
    ),
)
def _(spark, d):
    return _built(spark, d)["casualty"].select(
        "collision_index", F.col("vehicle_reference").cast("string").alias("vehicle_reference"), "casualty_class", "casualty_severity"
    )


@add(
    "etl_master",
    with_roles(
        "SELECT CAST(k.collision_index AS VARCHAR) AS collision_index, k.collision_severity, c.casualty_class, c.casualty_severity, v.vehicle_type "
        "FROM casualty c JOIN kept k USING (collision_index) LEFT JOIN vehicle v USING (collision_index, vehicle_reference)",
        "casualty",
        "vehicle",
        "collision",
        kept=_KEPT,
    ),
)
def _(spark, d):
    return _built(spark, d)["master"].select("collision_index", "collision_severity", "casualty_class", "casualty_severity", "vehicle_type")


@add(
    "etl_dropped",
    with_roles(
        "SELECT 'collision' AS table_name, 'outside_years' AS reason, count(*) FILTER (WHERE year NOT BETWEEN 2000 AND 2024) AS n FROM collision "
        "UNION ALL SELECT 'collision', 'without_position', count(*) FROM collision WHERE year BETWEEN 2000 AND 2024 AND (latitude IS NULL OR longitude IS NULL) "
        "UNION ALL SELECT 'vehicle', 'orphans', count(*) FROM vehicle WHERE collision_index NOT IN (SELECT collision_index FROM kept) "
        "UNION ALL SELECT 'casualty', 'orphans', count(*) FROM casualty WHERE collision_index NOT IN (SELECT collision_index FROM kept) "
        "UNION ALL SELECT k, 'outside_years', 0 FROM (VALUES ('vehicle'), ('casualty')) AS v(k)",
        "casualty",
        "vehicle",
        "collision",
        kept=_KEPT,
    ),
)
def _(spark, d):
    dropped = _built(spark, d).dropped
    rows = [(name, reason, n) for name, reasons in dropped.items() for reason, n in reasons.items()]
    return spark.createDataFrame(rows, "table_name string, reason string, n bigint")


# --- readers ------------------------------------------------------------------


@add(
    "typed_scan_guessed",
    "SELECT CAST(p_partkey AS INT) AS number, p_partkey * 10000000000 AS big, p_retailprice AS price, p_size > 25 AS flag, "
    "DATE '1990-01-01' + CAST(p_partkey AS INT) AS day, CAST(DATE '1990-01-01' + CAST(p_partkey AS INT) AS TIMESTAMP) + INTERVAL 90 SECOND AS moment, "
    "lpad(CAST(p_size AS VARCHAR), 3, '0') AS code, CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS odd, "
    "'09:15' AS hour, CAST(NULL AS BOOLEAN) AS nothing, p_name AS name FROM part",
)
def _(spark, d):
    parts = table(spark, d, "part")
    day = F.expr("date_add(DATE'1990-01-01', CAST(p_partkey AS INT))")
    last = parts.agg(F.max("p_partkey")).first()[0]  # the odd value is in the last row only
    raw = parts.select(
        F.col("p_partkey").alias("number"), (F.col("p_partkey") * 10000000000).alias("big"), F.col("p_retailprice").alias("price"),
        F.upper((F.col("p_size") > 25).cast("string")).alias("flag"), day.alias("day"),
        F.concat(day.cast("string"), F.lit("T00:01:30")).alias("moment"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("code"),
        F.when(F.col("p_partkey") == last, "n/a").otherwise(F.col("p_size").cast("string")).alias("odd"), F.lit("09:15").alias("hour"),
        F.lit(None).cast("string").alias("nothing"), F.col("p_name").alias("name"),
    )
    path = scratch_path(spark, "guessed")
    tables.write_csv(raw, path)
    return records.read_csv(spark, path, {}, guess=True)


@add(
    "get_records",
    with_roles(
        "SELECT CAST(collision_index AS VARCHAR) AS collision_index, datetime, longitude, latitude, number_of_vehicles FROM collision",
        "collision",
    ),
)
def _(spark, d):
    folder, name = scratch_path(spark, "records"), "dft-road-casualty-statistics-collision-2020.csv"
    tables.write_csv(raw_collisions(spark, d), f"{folder}/{name}")
    df = records.get_records(spark, folder, 2020, "accidents", spark.createDataFrame(_CODES, CODE_MAP), available=[name])
    return df.select("collision_index", "datetime", "longitude", "latitude", "number_of_vehicles")


@add("code_map_file", with_roles("SELECT collision_index, collision_severity FROM collision", "collision"))
def _(spark, d):
    path = scratch_path(spark, "codes")
    codes = spark.createDataFrame(_CODES, CODE_MAP)
    tables.write_csv(codes.coalesce(1).drop("ord"), path)
    code = F.expr("CASE collision_severity WHEN 'Fatal' THEN 1 WHEN 'Serious' THEN 2 ELSE 3 END")
    coded = collision(spark, d).select("collision_index", code.alias("collision_severity"))
    return decode.decode_labels(coded, records.read_code_map(spark, path), "collision", ["collision_severity"])


@add(
    "numeric_coordinates",
    with_roles(
        "SELECT collision_index, CASE WHEN collision_index % 7 = 0 THEN NULL ELSE longitude END AS longitude, latitude FROM collision",
        "collision",
    ),
)
def _(spark, d):
    text = F.when(F.col("collision_index") % 7 == 0, "unknown").otherwise(F.col("longitude").cast("string"))
    return clean.force_numeric_coordinates(
        collision(spark, d).select("collision_index", text.alias("longitude"), F.col("latitude").cast("string").alias("latitude"))
    )
