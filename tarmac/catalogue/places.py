"""Area, road and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.roles import collision, roads, table, with_roles, zones
from tarmac.operators import network, spatial
from tarmac.session import scratch_path
from tarmac.sources import geojson

catalogue = Catalogue()
add = catalogue.add

# cell sizes: degrees for areas, metres for roads
_ZONE_CELL = 0.5
_DISTANCE = 5000.0

_INSIDE = "k.longitude BETWEEN z.x0 AND z.x1 AND k.latitude BETWEEN z.y0 AND z.y1"


def _located(spark, d):
    return collision(spark, d).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def _on_grid(spark, d):
    return (
        collision(spark, d)
        .where(F.col("location_easting_osgr").isNotNull() & F.col("location_northing_osgr").isNotNull())
        .select(
            "collision_index",
            F.col("location_easting_osgr").alias("x"),
            F.col("location_northing_osgr").alias("y"),
        )
    )


@add(
    "point_in_polygon",
    with_roles(
        f"SELECT k.collision_index, k.longitude, k.latitude FROM collision k WHERE EXISTS (SELECT 1 FROM zone z WHERE {_INSIDE})",
        "collision",
        "zone",
    ),
)
def _(spark, d):
    points = _located(spark, d).select("collision_index", "longitude", "latitude")
    return spatial.within_zones(points, zones(spark, d), "longitude", "latitude", _ZONE_CELL)


@add(
    "zone_join_left",
    with_roles(
        f"SELECT k.collision_index, z.zone_id, z.population FROM collision k LEFT JOIN zone z ON {_INSIDE} WHERE k.latitude IS NOT NULL",
        "collision",
        "zone",
    ),
)
def _(spark, d):
    points = _located(spark, d).select("collision_index", "longitude", "latitude")
    return spatial.join_zones(points, zones(spark, d), "longitude", "latitude", _ZONE_CELL, "left").select(
        "collision_index", "zone_id", "population"
    )


@add(
    "zone_join_inner",
    with_roles(
        f"SELECT k.collision_index, z.zone_id FROM collision k JOIN zone z ON {_INSIDE}",
        "collision",
        "zone",
    ),
)
def _(spark, d):
    points = _located(spark, d).select("collision_index", "longitude", "latitude")
    return spatial.join_zones(points, zones(spark, d), "longitude", "latitude", _ZONE_CELL, "inner").select(
        "collision_index", "zone_id"
    )


@add(
    "zones_with_points",
    with_roles(
        f"SELECT zone_id, population FROM zone z WHERE EXISTS (SELECT 1 FROM collision k WHERE {_INSIDE})",
        "collision",
        "zone",
    ),
)
def _(spark, d):
    return spatial.zones_with_points(zones(spark, d), _located(spark, d), "longitude", "latitude", _ZONE_CELL).drop("ring")


@add(
    "zone_count",
    with_roles(
        f"SELECT z.zone_id, z.population, count(k.collision_index) AS n FROM zone z LEFT JOIN collision k ON {_INSIDE} GROUP BY 1, 2",
        "collision",
        "zone",
    ),
)
def _(spark, d):
    return spatial.zone_counts(zones(spark, d), _located(spark, d), "longitude", "latitude", _ZONE_CELL)


# each zone with a hole in its middle and a second part beside it
_HOLED = (
    f"({_INSIDE} AND NOT (k.longitude > z.x0 + (z.x1 - z.x0) / 4 AND k.longitude < z.x1 - (z.x1 - z.x0) / 4 "
    "AND k.latitude > z.y0 + (z.y1 - z.y0) / 4 AND k.latitude < z.y1 - (z.y1 - z.y0) / 4)) "
    "OR (k.longitude BETWEEN z.x1 + 1 AND z.x1 + 2 AND k.latitude BETWEEN z.y0 AND z.y1)"
)


@add(
    "holed_zone_join",
    with_roles(f"SELECT k.collision_index, z.zone_id FROM collision k JOIN zone z ON {_HOLED}", "collision", "zone"),
)
def _(spark, d):
    box = lambda x0, y0, x1, y1: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    x0, y0, x1, y1 = F.col("ring")[0]["x"], F.col("ring")[0]["y"], F.col("ring")[2]["x"], F.col("ring")[2]["y"]
    hole = box(x0 + (x1 - x0) / 4, y0 + (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1 - (y1 - y0) / 4)
    area = F.array(F.array(box(x0, y0, x1, y1), hole), F.array(box(x1 + 1, y0, x1 + 2, y1)))
    layer = zones(spark, d).select("zone_id", "population", area.alias("area"))
    # through a file, as a real layer comes
    path = scratch_path(spark, "areas")
    geojson.write_features(geojson.area_features(layer, ["zone_id", "population"]), path)
    properties = T.StructType([T.StructField("zone_id", T.IntegerType()), T.StructField("population", T.DoubleType())])
    layer = geojson.parse_features(spark.read.text(path).toDF("feature"), "Area", properties)
    points = _located(spark, d).select("collision_index", "longitude", "latitude")
    return spatial.join_zones(points, layer, "longitude", "latitude", _ZONE_CELL, "inner").select("collision_index", "zone_id")


@add(
    "zone_mean",
    with_roles(
        f"SELECT z.zone_id, z.population, round(avg(k.speed_limit), 6) AS mean FROM zone z LEFT JOIN (SELECT * FROM collision "
        f"WHERE month_num = 5) k ON {_INSIDE} GROUP BY 1, 2",
        "collision",
        "zone",
    ),
)
def _(spark, d):
    points = _located(spark, d).where(F.col("month_num") == 5)
    means = spatial.zone_means(zones(spark, d), points, "speed_limit", "longitude", "latitude", _ZONE_CELL)
    return means.withColumn("mean", F.round("mean", 6))


# --- roads --------------------------------------------------------------------

_T = (
    "least(greatest(coalesce(((p.x - r.x1) * (r.x2 - r.x1) + (p.y - r.y1) * (r.y2 - r.y1)) / "
    "nullif((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1), 0), 0), 0), 1)"
)
_GAP2 = (
    f"(p.x - (r.x1 + {_T} * (r.x2 - r.x1))) * (p.x - (r.x1 + {_T} * (r.x2 - r.x1))) + "
    f"(p.y - (r.y1 + {_T} * (r.y2 - r.y1))) * (p.y - (r.y1 + {_T} * (r.y2 - r.y1)))"
)
_POINTS = (
    "SELECT collision_index, location_easting_osgr AS x, location_northing_osgr AS y FROM collision "
    "WHERE location_easting_osgr IS NOT NULL AND location_northing_osgr IS NOT NULL"
)


def _roads_sql(body):
    return with_roles(body, "collision", "road", point=_POINTS)


@add(
    "within_distance",
    _roads_sql(
        f"SELECT collision_index, x, y FROM point p WHERE EXISTS (SELECT 1 FROM road r WHERE {_GAP2} <= {_DISTANCE * _DISTANCE})"
    ),
)
def _(spark, d):
    return spatial.within_distance(_on_grid(spark, d), roads(spark, d), "x", "y", _DISTANCE)


@add(
    "outside_distance",
    _roads_sql(
        f"SELECT collision_index, x, y FROM point p WHERE NOT EXISTS (SELECT 1 FROM road r WHERE {_GAP2} <= {_DISTANCE * _DISTANCE})"
    ),
)
def _(spark, d):
    return spatial.outside_distance(_on_grid(spark, d), roads(spark, d), "x", "y", _DISTANCE)


# each road bends at its end and goes on to a third vertex
_BENT = (
    "SELECT road_id, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by, x2 + 8000.0 AS cx, y2 - 6000.0 AS cy FROM road"
)


def _foot(a, b):
    d = f"((b.{b}x - b.{a}x) * (b.{b}x - b.{a}x) + (b.{b}y - b.{a}y) * (b.{b}y - b.{a}y))"
    return f"(((p.x - b.{a}x) * (b.{b}x - b.{a}x) + (p.y - b.{a}y) * (b.{b}y - b.{a}y)) / nullif({d}, 0))"


def _beside(a, b):
    t = _foot(a, b)
    gap = " + ".join(f"pow(p.{c} - (b.{a}{c} + {t} * (b.{b}{c} - b.{a}{c})), 2)" for c in "xy")
    return f"({t} BETWEEN 0 AND 1 AND {gap} <= {_DISTANCE * _DISTANCE})"


@add(
    "outside_distance_flat",
    with_roles(
        f"SELECT collision_index, x, y FROM point p WHERE NOT EXISTS (SELECT 1 FROM bent b WHERE {_beside('a', 'b')} OR {_beside('b', 'c')} "
        f"OR ({_foot('a', 'b')} > 1 AND {_foot('b', 'c')} < 0 AND pow(p.x - b.bx, 2) + pow(p.y - b.by, 2) <= {_DISTANCE * _DISTANCE}))",
        "collision", "road", point=_POINTS, bent=_BENT,
    ),
)
def _(spark, d):
    at = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    lines = roads(spark, d).select("road_id", F.array(at("x1", "y1"), at("x2", "y2"), at("x2 + 8000.0D", "y2 - 6000.0D")).alias("line"))
    return spatial.outside_distance(_on_grid(spark, d), spatial.polyline_segments(lines), "x", "y", _DISTANCE, flat=True)


@add(
    "nearest_count",
    _roads_sql(
        f", near AS (SELECT p.collision_index, arg_min(r.road_id, {{'g': sqrt({_GAP2}), 'i': r.road_id}}) AS road_id "
        "FROM point p, road r GROUP BY 1) SELECT r.road_id, count(near.collision_index) AS n "
        "FROM road r LEFT JOIN near ON near.road_id = r.road_id GROUP BY 1"
    ),
)
def _(spark, d):
    return spatial.nearest_counts(_on_grid(spark, d), roads(spark, d), "x", "y", 10_000.0)


# --- network ------------------------------------------------------------------
# Roads form a binary tree: road k runs from junction k to junction k / 2, so a
# junction joins three roads however many there are.


def _network(spark, d):
    ends = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("road_id"),
        F.explode(F.array(F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 2))).alias("junction"),
    )
    per_road = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("road_id")).agg(F.count("*").alias("n"))
    counts = (
        table(spark, d, "supplier")
        .select(F.col("s_suppkey").alias("road_id"))
        .join(per_road, "road_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    return counts, ends


def _network_sql(order):
    steps = [
        "e AS (SELECT DISTINCT a.road_id AS src, b.road_id AS dst FROM ends a JOIN ends b USING (junction) WHERE a.road_id <> b.road_id)",
        "counts AS (SELECT s_suppkey AS road_id, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)",
        "r0 AS (SELECT road_id, road_id AS member FROM counts)",
    ]
    for i in range(1, order + 1):
        steps.append(
            f"r{i} AS (SELECT road_id, member FROM r{i - 1} UNION SELECT r.road_id, e.dst FROM r{i - 1} r JOIN e ON e.src = r.member)"
        )
    return (
        "WITH ends AS (SELECT s_suppkey AS road_id, s_suppkey AS junction FROM supplier UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier), "
        + ", ".join(steps)
        + f" SELECT r.road_id, round(avg(c.n), 6) AS smoothed FROM r{order} r JOIN counts c ON c.road_id = r.member GROUP BY 1"
    )


@add("khop_smooth", _network_sql(2))
def _(spark, d):
    return network.smooth(*_network(spark, d), 2).withColumn("smoothed", F.round("smoothed", 6))


@add("khop_smooth_4", _network_sql(4))
def _(spark, d):
    return network.smooth(*_network(spark, d), 4).withColumn("smoothed", F.round("smoothed", 6))


def _components_sql(order):
    """Mean of the whole component.  A road's deepest ancestor chain and the deepest road
    bound its reach; where ``order`` is less, the query has no rows."""
    return (
        "WITH counts AS (SELECT s_suppkey AS road_id, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), "
        "depth AS (SELECT CAST(max(floor(log2(s_suppkey))) AS INT) AS d FROM supplier WHERE s_suppkey > 0) "
        f"SELECT road_id, round((SELECT avg(n) FROM counts), 6) AS smoothed FROM counts, depth WHERE 2 * d + 1 <= {order}"
    )


# in so many steps every road of the tree reaches all others
@add("khop_smooth_50", _components_sql(50))
def _(spark, d):
    return network.smooth(*_network(spark, d), 50).withColumn("smoothed", F.round("smoothed", 6))


# --- layers -------------------------------------------------------------------


@add(
    "geojson_export",
    with_roles(
        "SELECT collision_index, collision_severity, longitude AS x, latitude AS y FROM collision WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
        "collision",
    ),
)
def _(spark, d):
    features = geojson.point_features(
        _located(spark, d), "longitude", "latitude", ["collision_index", "collision_severity"]
    )
    properties = T.StructType(
        [T.StructField("collision_index", T.LongType()), T.StructField("collision_severity", T.StringType())]
    )
    path = scratch_path(spark, "points")
    geojson.write_features(features, path)
    return geojson.parse_features(spark.read.text(path).toDF("feature"), "Point", properties)
