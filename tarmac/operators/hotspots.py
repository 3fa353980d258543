"""Grid hotspots: dynamic binning, ranking, radius search and drill-down."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import EARTH_RADIUS_MILES, cell_index, haversine_miles
from tarmac.functions.severity import risk_weight
from tarmac.operators.ordering import ordered_head

# Fixed value: default centre of the radius search.
DEFAULT_CENTRE = (51.5074, -0.1278)

METRICS = ("risk_score", "casualties", "collisions")

_GEOPOINT_COLUMNS = (
    "latitude",
    "longitude",
    "year",
    "month_num",
    "collision_severity",
    "date",
    "time",
    "number_of_casualties",
    "number_of_vehicles",
    "road_type",
    "weather_conditions",
    "light_conditions",
)


def _located(collision: DataFrame) -> DataFrame:
    return collision.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def geopoints(collision: DataFrame) -> DataFrame:
    """Columns the map needs, for collisions with a position."""
    return _located(collision).select(*_GEOPOINT_COLUMNS)


def geo_events(collision: DataFrame) -> DataFrame:
    """Columns hotspot queries need, for collisions with a position."""
    return _located(collision).select(
        "latitude",
        "longitude",
        "date",
        "year",
        "month_num",
        "collision_severity",
        "weather_conditions",
        "light_conditions",
        "road_type",
        F.col("number_of_casualties").alias("casualties"),
        F.col("number_of_vehicles").alias("vehicles"),
    )


def map_points(points: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Points for the map, at most ``limit``.  The order over all shown columns
    makes the cut repeatable."""
    shown = [
        "latitude",
        "longitude",
        "collision_severity",
        "date",
        "time",
        "number_of_casualties",
        "number_of_vehicles",
    ]
    rest = [c for c in shown if c != "date"]
    return ordered_head(points.where(condition).select(*shown), F.col("date"), ["date", *rest], limit)


def binned(events: DataFrame, scale: int) -> DataFrame:
    """Events with the grid cell (gx, gy) they fall in, ``scale`` cells per degree."""
    return events.withColumns(
        {"gx": cell_index(F.col("latitude"), scale), "gy": cell_index(F.col("longitude"), scale)}
    )


def cell_summary(events: DataFrame, scale: int) -> DataFrame:
    """Per cell: identity, centroid, collisions, casualties and risk score."""
    cells = (
        binned(events, scale)
        .groupBy("gx", "gy")
        .agg(
            F.count("*").alias("collisions"),
            F.sum("casualties").alias("casualties"),
            F.sum(risk_weight(F.col("collision_severity"))).alias("risk_score"),
        )
    )
    step = F.lit(float(scale))
    return cells.select(
        F.concat_ws("_", "gx", "gy").alias("cell_id"),
        ((F.col("gx") + 0.5) / step).alias("grid_lat"),
        ((F.col("gy") + 0.5) / step).alias("grid_lon"),
        "collisions",
        "casualties",
        "risk_score",
    )


def _box(centre: tuple[float, float], radius: float, scale: int) -> Column:
    """Events that can lie in a cell within reach: ranges of both coordinates widened
    by one cell, which the scan can push down.  The exact test follows on cells."""
    latitude, longitude = centre
    angle = radius / EARTH_RADIUS_MILES
    reach = math.degrees(angle) + 1.0 / scale
    near = F.col("latitude").between(latitude - reach, latitude + reach)
    widest = math.cos(math.radians(latitude))
    if abs(latitude) + reach >= 90 or math.sin(min(angle, math.pi / 2)) >= widest:
        return near  # a pole is within reach
    across = math.degrees(math.asin(math.sin(angle) / widest)) + 1.0 / scale
    if longitude - across < -180 or longitude + across > 180:
        return near
    return near & F.col("longitude").between(longitude - across, longitude + across)


def hotspots(
    events: DataFrame,
    scale: int,
    condition: Column,
    metric: str,
    top: int,
    centre: tuple[float, float] = DEFAULT_CENTRE,
    radius_miles: float | None = None,
) -> DataFrame:
    """Highest-ranking cells, optionally only those whose centroid lies within a
    radius.  One shuffle on the cell with partial aggregation, then a top-k."""
    if metric not in METRICS:
        raise ValueError(f"rank by one of {METRICS}")
    chosen = events.where(condition)
    if radius_miles is not None:
        chosen = chosen.where(_box(centre, radius_miles, scale))
    cells = cell_summary(chosen, scale).withColumn(
        "distance_miles", haversine_miles(F.col("grid_lat"), F.col("grid_lon"), *centre)
    )
    if radius_miles is not None:
        cells = cells.where(F.col("distance_miles") <= radius_miles)
    return cells.orderBy(F.desc(metric), "cell_id").limit(top)


def decode_cell(cell_id: str) -> tuple[int, int]:
    gx, gy = cell_id.split("_")
    return int(gx), int(gy)


def decode_cells(df: DataFrame, cell_id: str = "cell_id") -> DataFrame:
    parts = F.split(cell_id, "_")
    return df.withColumns({"gx": parts[0].cast("bigint"), "gy": parts[1].cast("bigint")})


def _in_cell(events: DataFrame, scale: int, cell_id: str) -> DataFrame:
    """Rows of one cell.  The coordinate ranges let the scan skip most files; the
    exact cell test decides."""
    gx, gy = decode_cell(cell_id)
    slack = 1e-9
    near = F.col("latitude").between(gx / scale - slack, (gx + 1) / scale + slack) & F.col("longitude").between(
        gy / scale - slack, (gy + 1) / scale + slack
    )
    return binned(events.where(near), scale).where((F.col("gx") == gx) & (F.col("gy") == gy))


def cell_severities(events: DataFrame, scale: int, condition: Column, cell_id: str) -> DataFrame:
    return (
        _in_cell(events.where(condition), scale, cell_id)
        .groupBy("collision_severity")
        .agg(F.count("*").alias("collisions"), F.sum("casualties").alias("casualties"))
        .orderBy(F.desc("collisions"), "collision_severity")
    )


_PAGE_COLUMNS = (
    "date",
    "year",
    "month_num",
    "latitude",
    "longitude",
    "collision_severity",
    "casualties",
    "vehicles",
    "weather_conditions",
    "light_conditions",
    "road_type",
)


def cell_page(
    events: DataFrame,
    scale: int,
    condition: Column,
    cell_id: str,
    order_by: str,
    limit: int,
    offset: int = 0,
    columns: Sequence[str] = _PAGE_COLUMNS,
) -> DataFrame:
    """One page of a cell's raw rows.  The chosen order is completed by all columns,
    so pages never overlap or skip."""
    if order_by not in ("date", "collision_severity", "casualties"):
        raise ValueError(f"cannot order by {order_by}")
    rest = [c for c in _PAGE_COLUMNS if c != order_by]
    rows = _in_cell(events.where(condition), scale, cell_id).select(*_PAGE_COLUMNS)
    return rows.orderBy(order_by, *rest).offset(offset).limit(limit).select(*columns)


def _not_before(row: Mapping[str, object], order: Sequence[str]) -> Column:
    """Rows that are not before ``row`` in the order (missing values first); the leading column alone is a range the scan can skip by."""
    here = F.lit(True)
    for c in reversed(order):
        value = row[c]
        later = F.col(c).isNotNull() if value is None else F.col(c) > F.lit(value)
        here = F.coalesce(later, F.lit(False)) | (F.col(c).eqNullSafe(F.lit(value)) & here)
    lead = row[order[0]]
    return here if lead is None else (F.col(order[0]) >= F.lit(lead)) & here


def cell_page_after(
    events: DataFrame, scale: int, condition: Column, cell_id: str, order_by: str, limit: int, after: Row | None = None
) -> DataFrame:
    """The page of a cell's raw rows that follows ``after``, the last row of the page before (None: the first page).

    Pages are those of ``cell_page``, but a page costs the same however deep it
    lies: it starts from a position in the order instead of counting all rows
    before it.  ``copy`` numbers rows that are alike in every column, so that a page
    may end between them.
    """
    if order_by not in ("date", "collision_severity", "casualties"):
        raise ValueError(f"cannot order by {order_by}")
    order = [order_by, *[c for c in _PAGE_COLUMNS if c != order_by]]
    rows, shown = _in_cell(events.where(condition), scale, cell_id).select(*_PAGE_COLUMNS), 0
    if after is not None:
        rows, shown = rows.where(_not_before(after.asDict(), order)), after["copy"]
    alike = Window.partitionBy(*order).orderBy(F.lit(1))
    head = rows.orderBy(*order).limit(limit + shown).withColumn("copy", F.row_number().over(alike))
    if after is not None:
        again = [F.col(c).eqNullSafe(F.lit(after[c])) for c in order]
        head = head.where(~reduce(lambda a, b: a & b, again) | (F.col("copy") > shown))
    return head.orderBy(*order, "copy")


def condition_hotspots(cells_scale: int, events: DataFrame, condition: Column, metric: str, top: int) -> DataFrame:
    """Top cells under year and multi-choice conditions, ties by cell."""
    if metric not in METRICS:
        raise ValueError(f"rank by one of {METRICS}")
    return cell_summary(events.where(condition), cells_scale).orderBy(F.desc(metric), "cell_id").limit(top)


def stable_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of at most ``n`` rows: the smallest digests of
    key and seed, so partitioning does not matter."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hashed = df.withColumn("__h", digest)
    return ordered_head(hashed, F.substring("__h", 1, 3), ["__h", *key], n).drop("__h")
