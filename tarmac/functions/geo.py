"""Geometry as column expressions: great-circle distance, text form, map
projection and planar tests.  No Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in miles.
EARTH_RADIUS_MILES = 3958.8

# Great Britain box for sanity checks (south, north, west, east).
GB_BOX = (49.0, 61.0, -8.0, 2.0)


def haversine_miles(lat: Column, lon: Column, centre_lat: float, centre_lon: float) -> Column:
    """Great-circle distance to a fixed centre, safe against rounding above 1."""
    half_lat = F.radians((lat - centre_lat) / 2)
    half_lon = F.radians((lon - centre_lon) / 2)
    chord = F.pow(F.sin(half_lat), 2) + math.cos(math.radians(centre_lat)) * F.cos(F.radians(lat)) * F.pow(
        F.sin(half_lon), 2
    )
    return F.asin(F.sqrt(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0)))) * (2 * EARTH_RADIUS_MILES)


def outside_gb(lat: Column, lon: Column) -> Column:
    south, north, west, east = GB_BOX
    return ~(lat.between(south, north) & lon.between(west, east))


def _plain_number(value: Column) -> Column:
    return F.regexp_replace(value.cast("decimal(20,10)").cast("string"), r"\.?0+$", "")


def point_wkt(x: Column, y: Column) -> Column:
    """``POINT (x y)``; NULL when a coordinate is missing."""
    return F.concat(F.lit("POINT ("), _plain_number(x), F.lit(" "), _plain_number(y), F.lit(")"))


def cell_index(value: Column, scale: float) -> Column:
    return F.floor(value * F.lit(float(scale))).cast("bigint")


# --- national grid <-> WGS84 --------------------------------------------------
# Fixed values, from the Ordnance Survey guide to coordinate systems: ellipsoids
# (semi-axes in metres), the national grid projection, and the Helmert shift
# from OSGB36 to WGS84 (metres, arc-seconds, parts per million).
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.3141)
GRID_SCALE, GRID_LAT0, GRID_LON0, GRID_E0, GRID_N0 = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0
SHIFT_T = (446.448, -125.157, 542.060)
SHIFT_R = (0.1502, 0.2470, 0.8421)
SHIFT_S = -20.4894


def _third_flattening() -> float:
    a, b = AIRY
    return (a - b) / (a + b)


def _rectifying_radius() -> float:
    """Radius of the sphere whose meridian is as long as the ellipsoid's."""
    n = _third_flattening()
    return AIRY[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _even_sines(sin2, cos2) -> tuple:
    """sin of 2x, 4x, 6x and 8x from sin and cos of 2x."""
    return sin2, 2 * sin2 * cos2, sin2 * (3 - 4 * sin2 * sin2), 4 * sin2 * cos2 * (1 - 2 * sin2 * sin2)


def _meridian_arc(lat, sin2, cos2):
    """Unscaled distance along the meridian from the equator; plain numbers or columns."""
    n = _third_flattening()
    weights = (-3 / 2 * n + 9 / 16 * n**3, 15 / 16 * n**2 - 15 / 32 * n**4, -35 / 48 * n**3, 315 / 512 * n**4)
    return (lat + sum(s * w for w, s in zip(weights, _even_sines(sin2, cos2)))) * _rectifying_radius()


def _origin_arc() -> float:
    lat0 = math.radians(GRID_LAT0)
    return _meridian_arc(lat0, math.sin(2 * lat0), math.cos(2 * lat0))


def _footpoint(mu: Column, sin2: Column, cos2: Column) -> Column:
    """Latitude whose meridian distance belongs to the rectifying latitude ``mu``.

    A series instead of the usual iteration, and few function calls: the code
    generated for all steps together must stay small enough to be compiled.
    """
    n = _third_flattening()
    weights = (3 / 2 * n - 27 / 32 * n**3, 21 / 16 * n**2 - 55 / 32 * n**4, 151 / 96 * n**3, 1097 / 512 * n**4)
    return mu + sum(s * w for w, s in zip(weights, _even_sines(sin2, cos2)))


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    """One projection step; steps keep shared sub-expressions computed once."""
    return df.withColumns({f"__{name}": col for name, col in columns.items()})


def _c(name: str) -> Column:
    return F.col(f"__{name}")


def _curvature(df: DataFrame) -> DataFrame:
    """Trigonometry and radii of curvature at ``__lat`` on the Airy ellipsoid."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    df = _stage(df, sin=F.sin(_c("lat")), cos=F.cos(_c("lat")))
    df = _stage(df, tan=_c("sin") / _c("cos"), w=1 - e2 * _c("sin") * _c("sin"))
    df = _stage(df, t2=_c("tan") * _c("tan"), nu=a * GRID_SCALE / F.sqrt(_c("w")))
    # ratio of the radii across and along the meridian
    return _stage(df, ratio=_c("w") / (1 - e2))


def _rotation(direction: int) -> tuple[list[list[float]], list[float]]:
    """Linear part and translation of the datum shift; the way back is its inverse."""
    rx, ry, rz = (math.radians(r / 3600) for r in SHIFT_R)
    k = 1 + SHIFT_S * 1e-6
    m = [[k, -rz, ry], [rz, k, -rx], [-ry, rx, k]]
    t = list(SHIFT_T)
    if direction > 0:
        return m, t
    det = sum(
        m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3)
    )
    inv = [
        [
            (m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3])
            / det
            for j in range(3)
        ]
        for i in range(3)
    ]
    return inv, [-sum(inv[i][j] * t[j] for j in range(3)) for i in range(3)]


def _change_datum(df: DataFrame, source: tuple, target: tuple, direction: int) -> DataFrame:
    """Move ``__lat``, ``__lon`` (radians, height 0) between ellipsoids."""
    a, b = source
    e2 = 1 - (b / a) ** 2
    df = _stage(df, sin=F.sin(_c("lat")), cos=F.cos(_c("lat")))
    df = _stage(df, r=a / F.sqrt(1 - e2 * _c("sin") * _c("sin")))
    df = _stage(
        df,
        x=_c("r") * _c("cos") * F.cos(_c("lon")),
        y=_c("r") * _c("cos") * F.sin(_c("lon")),
        z=_c("r") * (1 - e2) * _c("sin"),
    )
    m, t = _rotation(direction)
    df = _stage(
        df, **{n: m[i][0] * _c("x") + m[i][1] * _c("y") + m[i][2] * _c("z") + t[i] for i, n in enumerate(("x2", "y2", "z2"))}
    )
    a, b = target
    e2, second = 1 - (b / a) ** 2, (a / b) ** 2 - 1
    df = _stage(df, p=F.sqrt(_c("x2") * _c("x2") + _c("y2") * _c("y2")), lon=F.atan2(_c("y2"), _c("x2")))
    # Bowring's closed form; its error on the ground is far below a millimetre
    df = _stage(df, tan=_c("z2") * (a / b) / _c("p"))
    df = _stage(df, cos=1 / F.sqrt(1 + _c("tan") * _c("tan")))
    df = _stage(df, sin=_c("tan") * _c("cos"))
    return _stage(
        df,
        lat=F.atan2(
            _c("z2") + second * b * _c("sin") * _c("sin") * _c("sin"),
            _c("p") - e2 * a * _c("cos") * _c("cos") * _c("cos"),
        ),
    )


def with_lonlat(df: DataFrame, easting: str, northing: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add WGS84 coordinates computed from national grid ones."""
    kept = [c for c in df.columns if c not in (lat, lon)]
    north = F.col(northing).cast("double") - GRID_N0
    df = _stage(df, mu=(north / GRID_SCALE + _origin_arc()) / _rectifying_radius())
    df = _stage(df, s=F.sin(2 * _c("mu")), c=F.cos(2 * _c("mu")))
    df = _curvature(_stage(df, lat=_footpoint(_c("mu"), _c("s"), _c("c"))))
    df = _stage(df, d=(F.col(easting).cast("double") - GRID_E0) / _c("nu"))
    df = _stage(df, q=_c("d") * _c("d"))
    t2, ratio, d, q = _c("t2"), _c("ratio"), _c("d"), _c("q")
    eta2 = ratio - 1
    df = _stage(
        df,
        lat=_c("lat")
        - _c("tan") * ratio / 2 * q * (1 - q / 12 * ((5 + 3 * t2 + eta2 - 9 * t2 * eta2) - q / 30 * (61 + (90 + 45 * t2) * t2))),
        lon=math.radians(GRID_LON0)
        + d / _c("cos")
        * (1 - q / 6 * ((ratio + 2 * t2) - q / 20 * ((5 + (28 + 24 * t2) * t2) - q / 42 * (61 + (662 + (1320 + 720 * t2) * t2) * t2)))),
    )
    df = _change_datum(df, AIRY, WGS84, +1)
    return df.select(*kept, F.degrees(_c("lat")).alias(lat), F.degrees(_c("lon")).alias(lon))


def with_grid(df: DataFrame, lat: str, lon: str, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add national grid coordinates computed from WGS84 ones."""
    kept = [c for c in df.columns if c not in (easting, northing)]
    df = _stage(df, lat=F.radians(F.col(lat)), lon=F.radians(F.col(lon)))
    df = _curvature(_change_datum(df, WGS84, AIRY, -1))
    df = _stage(df, d=_c("cos") * (_c("lon") - math.radians(GRID_LON0)))
    # double-angle terms of the meridian distance
    df = _stage(df, g=_c("d") * _c("d"), s=2 * _c("sin") * _c("cos"), c=1 - 2 * _c("sin") * _c("sin"))
    t2, nu, ratio, d, g = _c("t2"), _c("nu"), _c("ratio"), _c("d"), _c("g")
    eta2 = ratio - 1
    arc = (_meridian_arc(_c("lat"), _c("s"), _c("c")) - _origin_arc()) * GRID_SCALE
    df = _stage(
        df,
        n=arc
        + GRID_N0
        + nu / 2 * _c("tan") * g * (1 + g / 12 * ((5 - t2 + 9 * eta2) + g / 30 * (61 - (58 - t2) * t2))),
        e=GRID_E0
        + nu * d * (1 + g / 6 * ((ratio - t2) + g / 20 * (5 - (18 - t2) * t2 + 14 * eta2 - 58 * t2 * eta2))),
    )
    return df.select(*kept, _c("e").alias(easting), _c("n").alias(northing))


# --- planar tests -------------------------------------------------------------


def ring_edges(ring: Column) -> Column:
    """Edges of a closed ring given as ``ARRAY<STRUCT<x,y>>`` (first point may repeat)."""
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p["x"].alias("x1"),
            p["y"].alias("y1"),
            F.get(ring, (i + 1) % F.size(ring))["x"].alias("x2"),
            F.get(ring, (i + 1) % F.size(ring))["y"].alias("y2"),
        ),
    )


def in_area_cell(x: Column, y: Column, mark_x: Column, mark_y: Column, mark_inside: Column, edges: Column) -> Column:
    """Is a point in an area, given the edges of one grid cell and whether a mark in that cell is inside.

    The way from the point level to the mark's x, then up or down to the mark, stays
    in the cell, so it crosses that cell's edges only; each crossing changes sides.
    Both legs use one value for the side on which their corner lies; levels count as
    just above their value, at vertices and on level edges alike.  The boundary
    belongs to the area.
    """

    def side(px: Column, py: Column, e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        return (turn > 0) | ((turn == 0) & (e["x2"] > e["x1"]))

    def level(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (side(x, y, e) != side(mark_x, y, e))

    def upright(e):
        return ((e["x1"] > mark_x) != (e["x2"] > mark_x)) & (side(mark_x, y, e) != side(mark_x, mark_y, e))

    def touches(e):
        return (
            ((x - e["x1"]) * (e["y2"] - e["y1"]) == (y - e["y1"]) * (e["x2"] - e["x1"]))
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    crossings = F.size(F.filter(edges, level)) + F.size(F.filter(edges, upright))
    return ((crossings % 2 == 1) != mark_inside) | F.exists(edges, touches)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring, in squared coordinate units."""
    doubled = F.aggregate(
        ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    )
    return F.abs(doubled) / 2


def segment_distance2(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance from a point to a line segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(length2, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    px, py = x - (x1 + t * dx), y - (y1 + t * dy)
    return px * px + py * py


def along_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where a point's foot lies along a line segment: 0 at its start, 1 at its end; NULL for a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    return ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
