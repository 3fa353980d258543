"""Joins between points and areas or lines.

Theta conditions become equi joins on a square grid: the layer (areas, roads) is
spread over the cells it can touch, each point looks up exactly one cell, so the
large side is never duplicated.  Semi and anti joins stop at the first match and
emit no pairs.  Layers are reference data; whether they are broadcast is decided
by Catalyst and AQE from their measured size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.geo import along_segment, cell_index, in_area_cell, ring_area, ring_edges, segment_distance2
from tarmac.session import ensure_checkpointing

_CELL = ["__cx", "__cy"]


def _cells_between(df: DataFrame, x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column, size: float) -> DataFrame:
    """One row per grid cell that a box overlaps."""
    span = lambda lo, hi: F.sequence(cell_index(lo, 1 / size), cell_index(hi, 1 / size))
    return df.withColumn("__cx", F.explode(span(x_lo, x_hi))).withColumn("__cy", F.explode(span(y_lo, y_hi)))


def _with_cell(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return points.withColumns({"__cx": cell_index(F.col(x), 1 / size), "__cy": cell_index(F.col(y), 1 / size)})


# --- areas --------------------------------------------------------------------


#: A layer has one of these: a ring, rings, or polygons (each an outer ring and its holes).
_SHAPES = ("ring", "rings", "area")


def _shape(zones: DataFrame) -> str:
    return next(c for c in _SHAPES if c in zones.columns)


def _rings(zones: DataFrame) -> Column:
    """All rings of an area.  A point is inside if it crosses an odd number of their
    edges, so holes and further parts need nothing else."""
    rings = {"ring": F.array, "rings": F.col, "area": F.flatten}
    return rings[_shape(zones)](_shape(zones))


#: Where a cell's mark lies, in cell widths: off any lattice that coordinates may be on.
_MARK_X, _MARK_Y = 0.7548776662466927, 0.5698402909980532


def _mark() -> tuple[Column, Column]:
    return F.col("__cx") + _MARK_X, F.col("__cy") + _MARK_Y


def area_cells(zones: DataFrame, size: float) -> DataFrame:
    """Rows (__zone, __cx, __cy, __edges, __odd) of every cell that an area may hold a position of.

    A cell keeps the edges that pass through it and whether its mark is inside.
    Cells in the interior have no edges.  So what is stored grows with the edges (one
    row per cell that they pass) and the cells, not with their product.
    """
    shapes = zones.select("__zone", _shape(zones)).dropDuplicates(["__zone"])
    edges = shapes.select("__zone", F.posexplode(F.flatten(F.transform(_rings(shapes), ring_edges))).alias("__edge", "e")).select(
        "__zone", "__edge", *[F.col(f"e.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    )
    passed = _road_cells(edges, size, 0.0).groupBy("__zone", *_CELL).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__edges"))
    # where the level of a row's marks crosses the outline: marks between an odd and the next crossing are inside
    level = F.col("__my") * size
    rows = F.sequence(cell_index(F.least("y1", "y2"), 1 / size) - 1, cell_index(F.greatest("y1", "y2"), 1 / size) + 1)
    crossed = (
        edges.withColumn("__cy", F.explode(rows)).withColumn("__my", _mark()[1])
        .where((F.col("y1") > level) != (F.col("y2") > level))
        .select("__zone", "__cy", ((F.col("x1") + (level - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) / size - _MARK_X).alias("at"))
        .groupBy("__zone", "__cy").agg(F.sort_array(F.collect_list("at")).alias("at"))
    )
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(at) div 2 - 1")), lambda i: F.struct((F.floor(F.col("at")[2 * i]) + 1).alias("a"), F.floor(F.col("at")[2 * i + 1]).alias("b")))
    inside = (
        crossed.select("__zone", "__cy", F.explode(pairs).alias("r")).where("r.a <= r.b")
        .select("__zone", F.explode(F.sequence("r.a", "r.b")).alias("__cx"), "__cy", F.lit(True).alias("__odd"))
    )
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return passed.join(inside, ["__zone", *_CELL], "full").select(
        "__zone", *_CELL, F.coalesce("__edges", none).alias("__edges"), F.coalesce("__odd", F.lit(False)).alias("__odd")
    )


def _zone_cells(zones: DataFrame, size: float) -> DataFrame:
    """The layer's attributes on every cell of its index."""
    keyed = zones.withColumn("__zone", F.xxhash64(*zones.columns))
    return keyed.drop(*_SHAPES).join(area_cells(keyed, size), "__zone").drop("__zone")


def _inside(x: str, y: str, size: float) -> Column:
    mark = [(F.col(f"z.{c}") + at) * size for c, at in zip(_CELL, (_MARK_X, _MARK_Y))]
    return in_area_cell(F.col(f"p.{x}").cast("double"), F.col(f"p.{y}").cast("double"), *mark, F.col("z.__odd"), F.col("z.__edges"))


def _match(x: str, y: str, size: float) -> Column:
    same_cell = (F.col("p.__cx") == F.col("z.__cx")) & (F.col("p.__cy") == F.col("z.__cy"))
    return same_cell & _inside(x, y, size)


def within_zones(points: DataFrame, zones: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points lying in any zone (boundary included)."""
    cells = _zone_cells(zones, size).select(*_CELL, "__edges", "__odd").alias("z")
    return _with_cell(points, x, y, size).alias("p").join(cells, _match(x, y, size), "left_semi").drop(*_CELL)


def join_zones(points: DataFrame, zones: DataFrame, x: str, y: str, size: float, how: str = "left") -> DataFrame:
    """Points with the attributes of every zone they lie in; ``left`` keeps the rest."""
    cells = _zone_cells(zones, size).alias("z")
    joined = _with_cell(points, x, y, size).alias("p").join(cells, _match(x, y, size), how)
    layer = [F.col(f"z.{c}") for c in zones.columns if c not in _SHAPES]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *layer)


def zones_with_points(zones: DataFrame, points: DataFrame, x: str, y: str, size: float, key: str = "zone_id") -> DataFrame:
    """Zones containing at least one point.  Matches shrink to one row per zone and
    task before any shuffle."""
    hit = join_zones(points.select(x, y), zones.select(key, _shape(zones)), x, y, size, "inner").select(key).distinct()
    return zones.join(hit, key, "left_semi")


def zone_counts(zones: DataFrame, points: DataFrame, x: str, y: str, size: float, key: str = "zone_id") -> DataFrame:
    """Points per zone, zones without any included.  While the layer is small enough
    to be broadcast, points are matched and counted where they are read."""
    matched = join_zones(points.select(x, y), zones.select(key, _shape(zones)), x, y, size, "inner")
    tally = matched.groupBy(key).agg(F.count("*").alias("n"))
    return zones.drop(*_SHAPES).join(tally, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def zone_means(
    zones: DataFrame, points: DataFrame, value: str, x: str, y: str, size: float, key: str = "zone_id"
) -> DataFrame:
    """Mean of a point attribute per zone; NULL for zones without points."""
    matched = join_zones(points.select(x, y, value), zones.select(key, _shape(zones)), x, y, size, "inner")
    return zones.drop(*_SHAPES).join(matched.groupBy(key).agg(F.avg(value).alias("mean")), key, "left")


def zone_density(zones: DataFrame, amount: str, unit_area: float) -> DataFrame:
    """Area in ``unit_area`` units and amount per unit of area."""
    if "area" in zones.columns:  # per polygon the outer ring less its holes
        zones = zones.withColumnRenamed("area", "polygons")
        polygon = lambda rings: 2 * ring_area(rings[0]) - F.aggregate(rings, F.lit(0.0), lambda a, r: a + ring_area(r))
        whole = F.aggregate(F.transform("polygons", polygon), F.lit(0.0), lambda a, b: a + b)
    else:
        whole = ring_area(F.col("ring"))
    return zones.withColumn("area", whole / unit_area).withColumn("density", F.try_divide(amount, "area"))


# --- lines --------------------------------------------------------------------


def _pieces(roads: DataFrame, length: float) -> DataFrame:
    """Road segments cut into pieces no longer than ``length``.  The whole segment's
    ends stay alongside, because distances are measured to the whole segment."""
    run = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    count = F.greatest(F.ceil(run / length), F.lit(1)).cast("int")
    pieces = roads.withColumn("__k", count).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("__k")
    return pieces.withColumns(
        {
            "__ax": at("x1", "x2", F.col("__i")),
            "__ay": at("y1", "y2", F.col("__i")),
            "__bx": at("x1", "x2", F.col("__i") + 1),
            "__by": at("y1", "y2", F.col("__i") + 1),
        }
    ).drop("__i", "__k")


def _road_cells(roads: DataFrame, size: float, margin: float) -> DataFrame:
    """Cells that hold any position within ``margin`` of a road segment."""
    # a little slack keeps rounding in the cut points from losing a border cell
    slack = margin + size * 1e-6
    pieces = _pieces(roads, size)
    spread = _cells_between(
        pieces,
        F.least("__ax", "__bx") - slack,
        F.greatest("__ax", "__bx") + slack,
        F.least("__ay", "__by") - slack,
        F.greatest("__ay", "__by") + slack,
        size,
    )
    return spread.drop("__ax", "__ay", "__bx", "__by").distinct()


def _round(x: Column, y: Column, distance: float) -> Column:
    """Within the distance of a road segment, ends included."""
    return segment_distance2(x, y, *[F.col(f"r.{c}") for c in ("x1", "y1", "x2", "y2")]) <= distance * distance


def _flat(x: Column, y: Column, distance: float) -> Column:
    """Beside a road segment, or in the gap that a bend opens at its start: behind the
    end of the segment before, ahead of this one's start, within the distance of the bend."""
    before, start, end = ([F.col(f"r.{c}") for c in pair] for pair in (("x0", "y0"), ("x1", "y1"), ("x2", "y2")))
    along = along_segment(x, y, *start, *end)
    bend = (along < 0) & (along_segment(x, y, *before, *start) > 1) & (F.pow(x - start[0], 2) + F.pow(y - start[1], 2) <= distance * distance)
    return F.coalesce(along.between(0, 1) & _round(x, y, distance), F.lit(False)) | F.coalesce(bend, F.lit(False))


def _by_distance(points: DataFrame, roads: DataFrame, x: str, y: str, distance: float, how: str, flat: bool) -> DataFrame:
    size = 2.0 * distance
    ends = ["x1", "y1", "x2", "y2"] + (["x0", "y0"] if flat else [])
    if flat and "x0" not in roads.columns:
        roads = roads.withColumns({"x0": F.lit(None), "y0": F.lit(None)})
    segments = roads.select(*[F.col(c).cast("double").alias(c) for c in ends]).distinct()
    cells = _road_cells(segments, size, distance).alias("r")
    same_cell = (F.col("p.__cx") == F.col("r.__cx")) & (F.col("p.__cy") == F.col("r.__cy"))
    near = (_flat if flat else _round)(F.col(f"p.{x}").cast("double"), F.col(f"p.{y}").cast("double"), distance)
    return _with_cell(points, x, y, size).alias("p").join(cells, same_cell & near, how).drop(*_CELL)


def within_distance(points: DataFrame, roads: DataFrame, x: str, y: str, distance: float, flat: bool = False) -> DataFrame:
    """Points at most ``distance`` from any road.

    Round: a point just past a road's end is near too.  ``flat`` caps the ends
    there, so that only what lies beside a road is near, and what lies around an
    inner vertex of it (segments of ``polyline_segments`` know the vertex before
    them; a plain segment has no inner vertices).
    """
    return _by_distance(points, roads, x, y, distance, "left_semi", flat)


def outside_distance(points: DataFrame, roads: DataFrame, x: str, y: str, distance: float, flat: bool = False) -> DataFrame:
    """Points that are not ``within_distance`` of any road."""
    return _by_distance(points, roads, x, y, distance, "left_anti", flat)


def _levels(df: DataFrame, columns: Sequence[str], last: int) -> DataFrame:
    """A row per level: the cells of level l are 2 ** l base cells wide."""
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level"))).cast("bigint")
    every = df.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return every.withColumns({p: up(c) for c, p in zip(columns, ("__px", "__py"))})


def _around(df: DataFrame) -> DataFrame:
    """A row for each of the cell (__px, __py) and its eight neighbours."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.withColumn("__s", steps).withColumns({"__px": F.col("__px") + F.col("__s.i"), "__py": F.col("__py") + F.col("__s.j")}).drop("__s")


def _candidates(base: DataFrame, road_cells: DataFrame, size: float, extent: float) -> DataFrame:
    """For base cells (bx, by): every road that can be nearest to a position in them.

    Road cells are kept at all levels of a quadtree, with one road each.  A base
    cell first meets the roads that stand for the cells around it at every level;
    the least distance of its centre to one of them is a bound (partial minima, one
    row per base cell).  Positions lie within half a diagonal of the centre, so only
    roads up to a diagonal behind the bound can win, and these pass through the
    cells around it at the first level that is wide enough.
    """
    last = max(1, math.ceil(math.log2(2 * extent / size)))
    ends = ["x1", "y1", "x2", "y2"]
    at = lambda e: segment_distance2((F.col("bx") + 0.5) * size, (F.col("by") + 0.5) * size, *[F.col(f"{e}{c}") for c in ends])
    key = ["__level", "__px", "__py"]
    tree = _levels(road_cells, _CELL, last)
    standing = tree.groupBy(*key).agg(F.min(F.struct("road_id", *ends)).alias("r"))
    based = _levels(base, ("bx", "by"), last)
    bound = (
        based.join(_around(standing.select(*key, "r.*")), key)
        .groupBy("bx", "by").agg((F.sqrt(F.min(at(""))) + size * 2**0.5 * 1.000001).alias("__reach"))
    )
    wide = F.greatest(F.ceil(F.log2(F.col("__reach") / size)), F.lit(0)).cast("int")
    # the cells of a level that are as wide as the reach, or wider
    wide = F.least(F.when(F.pow(F.lit(2.0), wide) * size < F.col("__reach"), wide + 1).otherwise(wide), F.lit(last))
    level = bound.withColumn("__level", wide)
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level"))).cast("bigint")
    seen = _around(level.withColumns({"__px": up("bx"), "__py": up("by")}))
    return (
        seen.join(tree.select(*key, "road_id", *ends).distinct(), key)
        .where(F.sqrt(at("")) <= F.col("__reach"))
        .select("bx", "by", "road_id", *ends)
        .distinct()
    )


#: Cells with more roads to choose from and more positions than these are quartered, so many times at most.
_MANY_ROADS, _MANY_SPOTS, _QUARTERINGS = 64, 16, 12


def _at_level(df: DataFrame, size: float, level: int) -> DataFrame:
    """The cell (bx, by) of each position when base cells were quartered ``level`` times."""
    return df.withColumns({"bx": cell_index(F.col("x"), 2.0**level / size), "by": cell_index(F.col("y"), 2.0**level / size), "__level": F.lit(level)})


def _quartered(candidates: DataFrame, spots: DataFrame, size: float) -> DataFrame:
    """Rows (__level, bx, by, road_id, ...): cells that hold every position once, with the roads that can be nearest to one in them.

    A quarter of a cell takes from the cell's roads those up to its diagonal behind
    the one nearest to its centre.  So the roads that a position is measured to stay
    few however densely roads lie, and only crowded cells are looked at again.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    leaves = []
    for level in range(_QUARTERINGS + 1):
        roads = candidates.groupBy("bx", "by").agg(F.count("*").alias("__n"))
        held = _at_level(spots, size, level).groupBy("bx", "by").agg(F.count("*").alias("__spots"))
        crowded = (F.col("__n") > _MANY_ROADS) & (F.col("__spots") > _MANY_SPOTS) & F.lit(level < _QUARTERINGS)
        cells = roads.join(held, ["bx", "by"]).withColumn("crowded", crowded).checkpoint()
        leaves.append(candidates.join(cells.where(~F.col("crowded")), ["bx", "by"], "left_semi").withColumn("__level", F.lit(level)))
        if cells.where("crowded").isEmpty():
            break
        width = size / 2.0 ** (level + 1)
        half = lambda c: F.floor(F.col(c) / 2).cast("bigint")
        quarters = _at_level(spots, size, level + 1).select(F.col("bx").alias("qx"), F.col("by").alias("qy")).distinct()
        quarters = quarters.withColumns({"bx": half("qx"), "by": half("qy")}).join(cells.where("crowded").select("bx", "by"), ["bx", "by"])
        gap = F.sqrt(segment_distance2((F.col("qx") + 0.5) * width, (F.col("qy") + 0.5) * width, *ends))
        rows = quarters.join(candidates, ["bx", "by"]).drop("bx", "by").withColumn("__gap", gap)
        least = rows.groupBy("qx", "qy").agg((F.min("__gap") + width * 2**0.5 * 1.000001).alias("__reach"))
        candidates = rows.join(least, ["qx", "qy"]).where(F.col("__gap") <= F.col("__reach")).drop("__gap", "__reach").withColumnsRenamed({"qx": "bx", "qy": "by"}).checkpoint()
    return reduce(DataFrame.unionByName, leaves)


def nearest_road(points: DataFrame, roads: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Distinct positions with their nearest road (``road_id``, ``distance``, ``n``
    points there); ties go to the lowest id.

    The search runs over occupied base cells, of which there are at most
    (extent / size) squared however many points fall in them, and over quarters of
    crowded ones; the points themselves are joined at the end, with the few roads of
    their cells, and no pairs are shuffled or sorted.  The extent is that of the data.
    """
    # roads in the very same place are one candidate: the lowest id wins anyway
    ensure_checkpointing(points.sparkSession)
    roads = roads.groupBy(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).agg(
        F.min("road_id").alias("road_id")
    )
    spots = points.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count("*").alias("n")
    ).checkpoint()
    base = _at_level(spots, size, 0).select("bx", "by").distinct()
    candidates = _candidates(base, _road_cells(roads, size, 0.0).checkpoint(), size, _extent(spots, roads, size)).checkpoint()
    cells = _quartered(candidates, spots, size).checkpoint()
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect()) or [0]
    placed = reduce(DataFrame.unionByName, [_at_level(spots, size, level) for level in levels])
    key = ["__level", "bx", "by"]
    gap = F.sqrt(segment_distance2(F.col("x"), F.col("y"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    # minima of plain numbers need no sort: first the least distance, then the least id at that distance
    least = placed.join(cells, key).groupBy(*key, "x", "y", "n").agg(F.min(gap).alias("distance"))
    return least.join(cells, key).where(gap == F.col("distance")).groupBy("x", "y", "n", "distance").agg(F.min("road_id").alias("road_id")).select("x", "y", "n", "road_id", "distance")


def _extent(spots: DataFrame, roads: DataFrame, size: float) -> float:
    """A bound of all absolute coordinates, a cell more than the largest."""
    most = lambda df, *columns: df.agg(F.max(F.greatest(*[F.abs(c) for c in columns]))).first()[0] or 0.0
    return max(most(spots, "x", "y"), most(roads, "x1", "y1", "x2", "y2")) + size


def nearest_counts(points: DataFrame, roads: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points per road they are nearest to, roads without any included."""
    tally = nearest_road(points, roads, x, y, size).groupBy("road_id").agg(F.sum("n").alias("n"))
    return roads.select("road_id").join(tally, "road_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def polyline_segments(roads: DataFrame, line: str = "line") -> DataFrame:
    """Polylines (``ARRAY<STRUCT<x,y>>``) as one row per straight segment (x1, y1, x2, y2), with the vertex before it (x0, y0; NULL for the first)."""
    pts = F.col(line)
    at = lambda i, n: [F.get(pts, i)[c].alias(f"{c}{n}") for c in ("x", "y")]
    pairs = F.transform(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), lambda p, i: F.struct(*at(i, 1), *at(i + 1, 2), *at(i - 1, 0)))
    rest: Sequence[str] = [c for c in roads.columns if c != line]
    return roads.select(*rest, F.explode(pairs).alias("s")).select(*rest, "s.*")
