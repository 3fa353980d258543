import math
import random

import pytest
from pyspark.sql import functions as F

from tarmac.functions.geo import ring_area
from tarmac.operators import network, spatial

ZONES = {
    1: [(0, 0), (10, 0), (10, 10), (0, 10)],
    2: [(10, 0), (20, 0), (15, 10)],  # shares the corner (10, 0) with zone 1
    3: [(30, 30), (40, 30), (40, 40), (35, 33), (30, 40)],  # concave
    4: [(-50, -50), (-40, -50), (-45, -45)],  # far away
}


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def gap(x, y, x1, y1, x2, y2):
    d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if d2 == 0 else max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d2))
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


@pytest.fixture(scope="module")
def zones(spark):
    rows = [(k, float(k * 100), [(float(x), float(y)) for x, y in ring]) for k, ring in ZONES.items()]
    return spark.createDataFrame(rows, "zone_id int, population double, ring array<struct<x:double,y:double>>")


@pytest.fixture(scope="module")
def point_rows():
    rng = random.Random(3)
    rows = [(rng.uniform(-5, 45), rng.uniform(-5, 45)) for _ in range(600)]
    rows += [(10.0, 0.0), (0.0, 0.0), (5.0, 10.0), (15.0, 10.0), (35.0, 33.0), (35.0, 36.0)]
    rows += [(5.0, 5.0)] * 300  # a third of the rows in one place
    return [(i, x, y, i % 7) for i, (x, y) in enumerate(rows)]


@pytest.fixture(scope="module")
def points(spark, point_rows):
    return spark.createDataFrame(point_rows, "id int, x double, y double, v int").cache()


@pytest.mark.parametrize("size", [1.0, 7.0, 1000.0])
def test_zone_joins_match_brute_force(points, zones, point_rows, size):
    pairs = {(i, k) for i, x, y, _ in point_rows for k, ring in ZONES.items() if inside(x, y, ring)}
    got = spatial.join_zones(points, zones, "x", "y", size, "inner")
    rows = [(r.id, r.zone_id) for r in got.select("id", "zone_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == pairs
    within = {r.id for r in spatial.within_zones(points, zones, "x", "y", size).collect()}
    assert within == {i for i, _ in pairs}
    left = spatial.join_zones(points, zones, "x", "y", size, "left")
    assert left.where(F.col("zone_id").isNull()).count() == len(point_rows) - len(within)


def test_zone_aggregates_keep_empty_zones(points, zones, point_rows):
    counts = {r.zone_id: r.n for r in spatial.zone_counts(zones, points, "x", "y", 5.0).collect()}
    means = {r.zone_id: r["mean"] for r in spatial.zone_means(zones, points, "v", "x", "y", 5.0).collect()}
    for k, ring in ZONES.items():
        values = [v for _, x, y, v in point_rows if inside(x, y, ring)]
        assert counts[k] == len(values)
        assert means[k] is None if not values else abs(means[k] - sum(values) / len(values)) < 1e-9
    assert {r.zone_id for r in spatial.zones_with_points(zones, points, "x", "y", 5.0).collect()} == {1, 2, 3}


def test_area_and_density(zones):
    areas = {r.zone_id: r.a for r in zones.select("zone_id", ring_area(F.col("ring")).alias("a")).collect()}
    assert areas[1] == 100.0 and areas[2] == 50.0
    assert {r.zone_id: r.density for r in spatial.zone_density(zones, "population", 1.0).collect()}[1] == 1.0


ROADS = [
    (1, 0.0, 0.0, 100.0, 0.0),
    (2, 0.0, 40.0, 100.0, 40.0),
    (3, 500.0, 500.0, 530.0, 900.0),
    (4, 5000.0, 5000.0, 5000.0, 5000.0),  # a point-like road
    (5, 0.0, 0.0, 100.0, 0.0),  # same place as road 1
    (6, -9000.0, 9000.0, -8000.0, 9500.0),  # nothing near it
]


@pytest.fixture(scope="module")
def roads(spark):
    return spark.createDataFrame(ROADS, "road_id int, x1 double, y1 double, x2 double, y2 double")


@pytest.fixture(scope="module")
def spots():
    rng = random.Random(5)
    rows = [(rng.uniform(-200, 1200), rng.uniform(-200, 1200)) for _ in range(300)]
    rows += [(50.0, 49.0), (50.0, 90.0), (50.0, 91.0), (50.0, 20.0), (50.0, -50.0), (50.0, -50.1), (149.0, 0.0), (151.0, 0.0)]
    rows += [(4000.0, 4990.0), (60.0, 1.0)] + [(60.0, 1.0)] * 150
    return [(i, x, y) for i, (x, y) in enumerate(rows)]


@pytest.mark.parametrize("distance", [50.0, 7.5, 300.0])
def test_distance_filters_match_brute_force(spark, roads, spots, distance):
    df = spark.createDataFrame(spots, "id int, x double, y double")
    near = {i for i, x, y in spots if min(gap(x, y, *r[1:]) for r in ROADS) <= distance}
    assert {r.id for r in spatial.within_distance(df, roads, "x", "y", distance).collect()} == near
    assert {r.id for r in spatial.outside_distance(df, roads, "x", "y", distance).collect()} == {s[0] for s in spots} - near


@pytest.mark.parametrize("size", [25.0, 400.0])
def test_nearest_matches_brute_force(spark, roads, spots, size):
    df = spark.createDataFrame(spots, "id int, x double, y double")
    got = {(r.x, r.y): (r.road_id, r.n) for r in spatial.nearest_road(df, roads, "x", "y", size).collect()}
    want = {}
    for _, x, y in spots:
        best = min((gap(x, y, *r[1:]), r[0]) for r in ROADS)[1]
        want[(x, y)] = (best, want.get((x, y), (0, 0))[1] + 1)
    assert got == want
    counts = {r.road_id: r.n for r in spatial.nearest_counts(df, roads, "x", "y", size).collect()}
    assert counts[6] == 0 and counts[5] == 0 and sum(counts.values()) == len(spots)


def test_polylines(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)])], "road_id int, line array<struct<x:double,y:double>>")
    got = [tuple(r) for r in spatial.polyline_segments(df).collect()]
    assert got == [(1, 0.0, 0.0, 1.0, 0.0, None, None), (1, 1.0, 0.0, 1.0, 2.0, 0.0, 0.0)]


def flat_near(x, y, line, d):
    """Inside the flat-capped buffer: rectangles beside the segments and sectors at the bends."""
    foot = lambda a, b: ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)
    beside = any(0 <= foot(a, b) <= 1 and gap(x, y, *a, *b) <= d for a, b in zip(line, line[1:]))
    bends = any(foot(a, b) > 1 and foot(b, c) < 0 and math.dist((x, y), b) <= d for a, b, c in zip(line, line[1:], line[2:]))
    return beside or bends


@pytest.mark.parametrize("d", [5.0, 40.0])
def test_flat_caps(spark, d):
    lines = {1: [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (130.0, 60.0)], 2: [(300.0, 300.0), (320.0, 300.0)], 3: [(300.0, 300.0), (300.0, 330.0)]}
    rng = random.Random(11)
    spots = [(rng.uniform(-60, 360), rng.uniform(-60, 360)) for _ in range(900)]
    spots += [(-0.001, 0.0), (0.0, 1.0), (103.0, -3.0), (300.0, 299.999), (297.0, 297.0), (320.001, 300.0), (320.0, 301.0)]
    df = spark.createDataFrame(list(lines.items()), "road_id int, line array<struct<x:double,y:double>>")
    points = spark.createDataFrame(spots, "x double, y double")
    segments = spatial.polyline_segments(df)
    near = {s for s in spots if any(flat_near(*s, line, d) for line in lines.values())}
    assert {tuple(r) for r in spatial.within_distance(points, segments, "x", "y", d, flat=True).collect()} == near
    assert {tuple(r) for r in spatial.outside_distance(points, segments, "x", "y", d, flat=True).collect()} == set(spots) - near
    # just past an end is far with flat caps and near with round ones; a bend is near, two roads that meet have no bend
    assert not near & {(-0.001, 0.0), (297.0, 297.0)} and (103.0, -3.0) in near and ((320.001, 300.0) in near) == (d > 20)
    plain = segments.drop("x0", "y0")
    assert (103.0, -3.0) not in {tuple(r) for r in spatial.within_distance(points, plain, "x", "y", d, flat=True).collect()}


def road_ends(links):
    """Road ends and links of roads from (road, junction, junction)."""
    ends = [(r, j) for r, *js in links for j in js]
    at = {}
    for r, j in ends:
        at.setdefault(j, set()).add(r)
    return ends, {r: set().union(*(at[j] for j in js)) for r, *js in links}


def smoothed(counts, near, order):
    out = {}
    for r in counts:
        reached = {r}
        for _ in range(order):
            reached |= set().union(*(near.get(m, set()) for m in reached))
        out[r] = round(sum(counts[m] for m in reached) / len(reached), 9)
    return out


NETWORK = [
    # a path, a triangle, a dead end that meets nothing, a loop, parallel roads, a road with three ends
    *[(i, f"p{i}", f"p{i + 1}") for i in range(1, 9)],
    (10, "a", "b"), (11, "b", "c"), (12, "c", "a"), (20, "x", "y"), (21, "l", "l"), (22, "m", "n"), (23, "n", "m"),
    (30, "t1", "t2", "t3"), (31, "t1", "u"), (32, "t3", "v"), (33, "v", "w"),
]


@pytest.mark.parametrize(("order", "listed"), [(0, 1), (1, 1), (2, 1), (2, 10_000), (4, 1), (50, 10_000)])
def test_smoothing_matches_brute_force(spark, order, listed):
    ends, near = road_ends(NETWORK)
    values = {r: 10 * r % 37 for r, *_ in NETWORK} | {99: 5}  # road 99 has no ends at all
    counts = spark.createDataFrame(list(values.items()), "road_id int, n int")
    df = spark.createDataFrame([*ends, (1, "p1"), (77, "p1"), (2, None)], "road_id int, junction string")  # a repeated end, an unknown road, no junction
    got = {r.road_id: round(r.smoothed, 9) for r in network.smooth(counts, df, order, listed).collect()}
    assert got == smoothed(values, near, order)


def test_a_hub_stays_linear(spark):
    """A third of all roads meet at one junction: whoever reaches everything is not listed."""
    links = [(i, "hub", f"e{i}") for i in range(200)] + [(200 + i, f"e{i}", f"f{i}") for i in range(200)] + [(400 + i, f"f{i}", f"g{i}") for i in range(200)]
    ends, near = road_ends(links)
    values = {r: r % 11 for r, *_ in links}
    df, counts = spark.createDataFrame(ends, "road_id int, junction string"), spark.createDataFrame(list(values.items()), "road_id int, n int")
    depths = network.road_depths(df, 5)
    assert depths.count() == len(links) and depths.agg(F.max("depth")).first()[0] == 2
    assert depths.where("depth IS NULL").count() == 0
    want = smoothed(values, near, 5)
    plans = []
    keep = network.neighbourhood

    def watched(roads, own, order):
        plans.append(roads.count())
        return keep(roads, own, order)

    network.neighbourhood = watched
    try:
        got = {r.road_id: round(r.smoothed, 9) for r in network.smooth(counts, df, 5).collect()}
    finally:
        network.neighbourhood = keep
    assert got == want and plans == [0]


def test_components_and_depths(spark):
    ends, _ = road_ends(NETWORK)
    df = spark.createDataFrame(ends, "road_id int, junction string")
    found = {r.junction: r.component for r in network.components(df).collect()}
    assert found["p9"] == "p1" and found["c"] == "a" and found["w"] == found["u"] == "t1" and found["l"] == "l"
    depths = {r.road_id: r.depth for r in network.road_depths(df, 3).collect()}
    assert depths[8] is not None and depths[1] is None  # the search ends after three rounds


def test_the_busiest_junction_may_lie_at_the_edge(spark, monkeypatch):
    """A path with a star at its end: in five steps all roads reach all others, which a search from the star does not show."""
    links = [(i, f"p{i}", f"p{i + 1}") for i in range(5)] + [(10 + i, "p5", f"s{i}") for i in range(3)]
    ends, near = road_ends(links)
    values = {r: r % 7 for r, *_ in links}
    asked, keep = [], network.neighbourhood
    monkeypatch.setattr(network, "neighbourhood", lambda roads, own, n: asked.append(roads.count()) or keep(roads, own, n))
    df, counts = spark.createDataFrame(ends, "road_id int, junction string"), spark.createDataFrame(list(values.items()), "road_id int, n int")
    got = {r.road_id: round(r.smoothed, 9) for r in network.smooth(counts, df, 5, 1).collect()}
    assert got == smoothed(values, near, 5) and asked == [0]


def test_nearest_where_roads_crowd(spark):
    """All roads in one cell, points near and far; copies of a road; no window in the plan."""
    rng = random.Random(14)
    rows = [(i, *(1000 + rng.uniform(0, 9) for _ in range(4))) for i in range(120)]
    rows += [(500 + i, *rows[i][1:]) for i in range(10)]
    spots = [(rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for _ in range(60)] + [(1000 + rng.uniform(0, 9), 1000 + rng.uniform(0, 9)) for _ in range(60)]
    roads = spark.createDataFrame(rows, "road_id int, x1 double, y1 double, x2 double, y2 double")
    found = spatial.nearest_road(spark.createDataFrame(spots, "x double, y double"), roads, "x", "y", 10.0)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.x, r.y): (r.road_id, round(r.distance, 6)) for r in found.collect()}
    for s in spots:
        distance, road = min((gap(*s, *r[1:]), r[0]) for r in rows)
        assert got[s] == (road, round(distance, 6))


def test_nearest_quarters_crowded_cells(spark):
    """Many roads and positions in one base cell: few roads are measured per position, and nothing is sorted for it."""
    rng = random.Random(15)
    rows = [(i, *(a := (rng.uniform(0, 1000), rng.uniform(0, 1000))), a[0] + rng.uniform(-20, 20), a[1] + rng.uniform(-20, 20)) for i in range(500)]
    rows += [(900, 500.0, 0.0, 500.0, 8.0), (901, 500.0, 12.0, 500.0, 20.0)]  # as far from a quarter's corner
    spots = [(rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for _ in range(150)] + [(500.0, 10.0)]
    points, roads = spark.createDataFrame(spots, "x double, y double"), spark.createDataFrame(rows, "road_id int, x1 double, y1 double, x2 double, y2 double")
    found = spatial.nearest_road(points, roads, "x", "y", 1000.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan
    got = {(r.x, r.y): (r.road_id, round(r.distance, 6)) for r in found.collect()}
    for s in spots:
        distance, road = min((gap(*s, *r[1:]), r[0]) for r in rows)
        assert got[s] == (road, round(distance, 6))


def test_nearest_has_no_extent(spark):
    points = spark.createDataFrame([(5_000_000.0, 5_000_000.0), (1000.0, 1000.0)], "x double, y double")
    far = spark.createDataFrame([(1, -20_000.0, -20_000.0, -19_000.0, -20_000.0)], "road_id int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.x, r.road_id) for r in spatial.nearest_road(points, far, "x", "y", 10_000.0).collect()) == [(1000.0, 1), (5_000_000.0, 1)]
    assert spatial.nearest_counts(points, far, "x", "y", 10_000.0).collect()[0].n == 2


def test_areas_with_holes_and_parts(spark):
    square = lambda a, b: [(float(a), float(a)), (float(b), float(a)), (float(b), float(b)), (float(a), float(b))]
    point = "struct<x:double,y:double>"
    areas = spark.createDataFrame([(1, 10.0, [[square(0, 10), square(3, 7)], [square(20, 22)]])], f"zone_id int, population double, area array<array<array<{point}>>>")
    spots = [(5.0, 5.0), (1.0, 1.0), (3.0, 5.0), (21.0, 21.0), (15.0, 15.0), (10.0, 10.0), (6.99, 6.99)]
    points = spark.createDataFrame(spots, "x double, y double")
    for size in (0.7, 4.0, 100.0):
        got = {(r.x, r.y) for r in spatial.within_zones(points, areas, "x", "y", size).collect()}
        assert got == {(1.0, 1.0), (3.0, 5.0), (21.0, 21.0), (10.0, 10.0)}
        assert spatial.zone_counts(areas, points, "x", "y", size).first().n == 4
    assert spatial.zone_density(areas, "population", 1.0).first().area == 100 - 16 + 4


def test_areas_on_a_lattice(spark):
    """Corners, edges and points that all lie on cell borders and on each other's levels."""
    rng = random.Random(9)
    rings = {k: [(float(rng.randint(0, 8)), float(rng.randint(0, 8))) for _ in range(rng.randint(3, 9))] for k in range(40)}
    df = spark.createDataFrame([(k, 1.0, r) for k, r in rings.items()], "zone_id int, population double, ring array<struct<x:double,y:double>>")
    spots = [(x / 2, y / 2) for x in range(-1, 18) for y in range(-1, 18)]
    points = spark.createDataFrame(spots, "x double, y double")
    want = {(x, y, k) for x, y in spots for k, r in rings.items() if inside(x, y, r)}
    for size in (0.5, 1.0, 3.0):
        got = [(r.x, r.y, r.zone_id) for r in spatial.join_zones(points, df, "x", "y", size, "inner").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_index_of_a_long_outline(spark):
    """What is stored grows with vertices and cells, not with their product; interior cells hold no edges."""
    n = 10_000
    ring = [(50 + (40 + (i % 2)) * math.cos(2 * math.pi * i / n), 50 + (40 + (i % 2)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    df = spark.createDataFrame([(1, ring)], "__zone int, ring array<struct<x:double,y:double>>")
    for size in (5.0, 1.0):
        cells = spatial.area_cells(df, size).selectExpr("__odd", "size(__edges) AS k").cache()
        row = cells.selectExpr("count(*) AS cells", "sum(k) AS edges", "count_if(__odd AND k = 0) AS interior").first()
        assert row.edges <= 3 * n + 4 * row.cells and row.cells <= (90 / size + 2) ** 2
        assert row.interior > 0.6 * math.pi * 40 * 40 / size / size
    rng = random.Random(1)
    spots = [(rng.uniform(5, 95), rng.uniform(5, 95)) for _ in range(150)]
    points = spark.createDataFrame(spots, "x double, y double")
    got = {(r.x, r.y) for r in spatial.within_zones(points, df.withColumnRenamed("__zone", "zone_id"), "x", "y", 5.0).collect()}
    assert got == {s for s in spots if inside(*s, ring)}
