import math
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import hotspots
from tarmac.operators.ordering import ordered_head


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        # a third of all events share one position
        lat, lon = (51.5, -0.1) if i % 3 == 0 else (rng.uniform(50, 53), rng.uniform(-2, 1))
        rows.append((lat, lon, rng.choice(["Fatal", "Serious", "Slight", "Other"]), rng.randint(1, 5), 2020))
    return spark.createDataFrame(rows, "latitude double, longitude double, collision_severity string, casualties int, year int").cache()


def brute(events, scale):
    cells = {}
    for r in events.collect():
        key = (math.floor(r.latitude * scale), math.floor(r.longitude * scale))
        c = cells.setdefault(key, [0, 0, 0])
        c[0] += 1
        c[1] += r.casualties
        c[2] += {"Fatal": 3, "Serious": 2, "Slight": 1}.get(r.collision_severity, 0)
    return cells


def haversine(lat1, lon1, lat2, lon2):
    a = (
        math.sin(math.radians(lat1 - lat2) / 2) ** 2
        + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon1 - lon2) / 2) ** 2
    )
    return 3958.8 * 2 * math.asin(math.sqrt(a))


@pytest.mark.parametrize("metric,index", [("collisions", 0), ("casualties", 1), ("risk_score", 2)])
def test_ranking(events, metric, index):
    want = sorted(((-v[index], f"{gx}_{gy}") for (gx, gy), v in brute(events, 20).items()))[:15]
    got = hotspots.hotspots(events, 20, F.lit(True), metric, 15).collect()
    assert [(-r[metric], r.cell_id) for r in got] == want


def test_radius_applies_to_centroids(events):
    scale, radius = 20, 30.0
    inside = {
        f"{gx}_{gy}"
        for gx, gy in brute(events, scale)
        if haversine((gx + 0.5) / scale, (gy + 0.5) / scale, 51.5074, -0.1278) <= radius
    }
    got = hotspots.hotspots(events, scale, F.lit(True), "collisions", 10_000, radius_miles=radius).collect()
    assert {r.cell_id for r in got} == inside
    counts = brute(events, scale)
    assert all(counts[hotspots.decode_cell(r.cell_id)][0] == r.collisions for r in got)


def test_cells_on_negative_edges(spark):
    df = spark.createDataFrame([(50.0, -0.05), (50.0, -0.0500001), (50.0, 0.0)], "latitude double, longitude double")
    cells = [(r.gx, r.gy) for r in hotspots.binned(df, 20).collect()]
    assert cells == [(1000, -1), (1000, -2), (1000, 0)]
    assert hotspots.decode_cell("1000_-2") == (1000, -2)


def test_drilldown_equals_whole_cell(events):
    total = hotspots.cell_severities(events, 20, F.lit(True), "1030_-2").agg(F.sum("collisions")).first()[0]
    assert total == brute(events, 20)[(1030, -2)][0]


def test_pages_cover_each_row_once(spark):
    rows = [(51.5, -0.1, "Fatal", i % 3, 1, "2020-01-01", 2020, 1, "w", "l", str(i)) for i in range(25)]
    df = spark.createDataFrame(
        rows,
        "latitude double, longitude double, collision_severity string, casualties int, vehicles int, date string, year int, month_num int, "
        "weather_conditions string, light_conditions string, road_type string",
    ).repartition(5)
    seen = []
    for offset in range(0, 30, 10):
        page = hotspots.cell_page(df, 20, F.lit(True), "1030_-2", "casualties", limit=10, offset=offset, columns=["road_type"])
        seen += [r.road_type for r in page.collect()]
    assert len(seen) == 25 and len(set(seen)) == 25
    with pytest.raises(ValueError):
        hotspots.cell_page(df, 20, F.lit(True), "1030_-2", "road_type; drop table x", 10)


@pytest.mark.parametrize("order_by", ["date", "casualties"])
def test_pages_follow_each_other(spark, order_by):
    """Ties, rows alike in every column, missing values in the order, pages that end between copies."""
    rows = [(51.5, -0.1, "Fatal" if i % 2 else None, None if i % 5 == 0 else i % 3, 1, None if i % 7 == 0 else f"2020-01-0{1 + i % 4}", 2020, 1, "w", "l", str(i % 6)) for i in range(60)] * 2
    df = spark.createDataFrame(
        rows,
        "latitude double, longitude double, collision_severity string, casualties int, vehicles int, date string, year int, month_num int, "
        "weather_conditions string, light_conditions string, road_type string",
    ).repartition(5)
    whole = [tuple(r) for r in hotspots.cell_page(df, 20, F.lit(True), "1030_-2", order_by, limit=1000).collect()]
    seen, last = [], None
    while page := hotspots.cell_page_after(df, 20, F.lit(True), "1030_-2", order_by, 7, last).collect():
        assert len(page) == 7 or len(seen) + len(page) == 120
        seen, last = seen + [tuple(r)[:-1] for r in page], page[-1]
    assert seen == whole and len(seen) == 120
    plan = hotspots.cell_page_after(df, 20, F.lit(True), "1030_-2", order_by, 7, last)._jdf.queryExecution().toString()
    assert "Offset" not in plan
    with pytest.raises(ValueError):
        hotspots.cell_page_after(df, 20, F.lit(True), "1030_-2", "road_type", 10)


def test_ordered_head_equals_sort(spark):
    rows = [(None if i % 50 == 0 else i % 7, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "d int, i int").repartition(6)
    want = [tuple(r) for r in df.orderBy("d", "i").limit(300).collect()]
    assert [tuple(r) for r in ordered_head(df, F.col("d"), ["d", "i"], 300).collect()] == want
    assert ordered_head(df, F.col("d"), ["d", "i"], 5000).count() == 1000


def test_sample_is_stable_across_partitionings(spark):
    df = spark.range(20000)
    a = {r.id for r in hotspots.stable_sample(df.repartition(3), ["id"], 500).collect()}
    b = {r.id for r in hotspots.stable_sample(df.repartition(11), ["id"], 500).collect()}
    c = {r.id for r in hotspots.stable_sample(df, ["id"], 500, seed=1).collect()}
    assert len(a) == 500 and a == b and a != c
