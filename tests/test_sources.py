import csv
import glob
import json
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.predicates import TimeFilter
from tarmac.model import CODE_MAP
from tarmac.operators import decode, joins, matching, models, quality
from tarmac.plans import dashboard, etl
from tarmac.session import side_by_side
from tarmac.sources import geojson, records, tables

CODES = [
    (1, "collision", "collision_severity", "1", "Fatal", None, None),
    (2, "collision", "collision_severity", "2", "Serious", None, None),
    (3, "collision", "collision_severity", "3", "Slight", None, None),
    (4, "collision", "weather_conditions", "1", "Fine no high winds", None, None),
    (5, "collision", "light_conditions", "1", "Daylight", None, None),
    (6, "collision", "road_type", "6", "Single carriageway", None, None),
    (7, "casualty", "casualty_type", "0", "Pedestrian", None, None),
    (8, "casualty", "sex_of_casualty", "1", "Male", None, None),
    (9, "casualty", "casualty_class", "3", "Pedestrian", None, None),
    (10, "casualty", "casualty_severity", "3", "Slight", None, None),
    (11, "vehicle", "vehicle_type", "9", "Car", None, None),
]

COLLISION = [
    ("Collision Index", "Date", "Time", "Longitude", "Latitude", "Collision Severity", "Number of Vehicles", "Number of Casualties",
     "Collision Adjusted Severity (Serious)", "Collision Adjusted Severity (Slight)", "Weather Conditions", "Light Conditions", "Road Type", "Notes?"),
    ("A1", "05/06/2020", "13:30", "-0.1", "51.5", "1", "2", "1", "0", "0", "1", "1", "6", "fine, clear"),
    ("A2", "06/06/2020", "23:59", "-0.2", "51.6", "3", "1", "2", "0.25", "0.75", "-1", "1", "6", ""),
    ("A3", "07/06/2020", "10:00", "", "51.5", "2", "1", "1", "1", "0", "1", "1", "6", "no longitude"),
    ("A4", "31/02/2020", "10:00", "-0.1", "51.5", "2", "1", "1", "1", "0", "1", "1", "6", "bad date"),
    ("A5", "07/06/1999", "10:00", "-0.1", "51.5", "2", "1", "1", "1", "0", "1", "1", "6", "too early"),
]
VEHICLE = [
    ("collision_index", "vehicle_reference", "vehicle_type"),
    ("A1", "1", "9"), ("A1", "2", "42"), ("A2", "1", "9"), ("A3", "1", "9"), ("A5", "1", "9"), ("ZZ", "1", "9"),
]
CASUALTY = [
    ("collision_index", "vehicle_reference", "casualty_reference", "casualty_class", "casualty_type", "sex_of_casualty", "age_of_casualty", "casualty_severity"),
    ("A1", "1", "1", "3", "0", "1", "15", "3"), ("A1", "9", "2", "3", "0", "1", "-1", "3"), ("A2", "1", "1", "3", "5", "1", "65", "3"), ("A3", "1", "1", "3", "0", "1", "65", "3"),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    files = {}
    for kind, rows in (("collision", COLLISION), ("vehicle", VEHICLE), ("casualty", CASUALTY)):
        path = folder / f"dft-road-casualty-statistics-{kind}-2020.csv"
        with open(path, "w", newline="") as handle:
            csv.writer(handle).writerows(rows)
        files[kind] = str(path)
    out = str(tmp_path_factory.mktemp("out"))
    result = etl.run(spark, files, spark.createDataFrame(CODES, CODE_MAP), out)
    return result, str(folder), out


def test_etl_tables(spark, built):
    result, _, out = built
    rows = {r.collision_index: r for r in result["collision"].collect()}
    # missing longitude, bad date and an early year are gone
    assert set(rows) == {"A1", "A2"}
    a1 = rows["A1"]
    assert (a1.collision_severity, a1.weather_conditions, a1.day_of_week, a1.hour, a1.geometry) == ("Fatal", "Fine no high winds", "Friday", 13, "POINT (-0.1 51.5)")
    assert rows["A2"].weather_conditions == "-1" and rows["A2"].notes is None
    assert sorted(r.collision_index for r in result["vehicle"].collect()) == ["A1", "A1", "A2"]
    people = {(r.collision_index, r.casualty_reference): r for r in result["casualty"].collect()}
    assert set(people) == {("A1", 1), ("A1", 2), ("A2", 1)}
    assert [people[k].age_group for k in sorted(people)] == ["Child", "Unknown", "Senior"]
    assert people["A2", 1].casualty_type == "5"
    # the CSV copies were written before keys were enforced
    assert spark.read.option("header", True).csv(f"{out}/csv/vehicle").count() == 6
    master = {(r.collision_index, r.casualty_reference): r.vehicle_type for r in result["master"].collect()}
    assert master == {("A1", 1): "Car", ("A1", 2): None, ("A2", 1): "Car"}
    assert "nan" not in {str(v) for r in result["master"].collect() for v in r}


def test_etl_invariants(spark, built):
    result = built[0]
    collision = result["collision"]
    assert quality.unknown_severities(collision).count() == 0
    assert quality.date_mismatches(collision).first().n_mismatch == 0
    assert quality.coordinate_violations(collision).first().n_violations == 0
    assert {(r.raw_total, r.kpi_total) for r in quality.reconcile_with_monthly(collision, result["kpi_monthly"]).collect()} == {(2, 2)}
    counts = quality.orphan_counts(collision, vehicle=result["vehicle"], casualty=result["casualty"])
    assert {r.n_orphans for r in counts.collect()} == {0}
    bad = quality.invalid_labels(collision, result["code_map"], "collision", ["collision_severity", "weather_conditions"])
    assert [(r.variable, r.label, r.n) for r in bad.collect()] == [("weather_conditions", "-1", 1)]


def test_etl_with_buckets_gives_the_same_tables(spark, built, tmp_path):
    result, folder, _ = built
    files = {k: f"{folder}/dft-road-casualty-statistics-{k}-2020.csv" for k in ("collision", "vehicle", "casualty")}
    stored = etl.run(spark, files, spark.createDataFrame(CODES, CODE_MAP), str(tmp_path), buckets=4, database="hashed")
    try:
        for name, df in result.items():
            columns = sorted(df.columns)
            assert sorted(map(str, df.select(columns).collect())) == sorted(map(str, stored[name].select(columns).collect()))
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = joins.keep_children(stored["casualty"], stored["collision"])
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    finally:
        spark.sql("DROP DATABASE IF EXISTS hashed CASCADE")
        spark.sql("DROP DATABASE IF EXISTS hashed_versions CASCADE")


def test_dropped_rows_are_counted_while_tables_are_written(spark, built):
    result, _, out = built
    # A5 too early, A4 without a date; A3 without a longitude
    assert result.dropped["collision"] == {"outside_years": 2, "without_position": 1}
    for kind, n in (("vehicle", 3), ("casualty", 1)):
        raw = spark.read.option("header", True).csv(f"{out}/csv/{kind}")
        assert result.dropped[kind] == {"outside_years": 0, "orphans": n}
        assert joins.orphans(raw, result["collision"]).count() == n


def test_csv_copies_are_compressed_unless_asked_otherwise(spark, built, tmp_path):
    _, folder, out = built
    for kind in ("collision", "vehicle", "casualty", "master"):
        copies = glob.glob(f"{out}/csv/{kind}/part-*")
        assert copies and all(c.endswith(".csv.gz") for c in copies)
    files = {"collision": f"{folder}/dft-road-casualty-statistics-collision-2020.csv"}
    try:
        etl.run(spark, files, spark.createDataFrame(CODES, CODE_MAP), str(tmp_path), database="plain", csv_compression="none")
        copies = glob.glob(f"{tmp_path}/csv/collision/part-*")
        assert copies and all(c.endswith(".csv") for c in copies)
        read = lambda path: sorted(map(str, spark.read.option("header", True).csv(path).collect()))
        assert read(f"{tmp_path}/csv/collision") == read(f"{out}/csv/collision")
    finally:
        spark.sql("DROP DATABASE IF EXISTS plain CASCADE")
        spark.sql("DROP DATABASE IF EXISTS plain_versions CASCADE")


def test_steps_that_do_not_need_each_other_run_side_by_side(spark, built, tmp_path, monkeypatch):
    _, folder, _ = built
    files = {k: f"{folder}/dft-road-casualty-statistics-{k}-2020.csv" for k in ("collision", "vehicle", "casualty")}
    together, clean_table = threading.Barrier(3, timeout=60), etl.clean_table

    def waiting(*arguments):
        together.wait()  # goes on when all three kinds are here, and breaks if they come one by one
        return clean_table(*arguments)

    monkeypatch.setattr(etl, "clean_table", waiting)
    try:
        result = etl.run(spark, files, spark.createDataFrame(CODES, CODE_MAP), str(tmp_path), database="beside")
        assert result["master"].count() == 3
        assert list(result)[:5] == ["code_map", "collision", "vehicle", "casualty", "master"] and list(result)[5:] == list(etl.AGGREGATES)
    finally:
        spark.sql("DROP DATABASE IF EXISTS beside CASCADE")
        spark.sql("DROP DATABASE IF EXISTS beside_versions CASCADE")


def test_an_error_of_one_step_is_raised_and_ends_the_rest(spark):
    done = []

    def second(first):
        first.result()
        done.append(2)

    with pytest.raises(ValueError, match="first"):
        with side_by_side(spark, 2) as start:

            def fails():
                raise ValueError("first")

            start(second, start(fails))
    assert done == []


def test_a_new_version_cuts_nobody_off(spark, tmp_path):
    root = str(tmp_path)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS swapped LOCATION '{root}/db'")
    try:
        first = tables.replace_table(spark.range(10).withColumn("year", F.lit(2001)), "swapped", "t", root, ["year"])
        reader = spark.table("swapped.t")
        assert reader.count() == 10
        broken = spark.range(5).select(F.raise_error(F.lit("no more")).cast("bigint").alias("id"))
        with pytest.raises(Exception, match="no more"):
            tables.replace_table(broken, "swapped", "t", root)
        assert spark.table("swapped.t").count() == 10 and len(tables.old_versions(spark, "swapped", "t")) <= 1
        tables.forget_versions(spark, "swapped", "t")
        # other columns, buckets instead of partitions
        second = tables.replace_table(spark.range(3).withColumn("name", F.lit("x")), "swapped", "t", root, buckets=(2, "id"))
        assert spark.table("swapped.t").columns == ["id", "name"] and second.count() == 3
        assert reader.count() == first.count() == 10  # opened before the switch
        # a table from before there were versions is taken over
        spark.range(4).write.mode("overwrite").option("path", f"{root}/old").saveAsTable("swapped.plain")
        tables.replace_table(spark.range(6), "swapped", "plain", root)
        assert spark.table("swapped.plain").count() == 6
        gone = tables.forget_versions(spark, "swapped", "t")
        assert len(gone) == 1 and root in gone[0] and spark.table("swapped.t").count() == 3
        assert tables.old_versions(spark, "swapped", "t") == []
    finally:
        spark.sql("DROP DATABASE IF EXISTS swapped CASCADE")
        spark.sql("DROP DATABASE IF EXISTS swapped_versions CASCADE")


def test_guessed_types(spark, tmp_path):
    files = []
    for i, rows in enumerate((["1,1.5,T,2020-01-31,007,2020-01-31 10:00:00.5,1,,x,.5,1", "-2,3,FALSE,2020-02-01,008,2020-01-31T10:00:01,2,,9:30,-1e3,"], ["3000000000,,F,2020-02-29,009,,odd,, y ,7.,2020-02-30", ",,,,010,,,,,,"])):
        path = tmp_path / f"{i}.csv"
        path.write_text("\n".join(["a,b,c,d,e,f,g,h,i,j,k", *rows]) + "\n")
        files.append(str(path))
    df = records.read_csv(spark, files, {"b": T.StringType()}, guess=True)
    assert dict(df.dtypes) == {
        "a": "bigint", "b": "string", "c": "boolean", "d": "date", "e": "string", "f": "timestamp_ntz", "g": "string", "h": "boolean", "i": "string", "j": "double", "k": "string",
    }
    rows = {r.e: r for r in df.collect()}
    assert rows["009"].a == 3_000_000_000 and rows["008"].c is False and rows["009"].g == "odd" and rows["008"].j == -1000.0 and rows["009"].k == "2020-02-30"
    assert [t for _, t in records.read_csv(spark, files[0], {}, guess=True).dtypes][0] == "int"
    assert dict(records.read_csv(spark, files, {}).dtypes)["a"] == "string"
    # not a row at all
    (tmp_path / "none.csv").write_text("a,b\n")
    assert records.read_csv(spark, str(tmp_path / "none.csv"), {}, guess=True).count() == 0


def test_stored_tables_have_names_and_prune(spark, built):
    result = built[0]
    names = ["collision", "vehicle", "casualty", "code_map", "master", "kpi_monthly", "kpi_daily", "geo_events_raw", "collision_geopoints"]
    assert all(quality.required_tables(spark, [f"{etl.DATABASE}.{n}" for n in names]).values())
    assert set(names) <= set(tables.existing_tables(spark, etl.DATABASE))
    for name, df in result.items():
        assert spark.table(f"{etl.DATABASE}.{name}").count() == df.count()
    for name in ("geo_events_raw", "collision_geopoints", "collision"):
        plan = result[name].where("year = 2020")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan


def test_bucketed_files_are_bounded(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("year")).repartition(8)
    tables.write_table(df, "t_few", ["year"], (6, "k"), str(tmp_path / "t"))
    files = spark.table("t_few").inputFiles()
    spark.sql("DROP TABLE t_few")
    assert len(files) <= 30


def test_pages_on_the_built_tables(spark, built):
    result = built[0]
    when, both = TimeFilter(year=2020), ["Fatal", "Serious", "Slight"]
    assert dashboard.overview(result, when, both)["totals"].first().total_collisions == 2
    assert dashboard.overview(result, when, [])["totals"].first().total_collisions == 0
    assert dashboard.overview(result, TimeFilter(year=2020, month=6), ["Fatal"])["trend"].first()["count"] == 1
    ranged = dashboard.overview(result, TimeFilter(start="2020-06-06", end="2020-06-30"), both)
    assert ranged["totals"].first().total_casualties == 2 and ranged["trend"].count() == 1
    assert dashboard.heatmap(result, when, ["Slight"], limit=50000)["points"].first().color == [0, 128, 255, 160]
    demo = dashboard.demographics(result, when, both, ages=["Child"])
    assert demo["counts"].first()["count"] == 1
    env = dashboard.environment(result, when, both, "weather_conditions", "light_conditions", ["Daylight"])
    assert env["grid"].agg(F.sum("Daylight")).first()[0] == 2
    top = dashboard.hotspot_ranking(result, when, both, 100, "risk_score", 20, radius_miles=50).collect()
    assert [r.risk_score for r in top] == [3, 1]
    cell = dashboard.hotspot_cell(result, when, both, 100, top[0].cell_id, "date", 2000, 500)
    assert cell["page"].count() == cell["drawn"].count() == 1
    assert {r.year for r in dashboard.choices(result)["years"].collect()} == {2020}


def test_reader_facade(spark, built):
    folder = built[1]
    codes = spark.createDataFrame(CODES, CODE_MAP)
    df = records.get_records(spark, folder, 2020, "accidents", codes)
    # typed mode: labels do not fit the coded integer columns
    assert df.where(F.col("collision_severity").isNotNull()).count() == 0
    assert dict(df.dtypes)["datetime"] == "timestamp_ntz" and df.count() == 5
    raw = records.get_records(spark, folder, 2020, "vehicles", formatted=False)
    assert raw.columns == list(VEHICLE[0]) and raw.count() == 6
    # casualties have no position whatever is asked
    assert records.get_records(spark, folder, 2020, "casualties", output="points").count() == 4
    with pytest.raises(FileNotFoundError):
        records.get_records(spark, folder, 2031, "vehicle")


def test_grid_only_files_are_reprojected(spark):
    df = spark.createDataFrame([(651409.903, 313177.270), (None, 1.0)], "location_easting_osgr double, location_northing_osgr double")
    row = etl.locate(df).collect()
    assert len(row) == 1 and abs(row[0].latitude - 52.657977) < 2e-5 and row[0].geometry.startswith("POINT (1.716")
    plain = spark.createDataFrame([(1,)], "a int")
    assert etl.locate(plain).columns == ["a"]


def test_file_selection(spark):
    names = records.file_names(range(2019, 2025))
    pick = lambda *a: records.select_files(spark, names, *a)
    stem = "dft-road-casualty-statistics-"
    assert pick(2022, "collision") == [stem + "collision-2022.csv"]
    assert pick(2022, "cas") == [stem + "casualty-2022.csv"]
    assert pick(2016, "vehicle") == [stem + "vehicle-1979-latest-published-year.csv"]
    assert pick("5 years", "collision") == pick(5, "collision") == [stem + "collision-last-5-years.csv"]
    assert len(pick(2022)) == 3 and len(pick(1985)) == 3
    assert set(pick(2022, "bicycle")) == set(pick(2022))
    with pytest.raises(FileNotFoundError):
        pick(None, "bicycle")


def test_partitioned_sink_prunes(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3 + 2000).cast("int").alias("year"))
    stored = tables.materialise(df, str(tmp_path / "t"), ["year"])
    one = stored.where(F.col("year") == 2001)
    assert one.count() == 333 and len(one.inputFiles()) > 0
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for name, rows in (("t_parent", 100), ("t_child", 400)):
        df = spark.range(rows).select((F.col("id") % 100).alias("collision_index"), F.col("id").alias(name))
        tables.write_table(df, name, buckets=(4, "collision_index"), path=str(tmp_path / name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.casualty_with_collision(spark.table("t_child"), spark.table("t_parent"))
        assert joined.count() == 400
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE t_parent")
        spark.sql("DROP TABLE t_child")


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("collision_index,speed_limit\nA,30\n")
    (tmp_path / "b.csv").write_text("speed_limit,collision_index\n40,B\n")
    with pytest.raises(Exception):
        records.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    one = records.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert (one.collision_index, one.speed_limit) == ("A", 30)


def test_code_map_from_csv_keeps_file_order(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("table,variable,code,label,note,type\ncollision,road,1,Old,,\ncollision,road,1,New,,\n")
    codes = records.read_code_map(spark, str(path))
    df = spark.createDataFrame([(1,)], "road int")
    assert decode.decode_labels(df, codes, "collision", ["road"]).first().road == "New"
    text = spark.createDataFrame([("1",)], "road string")
    assert decode.decode_typed(text, codes, ["road"]).first().road == "Old"


def test_catalog_probe(spark):
    spark.range(3).createOrReplaceTempView("present_table")
    rows = {r.table_name: (r.present, r.n_rows) for r in quality.table_sizes(spark, ["present_table", "absent_table"]).collect()}
    assert rows == {"present_table": (True, 3), "absent_table": (False, None)}
    assert "present_table" in tables.existing_tables(spark)


def test_geojson_collection(spark, tmp_path):
    body = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, s], [0, 0]]]}}
            for n, s in (("a", 2), ("b", 3))
        ],
    }
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps(body, indent=1))
    got = geojson.read_collection(spark, str(path), "Polygon", T.StructType([T.StructField("name", T.StringType())]))
    assert {r.name: [(p.x, p.y) for p in r.rings[0]] for r in got.collect()} == {"a": [(0, 0), (2, 0), (2, 2)], "b": [(0, 0), (2, 0), (2, 3)]}


def test_edit_distance(spark):
    pairs = [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "acbe", 2), ("ca", "abc", 3), ("", "ab", 2), ("ab", "", 2), ("", "", 0), ("kitten", "sitting", 3), ("ab", "ba", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    bad = df.withColumn("got", matching.edit_distance(F.col("a"), F.col("b"))).where("got <> d")
    assert bad.collect() == []


def test_fuzzy_join_keeps_both_sides(spark):
    a = spark.createDataFrame([("first_road_class",), ("speed_limit",), ("gone",)], "old string")
    b = spark.createDataFrame([("frist_road_clas",), ("speed_limit",), ("brand_new",)], "new string")
    got = {(r.old, r.new, r.distance) for r in matching.fuzzy_full_join(a, b, "old", "new").collect()}
    assert got == {("first_road_class", "frist_road_clas", 2), ("speed_limit", "speed_limit", 0), ("gone", None, None), (None, "brand_new", None)}


def within_two(a, b):
    row, above, above2 = list(range(len(b) + 1)), None, None
    for i, x in enumerate(a, 1):
        above2, above, row = above, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], above2[j - 2] + 1)
    return row[-1] <= 2


def test_fuzzy_keys_are_made_once_per_name(spark, tmp_path):
    """However many rows have a name: nothing made of names is evaluated on the rows."""
    spark.range(5000).select(F.concat(F.lit("name "), (F.col("id") % 5).cast("string")).alias("old")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = matching.fuzzy_candidates(rows, rows.select(F.concat("old", F.lit("s")).alias("new")), "old", "new")
    assert "parquet" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert found.count() == 25


def test_fuzzy_candidates_are_complete_and_few(spark):
    rng = random.Random(12)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(250)} | {"", "ab", "ba", "aaaaaaaa", "aaaaaa"}
    a, b = sorted(names)[::2], sorted(names)[1::2] + ["aaaaaaaa"]
    left, right = spark.createDataFrame([(x,) for x in a], "old string"), spark.createDataFrame([(x,) for x in b], "new string")
    want = {(x, y) for x in a for y in b if within_two(x, y)}
    got = {(r.old, r.new) for r in matching.fuzzy_full_join(left, right, "old", "new").where("distance IS NOT NULL").collect()}
    assert got == want
    # a stem that all names share makes no candidates: the rarest pairs of characters decide
    stem = lambda n: [("accident_statistics_" + "".join(rng.choice("bcdfghjklmnpqrvwxz0123456789") for _ in range(10)),) for _ in range(n)]
    left, right = spark.createDataFrame(stem(150), "old string"), spark.createDataFrame(stem(150), "new string")
    assert matching.fuzzy_candidates(left, right, "old", "new").count() < 150 * 150 / 10


def test_schema_drift(spark):
    old = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    new = spark.createDataFrame([(None, 1.0)], "a int, c double")
    got = {r.column_name: (r.old_missing, r.new_missing, r.status) for r in matching.schema_drift(old, new).collect()}
    assert got == {"a": (0, 1, "kept"), "b": (1, None, "removed"), "c": (None, 0, "added")}


def test_multinomial_reproduces_shares(spark):
    rows = [(["Fatal", "Serious", "Slight"][i % 3 if i % 7 else 2], float(i % 11), float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "collision_severity string, a double, b double")
    for r in models.severity_probabilities(df, ["a", "b"], iterations=200).collect():
        assert abs(r.share - r.mean_fitted) < 1e-4
