from collections import Counter

from pyspark.sql import functions as F

from tarmac.operators import factsheet, joins


def test_master_keeps_unmatched_and_suffixes(spark):
    collision = spark.createDataFrame([("a", 2020, 1), ("b", 2021, 2)], "collision_index string, year int, speed int")
    vehicle = spark.createDataFrame(
        [("a", 1, "Car", 2020), ("b", 1, "Bus", 2021)],
        "collision_index string, vehicle_reference int, vehicle_type string, year int",
    )
    casualty = spark.createDataFrame(
        [("a", 1, 1, 2020), ("a", 0, 2, 2020), ("zz", 1, 1, 1999)],
        "collision_index string, vehicle_reference int, casualty_reference int, year int",
    )
    out = joins.master(collision, vehicle, casualty)
    assert set(out.columns) == {
        "collision_index", "vehicle_reference", "casualty_reference", "year_cas", "year_col", "speed", "vehicle_type", "year",
    }
    got = {(r.collision_index, r.vehicle_reference): (r.year_cas, r.year_col, r.vehicle_type) for r in out.collect()}
    assert got == {("a", 1): (2020, 2020, "Car"), ("a", 0): (2020, 2020, None), ("zz", 1): (1999, None, None)}


def test_master_joins_the_wide_collisions_last(spark):
    """Names, order and multiplicity as if they came first, also where names clash and keys repeat or are null."""
    collision = spark.createDataFrame([("a", 1, 7, 5), ("a", 2, 8, 6), ("b", 3, 9, 7), (None, 4, 9, 8)], "collision_index string, x int, y int, z_veh int")
    vehicle = spark.createDataFrame([(1, "a", 5, 10, 3), (1, "a", 6, 11, 4), (None, "b", 7, 12, 5), (2, "zz", 7, 13, 6)], "vehicle_reference int, collision_index string, x int, y int, x_cas int")
    casualty = spark.createDataFrame([(20, "a", 1, 3), (21, "a", 1, 4), (22, "b", None, 5), (23, "zz", 2, 6), (24, None, 1, 7)], "x int, collision_index string, vehicle_reference int, z int")
    out = joins.master(collision, vehicle, casualty)
    both = joins.casualty_with_collision(casualty, collision)
    first = both.join(vehicle.withColumnsRenamed({"y": "y_veh", "x_cas": "x_cas_veh"}), ["collision_index", "vehicle_reference"], "left")
    assert out.columns == first.columns and len(set(out.columns)) == len(out.columns)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, first.collect()))
    top = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)
    assert "collision_index" in top and "vehicle_reference" not in top


def test_orphans_after_coordinate_drop(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "collision_index string")
    child = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1), (None, 1)], "collision_index string, n int")
    assert joins.keep_children(child, parent).count() == 2
    assert joins.orphans(child, parent).count() == 2


def test_natural_join_matches_missing_keys(spark):
    left = spark.createDataFrame([(1, None, "l1"), (2, "x", "l2")], "k int, g string, a string")
    right = spark.createDataFrame([(1, None, "r1"), (2, "y", "r2")], "k int, g string, b string")
    assert [(r.k, r.g, r.a, r.b) for r in joins.natural_join(left, right).collect()] == [(1, None, "l1", "r1")]


def test_other_vehicle_matches_brute_force(spark):
    vehicles = [("one", 1), ("two", 1), ("two", 2), ("three", 1), ("three", 2), ("three", 3), ("same", 5), ("same", 5)]
    vehicles += [("hot", i) for i in range(500)]
    people = [(c, v, i) for i, (c, v) in enumerate(vehicles)] + [("two", 9, 900), ("same", 1, 901)]
    vdf = spark.createDataFrame([(c, v, f"{c}{v}") for c, v in vehicles], "collision_index string, vehicle_reference int, vehicle_type string")
    pdf = spark.createDataFrame(people, "collision_index string, vehicle_reference int, person int")
    got = Counter((r.person, r.other_vehicle_reference, r.other_vehicle_type) for r in joins.other_vehicle(pdf, vdf, ["vehicle_type"]).collect())
    sizes = Counter(c for c, _ in vehicles)
    want = Counter(
        (i, v2, f"{c2}{v2}") for c, v, i in people for c2, v2 in vehicles if c == c2 and v != v2 and sizes[c] == 2
    )
    assert got == want


def test_first_per_key_with_hot_key(spark):
    rows = [("hot", i % 1000, i) for i in range(5000)] + [("cold", 3, 1), ("cold", 2, 9)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {r.k: (r.o, r.v) for r in joins.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"hot": (0, 0), "cold": (2, 9)}


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2.0)], "s string, d double")
    out = joins.union_tables(a, b)
    assert sorted(out.columns) == ["d", "n", "s"] and out.where(F.col("d").isNull()).count() == 1


def test_first_vehicle_needs_no_fan_out(spark):
    rows = [("a", 2, "Bus"), ("a", 1, "Car"), ("b", 4, None)]
    df = spark.createDataFrame(rows, "collision_index string, vehicle_reference int, vehicle_type string")
    assert {r.collision_index: r.vehicle_type for r in factsheet.first_vehicle(df).collect()} == {"a": "Car", "b": None}


def test_natural_join_keeps_keys_of_either_side(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, r string")
    rows = lambda how: sorted(map(str, [tuple(r) for r in joins.natural_join(left, right, how).select("k", "l", "r").collect()]))
    assert rows("full") == sorted(map(str, [(1, "a", None), (2, "b", "x"), (3, None, "y"), (None, "c", "z")]))
    assert rows("right") == sorted(map(str, [(2, "b", "x"), (3, None, "y"), (None, "c", "z")]))
    assert rows("inner") == sorted(map(str, [(2, "b", "x"), (None, "c", "z")]))
