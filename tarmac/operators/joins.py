"""Key joins between the fact tables.  Join strategy is left to Catalyst and AQE:
hot collision keys on the many side are split by the adaptive skew join, which
is possible because the other side holds one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

COLLISION_KEY = "collision_index"
VEHICLE_KEY = (COLLISION_KEY, "vehicle_reference")


def _suffix_clashes(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]):
    clashes = (set(left.columns) & set(right.columns)) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clashes})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clashes})
    return left, right


def casualty_with_collision(casualty: DataFrame, collision: DataFrame) -> DataFrame:
    """Each casualty with its collision; shared names get ``_cas`` and ``_col``."""
    left, right = _suffix_clashes(casualty, collision, [COLLISION_KEY], ("_cas", "_col"))
    return left.join(right, COLLISION_KEY, "left")


def master(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame) -> DataFrame:
    """The denormalised table.  Casualties without a matching vehicle are kept.

    Columns are named and ordered as if the collision came first; it is joined last,
    so that its many columns are not shuffled again, once per casualty.
    """
    people, places = _suffix_clashes(casualty, collision, [COLLISION_KEY], ("_cas", "_col"))
    named = {*people.columns, *places.columns}
    vehicles = vehicle.withColumnsRenamed({c: f"{c}_veh" for c in vehicle.columns if c in named and c not in VEHICLE_KEY})
    seated = people.join(vehicles, list(VEHICLE_KEY), "left")
    others = [c for df in (people, places, vehicles) for c in df.columns if c not in VEHICLE_KEY]
    return seated.join(places, COLLISION_KEY, "left").select(*VEHICLE_KEY, *others)


def keep_children(
    child: DataFrame, parent: DataFrame, key: str = COLLISION_KEY, seen: Observation | None = None, kept: Observation | None = None
) -> DataFrame:
    """Child rows whose key exists in the parent.

    ``seen`` and ``kept`` learn ``n``, the rows before and after, when the result is
    first written or collected; the difference are the orphans (NULL keys included).
    """
    if seen is not None:
        child = child.observe(seen, F.count(F.lit(1)).alias("n"))
    child = child.join(parent.select(key), key, "left_semi")
    return child if kept is None else child.observe(kept, F.count(F.lit(1)).alias("n"))


def orphans(child: DataFrame, parent: DataFrame, key: str = COLLISION_KEY) -> DataFrame:
    """Child rows whose key is missing from the parent (NULL keys included)."""
    return child.join(parent.select(key), key, "left_anti")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every shared column; missing values match each other."""
    shared = [c for c in left.columns if c in right.columns]
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shared])
    joined = left.join(renamed, condition, how)
    # in a right or full join a key may come from the right side alone
    keys = {c: F.coalesce(c, f"__{c}") for c in shared} if how.startswith(("right", "full", "outer")) else {}
    return joined.withColumns(keys).drop(*[f"__{c}" for c in shared]) if keys else joined.drop(*[f"__{c}" for c in shared])


def salted_join(many: DataFrame, one: DataFrame, key: str, salt_by: Sequence[str], salts: int = 4) -> DataFrame:
    """Inner join of many rows to a reduced table with one row per key.

    A reduced table is already partitioned by its key, and joined as it is would
    send all rows of a hot key to one task that the adaptive skew join may not
    split.  Salting the many side spreads the key at once, and as both sides are
    then shuffled for the join, what is still skewed is split at run time.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    copies = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("__salt", salt).join(copies, [key, "__salt"]).drop("__salt")


def other_vehicle(casualty: DataFrame, vehicle: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Casualties of two-vehicle collisions with the vehicle they were not in.

    The vehicles of a collision are folded to (count, lowest, highest) before the
    join, so a collision with very many vehicles is dropped by its count and
    never paired out: each casualty meets two candidates at most.
    """
    record = F.struct("vehicle_reference", *columns)
    pairs = (
        vehicle.groupBy(COLLISION_KEY)
        .agg(F.count("*").alias("n"), F.min(record).alias("a"), F.max(record).alias("b"))
        .where(F.col("n") == 2)
        .select(COLLISION_KEY, F.array("a", "b").alias("parties"))
    )
    return (
        salted_join(casualty, pairs, COLLISION_KEY, casualty.columns)
        .withColumn("other", F.explode(F.filter("parties", lambda v: v["vehicle_reference"] != F.col("vehicle_reference"))))
        .drop("parties")
        .select(
            *casualty.columns,
            F.col("other.vehicle_reference").alias("other_vehicle_reference"),
            *[F.col(f"other.{c}").alias(f"other_{c}") for c in columns],
        )
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole first row of each key under the given order, as an aggregate: partial
    minima are taken before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("r"))
        .select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])
    )


def left_lookup(facts: DataFrame, series: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Facts with an external series (population, distance, deprivation)."""
    return facts.join(series, on, "left")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Row-bind by name; columns missing from a table are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
