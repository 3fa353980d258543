"""Smoothing over a road network.

A network is given by its road ends, rows (road_id, junction); a road may have any
number of them.  A step leads from a road over a junction to another road there.
Roads at a junction are never paired with each other: steps go from roads to
junctions and from junctions to roads.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpointing


def components(ends: DataFrame) -> DataFrame:
    """Rows (junction, component): the least junction that roads lead to.

    A label goes to the least one next to it, then to that one's label, until none
    changes, so rounds grow with the logarithm of a component's extent.  All
    steps are joins with one row per key and minima.
    """
    ensure_checkpointing(ends.sparkSession)
    labels = ends.select("junction", F.col("junction").alias("component")).distinct().checkpoint()
    while True:
        per_road = ends.join(labels, "junction").groupBy("road_id").agg(F.min("component").alias("least"))
        near = ends.join(per_road, "road_id").groupBy("junction").agg(F.min("least").alias("near"))
        further = labels.toDF("near", "further")
        after = (
            near.join(further, "near").join(labels, "junction")
            .select("junction", F.least("near", "further", "component").alias("component"), (F.col("component") > F.least("near", "further")).alias("fell"))
            .checkpoint()
        )
        labels = after.select("junction", "component")
        if after.where("fell").isEmpty():
            return labels


def depths(ends: DataFrame, roots: DataFrame, rounds: int) -> DataFrame:
    """Rows (junction, depth): steps from the nearest of ``roots``, one frontier for all of them.

    Junctions more than ``rounds`` steps away are missing.
    """
    found = [roots.select("junction").checkpoint()]
    for _ in range(rounds):
        over = ends.join(found[-1], "junction", "left_semi").select("road_id").distinct()
        further = ends.join(over, "road_id", "left_semi").select("junction").distinct()
        for seen in found[-2:]:  # links go both ways: only the last two rounds can come again
            further = further.join(seen, "junction", "left_anti")
        further = further.checkpoint()
        if further.isEmpty():
            break
        found.append(further)
    return reduce(DataFrame.unionByName, [f.withColumn("depth", F.lit(i)) for i, f in enumerate(found)])


def _by_road(ends: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (road_id, component, depth, missed) of junctions (junction, component, depth); ``missed`` of them have no depth."""
    return ends.join(found, "junction").groupBy("road_id").agg(
        F.min("component").alias("component"), F.min("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("missed")
    )


def road_depths(ends: DataFrame, order: int) -> DataFrame:
    """Rows (road_id, component, depth): steps from the road to the component's busiest junction.

    The search ends after ``order`` rounds; roads that it has not met by then have a NULL depth.
    """
    labels = components(ends)
    degrees = ends.groupBy("junction").agg(F.count("*").alias("degree"))
    roots = labels.join(degrees, "junction").groupBy("component").agg(F.max_by("junction", F.struct("degree", "junction")).alias("junction"))
    found = labels.join(depths(ends, roots, order - 1), "junction", "left")
    return _by_road(ends, found).select("road_id", "component", F.when(F.lit(order > 0), F.col("depth")).alias("depth"))


def _search(ends: DataFrame, labels: DataFrame, roots: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """From one root per component: junctions (junction, component, depth), and roads (road_id, component, steps).

    A road d steps from a junction that no road is more than e steps from reaches
    all others in d + e + 1 steps; that is ``steps``.  It is NULL where the component is
    too wide for any road to reach all in ``order``.
    """
    # a road that does leaves no junction more than 2 * order + 1 steps from another
    found = labels.join(depths(ends, roots, 2 * order + 1), "junction", "left").checkpoint()
    of_road = _by_road(ends, found)
    deepest = of_road.groupBy("component").agg(F.when(F.sum("missed") == 0, F.max("depth")).alias("deepest"))
    return found, of_road.join(deepest, "component").select("road_id", "component", (F.col("depth") + F.col("deepest") + 1).alias("steps")).checkpoint()


def reaching_all(ends: DataFrame, order: int) -> DataFrame:
    """Rows (road_id, component, whole): whether the road is known to reach its whole component in ``order`` steps.

    The first search is from the component's busiest junction.  That may lie at the
    edge; where it does not settle all roads, the ends of a long way (the junction
    furthest from the first, then the one furthest from that) and the middle between
    them are roots too.
    """
    labels = components(ends)
    degrees = ends.groupBy("junction").agg(F.count("*").alias("degree"))
    roots = labels.join(degrees, "junction").groupBy("component").agg(F.min_by("junction", F.struct(-F.col("degree"), "junction")).alias("junction"))
    found, roads = _search(ends, labels, roots, order)
    proved = [roads]
    wide = roads.where(F.col("steps") > order).select("component").distinct().checkpoint()
    if not wide.isEmpty():
        labels = labels.join(wide, "component", "left_semi").select("junction", "component").checkpoint()
        ends = ends.join(labels, "junction", "left_semi").checkpoint()
        sides = []
        for name in ("d0", "d1"):
            roots = found.join(wide, "component", "left_semi").groupBy("component").agg(F.min_by("junction", F.struct(-F.col("depth"), "junction")).alias("junction"))
            found, more = _search(ends, labels, roots, order)
            sides.append(found.withColumnRenamed("depth", name))
            proved.append(more)
        between = sides[0].join(sides[1], ["junction", "component"]).where("d0 IS NOT NULL AND d1 IS NOT NULL")
        roots = between.groupBy("component").agg(F.min_by("junction", F.struct(F.greatest("d0", "d1"), "junction")).alias("junction"))
        proved.append(_search(ends, labels, roots, order)[1])
    return reduce(DataFrame.unionByName, proved).groupBy("road_id", "component").agg(F.coalesce(F.min("steps") <= order, F.lit(False)).alias("whole"))


def neighbourhood(roads: DataFrame, ends: DataFrame, order: int) -> DataFrame:
    """Pairs (road_id, member): every road that each of ``roads`` reaches in at most ``order`` steps, itself included.

    Each round takes the junctions found in the round before to their roads and on
    to the next junctions.  As links go both ways, what a round finds can repeat
    only the last two rounds, so older pairs need not be looked at again.
    """
    ensure_checkpointing(roads.sparkSession)
    roads = roads.select("road_id").distinct()
    met = [roads.join(ends, "road_id").select("road_id", "junction").distinct()]
    for _ in range(1, order):
        last = met[-1] = met[-1].checkpoint()
        if last.isEmpty():
            break
        over = last.join(ends.select(F.col("road_id").alias("__over"), "junction"), "junction").select("road_id", "__over").distinct()
        found = over.join(ends.select(F.col("road_id").alias("__over"), "junction"), "__over").select("road_id", "junction").distinct()
        for seen in met[-2:]:
            found = found.join(seen, ["road_id", "junction"], "left_anti")
        met.append(found)
    reached = reduce(DataFrame.unionByName, met)
    at = ends.select(F.col("road_id").alias("member"), "junction")
    alone = roads.select("road_id", F.col("road_id").alias("member"))
    if order < 1:
        return alone
    return reached.join(at, "junction").select("road_id", "member").union(alone).distinct()


def _most(ends: DataFrame, key: str) -> DataFrame:
    return ends.groupBy(key).agg(F.count("*").alias("k")).agg(F.max("k").alias(key))


def smooth(counts: DataFrame, ends: DataFrame, order: int, listed: int = 10_000) -> DataFrame:
    """Mean count over the roads that each road reaches in ``order`` steps.  ``counts`` is (road_id, n).

    A road that reaches its whole component (``reaching_all``) has the component's
    mean, which is one aggregate.  So neither a junction where very many roads meet
    nor a high order lists pairs.  Only the neighbourhoods of the other roads are
    listed; they are as large as the definition asks.  If no road can reach more
    than ``listed`` others, by the most roads at a junction and the most ends of a
    road, all are listed at once.
    """
    ensure_checkpointing(counts.sparkSession)
    counts = counts.checkpoint()  # an aggregate of all facts, read several times
    ends = ends.select("road_id", "junction").where(F.col("junction").isNotNull()).join(counts.select("road_id"), "road_id", "left_semi").distinct().checkpoint()
    most = [_most(ends, key).first()[0] or 0 for key in ("junction", "road_id")]
    fan = most[0] * most[1]
    values = counts.select(F.col("road_id").alias("member"), "n")
    mean = lambda roads: neighbourhood(roads, ends, order).join(values, "member").groupBy("road_id").agg(F.avg("n").alias("smoothed"))
    if fan <= 1 or order * math.log(fan) <= math.log(listed):
        return mean(counts)
    roads = reaching_all(ends, order).checkpoint()
    means = roads.join(counts, "road_id").groupBy("component").agg(F.avg("n").alias("smoothed"))
    reach = roads.where("whole").join(means, "component").select("road_id", "smoothed").checkpoint()
    return reach.unionByName(mean(counts.select("road_id").join(reach, "road_id", "left_anti")))
