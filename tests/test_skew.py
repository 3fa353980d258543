"""A third of all rows on one key: results stay right and AQE splits the key."""

import pytest
from pyspark.sql import functions as F

from tarmac.operators import inspection, joins

SETTINGS = {
    # small-scale stand-ins for what large inputs meet by themselves
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100000",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10000",
    "spark.sql.shuffle.partitions": "64",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    folder = str(tmp_path_factory.mktemp("skew"))
    ids = spark.range(300_000)
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5003)
    ids.select(
        key.alias("vehicle"),
        F.lit(None).cast("date").alias("registration_date"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 7)).alias("completed"),
        F.lit(None).cast("date").alias("expiry"),
        F.col("id").cast("double").alias("odometer"),
        F.lit("mi").alias("unit"),
        F.lit("PASSED").alias("result"),
    ).write.parquet(folder + "/many")
    spark.range(5003).select(F.col("id").alias("vehicle"), (F.col("id") * 2).alias("w")).write.parquet(folder + "/one")
    yield spark.read.parquet(folder + "/many"), spark.read.parquet(folder + "/one")
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_joins_split_the_hot_key(skewed):
    many, one = (df.withColumnRenamed("vehicle", "collision_index") for df in skewed)
    for joined in (joins.casualty_with_collision(many, one), joins.keep_children(many, one)):
        counted = joined.groupBy((F.col("odometer") % 10).alias("d")).agg(F.count("*").alias("n"))
        assert "skew=true" in final_plan(counted)
        assert sum(r.n for r in counted.collect()) == 300_000


def test_lookback_splits_the_hot_vehicle(skewed):
    many, _ = skewed
    found = inspection.asof_lookback(many, 7000)
    assert "skew=true" in final_plan(found)
    hot = found.where(F.col("vehicle") == 0).first()
    # every third reading is the hot vehicle's, seven seconds apart
    assert (hot.latest_odometer, hot.prev_odometer) == (299_997.0, 298_995.0)
    assert found.count() == 5003
