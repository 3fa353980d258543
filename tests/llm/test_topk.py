"""Exact top-k against SQL and brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import queries, topk
from tests.compare import compare, duck
from tests.llm.conftest import SMALL


def brute(rows, every, k=10):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in ok]
    out = []
    for qi, q in whole:
        if qi % every == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), ci) for ci, c in whole if ci != qi)
            out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(found[:k])]
    return sorted(out)


def test_query_equals_sql(spark):
    query = queries.catalogue.items["op2_columnar_topk"]
    assert compare(query.build(spark, SMALL), duck(SMALL), query.sql) is None


@pytest.mark.parametrize("block", [4096, 37])
def test_ties_copies_and_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 9)
    rng = random.Random(7)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(40)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(300)]
    rows += [(300, hot), (300, hot), (300, vec()), (None, hot), (400, None), (500, [0.1, None]), (600, [float("nan")] * 40), (700, [float("inf")] * 40), (800, []), (900, [0.5]), (1000, vec() + vec())]
    rows += [(-20, [1e-9] * 40), (1100, [2.0**40] * 40), (1200, [1e300] * 40), (1201, [-1e300] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("mine")).withColumn("score", F.lit(0))
    found = topk.exact_topk(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = df.where("vec_id in (20, 21, 22)")
    assert sorted(map(tuple, topk.exact_topk(few, F.col("vec_id") % 20 == 0).collect())) == brute([r for r in rows if r[0] in (20, 21, 22)], 20)


def test_repeated_rows_equal_sql(spark, tmp_path):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    twice = given.union(given.where("vec_id % 50 in (1, 2)"))
    twice.write.parquet(str(tmp_path / "embeddings.parquet"))
    query, con = queries.catalogue.items["op2_columnar_topk"], duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compare(query.build(spark, str(tmp_path)), con, query.sql) is None


def test_bounds_drop_candidates_but_no_result():
    rng = np.random.default_rng(1)
    decay = 2.0 ** -np.arange(64)
    values = np.floor(1000 * rng.normal(size=(64, 500)) * decay[:, None])
    block = topk.Block({"ids": np.arange(500).astype("<i8").tobytes(), "dims": 64, "vectors": np.ascontiguousarray(values).tobytes()})
    for j in range(0, 500, 50):
        ids, scores = topk.best_of_block(values[:, j], block.rest[:, j], j, block, 10)
        want = sorted((-int(values[:, j] @ values[:, i]), i) for i in range(500) if i != j)[:10]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want
