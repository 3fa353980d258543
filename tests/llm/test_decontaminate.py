"""Benchmark decontamination against a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm import decontaminate, queries
from tests.compare import compare, duck
from tests.llm.conftest import SMALL

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("span", T.IntegerType())])


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window):
    held = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            held.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in held}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in held:
                    hit |= set(range(i, i + size))
                    found |= held[k]
        out.append((doc_id, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def told(found):
    rows = found.collect()
    return sorted(((r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r["items"]) for r in rows), key=str)


def test_query_equals_its_sql(spark):
    name = "op11_winnowing_decontamination"
    found = queries.op11_winnowing_decontamination(spark, SMALL)
    assert compare(found, duck(SMALL), queries.catalogue.items[name].sql) is None
    assert found.where("contaminated").count() > 0


@pytest.mark.parametrize(("window", "gram", "bits"), [(10, 5, 26), (10, 5, 15), (10, 1, 20), (10, 10, 20), (4, 3, 16), (1, 1, 16)])
def test_planted_passages(spark, make_docs, window, gram, bits):
    rng = random.Random(window * 100 + gram)
    word = lambda: "".join(rng.choice("abÉß7") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(40)]
    items = [(1, " ".join(passage)), (2, "; ".join(passage[5:30])), (2, "; ".join(passage[5:30])), (11, " ".join(passage[3:12])), (12, passage[0]), (13, ""), (14, None)]
    items += [(20 + i, " ".join(passage[i : i + 14]) + " " + " ".join(word() for _ in range(20))) for i in range(20)]  # a third and more share windows
    items += [(None, " ".join(passage[20:36])), (None, None), (15, "-- ..")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            a, at = rng.randint(0, 30), rng.randint(0, len(own))
            own[at:at] = passage[a : a + rng.randint(5, 40)]
        docs.append((i, "\n ,".join(own).upper() if i % 2 else " ".join(own)))
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, docs[6][1]), (100, None), (101, ""), (102, "?!"), (103, " ".join(passage * 300))]
    df = make_docs(docs).withColumn("row", F.lit("mine")).withColumn("fp", F.lit(1))
    bench = spark.createDataFrame([(*r, 7) for r in items], ITEMS)
    assert told(decontaminate.contamination(df, bench, window=window, gram=gram, filter_bits=bits)) == brute(docs, items, window)


def test_every_shared_window_shares_a_fingerprint():
    """Equal stretches pick the same place, also among equal grams."""
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    starts = np.array([0, 1500, 1500, 4000])
    at, place, hashes = decontaminate.winnow(values, starts, 7, 4)
    assert len(at) == 1494 + 2494 and ((place >= at) & (place <= at + 3)).all()
    seen = {}
    for a, p in zip(at.tolist(), place.tolist()):
        key = tuple(values[a : a + 7].tolist())
        assert seen.setdefault(key, (p - a, hashes[p])) == (p - a, hashes[p])


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c", 1)], ITEMS)
    assert decontaminate.contamination(make_docs([]), bench).count() == 0
    assert told(decontaminate.contamination(make_docs([(1, "a b c")]), bench.limit(0))) == [(1, 3, [], [])]
    assert told(decontaminate.contamination(make_docs([(1, "x A-b.C y")]), bench)) == [(1, 5, [1, 2, 3], ["1"])]
