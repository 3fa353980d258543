"""SimHash against a brute-force version, planted near copies, crowded block values and edge rows."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tarmac.llm import queries, simhash
from tests.llm.conftest import SMALL


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint); the least id reachable, per row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(prints)):
        members.setdefault(find(i), []).append(i)
    out = [None] * len(prints)
    for m in members.values():
        for i in m:
            out[i] = min((prints[k][0] for k in m if prints[k][0] is not None), default=None)
    return out


def test_query_equals_brute_force(spark, documents):
    rows = [(r.doc_id, brute_print(r.text)) for r in documents.collect()]
    expected = {(i, f"{fp:016x}", c) for (i, fp), c in zip(rows, brute_components(rows))}
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SMALL).collect()]
    assert len(found) == len(rows) and set(found) == expected


def links_ok(spark, values, piece):
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").distinct()
    got = {r.fp: r.component_id for r in _classes(df.select(F.col("fp").alias("doc_id"), "fp"), piece)}
    fps = sorted(got)
    want = brute_components([(f, f & (1 << 64) - 1) for f in fps])
    assert [got[f] for f in fps] == want


def _classes(prints, piece):
    before = simhash.PIECE
    nodes = simhash.saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = simhash.connected_components(simhash.near_links(nodes, 3, 6, piece))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    assert simhash.PIECE == before
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").collect()


@pytest.mark.parametrize("piece", [2048, 7])
def test_dense_groups_and_chains(spark, piece):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(90)}
    chain = rng.getrandbits(64)
    for step in range(20):  # each three bits from the one before
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(chain)
    links_ok(spark, sorted(values), piece)


def test_masks_leave_no_near_pair_apart():
    cut = [m & (1 << 64) - 1 for m in simhash.masks(3, 6)]
    rng = random.Random(1)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & m == 0 for m in cut)


def test_edge_rows(make_docs):
    long = "w1 w2 w3 w4 w5 " * 20000
    docs = make_docs([(5, None), (3, ""), (9, " \t\n"), (None, "a b c d"), (None, "A B c D"), (7, "x"), (7, "x"), (8, long), (2, long), (4, "e f")])
    docs = docs.withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1)).withColumn("root", F.lit(2))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (None, None), (None, None), (7, 7), (7, 7), (8, 2), (2, 2), (4, 4)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["2", "3", "4", "7", "None"]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_first(empty).collect() == []
