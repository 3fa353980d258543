"""Repeated byte strings against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import prefix_free, queries
from tests.llm.conftest import SMALL


def brute(docs, length=100):
    """docs in corpus order."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(found):
    rows = found.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h")).collect()
    return sorted(map(tuple, rows), key=str)


def test_query_equals_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    found = [tuple(r)[:5] for r in queries.op10_prefix_free_dedup(spark, SMALL).collect()]
    assert sorted(found, key=str) == brute(docs)


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 3000])
def test_planted_passages(make_docs, chunk_bytes, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abc dé\n") for _ in range(n))
    passage, docs = noise(260), []
    for i in range(90):
        text = noise(rng.randint(0, 200))
        if i % 3 == 0:  # common, cut anywhere, with other text at its ends
            a = rng.randint(0, 120)
            text += passage[a : a + rng.randint(90, 260)] + noise(rng.randint(0, 90))
        docs.append((i, text))
    docs = [(None, docs[3][1])] + docs + [(200, docs[6][1]), (201, "ab" * 500), (202, "b" * 99), (203, "b" * 100), (204, "b" * 101), (205, None), (206, ""), (207, "é" * 3000)]
    df = make_docs(docs).withColumn("chunk", F.lit("mine")).withColumn("p", F.lit(1))
    assert digests(prefix_free.remove_repeats(df, chunk_bytes=chunk_bytes)) == brute(docs)


def test_crowded_triggers(make_docs):
    """One passage at whose end thousands of texts part."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    docs = [(i, passage + "".join(rng.choice("xyz") for _ in range(60))) for i in range(900)]
    for chunk_bytes in (4 << 20, 20_000):
        assert digests(prefix_free.remove_repeats(make_docs(docs), chunk_bytes=chunk_bytes)) == brute(docs)


def test_repeated_rows_and_other_lengths(make_docs):
    docs = [(1, "abcabcabcxyz"), (1, "abcabcabcxyz"), (2, "zabcab"), (3, "ab")]
    for length in (1, 3, 5):
        assert digests(prefix_free.remove_repeats(make_docs(docs), length=length)) == brute(docs, length)
    assert prefix_free.remove_repeats(make_docs(docs).limit(0)).collect() == []


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 7, 69, 200):
        assert list(prefix_free.sliding_least(values, width)) == [values[i : i + width].min() for i in range(200 - width + 1)]
    assert len(prefix_free.sliding_least(values, 201)) == 0
