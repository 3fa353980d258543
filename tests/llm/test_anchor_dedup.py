"""Repeated word windows against a brute-force version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarmac.llm import anchor_dedup, queries
from tests.llm.conftest import SMALL


def brute(docs, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, i + k) for places in seen.values() if len(places) > 1 for d, i in places for k in range(window)}
    out = []
    for d, (doc_id, _) in enumerate(docs):
        kept = [x for i, x in enumerate(words[d]) if (d, i) not in gone]
        out.append((doc_id, len(words[d]), len(words[d]) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(found):
    rows = found.select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n"), F.sha2("kept", 256).alias("h")).collect()
    return sorted(map(tuple, rows), key=str)


def test_query_equals_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    found = [tuple(r)[:4] for r in queries.op8_fixed_anchors(spark, SMALL).collect()]
    assert sorted(found, key=str) == brute(docs)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 700])
def test_planted_passages(make_docs, chunk_bytes):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:  # a third of all documents hold it, whole or in part
            a = rng.randint(0, 30)
            at = rng.randint(0, len(own))
            own[at:at] = passage[a : a + rng.randint(30, 60)]
        docs.append((i, " \n".join(own)))
    docs += [(100, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (None, docs[6][1]), (None, "same " * 80), (101, "same " * 34)]
    docs += [(102, None), (103, ""), (104, "\x1c\x85 \xa0"), (105, "x y " * 3000)]
    df = make_docs(docs).withColumn("chunk", F.lit("mine")).withColumn("kept", F.lit(1))
    assert digests(anchor_dedup.remove_repeats(df, chunk_bytes=chunk_bytes)) == brute(docs)


def test_other_windows_and_empty(make_docs):
    docs = [(1, "a b c d e f"), (2, "x b c d y"), (3, "b c"), (4, "q q q q q")]
    for window in (1, 2, 3, 4):
        assert digests(anchor_dedup.remove_repeats(make_docs(docs), window=window)) == brute(docs, window)
    assert anchor_dedup.remove_repeats(make_docs(docs).limit(0)).collect() == []
