"""Text statistics against regular expressions, the learned list against held-out labels, edge rows."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarmac.llm import quality_rules, queries
from tests.llm.conftest import SMALL


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_query_statistics_and_base(spark, documents):
    expected = {r.doc_id: brute(r.text) for r in documents.collect()}
    rows = queries.op3_decision_list(spark, SMALL).collect()
    assert {r.doc_id: columns(r) for r in rows} == expected and len(rows) == len(expected)
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and r.kept == (not failed and r.rule is None)


def test_held_out_accuracy(spark):
    """Learned on the documents of one half of the sources, judged on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("half", F.crc32("source") % 2)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality_rules.fit(docs.where("half = 0"), labels)
    assert 1 <= len(rules.rules) <= 16 and "reject if" in str(rules)
    judged = quality_rules.judged(docs.where("half = 1").join(labels, "doc_id"), rules).where("not _base_failed")
    n = {(r.quality, r.kept): r.n for r in judged.groupBy("quality", F.col("_kept").alias("kept")).agg(F.count("*").alias("n")).collect()}
    assert n.get((0, False), 0) >= 0.95 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]


def test_learner_finds_a_conjunction():
    rng = np.random.default_rng(3)
    counts = {c: rng.integers(1, 100, 3000) for c in quality_rules.COUNTS}
    bad = (counts["n_words"] >= 60) & (counts["n_lines"] * 2 >= counts["n_words"])
    rules = quality_rules.learn(counts, bad, precision=0.9)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules.rules:
        hit |= quality_rules._covered(quality_rules._features(counts), rule)
    assert (hit == bad).mean() > 0.95
    assert quality_rules.learn(counts, np.zeros(3000, dtype=bool)).rules == []


def test_edge_rows(spark, make_docs):
    texts = [None, "", "  \n\t ", "a b c a b c", "x x x x", "#|<> &\n\n#|<> &\n #|<> &", "é ü z", "w " * 200000, "one two"]
    docs = make_docs([(i if i else None, t) for i, t in enumerate(texts)] + [(4, "x x x x")]).withColumn("quality", F.lit("own")).withColumn("kept", F.lit(7))
    none = quality_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.rules == []
    odd = spark.createDataFrame([(None, 0), (1, None), (2, 5), (3, 0), (3, 1), (99, 0)], "doc_id long, quality int")
    assert quality_rules.fit(docs, odd).rules == []
    rows = quality_rules.judged(docs, none).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert columns(r._counts) == brute(r.text)
    assert quality_rules.judged(docs.limit(0), none).collect() == []
