"""Counts and base scores by hand, the mixture as a distribution, weights against held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import lm_score, queries
from tests.llm.conftest import SMALL


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(docs, weights):
    word, pair = Counter(), Counter()
    for doc_id, text in docs:
        if not held(doc_id):
            t = tokens(text)
            word.update(t)
            pair.update(zip(["</s>", *t], t))
    total, distinct = sum(word.values()), len(word)
    out = []
    for doc_id, text in docs:
        t = tokens(text)
        base = sum(math.log10((word[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t)
        score = 0.0
        for v, x in zip(["</s>", *t], t):
            a, b, c = weights[min(word[v].bit_length(), lm_score.BUCKETS - 1)]
            score += math.log10(a * pair[v, x] / max(word[v], 1) + b * word[x] / max(total, 1) + c / (distinct + 1))
        out.append((doc_id, held(doc_id), len(t), sum(word[x] > 0 for x in t), total, base, score))
    return out, word, pair


def same(rows, want):
    rows, want = sorted(map(tuple, rows), key=str), sorted(want, key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    for r, w in zip(rows, want):
        assert r[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk_bytes", [12 << 20, 60_000])
def test_scores_by_hand(spark, documents, chunk_bytes):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    _, total, distinct, weights = lm_score.fit(documents, chunk_bytes=chunk_bytes)
    want, word, _ = brute(docs, weights)
    assert (total, distinct) == (sum(word.values()), len(word))
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0
    same(lm_score.score(documents, chunk_bytes=chunk_bytes).collect(), want)


def test_query_beats_the_base_on_held_out_text(spark):
    rows = queries.op9_deleted_interpolation(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.b < rows.s < 0


def test_probabilities_of_a_context_sum_to_one(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.limit(40).collect()]
    _, total, distinct, weights = lm_score.fit(documents.limit(40))
    _, word, pair = brute(docs, weights)
    for v in [w for w, _ in word.most_common(5)] + ["never seen"]:
        a, b, c = weights[min(word[v].bit_length(), lm_score.BUCKETS - 1)]
        known = sum(a * pair[v, x] / max(word[v], 1) + b * word[x] / total + c / (distinct + 1) for x in word)
        # a context at a text's end is followed by the next text's first word or nothing
        assert known + c / (distinct + 1) == pytest.approx(1.0, abs=1e-9)


def test_weights_recover_a_mixture():
    """Tokens drawn from a known mixture of two estimates give its weights back."""
    rng = np.random.default_rng(2)
    n = 200_000
    p_pair, p_word = 2.0 ** -rng.integers(1, 8, n), 2.0 ** -rng.integers(4, 12, n)
    mixed = 0.7 * p_pair + 0.3 * p_word
    cells = (5 * lm_score._CELLS + lm_score._cell(p_pair)) * lm_score._CELLS + lm_score._cell(p_word)
    found = lm_score.mixture_weights(cells, mixed / mixed.mean(), 1e-12)[5]
    best = max(np.linspace(0, 1, 201), key=lambda a: (mixed * np.log(np.maximum(a * p_pair + (1 - a) * p_word, 1e-300))).sum())
    assert found[0] == pytest.approx(best, abs=0.02)


def test_edge_rows(make_docs):
    docs = [(1, None), (1, ""), (None, "A a"), (None, "a A"), (6, "x " * 30000), (7, "b\x1cb É é"), (2, "a b"), (2, "a b")]
    df = make_docs(docs).withColumn("chunk", F.lit("mine")).withColumn("order", F.lit(0)).withColumn("score", F.lit("x"))
    _, _, _, weights = lm_score.fit(df)
    same(lm_score.score(df).collect(), brute(docs, weights)[0])
    assert lm_score.score(df.limit(0)).collect() == []
    only_held = [i for i in range(60) if held(i)][:3]
    docs = [(i, "q r") for i in only_held]
    _, total, distinct, weights = lm_score.fit(make_docs(docs))
    assert (total, distinct) == (0, 0)
    same(lm_score.score(make_docs(docs)).collect(), brute(docs, weights)[0])
