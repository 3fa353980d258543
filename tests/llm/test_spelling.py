"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import queries, spelling
from tests.compare import compare, duck
from tests.llm.conftest import SMALL


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_words(docs, least=7, every=31):
    tally = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least:
                tally[run] += 1
    return {w: n for w, n in tally.items() if n >= 2}


def brute(words):
    forms, out = {}, []
    for w, n in words.items():
        by = sorted((-m, v) for v, m in words.items() if near(w, v))
        if by and -by[0][0] >= 10 * n:
            forms[w] = by[0]
        out.append((w, n, len(by)))
    rows = []
    for w, n, k in out:
        root = w
        while root in forms:
            root = forms[root][1]
        rows.append((w, n, k, forms[w][1] if w in forms else None, -forms[w][0] if w in forms else None, root))
    return sorted(rows)


def told(found):
    return sorted(map(tuple, found.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_query_equals_its_sql(spark):
    found = queries.op12_spelling_variants(spark, SMALL)
    assert compare(found, duck(SMALL), queries.catalogue.items["op12_spelling_variants"].sql) is None
    assert found.where("form IS NOT NULL").count() > 0


def test_pairs_of_an_acceptor():
    rng = random.Random(4)
    for size in (0, 1, 2, 30, 150):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(size)})
        a = spelling.Acceptor(words)
        pairs = spelling.one_edit_pairs(a)
        assert a.sizes[a.start] == len(words)
        assert sorted(tuple(sorted(p)) for p in pairs) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]
        assert all(len(words[i]) <= len(words[j]) for i, j in pairs)
        if size == 150:
            assert len(a.finals) < len({w[:k] for w in words for k in range(len(w) + 1)})  # fewer states than prefixes


@given(st.sets(st.text("abé", min_size=1, max_size=5), max_size=40))
@settings(max_examples=150, deadline=None)
def test_any_words(words):
    listed = sorted(words)
    pairs = spelling.one_edit_pairs(spelling.Acceptor(listed))
    assert sorted(tuple(sorted(p)) for p in pairs) == [(i, j) for i in range(len(listed)) for j in range(i + 1, len(listed)) if near(listed[i], listed[j])]


def test_very_long_words():
    """Deep machines: no recursion, no time that grows with the square of the length."""
    word = "ab" * 50_000
    words = sorted({word, word[:700] + word[701:], word + "b", word[:-1] + "c", "x" * 90_000, "x" * 90_001})
    pairs = {frozenset((words[i], words[j])) for i, j in spelling.one_edit_pairs(spelling.Acceptor(words))}
    assert pairs == {frozenset(p) for p in ((word, word[:700] + word[701:]), (word, word + "b"), (word, word[:-1] + "c"), ("x" * 90_000, "x" * 90_001))}


@pytest.mark.parametrize("most", [20_000, 3])
def test_crowded_partitions(spark, most):
    rng = random.Random(5)
    # a third of the words share all but a few code points
    words = {"commonhead" + "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 4))) + "commontail": rng.choice([2, 3, 40, 500]) for _ in range(150)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))): rng.choice([2, 30, 400, 5000]) for _ in range(200)}
    words |= {"x" * k: k * 2 for k in range(7, 20)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert told(spelling.variants(df, most=most)) == brute(words)
    if most == 3:
        sizes = spelling.partitions(df, most).groupBy("key", "base", "head", "tail").count().where("base - head - tail > 1").agg({"count": "max"}).first()[0]
        assert sizes <= most


def test_documents(spark, make_docs):
    rng = random.Random(6)
    vocabulary = ["Separate", "sepárate", "definitely", "définitely", "Àÿ×÷abc", "runaways", "runaway", "short"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(40)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (1, docs[1][1]), (50, None), (51, ""), (52, "définitly2definitly"), (53, "definitly DEFINITLY" * 400), (54, "Āabcdefg abcdefg")]
    found = spelling.vocabulary(make_docs(docs))
    assert dict(map(tuple, found.collect())) == brute_words(docs)
    assert told(spelling.variants(found)) == brute(brute_words(docs))


def test_roots_of_chains(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 2001, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = {r.word: r for r in spelling.variants(df).collect()}
    assert rows["abcdefg"].root == rows["abcdefghi"].root == "abcdefghij" and rows["zzzzzzz"].form == "zzzzzzx"
    assert told(spelling.variants(df)) == brute(words)


def test_empty_tables(spark, make_docs):
    assert spelling.variants(spelling.vocabulary(make_docs([]))).count() == 0
    assert spelling.variants(spelling.vocabulary(make_docs([(1, None)]))).count() == 0
