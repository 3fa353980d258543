"""Phrase collocations against a brute-force version."""

import random
import re
from collections import Counter

import pytest

from tarmac.llm import collocations, queries
from tests.compare import compare, duck
from tests.llm.conftest import SMALL


def brute(docs, least, share=80, top=2000, longest=4):
    counts, totals = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, found in counts.items():
        rows = []
        for phrase, a in found.items():
            if len(phrase) < 2 or a < least:
                continue
            if any(100 * b >= share * a for longer, b in found.items() if b >= least and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))):
                continue
            score, _, l, r = min((2_000_000 * a // (found[phrase[:k]] + found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase)))
            rows.append((-score, -a, " ".join(phrase).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def told(found):
    return sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_query_equals_its_sql(spark):
    sf = SMALL.replace("0.001", "0.01")
    found = queries.op13_phrase_collocations(spark, sf)
    assert compare(found, duck(sf), queries.catalogue.items["op13_phrase_collocations"].sql) is None
    assert found.count() > 100


def texts(rng):
    vocabulary = ["New", "york", "city", "hall", "of", "the", "Ünder", "x\x1cy", " "]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs = []
    for i in range(90):
        own = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", " ", ", ", ".\r\n"]) for _ in range(rng.randint(0, 50)))
        docs.append((own + passage if i % 3 == 0 else own, rng.choice(["en", "en", "fr", None, "und"])))
    docs += [docs[0]] * 30 + [(None, "en"), ("", None), (" ,.", "xx"), ("the same " * 500, "long"), ("a", "one")]
    return docs


@pytest.mark.parametrize(("mean", "chunk_bytes"), [(24, 1 << 20), (1, 3000), (3, 900), (10**6, 2000)])
def test_planted(spark, mean, chunk_bytes):
    docs = texts(random.Random(7))
    df = spark.createDataFrame([(*d, "mine", 1) for d in docs], "text string, lang string, phrase string, a int")
    for least, top in ((5, 2000), (30, 7)):
        found = collocations.collocations(df, least=least, top=top, mean=mean, chunk_bytes=chunk_bytes)
        assert told(found) == brute(docs, least, top=top)


def test_parse_owns_each_word_once_and_repeats():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(2000)).encode()
    other = " ".join(word() for _ in range(700)).encode()
    alone = list(collocations.parse([passage], 24, 4))
    assert sum(own for _, own, _ in alone) == 2000 and 40 < len(alone) < 200
    both = list(collocations.parse([other + b" " + passage, b"", passage + b". " + other], 24, 4))
    assert sum(own for _, own, _ in both) == 5400
    shared = {(own, body) for _, own, body in alone} & {(own, body) for t, own, body in both if t == 0}
    assert len(shared) >= len(alone) - 2  # but for the first and the last chunk the passage parses alike


def test_large_counts(spark):
    """Scores are exact where products pass 64 bits."""
    one = collocations.phrase_counts(spark.createDataFrame([("a b", "en")] * 40, "text string, lang string"))
    assert {(r.phrase, r.a) for r in one.collect()} == {("a", 40), ("b", 40), ("a b", 40), (None, 80)}
    big = 4 * 10**18
    expr = f"CAST((CAST({big} AS DECIMAL(20,0)) * 2000000) DIV (CAST({big} AS DECIMAL(20,0)) + {big}) AS BIGINT)"
    assert spark.sql(f"SELECT {expr}").first()[0] == 1_000_000


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string"), least=1).count() == 0
