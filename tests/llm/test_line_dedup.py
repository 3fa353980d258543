"""Near-equal lines against a brute-force version and SQL."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import line_dedup, queries
from tests.compare import compare, duck
from tests.llm.conftest import SMALL


def edits(a, b):
    """Word edit distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    """docs in corpus order; (id, kept text, removed lines)."""
    seen, out = [], []
    for doc_id, text in docs:
        kept, gone = [], []
        for k, line in enumerate((text or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(w) >= 5 and any(abs(len(w) - len(s)) <= 1 and edits(w, s) <= 1 for s in seen):
                gone.append(k)
            else:
                kept.append(line)
            if len(w) >= 5:
                seen.append(w)
        out.append((doc_id, "\n".join(kept) if text is not None else None, gone))
    return sorted(out, key=str)


def result(found):
    return sorted(((r.doc_id, r.text, list(r._removed)) for r in found.collect()), key=str)


def test_query_equals_sql(spark):
    query = queries.catalogue.items["op5_deletion_lines"]
    assert compare(query.build(spark, SMALL), duck(SMALL), query.sql) is None


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 800])
def test_planted_lines(make_docs, chunk_bytes):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijklmno")
    lines = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(25)]

    def near(line):
        w = line.split()
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = [word()] * rng.randint(0, 1) or w[i : i + 1]
        return rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " ", "\r"])

    docs = [(i, "\n".join(near(rng.choice(lines)) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    # a third of all lines share a variant: they differ in one word
    docs += [(100 + i, f"total of {rng.randint(0, 9999)} items was sold\n\nonly here {i}") for i in range(60)]
    docs = [(None, docs[0][1]), *docs, (400, None), (401, ""), (402, "\n\n"), (403, "w " * 400), (404, "w " * 399 + "v"), (405, "a a a a a a"), (406, "é ü ß a b\x1c"), (407, "é ü ß a b")]
    df = make_docs(docs).withColumn("chunk", F.lit("mine")).withColumn("rest", F.lit(3)).withColumn("_", F.lit(4)).withColumn("line", F.col("doc_id"))
    found = line_dedup.remove_near_lines(df, chunk_bytes=chunk_bytes)
    assert result(found) == brute(docs)
    assert found.columns == [*df.columns, "_n_lines", "_removed"]
    assert {(r.chunk, r.rest, r._, r.line == r.doc_id) for r in found.where("doc_id is not null").collect()} == {("mine", 3, 4, True)}


def test_repeated_rows_and_empty(make_docs):
    docs = make_docs([(1, "a b c d e\nx"), (1, "a b c d e\nx")])
    assert result(line_dedup.remove_near_lines(docs)) == [(1, "a b c d e\nx", []), (1, "x", [0])]
    assert line_dedup.remove_near_lines(docs.limit(0)).collect() == []
    bare = docs.select("doc_id", "text")
    assert line_dedup.remove_near_lines(bare).count() == 2


def test_lines_that_differ_in_every_word(make_docs):
    """A Thue-Morse line and its complement agree in every sum of powers modulo 2 ** 64; so do such words."""
    signs = [bin(i).count("1") % 2 for i in range(4096)]
    line, other = (" ".join(("ab", "cd")[s ^ flip] for s in signs) for flip in (0, 1))
    long, complement = ("".join("ab"[s ^ flip] for s in signs) for flip in (0, 1))
    docs = [(1, line), (2, other), (3, line), (4, f"{long} b c d e f"), (5, f"{complement} b c x e g"), (6, f"{long} b c d e f")]
    got = {r.doc_id: (r.text, list(r._removed)) for r in line_dedup.remove_near_lines(make_docs(docs)).collect()}
    assert got[2] == (other, []) and got[5][1] == [] and got[3] == ("", [0]) and got[6] == ("", [0])


def test_words_are_hashed_in_blocks():
    """The hashes are those of each word alone, and what they take grows with the words, not with all bytes at once."""
    rng = random.Random(5)
    words = [bytes(rng.choices(range(97, 123), k=rng.choice([1, 7, 300, 1000]))) for _ in range(6000)]
    words[50], words[51] = words[9], b"y" * (3 * line_dedup._BLOCK)
    blanks = [b" ", b"  ", b"\n", b" " * (2 * line_dedup._BLOCK)]
    text = b"".join(w + (blanks[i % 3] if i % 3000 else blanks[3]) for i, w in enumerate(words))
    rows = pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text], pa.binary()), "chunk": pa.array([0], pa.int32())})
    tracemalloc.start()
    found = line_dedup._Lines(rows, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < max(32 << 20, 24 * len(text))  # an array of 31 MB is freed untouched
    assert [text[a:b] for a, b in zip(found.begin, found.end)] == words

    def alone(word):
        value = sum(int(line_dedup._BYTE_VALUES[c]) * pow(line_dedup.BASES[0], k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)
        return int(line_dedup.mix(np.array([value], dtype=np.uint64))[0])

    short = [i for i in range(0, 6000, 7) if len(words[i]) <= line_dedup._LONG_WORD]
    assert [int(found.word[i]) for i in short] == [alone(words[i]) for i in short]
    assert found.word[50] == found.word[9]


@pytest.mark.parametrize("parts", [1, 3, 277])
def test_short_hashes_keep_the_order(parts):
    h = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64))
    h[-1], h[0] = (1 << 64) - 1, 0
    cut = line_dedup.bounds(h, parts)
    short = line_dedup._short(h, cut, parts)
    assert int(short.max()) < 1 << 8 * line_dedup._SHORT
    assert all((np.diff(short[a:b].astype(np.int64)) >= 0).all() for a, b in zip(cut[:-1], cut[1:]))
    values = np.unique(h[::50])
    assert set(h[line_dedup._among(h, values, 64)].tolist()) == set(values.tolist())
    assert len(line_dedup._among(h, values[:0], 64)) == 0
