"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import bpe, queries
from tests.llm.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(6)
    pick = lambda: chr(rng.choice([rng.randint(1, 127), rng.randint(1, 127), rng.randint(128, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)]))
    texts = ["", "<|endoftext|>a <|startoftext|><|x <|endoftext|", "ΑΣ ΣΑΣ İI ﬁ Å é \u0085x y  z\n\n aaaaaaaa AAAAAAAAA 'S don't I'LL we'RE", "\x00\x1c\x1d\x7f", " \t\n", "aab" * 5000, "l" * 4001, "x y " * 20000]
    return texts + ["".join(pick() for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_group_equals_library(library):
    texts = odd_texts()
    ids, offsets, decoded = bpe.Encoder(bpe.Merges(PATH))([t.encode() for t in texts])
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids, texts[i]
        assert decoded[i] == library.decode(e.ids, skip_special_tokens=False)
    ids, offsets, decoded = bpe.Encoder(bpe.Merges(PATH))([])
    assert len(ids) == 0 and offsets.tolist() == [0] and decoded == []


def test_remembered_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 400)
    encoder, texts = bpe.Encoder(bpe.Merges(PATH)), odd_texts()
    for a in range(0, len(texts), 50):
        ids, offsets, decoded = encoder([t.encode() for t in texts[a : a + 50]])
        for i, e in enumerate(library.encode_batch(texts[a : a + 50], add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids


def test_query_equals_library(spark, documents, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in documents.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_pair_index_bpe(spark, SMALL).collect()} == want


def test_edge_rows(make_docs, library):
    docs = make_docs([(None, "Same text"), (1, None), (1, None), (2, ""), (3, "Same text")]).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(0))
    same = library.encode("Same text", add_special_tokens=False).ids
    rows = sorted(((str(r.doc_id), list(r.ids), r.decoded) for r in bpe.encode(docs, PATH, group_bytes=8).collect()))
    text = library.decode(same, skip_special_tokens=False)
    assert rows == [("1", [], ""), ("1", [], ""), ("2", [], ""), ("3", same, text), ("None", same, text)]
    assert bpe.encode(docs.limit(0), PATH).collect() == []
