"""Every stage against a brute-force version of its decision, on the stage's own input."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarmac.llm import quality_rules
from tests.llm import test_line_dedup, test_packing, test_quality_rules, test_secrets, test_simhash
from tests.llm.conftest import SMALL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after every stage."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    assert all(df.columns == COLUMNS for df in stages[:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, stages):
    rules = quality_rules.fit(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    rejected = {r.doc_id for r in quality_rules.judged(stages[0], rules).where("_rule is not null").collect()}
    want = set()
    for r in stages[0].collect():
        n_words, _, _, _, repeated = test_quality_rules.brute(r.text)
        if n_words >= 50 and 100 * repeated <= 50 * n_words and r.doc_id not in rejected:
            want.add(r)
    assert set(stages[1].collect()) == want and 0 < len(want) < stages[0].count()


def test_lines(stages):
    before = stages[1].orderBy("doc_id").collect()
    want = {i: text for i, text, gone in test_line_dedup.brute([(r.doc_id, r.text) for r in before]) if not gone or text.strip(" \t\n\x0b\x0c\r")}
    got = by_id(stages[2])
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_copies(stages):
    before = [(r.doc_id, test_simhash.brute_print(r.text)) for r in stages[2].collect()]
    want = {c for c in test_simhash.brute_components(before)}
    assert sorted(by_id(stages[3])) == sorted(want)
    assert set(stages[3].collect()) <= set(stages[2].collect())


def test_secrets_are_gone_and_documents_stay(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        n = sum(test_secrets.brute(before[i].text)[:3])
        assert sum(test_secrets.brute(r.text)[:3]) == 0 and (r.text.count("[SECRET]") > 0) >= (n > 0)
        if "[SECRET]" not in r.text:
            assert r == before[i]


def test_pieces_and_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, *p) for r in stages[4].collect() for p in test_packing.want_pieces(library.encode(r.text, add_special_tokens=False).ids))
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    test_packing.check_packing(rows)


def test_run_equals_its_stages(spark, stages):
    pieces = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, SMALL)) == pieces(stages[5])


@pytest.mark.parametrize("k", range(5))
def test_edge_rows_and_empty_tables(spark, make_docs, k):
    docs = make_docs([(None, None), (1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "x " * 3000)])
    stage = corpus_pipeline.STAGES[k][1]
    stage(spark, docs, SMALL).collect()
    out = stage(spark, docs.limit(0), SMALL)
    assert out.collect() == [] and (k == 4 or out.columns == COLUMNS)
    more = docs.withColumn("_counts", F.lit(1)).withColumn("_fp", F.lit("x")).withColumn("_added", F.lit(2)).withColumn("text_key", F.lit(3))
    out = stage(spark, more, SMALL)
    out.collect()
    assert k == 4 or out.columns == more.columns
