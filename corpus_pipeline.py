"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it
kept, and returns a DataFrame with the columns of ``documents``; the last returns
the packed pieces.  ``run`` writes each stage as Parquet into the shared folder and
reads it again, so a lost executor never reaches back beyond a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import line_dedup, packing, quality_rules, secrets, simhash
from tarmac.llm.common import table
from tarmac.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs.select(F.struct("*").alias("row"), "text"), rules).where("_kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier near-equal one go; a document goes if its text did so with them.

    A document of whose lines nothing with a word is left consisted of copies, all
    of them kept where they stood first.  Documents without removed lines stay as
    they are, also empty ones.
    """
    found = line_dedup.remove_near_lines(docs)
    whole = F.size("_removed") == 0
    left = whole | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(left).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text"))).select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: fingerprints of shingles of three words, linked at three bits or fewer."""
    return simhash.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    return secrets.mask(docs).withColumn("n_chars", F.char_length("text")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut into pieces and packed into sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_copy_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The learned list, SimHash's XXH64 and the tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
