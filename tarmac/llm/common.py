"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpointing

#: \n, the other ASCII space characters and the blank: what ``bytes.split()`` splits at.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the folder the cluster names."""
    ensure_checkpointing(df.sparkSession)
    return df.checkpoint()


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose ``column`` holds about ``limit`` bytes; a longer value is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place: every input bit reaches every output bit."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
