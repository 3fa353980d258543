"""Questions that chunks of documents put to hash partitions, packed.

One row per text position does not pay at corpus size.  Documents are dealt into
chunks of bounded size (by a hash of the whole row, so that no source or group of
copies gathers in one).  A chunk asks each hash partition about its *distinct*
hashes with one row that holds them as packed bytes, and gets the answer as one
row; a hash that a third of all documents hold comes once per chunk.  Both sides
are grouped maps over Arrow tables; Spark shuffles, and a lost executor's groups
are computed again, as all of it is a function of the chunk's rows.

``chunk_bytes`` bounds what a task holds, and with it the number of chunks and
hash partitions; it should grow with the root of the corpus (the default fits up
to about a terabyte of text).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import mix, text_bytes

CHUNK_BYTES = 8 << 20

#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, *others: str) -> tuple[DataFrame, int]:
    """Rows ``doc_id``, ``text`` (bytes), ``chunk`` and ``others``, hashed by chunk; and the number of chunks."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), *others)
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    return dealt.repartition(n, "chunk"), n


def in_order(rows: pa.Table) -> pa.Table:
    """A chunk's documents by id (null first), then text."""
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return rows.take(order)


class WordHashes(dict):
    """64-bit hash by word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and each document's first place (one more at the end)."""
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    known = WordHashes()
    return np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(starts[-1])), starts


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values, by differences of a running sum."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        inverse = pow(base, -1, 1 << 64)
        self.sums = np.full(n + 1, base, dtype=np.uint64)
        powers = self.sums[1:]
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        powers *= values
        np.cumsum(powers, out=powers)
        self.sums[0] = 0
        self.back = np.full(n + 1, inverse, dtype=np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.back[starts]
        return mix(h)


def bounds(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash partition begins in sorted hashes: partitions are ranges of the leading 32 bits."""
    edges = np.array([((p << 32) // parts) << 32 for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))


def low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]


def wide(data: bytes, width: int) -> np.ndarray:
    """The values whose low bytes these are."""
    part = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), dtype=np.uint8)
    out[:, :width] = part
    return out.view("<u8").ravel()


def ask(chunks: DataFrame, question: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``question`` of every chunk; its schema has the columns ``p`` (hash partition) and ``chunk``."""
    return chunks.groupBy("chunk").applyInArrow(question, schema)


def answer(asked: DataFrame, n: int, reply: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``reply`` of every hash partition to all that it is asked; its schema has ``chunk``."""
    return asked.repartition(n, "p").groupBy("p").applyInArrow(reply, schema)


def with_answers(chunks: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``use`` of every chunk's documents and its answers (an empty table if there are none)."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(use, schema)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
