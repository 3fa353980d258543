"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into blocks, so that two fingerprints with few
differing bits agree in several whole blocks.  They meet on those blocks, and the
Hamming distance is verified.

Documents with equal fingerprints are one node (exact copies never meet in
pairs).  A crowded block value is dealt out in pieces: its commonest case, a dense
group around one fingerprint, is linked to that fingerprint by one join, and only
what stays further away is compared with the rest, piece against piece.  Each
comparison returns a spanning forest and not all pairs, so no link between
groups is lost and none is written twice.

A null text is empty; a text without a word has fingerprint zero.  A null id takes
part as a document without a number: it is never the smallest of a component that
has numbers, and a component of such rows only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tarmac.llm.common import saved, text_bytes
from tarmac.llm.components import connected_components
from tarmac.session import scratch_path

#: Rows of one block value that are compared in one piece.
PIECE = 2048


def simhash(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a text: bit set if set in over half its shingles' XXH64."""
    words = data.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@arrow_udf(T.LongType())
def simhash_text(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([simhash(x.as_py()) for x in texts], dtype=np.uint64).view(np.int64))


def masks(distance: int, blocks: int) -> list[int]:
    """Bits of every choice of ``blocks - distance`` blocks, as signed longs: a near pair agrees on all bits of one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (x, y) between two lists of fingerprints that join whatever near pairs join.

    From a found member outwards: what is reached leaves the unreached rest, so a
    dense group costs a few passes.  Near pairs within ``a`` or within ``b`` count too.
    """
    every = np.unique(np.concatenate([a, b])).view(np.uint64)
    rest, links = every, []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                links += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
                todo += list(found)
                rest = rest[~near]
    return links


def near_links(prints: DataFrame, distance: int = 3, blocks: int = 6, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` (long), enough to connect all near pairs."""
    cut = masks(distance, blocks)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in cut])).alias("mask", "value"))
    met = keyed.groupBy("mask", "value").agg(
        F.count("*").alias("n"), F.min("fp").alias("pivot")
    ).where("n > 1")
    members = saved(keyed.join(met, ["mask", "value"]))
    to_pivot = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= distance
    pivots = members.where(to_pivot & (F.col("fp") != F.col("pivot"))).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    # what is not next to the pivot meets everything, itself in pieces
    far = members.where(~to_pivot)
    pieces = F.ceil(F.col("n") / F.lit(piece)).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    open_values = far.groupBy("mask", "value").agg(F.count("*").alias("n_far"))
    meeting = members.join(open_values, ["mask", "value"])
    far_pieces = F.ceil(F.col("n_far") / F.lit(piece)).cast("int")
    own_far = F.pmod(F.xxhash64("fp"), far_pieces).cast("int")
    queries = meeting.where(~to_pivot).select("mask", "value", own_far.alias("i"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("j"), "fp", F.lit(True).alias("query"))
    targets = meeting.select("mask", "value", F.explode(F.sequence(F.lit(0), far_pieces - 1)).alias("i"), own.alias("j"), "fp", F.lit(False).alias("query"))
    compared = (
        queries.unionByName(targets)
        .repartition("mask", "value", "i", "j").sortWithinPartitions("mask", "value", "i", "j")
        .mapInArrow(lambda batches: _compare(batches, distance), "a bigint, b bigint")
    )
    return pivots.unionByName(compared)


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    key = None

    def links() -> pa.RecordBatch:
        fp = np.concatenate(held)
        found = np.array(_forest(fp[:0], fp, distance), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        k = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("mask", "value", "i", "j")])
        fp = batch.column("fp").to_numpy()
        starts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), len(fp)] if len(fp) else []
        for s, e in zip(starts, starts[1:]):
            this = tuple(k[:, s])
            if key is not None and this != key:
                yield links()
                held = []
            key = this
            held.append(fp[s:e])
    if held:
        yield links()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, blocks: int = 6) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``component_id`` (least id reachable)."""
    prints = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash_text(text_bytes(text_col)).alias("fp")))
    return prints.join(_classes(prints, distance, blocks), "fp").select("doc_id", "fp", "component_id")


def _classes(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fp``, ``root`` (a fingerprint of its component) and ``component_id`` for every distinct fingerprint."""
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(nodes, distance, blocks))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return saved(rooted.join(least, "root").select("fp", "root", "component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, blocks: int = 6) -> DataFrame:
    """One document of each component of near copies: that of the smallest id, null ids last.

    Rows that repeat an id and a fingerprint are copies too; one of them stays.
    Rows are written once with their fingerprint and a number; only numbers are
    grouped, and whole rows stream past the kept ones, without a sort.
    """
    path = scratch_path(docs.sparkSession, "fingerprints")
    # whole rows are carried as one column, so that no name of theirs can clash
    docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        simhash_text(text_bytes(text_col)).alias("fp"), F.monotonically_increasing_id().alias("number"),
    ).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "fp", "number")).alias("first")
    stay = rows.select("doc_id", "fp", "number").join(_classes(rows.select("doc_id", "fp"), distance, blocks), "fp").groupBy("root").agg(first).select("first.number")
    return rows.join(stay.hint("shuffle_hash"), "number", "left_semi").select("row.*")
