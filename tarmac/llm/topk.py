"""Exact top-k by inner product: columnar branch-and-bound.

Vectors lie in blocks, dimension by dimension (vertical layout).  A query adds up
its products block of dimensions by block of dimensions.  What the remaining
dimensions can still add is at most the product of the remaining masses (norms) of
query and candidate; candidates whose upper bound is below the k-th best lower
bound are dropped, and the survivors are moved together before the next step.

Queries are packed into blocks too and visit every candidate block, one after the
other, so a task holds one block of each.  Only the k best of a block go on.

Components become ``floor(1024 * x)``; sums are exact (in doubles where these hold
all integers that occur, else in whole numbers, cut to the range of a long).
Vectors that are null or have a null or non-finite component, and rows without an
id, take no part.  A vector that is too short counts as zero beyond its end.  Rows
that repeat id and vector are candidates each and queries each; rows that share an
id with a query are its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES, STEP = 4096, 128, 16
_PACKED = "block int, kind int, part int, dims int, ids binary, vectors binary"


def _pack(rows: pa.Table, kind: int) -> pa.Table:
    """One row: ids ascending and the matrix of dimensions by vectors."""
    lists = rows.column("vector").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    dims = int(sizes.max())
    matrix = np.zeros((len(sizes), dims))
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(1024 * lists.flatten().to_numpy()), -np.finfo(float).max, np.finfo(float).max)
    matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    ids = rows.column("id").to_numpy()
    order = np.lexsort((*matrix.T[::-1], ids))
    ids, matrix = ids[order], matrix[order]
    number = rows.column("part")[0].as_py()
    return pa.table(
        {"block": pa.array([number if kind == 0 else 0], pa.int32()), "kind": pa.array([kind], pa.int32()), "part": pa.array([number], pa.int32()), "dims": pa.array([dims], pa.int32()),
         "ids": [ids.astype("<i8").tobytes()], "vectors": [np.ascontiguousarray(matrix.T).tobytes()]}
    )


class Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.values = np.frombuffer(row["vectors"], float).reshape(row["dims"], len(self.ids))
        self.most = float(np.abs(self.values).max(initial=0.0))
        #: norms of what follows each step of dimensions
        with np.errstate(over="ignore"):
            squares = np.cumsum((self.values**2)[::-1], axis=0)[::-1] if row["dims"] else np.zeros((0, len(self.ids)))
        self.rest = np.sqrt(np.vstack([squares, np.zeros((1, len(self.ids)))]))


def best_of_block(query: np.ndarray, query_rest: np.ndarray, query_id: int, block: Block, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best candidates, ties to smaller ids."""
    dims = min(len(query), len(block.values))
    alive = np.flatnonzero(block.ids != query_id)
    partial = np.zeros(len(alive))
    exact = dims * float(np.abs(query).max(initial=0.0)) * block.most < 2**53
    if not exact:
        return _in_whole_numbers(query[:dims], block, alive, k)
    for a in range(0, dims, step):
        b = min(a + step, dims)
        partial = partial + query[a:b] @ block.values[a:b, alive]
        if b == dims or len(alive) <= k:
            continue
        slack = query_rest[b] * block.rest[b, alive] * (1 + 1e-12) + 1e-6
        low = partial - slack
        floor = np.partition(low, len(low) - k)[len(low) - k]
        stay = partial + slack >= floor
        if stay.sum() < 0.8 * len(alive):
            alive, partial = alive[stay], partial[stay]
    return _best(alive, partial.astype(np.int64), block, k)


def _best(alive: np.ndarray, scores: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(alive) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        top = np.flatnonzero(scores >= floor)
    else:
        top = np.arange(len(alive))
    top = top[np.lexsort((block.ids[alive[top]], ~scores[top]))]  # ~ turns the order without overflow
    return block.ids[alive[top[:k]]], scores[top[:k]]


def _in_whole_numbers(query: np.ndarray, block: Block, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    q = [int(x) for x in query]
    scores = [sum(x * int(y) for x, y in zip(q, column)) for column in block.values[: len(q), alive].T]
    return _best(alive, np.array([max(-(2**63), min(2**63 - 1, s)) for s in scores], dtype=np.int64), block, k)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    block, number = None, None
    for batch in batches:
        found = []
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["kind"] == 0:
                block, number = Block(row), row["block"]
            elif row["block"] == number:
                asked = Block(row)
                for j, query_id in enumerate(asked.ids.tolist()):
                    ids, scores = best_of_block(asked.values[:, j], asked.rest[:, j], query_id, block, k)
                    found.append((np.full(len(ids), query_id), np.full(len(ids), row["part"]), np.full(len(ids), j), ids, scores))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "part", "place", "vec_id", "score"])


def exact_topk(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows where ``queries`` holds, against all other rows."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731 - NaN is above every number
    own = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("query"))
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(F.forall("vector", finite))
    )
    size = own.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    n_blocks, n_parts = max(1, -(-size.n // BLOCK)), max(1, -(-size.q // QUERIES))
    packed = lambda rows, n, kind: rows.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")).groupBy("part").applyInArrow(lambda t: _pack(t, kind), _PACKED)
    asked = packed(own.where("query"), n_parts, 1).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = packed(own, n_blocks, 0).unionByName(asked).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")
    found = met.mapInArrow(lambda batches: _search(batches, k), "query_id bigint, part int, place int, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "part", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
