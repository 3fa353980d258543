"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of a word given its predecessor, of a word alone and
of any word are mixed.  The mixture weights depend on how often the context was
seen (buckets of powers of two) and are learned by expectation-maximisation on
held-out counts: every training token is held out in turn, by taking it from the
counts of its own n-grams.

Counts cover all training documents.  Chunks of documents ask hash partitions
about their distinct n-grams with packed rows (``chunks``), so a word or pair that
a third of all tokens are comes once per chunk.  Of the held-out tokens only the
histogram of their estimates, on a grid of fixed size, reaches the driver.

Null texts are empty and consist of the end token.  A document whose id is null
is a training document.  Every row counts, also if it repeats another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm import chunks
from tarmac.llm.chunks import BASES, batch, bounds, in_order, word_hashes
from tarmac.llm.common import mix, saved

CHUNK_BYTES = 12 << 20
#: Bytes kept of a pair's hash next to its partition; single words keep all eight.
_WIDTH = {1: 8, 2: 5}
#: Context counts share a weight by their number of bits, up to this.
BUCKETS = 24
#: Grid of the held-out estimates: steps per factor of two, and the least exponent.
_STEPS, _LEAST = 4, 40
_CELLS = _STEPS * _LEAST + 2

_ASK = pa.schema([("p", pa.int32()), ("chunk", pa.int32()), ("order", pa.int32()), ("size", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("p", pa.int32()), ("order", pa.int32()), ("owned", pa.int64()), ("counts", pa.binary())])
_SEEN = pa.schema([("owned", pa.int64()), ("trained", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("counts", pa.binary())])
_DDL = {
    "ask": "p int, chunk int, order int, size int, hashes binary, counts binary",
    "reply": "chunk int, p int, order int, owned bigint, counts binary",
    "seen": "owned bigint, trained bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<bigint>, counts binary",
}


def packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return pa.Codec("zstd").compress(planes, asbytes=True) if planes else b""


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(data, n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def held_out_id(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class _Chunk:
    """A chunk's tokens and its distinct n-grams by order, sorted by hash."""

    def __init__(self, rows: pa.Table, n: int):
        self.number = rows.column("chunk")[0].as_py()
        self.rows = in_order(rows)
        self.doc_ids = self.rows.column("doc_id").to_pylist()
        words = [[*t.lower().split(), b""] for t in self.rows.column("text").to_pylist()]  # no word is empty: the end
        word, self.starts = word_hashes(words)
        del words
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.starts[:-1]] = word[-1]
        self.held_out = [held_out_id(i) for i in self.doc_ids]
        self.trains = np.repeat(~np.array(self.held_out), np.diff(self.starts))
        self.grams = {}
        for order, h in ((1, word), (2, mix(before * np.uint64(BASES[0]) + word))):
            distinct, index = np.unique(h, return_inverse=True)
            self.grams[order] = distinct, index, bounds(distinct, n)


def _by_low(hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the hashes that are sent, and their order."""
    low = hashes & np.uint64((1 << 8 * _WIDTH[order]) - 1)
    return low, np.argsort(low, kind="stable")


def _question(rows: pa.Table, n: int) -> pa.Table:
    c, out = _Chunk(rows, n), []
    for order, (distinct, index, cut) in c.grams.items():
        counts = np.bincount(index, weights=c.trains, minlength=len(distinct)).astype(np.uint64)
        for p in np.flatnonzero(np.diff(cut)):
            s = slice(cut[p], cut[p + 1])
            low, rank = _by_low(distinct[s], order)
            # sorted low bytes lie close together: their differences pack well
            steps = np.diff(low[rank], prepend=np.uint64(0))
            out.append((p, c.number, order, s.stop - s.start, packed(steps, _WIDTH[order]), packed(counts[s][rank], 4)))
    return batch(_ASK, out)


def _reply(asked: pa.Table) -> pa.Table:
    rows, out = asked.to_pylist(), []
    for order in (1, 2):
        part = [r for r in rows if r["order"] == order]
        if not part:
            continue
        size = [r["size"] for r in part]
        hashes = np.concatenate([np.cumsum(unpacked(r["hashes"], k, _WIDTH[order]), dtype=np.uint64) for r, k in zip(part, size)])
        counts = np.concatenate([unpacked(r["counts"], k, 4) for r, k in zip(part, size)]).astype(np.int64)
        distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, index, counts)
        owner = np.zeros(len(hashes), dtype=bool)  # one asker of each trained word counts it
        owner[first[total > 0]] = True
        at = 0
        for r, k in zip(part, size):
            s = slice(at, at + k)
            at += k
            out.append((r["chunk"], r["p"], order, int(owner[s].sum()), packed(total[index[s]].astype(np.uint64), 4)))
    return batch(_REPLY, out)


def _seen(rows: pa.Table, replies: pa.Table, n: int) -> pa.Table:
    """The trained counts of every token's word and pair, in one packed row per chunk."""
    if not len(rows):
        return batch(_SEEN, [])
    c, owned = _Chunk(rows, n), 0
    totals = {order: np.zeros(len(g[0]), dtype=np.uint64) for order, g in c.grams.items()}
    for r in replies.to_pylist():
        order = r["order"]
        distinct, _, cut = c.grams[order]
        s = slice(cut[r["p"]], cut[r["p"] + 1])
        _, rank = _by_low(distinct[s], order)
        totals[order][np.arange(s.start, s.stop)[rank]] = unpacked(r["counts"], s.stop - s.start, 4)
        owned += r["owned"] if order == 1 else 0
    tokens = np.concatenate([totals[order][index] for order, (_, index, _) in c.grams.items()])
    return batch(_SEEN, [(owned, int(c.trains.sum()), c.doc_ids, c.held_out, np.diff(c.starts), packed(tokens, 4))])


class Tokens:
    """A chunk's tokens with their trained counts: of word, pair and context."""

    def __init__(self, row: dict):
        self.doc_ids, self.held_out = row["doc_ids"], np.array(row["held_out"], dtype=bool)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        n = int(self.sizes.sum())
        both = unpacked(row["counts"], 2 * n, 4).astype(np.float64)
        self.word, self.pair = both[:n], both[n:]
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.context = np.empty(n)
        self.context[1:] = self.word[:-1]
        self.context[self.starts[:-1]] = self.word[self.starts[1:] - 1]  # a text follows an end
        self.trains = np.repeat(~self.held_out, self.sizes)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def _cell(estimate: np.ndarray) -> np.ndarray:
    """Place on the grid: 0 for zero, else by the logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(estimate > 0, np.clip(np.rint(_STEPS * (np.log2(estimate) + _LEAST)), 0, _STEPS * _LEAST) + 1, 0).astype(np.int64)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, np.exp2((cell - 1) / _STEPS - _LEAST), 0.0)


def held_out_grid(seen: DataFrame, total: int) -> DataFrame:
    """How many training tokens have which estimates once taken from the counts: ``cell``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: dict[int, int] = {}
        for b in batches:
            for row in b.to_pylist():
                t = Tokens(row)
                word, pair, context = t.word[t.trains], t.pair[t.trains], t.context[t.trains]
                pairs = _cell((pair - 1) / np.maximum(context - 1, 1))
                words = _cell((word - 1) / max(total - 1, 1))
                cells, n = np.unique((bucket(context) * _CELLS + pairs) * _CELLS + words, return_counts=True)
                for k, v in zip(cells.tolist(), n.tolist()):
                    grid[k] = grid.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(grid), pa.int64()), pa.array(list(grid.values()), pa.int64())], ["cell", "n"])

    return seen.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def mixture_weights(cells: np.ndarray, n: np.ndarray, any_word: float, rounds: int = 60) -> np.ndarray:
    """(bucket, 3) weights of pair, word and any word: expectation-maximisation, with one token's worth of even weights."""
    b, pairs, words = cells // _CELLS // _CELLS, cells // _CELLS % _CELLS, cells % _CELLS
    estimates = np.stack([_value(pairs), _value(words), np.full(len(cells), any_word)], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        parts = weights[b] * estimates
        parts *= (n / parts.sum(axis=1))[:, None] if len(cells) else 1
        sums = np.full((BUCKETS, 3), 1 / 3)
        np.add.at(sums, b, parts)
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context has no pairs
    return weights


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int, np.ndarray]:
    """All tokens with their counts (saved, packed by chunk), training tokens, distinct ones, mixture weights."""
    own, n = chunks.chunked(docs, id_col, text_col, chunk_bytes)
    asked = chunks.ask(own, lambda t: _question(t, n), _DDL["ask"])
    replies = chunks.answer(asked, n, _reply, _DDL["reply"])
    seen = saved(chunks.with_answers(own, replies, lambda t, r: _seen(t, r, n), _DDL["seen"]))
    sums = seen.agg(F.sum("trained").alias("n"), F.sum("owned").alias("v")).first()
    total, distinct = sums.n or 0, sums.v or 0
    grid = held_out_grid(seen, total).toPandas()  # at most BUCKETS * _CELLS ** 2 rows, whatever the corpus
    weights = mixture_weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(np.float64), 1 / (distinct + 1))
    return seen, total, distinct, weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities)."""
    seen, total, distinct, weights = fit(docs, id_col, text_col, chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Tokens(row)
                if not len(t.sizes):
                    continue
                w = weights[bucket(t.context)]
                p = w[:, 0] * t.pair / np.maximum(t.context, 1) + w[:, 1] * t.word / max(total, 1) + w[:, 2] / (distinct + 1)
                base = np.log10((t.word + 0.5) / (total + 0.5 * (distinct + 1)))
                sums = [np.add.reduceat(x.astype(float), t.starts[:-1]) for x in (t.word > 0, base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.doc_ids, pa.int64()), pa.array(t.held_out), pa.array(t.sizes), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(t.sizes), total)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return seen.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
