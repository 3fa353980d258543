"""Repeated passages of words, found by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window, so
that each window of ``window`` words holds a whole block of its own document.
The blocks are the index; every rolling stretch of block length probes it.  A
window whose first block nothing else hits cannot repeat; the hit ones are
extended: all windows around a hit are compared as wholes, which together cover
exactly the maximal repeats of ``window`` words or more.

The work goes through packed questions (``chunks``): first all rolling hashes
against the block index, then the windows next to hits.  No pairs of occurrences
are formed, so a passage that a third of all documents hold is as cheap as any.

Windows are told apart by two 64-bit hashes, of which the first also chooses the
partition.  Null texts are empty.  Rows that repeat a document are occurrences of
their own: a long enough text given twice loses all its words, like any copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm import chunks
from tarmac.llm.chunks import BASES, Rolling, batch, bounds, in_order, low_bytes, wide, word_hashes

#: Bytes sent of a hash that only preselects.
SHORT = 5

_ASK1 = pa.schema([("p", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("block", pa.binary()), ("twice", pa.binary())])
_ASK2 = pa.schema([("p", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("place", pa.binary()), ("twice", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DDL = {
    "ask1": "p int, chunk int, hashes binary, block binary, twice binary",
    "reply1": "chunk int, p int, hits binary",
    "ask2": "p int, chunk int, hashes binary, place binary, twice binary",
    "reply2": "chunk int, places binary",
    "out": "doc_id bigint, n_words bigint, kept binary, spans array<struct<start:bigint,end:bigint>>",
}


class _Chunk:
    """A chunk's words, hashed; the same whenever it is read."""

    def __init__(self, rows: pa.Table, window: int):
        self.number = rows.column("chunk")[0].as_py()
        self.rows = in_order(rows)
        self.words = [t.split() for t in self.rows.column("text").to_pylist()]
        self.values, self.starts = word_hashes(self.words)
        self.window, self.block = window, (window + 1) // 2
        self.rolling = Rolling(self.values)

    def places(self, length: int) -> np.ndarray:
        """Where a stretch of ``length`` words of one document begins."""
        n = np.diff(self.starts)
        ends = np.repeat(self.starts[1:], n)
        at = np.arange(len(self.values))
        return at[at + length <= ends]

    def in_document(self, at: np.ndarray) -> np.ndarray:
        n = np.diff(self.starts)
        return at - np.repeat(self.starts[:-1], n)[at]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Block-length stretches: place, index into the distinct hashes; those hashes, whether a block's, whether met twice."""
        at = self.places(self.block)
        distinct, index, count = np.unique(self.rolling.at(at, at + self.block), return_inverse=True, return_counts=True)
        block = np.zeros(len(distinct), dtype=bool)
        block[index[self.in_document(at) % self.block == 0]] = True
        return at, index, distinct, block, count > 1


def _first_question(rows: pa.Table, n: int, window: int) -> pa.Table:
    c = _Chunk(rows, window)
    _, _, distinct, block, twice = c.stretches()
    cut, out = bounds(distinct, n), []
    for p in np.flatnonzero(np.diff(cut)):
        s = slice(cut[p], cut[p + 1])
        out.append((p, c.number, low_bytes(distinct[s], SHORT).tobytes(), np.packbits(block[s]).tobytes(), np.packbits(twice[s]).tobytes()))
    return batch(_ASK1, out)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _first_reply(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    hashes = [wide(r["hashes"], SHORT) for r in rows]
    size = [len(h) for h in hashes]
    _, index = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(index, weights=1 + np.concatenate([_bits(r["twice"], k) for r, k in zip(rows, size)]))
    block = np.bincount(index, weights=np.concatenate([_bits(r["block"], k) for r, k in zip(rows, size)])) > 0
    hit = ((count > 1) & block)[index]
    out, at = [], 0
    for r, k in zip(rows, size):
        out.append((r["chunk"], r["p"], np.packbits(hit[at : at + k]).tobytes()))
        at += k
    return batch(pa.schema([("chunk", pa.int32()), ("p", pa.int32()), ("hits", pa.binary())]), out)


def _second_question(rows: pa.Table, replies: pa.Table, n: int, window: int) -> pa.Table:
    if not len(rows):
        return batch(_ASK2, [])
    c = _Chunk(rows, window)
    at, index, distinct, _, _ = c.stretches()
    cut, hit = bounds(distinct, n), np.zeros(len(distinct), dtype=bool)
    for r in replies.to_pylist():
        s = slice(cut[r["p"]], cut[r["p"] + 1])
        hit[s] = _bits(r["hits"], s.stop - s.start)
    hit_at = np.zeros(len(c.values) + 1, dtype=bool)
    hit_at[at] = hit[index]
    whole = c.places(c.window)
    first_block = whole + -c.in_document(whole) % c.block
    whole = whole[hit_at[first_block]]
    h1 = c.rolling.at(whole, whole + c.window)
    h2 = Rolling(c.values, BASES[1]).at(whole, whole + c.window)
    order = np.lexsort((whole, h2, h1))
    whole, h1, h2 = whole[order], h1[order], h2[order]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    twice = np.diff(np.append(np.flatnonzero(new), len(whole))) > 1
    whole, h1, h2 = whole[new].astype("<u4"), h1[new], h2[new]
    cut, out = bounds(h1, n), []
    for p in np.flatnonzero(np.diff(cut)):
        s = slice(cut[p], cut[p + 1])
        out.append((p, c.number, low_bytes(h2[s], 8).tobytes(), whole[s].tobytes(), np.packbits(twice[s]).tobytes()))
    return batch(_ASK2, out)


def _second_reply(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    hashes = [wide(r["hashes"], 8) for r in rows]
    size = [len(h) for h in hashes]
    _, index = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(index, weights=1 + np.concatenate([_bits(r["twice"], k) for r, k in zip(rows, size)]))
    again = (count > 1)[index]
    out, at = [], 0
    for r, k in zip(rows, size):
        found = np.frombuffer(r["place"], "<u4")[again[at : at + k]]
        at += k
        if len(found):
            out.append((r["chunk"], found.tobytes()))
    return batch(pa.schema([("chunk", pa.int32()), ("places", pa.binary())]), out)


def _cut(rows: pa.Table, replies: pa.Table, window: int) -> pa.Table:
    if not len(rows):
        return batch(_OUT, [])
    c = _Chunk(rows, window)
    covered = np.zeros(len(c.values) + 1, dtype=np.int64)
    found = [np.frombuffer(x, "<u4") for x in replies.column("places").to_pylist()]
    if found:
        found = np.concatenate(found).astype(np.int64)
        whole = c.places(c.window)
        again = whole[np.isin(c.rolling.at(whole, whole + c.window), c.rolling.at(found, found + c.window))]
        covered[again] += 1
        covered[again + c.window] -= 1
        np.cumsum(covered, out=covered)
    gone = covered[:-1] > 0
    out = []
    for i, (doc_id, words) in enumerate(zip(c.rows.column("doc_id").to_pylist(), c.words)):
        s, e = c.starts[i], c.starts[i + 1]
        lost = gone[s:e]
        if lost.any():
            runs = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1))]
            words = [w for w, x in zip(words, lost) if not x]
        else:
            spans = []
        out.append((doc_id, int(e - s), b" ".join(words), spans))
    return batch(_OUT, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``kept`` (UTF-8 bytes of what stays, words joined by one blank), ``spans`` (removed word ranges)."""
    own, n = chunks.chunked(docs, id_col, text_col, chunk_bytes)
    asked = chunks.ask(own, lambda t: _first_question(t, n, window), _DDL["ask1"])
    hits = chunks.answer(asked, n, _first_reply, _DDL["reply1"])
    windows = chunks.with_answers(own, hits, lambda t, r: _second_question(t, r, n, window), _DDL["ask2"])
    again = chunks.answer(windows, n, _second_reply, _DDL["reply2"])
    return chunks.with_answers(own, again, lambda t, r: _cut(t, r, window), _DDL["out"])
