"""Repeated byte strings by a prefix-free parse and suffix order of its dictionary.

* **Parse.** Rolling-hash triggers: the trigger of a ``length``-byte string is the
  place inside it where a short rolling hash is least.  The places whose strings
  share a trigger follow each other; together with the bytes their strings need
  they form a phrase.  Equal strings have the same trigger at the same distance, so
  copies are parsed alike wherever they stand, and every place is in one phrase.
* **Dictionary.** Equal phrases (by trigger, content and place of the trigger) are
  one entry, and only the first in corpus order stays in question; all strings of
  the later ones start earlier.  For highly repetitive text that settles nearly all.
* **Suffix order.** The dictionary's phrases of one trigger meet, and their suffixes
  are sorted to ``length`` bytes; because a phrase carries the bytes that follow it,
  the order needs no look into the next phrase.  Suffixes equal to that depth are
  put into corpus order (the parse); all but the first start earlier.

A phrase whose trigger nothing else has, or whose trigger has only this one entry,
is never sent as text.  Questions are packed per chunk (``chunks``); an entry that
a third of all documents hold comes once per chunk.  At the ends of a very common
passage one trigger has very many entries; those of a crowded trigger are dealt
out by their own hash, and their strings are compared as 96-bit digests, each
string in its own partition, instead of meeting in the trigger's.

Null texts are empty, null ids come first.  Rows that share an id are ordered by
chunk and text: the same every time, and only the first of equal rows stays whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm import chunks
from tarmac.llm.chunks import BASES, Rolling, batch, bounds, in_order, low_bytes, wide
from tarmac.llm.common import mix

#: A chunk's text; each byte takes some dozens of bytes of working memory.
CHUNK_BYTES = 4 << 20
#: Bytes of the rolling hash that finds triggers.
TRIGGER = 32
#: Bits that a place in a chunk takes next to its hash.
_PLACE = 28
_SHORT = 5
#: Suffixes whose bytes are laid out at once while sorting (a trigger's are never parted).
_SORTED = 100_000

_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: Entries of a trigger, in one chunk and in all, from which it is crowded.
_CROWD, _CROWD_IN_ALL = 4, 64

_ASK1 = pa.schema([("p", pa.int32()), ("chunk", pa.int32()), ("trigger", pa.binary()), ("phrase", pa.binary()), ("doc", pa.binary()), ("crowd", pa.binary())])
_REPLY1 = pa.schema([("chunk", pa.int32()), ("p", pa.int32()), ("by_trigger", pa.bool_()), ("later", pa.binary()), ("open", pa.binary()), ("crowd", pa.binary())])
_ASK2 = pa.schema([("p", pa.int32()), ("chunk", pa.int32()), ("trigger", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("starts", pa.binary()), ("text", pa.binary()), ("digest", pa.binary()), ("settled", pa.binary())])
_REPLY2 = pa.schema([("chunk", pa.int32()), ("ranges", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DDL = {
    "ask1": "p int, chunk int, trigger binary, phrase binary, doc binary, crowd binary",
    "reply1": "chunk int, p int, by_trigger boolean, later binary, open binary, crowd binary",
    "ask2": "p int, chunk int, trigger binary, doc binary, place binary, starts binary, text binary, digest binary, settled binary",
    "reply2": "chunk int, ranges binary",
    "out": "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>",
}


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, from running minima inside blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Chunk:
    """A chunk's bytes and, when parsed, its phrases in corpus order."""

    def __init__(self, rows: pa.Table):
        self.number = rows.column("chunk")[0].as_py()
        self.rows = in_order(rows)
        self.texts = self.rows.column("text").to_pylist()
        self.starts = np.zeros(len(self.texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in self.texts], out=self.starts[1:])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def parse(self, length: int, n: int) -> None:
        """Phrases: ``first`` and ``last`` start, ``trigger`` hash, ``phrase`` hash; ``entry``: of which dictionary entry."""
        rolling = Rolling(_BYTE_VALUES[self.data])
        size = np.diff(self.starts)
        k = min(TRIGGER, length)
        at = np.arange(max(0, len(self.data) - k + 1))
        hashes = rolling.at(at, at + k)
        low = np.uint64((1 << _PLACE) - 1)
        least = sliding_least((hashes & ~low) | at.astype(np.uint64), length - k + 1) & low
        ends = np.repeat(self.starts[1:], size)[: len(least)]
        at = np.arange(len(least))
        at = at[at + length <= ends]
        where = least[at].astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.last = at[begin], at[np.append(begin[1:], len(at)) - 1] if len(begin) else at[begin]
        where = where[begin]
        # least hashes are small ones: mixed again, so that partitions are even
        self.trigger = mix(hashes[where])
        self.phrase = rolling.at(self.first, self.last + length)
        self.phrase ^= ((self.last - self.first) * 65_599 + (where - self.first)).astype(np.uint64)
        mix(self.phrase)
        order = np.lexsort((self.first, self.phrase, self.trigger))
        a, b = self.trigger[order], self.phrase[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        entries = order[new]  # the first phrase of each, sorted by trigger
        self.again = order[~new]
        begin = np.flatnonzero(np.diff(self.trigger[entries], prepend=~self.trigger[entries[:1]]) != 0)
        count = np.diff(np.append(begin, len(entries)))
        crowded = np.repeat(count > _CROWD, count)
        alone = ~crowded
        alone[begin] = True  # a crowded trigger's first entry stands for all in its partition
        #: asked by trigger; of them, those that stand for a crowd
        self.entries, self.crowd = entries[alone], crowded[alone]
        self.cut = bounds(self.trigger[self.entries], n)
        #: asked by phrase
        dealt = entries[crowded]
        self.dealt = dealt[np.argsort(self.phrase[dealt], kind="stable")]
        self.dealt_cut = bounds(self.phrase[self.dealt], n)
        self.rolling = rolling

    def doc_ids(self, places: np.ndarray) -> np.ndarray:
        ids = self.rows.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return ids[np.searchsorted(self.starts, places, side="right") - 1].astype("<i8")


def _doc_bytes(docs: np.ndarray) -> bytes:
    """Ids by byte planes, which compress well."""
    return docs.view(np.uint8).reshape(-1, 8).T.tobytes()


def _docs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _first_question(rows: pa.Table, n: int, length: int) -> pa.Table:
    c = _Chunk(rows)
    c.parse(length, n)
    out = []
    docs = c.doc_ids(c.first[c.entries])
    for p in np.flatnonzero(np.diff(c.cut)):
        s = slice(c.cut[p], c.cut[p + 1])
        e = c.entries[s]
        out.append((p, c.number, low_bytes(c.trigger[e], _SHORT).tobytes(), c.phrase[e].astype("<u8").tobytes(), _doc_bytes(docs[s]), np.packbits(c.crowd[s]).tobytes()))
    docs = c.doc_ids(c.first[c.dealt])
    for p in np.flatnonzero(np.diff(c.dealt_cut)):
        s = slice(c.dealt_cut[p], c.dealt_cut[p + 1])
        out.append((p, c.number, b"", c.phrase[c.dealt[s]].astype("<u8").tobytes(), _doc_bytes(docs[s]), b""))
    return batch(_ASK1, out)


def _first_reply(asked: pa.Table) -> pa.Table:
    rows, out = asked.to_pylist(), []
    for by_trigger in (True, False):
        part = [r for r in rows if bool(r["trigger"]) == by_trigger]
        if part:
            out += _compared(part, by_trigger)
    return batch(_REPLY1, out)


def _compared(rows: list[dict], by_trigger: bool) -> list[tuple]:
    size = [len(r["phrase"]) // 8 for r in rows]
    phrase = np.concatenate([np.frombuffer(r["phrase"], "<u8") for r in rows])
    doc = np.concatenate([_docs(r["doc"]) for r in rows])
    chunk = np.repeat([r["chunk"] for r in rows], size)
    n = len(phrase)
    if by_trigger:
        trigger = np.concatenate([wide(r["trigger"], _SHORT) for r in rows])
        stands = np.concatenate([_flags(r["crowd"], k) for r, k in zip(rows, size)])
    else:
        trigger, stands = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    order = np.lexsort((chunk, doc, phrase, stands, trigger))
    t, h, s = trigger[order], phrase[order], stands[order]
    other = np.ones(n, dtype=bool)
    other[1:] = t[1:] != t[:-1]
    entry = other.copy()
    entry[1:] |= (h[1:] != h[:-1]) | s[1:]
    group = np.cumsum(other) - 1
    entries, crowds = np.bincount(group, weights=entry), np.bincount(group, weights=s)
    later, several, crowd = (np.zeros(n, dtype=bool) for _ in range(3))
    later[order] = ~entry & ~s
    if by_trigger:
        several[order] = (entries + crowds > 1)[group]
        crowd[order] = ((entries > _CROWD_IN_ALL) | (crowds > 0))[group]
    out, at = [], 0
    for r, k in zip(rows, size):
        x = slice(at, at + k)
        at += k
        if later[x].any() or several[x].any():
            out.append((r["chunk"], r["p"], by_trigger, np.packbits(later[x]).tobytes(), np.packbits(several[x]).tobytes(), np.packbits(crowd[x]).tobytes()))
    return out


def _second_question(rows: pa.Table, replies: pa.Table, n: int, length: int) -> pa.Table:
    if not len(rows):
        return batch(_ASK2, [])
    c = _Chunk(rows)
    c.parse(length, n)
    later, several, crowd = (np.zeros(len(c.entries), dtype=bool) for _ in range(3))
    dealt_later = np.zeros(len(c.dealt), dtype=bool)
    for r in replies.to_pylist():
        cut = c.cut if r["by_trigger"] else c.dealt_cut
        s = slice(cut[r["p"]], cut[r["p"] + 1])
        if r["by_trigger"]:
            for flags, name in ((later, "later"), (several, "open"), (crowd, "crowd")):
                flags[s] = _flags(r[name], s.stop - s.start)
        else:
            dealt_later[s] = _flags(r["later"], s.stop - s.start)
    own = ~c.crowd  # what stands for a crowd is among the dealt ones
    settled = np.concatenate([c.again, c.entries[later & own], c.dealt[dealt_later]])
    ranges = [np.stack([c.first[settled], c.last[settled] + 1], axis=1)]
    out: list[tuple] = []
    opened = c.entries[several & ~crowd & ~later & own]
    cut, data = bounds(c.trigger[opened], n), c.data.tobytes()
    docs = c.doc_ids(c.first[opened])
    for p in np.flatnonzero(np.diff(cut)):
        s = slice(cut[p], cut[p + 1])
        e = opened[s]
        text = b"".join(data[a : b + length] for a, b in zip(c.first[e].tolist(), c.last[e].tolist()))
        out.append((p, c.number, low_bytes(c.trigger[e], _SHORT).tobytes(), docs[s].tobytes(), c.first[e].astype("<u4").tobytes(), (c.last[e] - c.first[e] + 1).astype("<u4").tobytes(), text, b"", b""))
    # strings of crowded triggers, each by itself
    e = np.concatenate([c.entries[several & crowd & ~later & own], c.dealt[~dealt_later]])
    at = np.sort(places_of(c.first[e], c.last[e] - c.first[e] + 1))
    h1 = c.rolling.at(at, at + length)
    h2 = Rolling(_BYTE_VALUES[c.data], BASES[1]).at(at, at + length) if len(at) else h1
    order = np.lexsort((at, h2, h1))
    at, h1, h2 = at[order], h1[order], h2[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    ranges.append(np.stack([at[~new], at[~new] + 1], axis=1))
    at, h1, h2 = at[new], h1[new], h2[new]
    cut, docs = bounds(h1, n), c.doc_ids(at)
    for p in np.flatnonzero(np.diff(cut)):
        s = slice(cut[p], cut[p + 1])
        digest = np.concatenate([low_bytes(h1[s], 4), low_bytes(h2[s], 8)], axis=1)
        out.append((p, c.number, b"", docs[s].tobytes(), at[s].astype("<u4").tobytes(), b"", b"", digest.tobytes(), b""))
    known = np.concatenate(ranges).astype("<u4")
    if len(known):
        out.append((c.number % n, c.number, b"", b"", b"", b"", b"", b"", known.tobytes()))
    return batch(_ASK2, out)


def places_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` places in a row from every ``first``."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes (stable), and where a new one begins in it."""
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[at]
    keys = np.ascontiguousarray(rows).view(f"S{length}").ravel()
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return order, new


def _second_reply(asked: pa.Table, length: int) -> pa.Table:
    rows = asked.to_pylist()
    out = [(r["chunk"], r["settled"]) for r in rows if r["settled"]]
    texts, digests = [r for r in rows if r["text"]], [r for r in rows if r["digest"]]
    if texts:
        out += _later_suffixes(texts, length)
    if digests:
        out += _later_digests(digests)
    return batch(_REPLY2, out)


def _later_suffixes(rows: list[dict], length: int) -> list[tuple]:
    count = np.concatenate([np.frombuffer(r["starts"], "<u4") for r in rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r["starts"]) // 4 for r in rows])
    doc = np.concatenate([np.frombuffer(r["doc"], "<i8") for r in rows])
    place = np.concatenate([np.frombuffer(r["place"], "<u4") for r in rows]).astype(np.int64)
    trigger = np.concatenate([wide(r["trigger"], _SHORT) for r in rows])
    text = np.frombuffer(b"".join(r["text"] for r in rows), np.uint8)
    begin = np.concatenate([[0], np.cumsum(count + length - 1)])[:-1]
    # phrases in corpus order within their trigger; the stable sort of their suffixes keeps it
    chunk = np.array([r["chunk"] for r in rows])[owner]
    corpus = np.lexsort((place, chunk, doc, trigger))
    at = places_of(begin[corpus], count[corpus])
    where, who = places_of(place[corpus], count[corpus]), np.repeat(owner[corpus], count[corpus])
    of = np.repeat(trigger[corpus], count[corpus])
    edges = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
    later = np.zeros(len(at), dtype=bool)
    a = 0
    while a < len(at):
        b = int(edges[np.searchsorted(edges, min(len(at), a + _SORTED))])
        order, new = suffix_order(text, at[a:b], length)
        later[a + order[~new]] = True
        a = b
    return _by_chunk(rows, who[later], where[later])


def _later_digests(rows: list[dict]) -> list[tuple]:
    owner = np.repeat(np.arange(len(rows)), [len(r["place"]) // 4 for r in rows])
    doc = np.concatenate([np.frombuffer(r["doc"], "<i8") for r in rows])
    place = np.concatenate([np.frombuffer(r["place"], "<u4") for r in rows]).astype(np.int64)
    digest = np.frombuffer(b"".join(r["digest"] for r in rows), np.uint8).reshape(-1, 12)
    h1, h2 = wide(digest[:, :4].tobytes(), 4), wide(digest[:, 4:].tobytes(), 8)
    chunk = np.array([r["chunk"] for r in rows])[owner]
    order = np.lexsort((place, chunk, doc, h2, h1))
    a, b = h1[order], h2[order]
    later = np.zeros(len(order), dtype=bool)
    later[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return _by_chunk(rows, owner[later], place[later])


def _by_chunk(rows: list[dict], who: np.ndarray, where: np.ndarray) -> list[tuple]:
    order = np.lexsort((where, who))
    who, where = who[order], where[order]
    cut = np.searchsorted(who, np.arange(len(rows) + 1))
    return [(r["chunk"], _ranges(where[cut[i] : cut[i + 1]])) for i, r in enumerate(rows) if cut[i] < cut[i + 1]]


def _ranges(sorted_places: np.ndarray) -> bytes:
    edge = np.flatnonzero(np.diff(sorted_places) > 1)
    first = sorted_places[np.append(0, edge + 1)]
    last = sorted_places[np.append(edge, len(sorted_places) - 1)]
    return np.stack([first, last + 1], axis=1).astype("<u4").tobytes()


def _cut(rows: pa.Table, replies: pa.Table, length: int) -> pa.Table:
    if not len(rows):
        return batch(_OUT, [])
    c = _Chunk(rows)
    covered = np.zeros(len(c.data) + 1, dtype=np.int32)
    for r in replies.column("ranges").to_pylist():
        a, b = np.frombuffer(r, "<u4").reshape(-1, 2).astype(np.int64).T
        np.add.at(covered, a, 1)
        np.add.at(covered, b + length - 1, -1)
    gone = np.cumsum(covered)[:-1] > 0
    out = []
    for i, (doc_id, text) in enumerate(zip(c.rows.column("doc_id").to_pylist(), c.texts)):
        lost, spans = gone[c.starts[i] : c.starts[i + 1]], []
        if lost.any():
            edge = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            text = np.frombuffer(text, np.uint8)[~lost].tobytes()
        out.append((doc_id, len(lost), text, spans))
    return batch(_OUT, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``kept`` (remaining bytes), ``spans`` (maximal removed runs)."""
    own, n = chunks.chunked(docs, id_col, text_col, chunk_bytes)
    asked = chunks.ask(own, lambda t: _first_question(t, n, length), _DDL["ask1"])
    settled = chunks.answer(asked, n, _first_reply, _DDL["reply1"])
    opened = chunks.with_answers(own, settled, lambda t, r: _second_question(t, r, n, length), _DDL["ask2"])
    later = chunks.answer(opened, n, lambda t: _second_reply(t, length), _DDL["reply2"])
    return chunks.with_answers(own, later, lambda t, r: _cut(t, r, length), _DDL["out"])
