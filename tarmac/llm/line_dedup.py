"""Near-equal lines by a deletion-neighbourhood join.

A line's words are its symbols.  Two lines within one edit (a word more, less or
other) share a variant: the line itself, or the line less one word.  All variants
are emitted as hashed keys and equal ones are joined; the edit distance is
verified on the words; of two such lines the earlier one in corpus order (id, then
place in the text) is kept.  A line goes if any earlier line is equal to it or
within the edit bound, judged on the input.

* Lines that repeat an earlier line exactly are found first, by their hash, and
  emit no variants.
* Variants that no other line has cannot join.  Chunks ask for all their variants
  in packed rows (``chunks``), and only those met twice become rows of a join.
* Per variant only its earliest line matters.  A shared variant with the deletion
  at the same place is a replaced word, a variant equal to a whole line is an added
  or lost one; so minima by (variant, place) decide, and no pairs are formed in a
  group, however many lines share a variant.

Lines under ``least_words`` words (five, so that one edit leaves a similarity of
0.8) are left alone, as are blank lines.  Words are split at ASCII space.  Null
texts stay null; null ids come first; rows that share an id are ordered by chunk
and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tarmac.llm import chunks
from tarmac.llm.chunks import BASES, Rolling, bounds, in_order
from tarmac.llm.common import ASCII_SPACE, mix, saved
from tarmac.llm.lm_score import packed, unpacked

LEAST_WORDS = 5
#: A chunk's text; each byte takes some dozens of bytes of working memory.
CHUNK_BYTES = 3 << 20
#: Bytes sent of a variant's hash next to its partition; it only preselects.
_SHORT = 5
_SPACE = np.isin(np.arange(256), np.frombuffer(ASCII_SPACE, np.uint8))
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_VALUES[_SPACE] = 0
#: Bytes hashed at once: what that takes stays in a core's cache.
_BLOCK = 1 << 16
_STEP = 0xD1342543DE82EF95
#: Bytes of a word beyond which it is hashed as a whole.
_LONG_WORD = 1024

_ASK1 = "p int, chunk int, size int, hashes binary, checks binary, docs binary"
_REPLY1 = "chunk int, p int, later binary"
_ASK2 = "p int, chunk int, size int, hashes binary, gone binary"
_REPLY2 = "chunk int, p int, met binary, gone binary"
_JOINED = "variant bigint, place int, doc_id bigint, chunk int, line int, words binary"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _hashed_words(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash per word: the values of its bytes times powers of a base, summed (blanks have the value 0)."""
    out = np.empty(len(begin), dtype=np.uint64)
    cut = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), _BLOCK)), len(begin)))
    edge = np.append(begin, len(data))[cut]
    powers, back = _powers(int(np.diff(edge).max(initial=0)))
    for i, j, a, b in zip(cut[:-1], cut[1:], edge[:-1], edge[1:]):
        values = _BYTE_VALUES[data[a:b]]
        values *= powers[: b - a]
        at = begin[i:j] - a
        out[i:j] = np.add.reduceat(values, at) * back[at]
    return mix(out)


def _reuse_memory() -> None:
    """An array of this size, freed untouched, makes malloc keep up to twice as much for the next arrays, which fresh pages would slow down."""
    np.empty(31 << 20, np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0."""
    powers, back = np.full(n, BASES[0], dtype=np.uint64), np.full(n, pow(BASES[0], -1, 1 << 64), dtype=np.uint64)
    powers[:1] = back[:1] = 1
    return np.cumprod(powers, out=powers), np.cumprod(back, out=back)


def _among(h: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Where hashes of so many bits are one of the sorted ``values``, which are few."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    leading = np.uint64(bits - 20)
    some = np.zeros(1 << 20, dtype=bool)
    some[values >> leading] = True
    at = np.flatnonzero(some[h >> leading])
    place = np.minimum(np.searchsorted(values, h[at]), len(values) - 1)
    return at[values[place] == h[at]]


class _Lines:
    """A chunk's lines in corpus order, as ranges of its words; words are hashed by their bytes."""

    def __init__(self, rows: pa.Table, least_words: int):
        _reuse_memory()
        self.number = rows.column("chunk")[0].as_py()
        self.rows = in_order(rows)
        self.texts = self.rows.column("text").to_pylist()
        data = np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8)
        blank = np.append(True, _SPACE[data])
        edge = np.flatnonzero(blank[1:] != blank[:-1])  # words begin and end by turns; a blank ends the last
        self.begin, self.end = edge[::2].copy(), edge[1::2].copy()
        self.word = _hashed_words(data, self.begin)
        for i in np.flatnonzero(self.end - self.begin > _LONG_WORD):  # too long for a sum of powers modulo 2 ** 64
            self.word[i] = xxhash.xxh3_64_intdigest(data[self.begin[i] : self.end[i]].tobytes())
        #: lines, also blank ones: a document's first line is where the one before it ended
        self.breaks = np.flatnonzero(data == 10)
        sizes = np.array([t.count(b"\n") + 1 for t in self.texts], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.texts)), sizes)
        self.first_line = np.append(0, np.cumsum(sizes))
        self.cut = np.append(0, np.searchsorted(self.begin, self.breaks))  # words before each line end
        self.count = np.diff(self.cut)
        self.taking_part = np.flatnonzero(self.count >= least_words)
        self.data = data
        self.rolling = Rolling(self.word, _STEP)
        self.hash = self.rolling.at(self.cut[:-1], self.cut[1:])
        # lines are told apart by what each word gives at its place, scrambled, and by half of the rolling hash
        place = np.arange(1, len(self.word) + 1) - np.repeat(self.cut[:-1], self.count)
        sums = np.append(np.uint64(0), np.cumsum(mix(self.word + place.astype(np.uint64) * np.uint64(BASES[0]))))
        self.exact = mix(sums[self.cut[1:]] - sums[self.cut[:-1]])
        self.check = self.hash & np.uint64(0xFFFFFFFF)
        self.doc_ids = self.rows.column("doc_id").combine_chunks()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that take part: the first of each content, sorted by ``exact``; and those that repeat one."""
        at = self.taking_part
        exact, check = self.exact[at], self.check[at]
        rank = np.argsort(exact, kind="stable")  # lines come in order already
        same = exact[rank[1:]] == exact[rank[:-1]]
        other = check[rank[1:]] != check[rank[:-1]]
        if (same & other).any():
            rank = np.lexsort((at, check, exact))
            same, other = exact[rank[1:]] == exact[rank[:-1]], check[rank[1:]] != check[rank[:-1]]
        new = np.append(True, ~same | other)[: len(rank)]
        return at[rank[new]], at[rank[~new]]

    def ids_of(self, lines: np.ndarray) -> np.ndarray:
        return self.doc_ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)[self.doc[lines]]

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every line itself (place -1) and each of its words left out: hash, line, place."""
        n = self.count[lines]
        owner = np.repeat(np.arange(len(lines)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, b = self.cut[lines][owner], self.cut[lines + 1][owner]
        at = a + place
        ahead = self.rolling.sums[at] - self.rolling.sums[a]
        after = self.rolling.sums[b] - self.rolling.sums[at + 1]
        # what follows moves one place ahead
        h = ahead * self.rolling.back[a] + after * self.rolling.back[a + 1]
        return np.concatenate([self.hash[lines], mix(h)]), np.concatenate([lines, lines[owner]]), np.concatenate([np.full(len(lines), -1), place])

    def text(self, line: int) -> bytes:
        a, b = self.cut[line], self.cut[line + 1]
        return b" ".join(self.data[self.begin[a] : self.end[b - 1]].tobytes().split())


def _first_question(rows: pa.Table, n: int, least_words: int) -> pa.Table:
    c = _Lines(rows, least_words)
    lines, _ = c.distinct()
    h, check, docs = c.exact[lines], c.check[lines], c.ids_of(lines).astype("<i8")
    cut, out = bounds(h, n), []
    for p in np.flatnonzero(np.diff(cut)):
        s = slice(cut[p], cut[p + 1])
        out.append((p, c.number, s.stop - s.start, packed(h[s], 8), packed(check[s], 4), docs[s].tobytes()))
    return _table(_ASK1, out)


def _first_reply(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    size = [r["size"] for r in rows]
    h = np.concatenate([unpacked(r["hashes"], k, 8) for r, k in zip(rows, size)])
    check = np.concatenate([unpacked(r["checks"], k, 4) for r, k in zip(rows, size)])
    docs = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])
    later = np.zeros(len(h), dtype=bool)
    rank = np.argsort(h)
    same = np.append(False, h[rank[1:]] == h[rank[:-1]])
    same[:-1] |= same[1:]
    met = rank[same]  # few lines are met twice; only they are put in corpus order
    order = met[np.lexsort((np.repeat([r["chunk"] for r in rows], size)[met], docs[met], check[met], h[met]))]
    later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    ends = np.cumsum(size)
    return _table(_REPLY1, [(r["chunk"], r["p"], np.packbits(later[e - k : e]).tobytes()) for r, k, e in zip(rows, size, ends) if later[e - k : e].any()])


def _settled(c: _Lines, replies: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are the first of their kind in the corpus, and those that repeat one."""
    lines, again = c.distinct()
    cut, later = bounds(c.exact[lines], n), np.zeros(len(lines), dtype=bool)
    for r in replies.to_pylist():
        s = slice(cut[r["p"]], cut[r["p"] + 1])
        later[s] = np.unpackbits(np.frombuffer(r["later"], np.uint8), count=s.stop - s.start).astype(bool)
    return np.sort(lines[~later]), np.concatenate([again, lines[later]])


def _second_question(rows: pa.Table, replies: pa.Table, n: int, least_words: int) -> pa.Table:
    if not len(rows):
        return _table(_ASK2, [])
    c = _Lines(rows, least_words)
    lines, gone = _settled(c, replies, n)
    h, line, _ = c.variants(lines)
    distinct = np.sort(h)
    again = distinct[1:] == distinct[:-1]
    at = _among(h, np.unique(distinct[1:][again]), 64)
    at = at[np.argsort(h[at])]
    # a line that has a variant twice (equal words in a row) does not meet itself
    other = (h[at[1:]] == h[at[:-1]]) & (line[at[1:]] != line[at[:-1]])
    distinct = distinct[np.append(True, ~again)[: len(h)]]
    twice = np.zeros(len(distinct), dtype=np.uint64)
    twice[np.searchsorted(distinct, h[at[1:][other]])] = 1
    h = distinct
    cut = bounds(h, n)
    asked = np.flatnonzero(np.diff(cut))
    short = _short(h, cut, n)
    sent = np.diff(short, prepend=np.uint64(0))
    sent[cut[asked]] = short[cut[asked]]
    planes = np.ascontiguousarray((sent << np.uint64(1) | twice).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : _SHORT + 1].T)
    zstd, out = pa.Codec("zstd"), []
    for p in asked:
        own = planes[:, cut[p] : cut[p + 1]]
        out.append((p, c.number, own.shape[1], zstd.compress(own.tobytes(), asbytes=True), b""))
    out.append((c.number % n, c.number, 0, b"", np.sort(gone).astype("<u4").tobytes()))
    return _table(_ASK2, out)


def _short(h: np.ndarray, cut: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes by their leading bytes within the partition, hence still in order there."""
    begin = np.array([((p << 32) // n) << 32 for p in range(n)], dtype=np.uint64)
    bits = 32 + (-(-(1 << 32) // n) - 1).bit_length()
    return (h - np.repeat(begin, np.diff(cut))) >> np.uint64(max(0, bits - 8 * _SHORT))


def _second_reply(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    out = [(r["chunk"], -1, b"", r["gone"]) for r in rows if not r["size"]]
    rows = [r for r in rows if r["size"]]
    if rows:
        _reuse_memory()
        sent = [unpacked(r["hashes"], r["size"], _SHORT + 1) for r in rows]
        h = np.concatenate([np.cumsum(x >> np.uint64(1), dtype=np.uint64) for x in sent])
        met = (np.concatenate(sent) & np.uint64(1)).astype(bool)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        met[order[1:][same]] = met[order[:-1][same]] = True
        at = 0
        for r in rows:
            s = slice(at, at := at + r["size"])
            if met[s].any():
                out.append((r["chunk"], r["p"], np.packbits(met[s]).tobytes(), b""))
    return _table(_REPLY2, out)


def _joining(rows: pa.Table, replies: pa.Table, n: int, least_words: int) -> pa.Table:
    """Variants that others have too, each with its line; and lines already settled (without a variant)."""
    if not len(rows):
        return _table(_JOINED, [])
    c = _Lines(rows, least_words)
    answers = replies.to_pylist()
    gone = np.concatenate([np.frombuffer(r["gone"], "<u4") for r in answers if r["gone"]] or [np.zeros(0, "<u4")]).astype(np.int64)
    first, _ = c.distinct()
    lines = np.sort(first[~np.isin(first, gone)])
    h, line, place = c.variants(lines)
    distinct = np.sort(h)
    distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])[: len(h)]]
    cut, met = bounds(distinct, n), np.zeros(len(distinct), dtype=bool)
    for r in answers:
        if r["met"]:
            s = slice(cut[r["p"]], cut[r["p"] + 1])
            met[s] = np.unpackbits(np.frombuffer(r["met"], np.uint8), count=s.stop - s.start).astype(bool)
    keep = _among(h, distinct[met], 64)
    h, line, place = h[keep].view(np.int64), line[keep], place[keep]
    docs, words = c.doc_ids.take(pa.array(c.doc[line])), {k: c.text(k) for k in np.unique(line).tolist()}
    settled = np.sort(gone)
    return pa.table(
        {
            "variant": pa.array(np.concatenate([h, np.zeros(len(settled), np.int64)])),
            "place": pa.array(np.concatenate([place, np.full(len(settled), -2)]), pa.int32()),
            "doc_id": pa.concat_arrays([docs, c.doc_ids.take(pa.array(c.doc[settled]))]),
            "chunk": pa.array(np.full(len(h) + len(settled), c.number), pa.int32()),
            "line": pa.array(np.concatenate([line, settled]), pa.int32()),
            "words": pa.array([words[k] for k in line.tolist()] + [b""] * len(settled), pa.binary()),
        }
    )


@arrow_udf(T.BooleanType())
def within_one_edit(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether two lines differ by at most one added, lost or replaced word."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        a, b = a.split(), b.split()
        most, least = max(len(a), len(b)), min(len(a), len(b))
        ahead = 0
        while ahead < least and a[ahead] == b[ahead]:
            ahead += 1
        after = 0
        while after < least - ahead and a[-1 - after] == b[-1 - after]:
            after += 1
        out.append(ahead + after >= most - 1)
    return pa.array(out)


def _near_lines(joined: DataFrame) -> DataFrame:
    """``chunk`` and ``line`` of lines with an earlier one within the bound."""
    order = F.struct(F.col("doc_id").isNotNull().alias("numbered"), "doc_id", "chunk", "line", "words")
    have = joined.withColumn("own", order)
    by_place = have.groupBy("variant", "place").agg(F.min("own").alias("first"))
    whole = by_place.where("place = -1").select("variant", "first")
    shorter = by_place.where("place >= 0").groupBy("variant").agg(F.min("first").alias("first"))
    meetings = [(have.where("place >= 0"), by_place.where("place >= 0"), ["variant", "place"]), (have.where("place >= 0"), whole, ["variant"]), (have.where("place = -1"), shorter, ["variant"])]
    found = None
    for lines, firsts, keys in meetings:
        near = lines.join(firsts, keys).where(F.col("first") < F.col("own")).where(within_one_edit("words", "first.words")).select("chunk", "line")
        found = near if found is None else found.unionByName(near)
    return found


def _cut(rows: pa.Table, gone: pa.Table) -> pa.Table:
    names = ["doc_id", "text", "rest", "n_lines", "removed"]
    if not len(rows):
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.binary()), "rest": rows.column("rest"), "n_lines": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.int64()))})
    ordered = in_order(rows)
    texts = ordered.column("text").to_pylist()
    first = np.append(0, np.cumsum([t.count(b"\n") + 1 for t in texts]))
    lines = np.unique(gone.column("line").to_numpy())
    share = np.searchsorted(lines, first)
    kept, removed = [], []
    for i, text in enumerate(texts):
        out = (lines[share[i] : share[i + 1]] - first[i]).tolist()
        if out:
            drop = set(out)
            text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in drop)
        kept.append(text)
        removed.append(out)
    return pa.table([ordered.column("doc_id"), pa.array(kept, pa.binary()), ordered.column("rest"), pa.array(np.diff(first)), pa.array(removed, pa.list_(pa.int64()))], names)


def remove_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with the lines removed from the text, and ``_n_lines`` and ``_removed`` (line numbers from 0)."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(F.col(text_col).isNull().alias("no_text"), F.struct(*[F.col(c) for c in others] or [F.lit(0).alias("none")]).alias("columns"))
    own, n = chunks.chunked(docs.select(F.col(id_col), F.col(text_col), rest.alias("rest")), id_col, text_col, chunk_bytes, "rest")
    asked = chunks.ask(own, lambda t: _first_question(t, n, least_words), _ASK1)
    later = chunks.answer(asked, n, _first_reply, _REPLY1)
    variants = chunks.with_answers(own, later, lambda t, r: _second_question(t, r, n, least_words), _ASK2)
    met = chunks.answer(variants, n, _second_reply, _REPLY2)
    joined = saved(chunks.with_answers(own, met, lambda t, r: _joining(t, r, n, least_words), _JOINED))
    gone = joined.where("place = -2").select("chunk", "line").unionByName(_near_lines(joined.where("place > -2")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), own.schema["rest"], T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType()))])
    found = chunks.with_answers(own, gone, _cut, schema)
    out = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.when(~F.col("rest.no_text"), F.col("text").cast("string"))}
    column = lambda c: out.get(c, F.col("rest.columns").getField(c)).alias(c)
    return found.select(*map(column, docs.columns), F.col("n_lines").alias("_n_lines"), F.col("removed").alias("_removed"))
