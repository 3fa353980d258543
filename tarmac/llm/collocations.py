"""Phrase collocations, counted on a prefix-free parse.

Texts are split into pieces at punctuation and line ends and the pieces into
words.  A word is a trigger if the hash of the bytes that follow its start is a
multiple of ``mean``; a chunk reaches from one trigger to the next (or to the end
of its text) and overlaps with what follows by up to ``longest - 1`` words of the
same piece.  Where chunks begin depends on the text alone, so equal passages give
equal chunks.  The distinct chunks of a language with their frequencies are the
dictionary and the parse.

Phrases are counted inside distinct chunks, weighted by frequency; a phrase belongs
to the chunk that owns its first word, so what overlaps counts once.  Most phrases
are too rare to matter.  So each part of the dictionary first asks hash partitions
about all its distinct phrases (packed rows of ``chunks``, four bytes each); equal
hashes can only raise a count.  Then it lists the phrases that may be frequent as
text, and these are summed exactly.  Within a part phrases are told apart by word
numbers, not by hashes.

Null and empty texts have no words; a null language is ``und``.  A very long text
goes through a task as a whole; a text without a trigger is one chunk.  Rows that
repeat a document count each.  Ties fall as stated in ``collocations``.  An empty
table gives no rows.  Only the text and language columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm import chunks
from tarmac.llm.chunks import BASES, batch
from tarmac.llm.common import mix, saved, slices, text_bytes
from tarmac.llm.lm_score import packed, unpacked

LONGEST = 4
CHUNK_BYTES = 6 << 20
#: A chunk has so many words on average.
MEAN = 24
#: Bytes that a trigger is decided by.
_SIGHT = 8
#: Bytes of text that a task parses at a time.
_PIECE = 4 << 20
#: Bytes of a phrase's hash next to its partition.
_WIDTH = 4

#: A to Z become small, what ends a piece a line end, the tab a blank.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_PARSE = pa.schema([("lang", pa.string()), ("own", pa.int32()), ("body", pa.binary()), ("freq", pa.int64())])
_ASK = pa.schema([("p", pa.int32()), ("chunk", pa.int32()), ("size", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("p", pa.int32()), ("bits", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("a", pa.int64())])
_DDL = {
    "parse": "lang string, own int, body binary, freq bigint",
    "ask": "p int, chunk int, size int, hashes binary, counts binary",
    "reply": "chunk int, p int, bits binary",
    "counts": "lang string, phrase binary, a bigint",
}


def word_places(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word, and the number of its piece."""
    data = np.frombuffer(plain, np.uint8)
    line = data == 10
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(line | (data == 32), out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.cumsum(line, dtype=np.int32)[starts]


def parse(texts: list[bytes], mean: int, longest: int) -> Iterator[tuple[int, int, bytes]]:
    """Text number, own words and bytes of each chunk."""
    gap = b"\n" * _SIGHT
    plain = gap.join(t.translate(_PLAIN) for t in texts) + gap
    starts, ends, piece = word_places(plain)
    n = len(starts)
    if not n:
        return
    text_starts = np.cumsum([0] + [len(t) + _SIGHT for t in texts[:-1]])
    text = np.searchsorted(text_starts, starts, side="right") - 1
    ahead = np.ndarray(len(plain) - _SIGHT + 1, "<u8", plain, strides=(1,))[starts]
    opens = mix(ahead.astype(np.uint64)) % np.uint64(mean) == 0
    opens[0] = True
    opens[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(opens)
    after = np.append(first[1:], n)
    last = after - 1
    for d in range(longest - 1):
        further = np.minimum(after + d, n - 1)
        last = np.where((last == after + d - 1) & (after + d < n) & (piece[further] == piece[after - 1]), further, last)
    for t, own, a, b in zip(text[first].tolist(), (after - first).tolist(), starts[first].tolist(), ends[last].tolist()):
        yield t, own, plain[a:b]


def parsed(docs: DataFrame, text_col: str, lang_col: str, mean: int, longest: int) -> DataFrame:
    """Chunks and how often each was met in a piece of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, _PIECE):
                langs = part.column(0).to_pylist()
                found = Counter((langs[t], own, body) for t, own, body in parse(part.column(1).to_pylist(), mean, longest))
                columns = [pa.array([k[i] for k in found], _PARSE.field(i).type) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], schema=_PARSE)

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, _DDL["parse"])


class _Numbers(dict):
    """Numbers by word, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and the number of every place's key."""
    rank = np.argsort(keys)
    new = np.empty(len(keys), dtype=bool)
    new[:1] = True
    ordered = keys[rank]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(keys), dtype=np.int64)
    number[rank] = np.cumsum(new) - 1
    return rank[new], number


class _Part:
    """The distinct phrases of a part of the dictionary, of all orders and languages, in the order of their hashes."""

    def __init__(self, rows: pa.Table, n: int, longest: int):
        self.number = rows.column("chunk")[0].as_py()
        bodies: Counter[tuple[str, int, bytes]] = Counter()
        for lang, own, body, freq in zip(*(rows.column(c).to_pylist() for c in ("lang", "own", "body", "freq"))):
            bodies[lang, own, body] += freq
        by_lang: dict[str, list[tuple[int, bytes, int]]] = {}
        for (lang, own, body), freq in bodies.items():
            by_lang.setdefault(lang, []).append((own, body, freq))
        self.langs, self.words, self.tokens = list(by_lang), [], []
        lang_of, order, place, count, hashes = [], [], [], [], []
        for k, own in enumerate(by_lang.values()):
            words, tokens, found = self.phrases(own, self.langs[k], longest)
            self.words.append(words)
            self.tokens.append(tokens)
            for size, (at, weight, h) in enumerate(found, 1):
                lang_of.append(np.full(len(at), k, dtype=np.int32))
                order.append(np.full(len(at), size, dtype=np.int8))
                place.append(at)
                count.append(weight)
                hashes.append(h)
        h = np.concatenate(hashes)
        rank = np.argsort(h)
        self.lang_of, self.order, self.place, self.count = (np.concatenate(x)[rank] for x in (lang_of, order, place, count))
        h = h[rank]
        self.cut = chunks.bounds(h, n)
        # within a partition the leading bits of the distance to its edge: in order, and short
        edges = np.array([((p << 32) // n) << 32 for p in range(n)], dtype=np.uint64)
        shift = max(0, (-(-(1 << 64) // n)).bit_length() - 8 * _WIDTH)
        self.short = (h - np.repeat(edges, np.diff(self.cut))) >> np.uint64(shift)

    @staticmethod
    def phrases(own: list[tuple[int, bytes, int]], lang: str, longest: int) -> tuple[list[bytes], int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Words, occurrences, and by order: a place, the weighted count and a hash of each distinct phrase."""
        text = b"\n".join(body for _, body, _ in own)
        starts, _, piece = word_places(text)
        words, numbers = text.split(), _Numbers()
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        value = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[ids]
        body_starts = np.cumsum([0] + [len(body) + 1 for _, body, _ in own])
        sizes = np.diff(np.searchsorted(starts, body_starts))
        owned = np.array([x for x, _, _ in own])
        weight = np.repeat(np.array([f for _, _, f in own], dtype=np.float64), sizes)
        at = np.flatnonzero(np.arange(len(ids)) < np.repeat(np.cumsum(sizes) - sizes + owned, sizes))
        tokens, found = int(weight[at].sum()), []
        h = np.full(len(at), xxhash.xxh3_64_intdigest(lang), dtype=np.uint64)
        phrase = np.zeros(len(at), dtype=np.int64)
        for size in range(1, longest + 1):
            end = at + size - 1
            inside = end < len(ids)
            inside[inside] = piece[end[inside]] == piece[at[inside]]
            at, end, h, phrase = at[inside], end[inside], h[inside], phrase[inside]
            h *= np.uint64(BASES[0])
            h += value[end]
            mix(h)
            first, phrase = numbered(phrase << 32 | ids[end])
            found.append((at[first], np.bincount(phrase, weights=weight[at], minlength=len(first)), h[first]))
        return words, tokens, found


def _question(rows: pa.Table, n: int, longest: int) -> pa.Table:
    part, out = _Part(rows, n, longest), []
    for p in np.flatnonzero(np.diff(part.cut)):
        s = slice(part.cut[p], part.cut[p + 1])
        out.append((p, part.number, s.stop - s.start, packed(np.diff(part.short[s], prepend=np.uint64(0)), _WIDTH), packed(part.count[s].astype(np.uint64), 8)))
    return batch(_ASK, out)


def _reply(asked: pa.Table, least: int) -> pa.Table:
    rows = asked.to_pylist()
    hashes = np.concatenate([np.cumsum(unpacked(r["hashes"], r["size"], _WIDTH), dtype=np.uint64) for r in rows])
    counts = np.concatenate([unpacked(r["counts"], r["size"], 8) for r in rows]).astype(np.float64)
    _, index = np.unique(hashes, return_inverse=True)
    enough, at, out = (np.bincount(index, weights=counts) >= least)[index], 0, []
    for r in rows:
        bits = enough[at : at + r["size"]]
        at += r["size"]
        if bits.any():
            out.append((r["chunk"], r["p"], np.packbits(bits).tobytes()))
    return batch(_REPLY, out)


def _listed(rows: pa.Table, replies: pa.Table, n: int, longest: int) -> pa.Table:
    if not len(rows):
        return batch(_COUNTS, [])
    part = _Part(rows, n, longest)
    enough = np.zeros(len(part.place), dtype=bool)
    for p, bits in zip(replies.column("p").to_pylist(), replies.column("bits").to_pylist()):
        s = slice(part.cut[p], part.cut[p + 1])
        enough[s] = np.unpackbits(np.frombuffer(bits, np.uint8), count=s.stop - s.start)
    told = [x[enough].tolist() for x in (part.lang_of, part.order, part.place, part.count.astype(np.int64))]
    out = [(part.langs[k], b" ".join(part.words[k][i : i + size]), a) for k, size, i, a in zip(*told)]
    return batch(_COUNTS, [*out, *zip(part.langs, [None] * len(part.langs), part.tokens)])


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST, mean: int = MEAN, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Rows ``lang``, ``phrase`` (string; null: all words), ``a``: phrases of up to ``longest`` words with ``least`` occurrences or more."""
    size = docs.agg(F.sum(F.octet_length(text_bytes(text_col)))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    found = parsed(docs, text_col, lang_col, mean, longest)
    parts = found.withColumn("chunk", F.pmod(F.xxhash64("lang", "own", "body"), F.lit(n)).cast("int")).repartition(n, "chunk")
    asked = chunks.ask(parts, lambda t: _question(t, n, longest), _DDL["ask"])
    replies = chunks.answer(asked, n, lambda t: _reply(t, least), _DDL["reply"])
    listed = chunks.with_answers(parts, replies, lambda t, r: _listed(t, r, n, longest), _DDL["counts"])
    summed = listed.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.col("phrase").isNull())
    return summed.select("lang", F.col("phrase").cast("string").alias("phrase"), "a")


def _wide(column: str) -> Column:
    """A count whose products cannot pass the type."""
    return F.col(column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST, share: int = 80, top: int | None = 2000,
    mean: int = MEAN, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per language ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` collocations (None: all).

    The lowest-scoring cut of a phrase counts (ties: the first).  A phrase goes if a
    longer one that holds it has ``share`` percent of its occurrences or more.
    Ranks fall by score, then by ``a``, then rise by phrase.
    """
    counts = saved(phrase_counts(docs, text_col, lang_col, least, longest, mean, chunk_bytes))
    single = counts.where("phrase IS NOT NULL")
    phrases = single.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w")).alias("rest"))
    cuts = cuts.join(single.toDF("lang", "head", "l"), ["lang", "head"]).join(single.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    size = F.size("w")
    subs = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    held = phrases.where(size > 2).select("lang", F.explode(F.array_distinct(subs)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * share)
    kept = scored.join(held, ["lang", "phrase"], "left").where(stays)
    if top is not None:
        # bands of scores that lie wholly behind the first ones go before rows of a language meet
        kept = saved(kept).withColumn("band", F.expr("cut.score div 1000"))
        ahead = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("band"))) - F.col("k")
        bands = kept.groupBy("lang", "band").agg(F.count("*").alias("k")).withColumn("ahead", ahead).where(F.col("ahead") < top)
        kept = kept.join(bands.select("lang", "band"), ["lang", "band"], "left_semi")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = counts.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
