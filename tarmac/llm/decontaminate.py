"""Benchmark decontamination by winnowing.

Documents and benchmark items become words (runs of digits, letters a to z and
characters beyond ASCII, A to Z lower-cased).  Of each stretch of ``window`` words
the last least hash among its grams of ``gram`` words is kept as its fingerprint,
on both sides, so that a span of ``window`` equal words always shares one.  An
item of fewer words is one window, and documents are winnowed for each length of
such items too (at most ``window`` lengths).

A fixed-size bitmap of the items' fingerprints goes to the documents' scan; what
it lets through is joined on the fingerprint, and the hit extended to whole
windows, which are compared word by word (they are part of the join's key).  Hits
next to each other grow into spans.  The bitmap's size does not depend on the
benchmark: with a larger one it lets more through, and the join decides.

Windows that the same items hold share one set of items, kept as a digest of its
ids; documents with the same sets share one list of items.  So a passage that a
third of all documents and of all items hold is neither listed per pair nor
gathered in one task: the adaptive skew join may split its rows, as each row finds
at most one match.

Null and empty texts, and texts without a word, have no words and no hits.  A very
long text goes through a task as a whole, in rows of its own.  Rows that repeat a
document have a result each; a repeated item counts once.  An item without an id
marks words but is not listed.  Either table may be empty.  Only the id and text
columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.chunks import BASES, word_hashes
from tarmac.llm.common import mix, saved, slices, text_bytes

WINDOW, GRAM = 10, 5
#: The bitmap has two to this power of bits: 8 MB, whatever the benchmark.
FILTER_BITS = 26
#: Bits of one part of the bitmap, as Spark's bitmap functions have it.
_PART = 15
#: Bytes of text that a task works on at a time.
_PIECE = 4 << 20

#: Word bytes stay, A to Z become small, all else parts words.
_TO_WORDS = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` values in a row."""
    n = len(values) - gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, gram, dtype=np.uint64)
    for d in range(gram):
        h *= np.uint64(BASES[0])
        h += values[d : d + n]
        mix(h)
    return h


def winnow(values: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a stretch of ``span`` words of one text begins, the place of its fingerprint, and all gram hashes by place."""
    gram = min(gram, span)
    hashes = gram_hashes(values, gram)
    sizes = np.diff(starts)
    ends = np.repeat(starts[1:], sizes)
    at = np.arange(len(values))
    at = at[at + span <= ends]
    place = at + (span - gram)
    least = hashes[place]
    for d in range(span - gram - 1, -1, -1):
        other = hashes[at + d]
        less = other < least
        least[less] = other[less]
        place[less] = at[less] + d
    return at, place, hashes


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


class _Texts:
    """Some texts as words, hashed."""

    def __init__(self, texts: list[bytes]):
        self.words = [words_of(t) for t in texts]
        self.values, self.starts = word_hashes(self.words)

    def windows(self, span: int, gram: int, passes: np.ndarray | None = None) -> Iterator[tuple[int, int, int, bytes]]:
        """Text, first word, fingerprint and words of each stretch of ``span`` words whose fingerprint passes."""
        at, place, hashes = winnow(self.values, self.starts, span, gram)
        if passes is not None:
            top = (hashes >> np.uint64(64 - (len(passes) * 8).bit_length() + 1)).astype(np.int64)
            keep = (passes[top >> 3] >> (top & 7).astype(np.uint8) & 1).astype(bool)[place]
            at, place = at[keep], place[keep]
        text = np.searchsorted(self.starts, at, side="right") - 1
        first = at - self.starts[text]
        for t, s, fp in zip(text.tolist(), first.tolist(), signed(hashes[place]).tolist()):
            yield t, s, fp, b" ".join(self.words[t][s : s + span])


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """Distinct rows ``item_id`` (string), ``span``, ``fp``, ``words``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, 1, _PIECE):
                ids = piece.column(0).to_pylist()
                texts = _Texts(piece.column(1).to_pylist())
                rows = []
                for span in {min(window, len(w)) for w in texts.words} - {0}:
                    for t, _, fp, words in texts.windows(span, gram):
                        if span == min(window, len(texts.words[t])):
                            rows.append((ids[t], span, fp, words))
                yield _batch(_ITEM, rows)

    own = benchmark.select(F.col(id_col).cast("string").alias("item_id"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, "item_id string, span int, fp bigint, words binary").distinct()


_ITEM = pa.schema([("item_id", pa.string()), ("span", pa.int32()), ("fp", pa.int64()), ("words", pa.binary())])
_CANDIDATE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("span", pa.int32()), ("start", pa.int64()), ("fp", pa.int64()), ("words", pa.binary())])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def fingerprint_bitmap(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Which leading ``bits`` bits a fingerprint has: one bit each, the lowest first.

    At most 2 ** (bits - 15) rows of 4 kB reach the driver.
    """
    top = F.shiftrightunsigned("fp", 64 - bits)
    parts = (
        windows.groupBy(F.shiftright(top, _PART).alias("part"))
        .agg(F.bitmap_construct_agg(top.bitwiseAND(F.lit((1 << _PART) - 1))).alias("bits")).collect()
    )
    bitmap = np.zeros(1 << bits - 3, dtype=np.uint8)
    for p in parts:
        bitmap[p.part << _PART - 3 : (p.part + 1) << _PART - 3] = np.frombuffer(p.bits, np.uint8)
    return bitmap


def candidates(docs: DataFrame, id_col: str, text_col: str, spans: list[int], gram: int, bitmap: np.ndarray) -> DataFrame:
    """A row per document (``start`` null) and one per stretch whose fingerprint the bitmap lets through."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for piece in slices(b, 1, _PIECE):
                ids = piece.column(0).to_pylist()
                texts = _Texts(piece.column(1).to_pylist())
                rows = [(row + t, i, len(w), None, None, None, None) for t, (i, w) in enumerate(zip(ids, texts.words))]
                for span in spans:
                    for t, s, fp, words in texts.windows(span, gram, bitmap):
                        rows.append((row + t, ids[t], None, span, s, fp, words))
                        if len(rows) >= 100_000:
                            yield _batch(_CANDIDATE, rows)
                            rows = []
                row += len(ids)
                yield _batch(_CANDIDATE, rows)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, span int, start bigint, fp bigint, words binary")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``spans`` (hit word ranges, ends exclusive) and ``items`` (sorted ids of items with an occurring window)."""
    key = ["span", "fp", "words"]
    named = saved(item_windows(benchmark, item_col, item_text_col, window, gram))
    spans = [r.span for r in named.select("span").distinct().collect()]  # at most ``window`` of them
    rows = saved(candidates(docs, id_col, text_col, spans, gram, fingerprint_bitmap(named, filter_bits)))
    held = F.struct(
        F.coalesce(F.bit_xor(F.when(F.col("item_id").isNotNull(), F.xxhash64("item_id"))), F.lit(0)).alias("a"),
        F.coalesce(F.bit_xor(F.when(F.col("item_id").isNotNull(), F.xxhash64("item_id", F.lit("again")))), F.lit(0)).alias("b"),
        F.count("item_id").alias("n"),
    )
    windows = named.groupBy(key).agg(held.alias("held"))
    hits = rows.where("start IS NOT NULL").join(windows, key).select("row", "start", (F.col("start") + F.col("span")).alias("end"), "held")
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grown = (
        hits.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("long"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "island").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("range"), F.collect_set("held").alias("sets"))
        .groupBy("row").agg(F.sort_array(F.collect_list("range")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    )
    grown = saved(grown)
    lists = grown.select("sets").distinct()
    wanted = lists.select("sets", F.explode("sets").alias("held"))
    one = windows.join(wanted.select("held").distinct(), "held", "left_semi").groupBy("held").agg(F.min(F.struct(*key)).alias("w")).select("held", "w.*")
    members = one.join(named.where("item_id IS NOT NULL"), key).select("held", "item_id")
    lists = wanted.join(members, "held").groupBy("sets").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = grown.join(lists, "sets", "left").select("row", "spans", "items")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (
        rows.where("start IS NULL").select("row", "doc_id", "n_words").join(found, "row", "left")
        .select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
