"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram reaches the driver: at most ``capacity`` numbers.  The linear
program has a variable for each way to fill a sequence; multiplicative weights
solve it, and a knapsack dynamic program finds the best filling at the current
prices.  The solution is rounded down; what is left is filled by exact subset
sums, the longest first.  Of several shares of the solution that one is kept which
needs the fewest sequences in the end.  Each piece then looks up its place by its
number among the pieces of its length, which partitions count by themselves.

Null texts are empty and consist of the end token.  Every row is a document of
its own, also if it repeats an id; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tarmac.llm.common import saved, slices

CAPACITY = 1024
#: Stretches that a process remembers, and bytes of text that it asks the tokenizer about at once.
_REMEMBERED, _GROUP = 500_000, 4 << 20
#: Stretches that go to the tokenizer as one text.
_ROW = 256
_TWO_SPACES = re.compile(r"\s\s")
#: What a text must not hold if it is to be cut by classes of bytes: control characters, letters beyond Latin-1; two spaces in a row.
_UNPLAIN = re.compile(r"[^ -~\n\t\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]")
_PAIRS = [a + b for a in " \n\t" for b in " \n\t"]
_LETTER, _DIGIT, _OTHER, _QUOTE, _BLANK, _BREAK = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.uint8)
    for signs, kind in ((string.ascii_letters.encode() + bytes(range(128, 256)), _LETTER), (string.digits.encode(), _DIGIT), (b"'", _QUOTE), (b" ", _BLANK), (b"\n\t\x01", _BREAK)):
        out[list(signs)] = kind
    return out


def _borders() -> np.ndarray:
    """Whether a token surely ends between two classes; around an apostrophe it may not, a blank goes with what follows."""
    left, right = np.indices((6, 6))
    runs = (left != right) & (left != _QUOTE) & (right != _QUOTE) & (left != _BLANK)
    return (runs | (right >= _BLANK) | (left == _BREAK)).ravel()


_CLASS, _BORDER = _classes(), _borders()


def stretches(texts: list[bytes]) -> list[list[bytes]]:
    """Plain texts, each cut wherever a run of letters, of digits or of other signs ends."""
    data = np.frombuffer(b"\x01".join(texts), np.uint8)
    if not len(data):
        return [[] for _ in texts]
    kind = _CLASS[data]
    cut = np.flatnonzero(_BORDER[kind[:-1] * np.uint8(6) + kind[1:]]) + 1
    parts = np.insert(data, cut, 0).tobytes().split(b"\x00")
    ends = [*np.flatnonzero(data[np.append(0, cut)] == 1).tolist(), len(parts)]
    return [parts[a:b] for a, b in zip([0, *[e + 1 for e in ends]], ends)]


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, by the tokenizers library.

    A text's stretches that the tokenizer treats apart are encoded once and
    remembered; new ones go to the library in long rows, which the lengths of the
    tokens take apart again.  Where the tokenizer cuts at letters, digits and other
    signs, plain texts are cut so too.  In texts where no two space characters
    meet, every blank and what follows up to the next one is a stretch.  Other
    texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        special = {i: len(content.encode()) for i, content in added.items()}
        vocab = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = special.get(i, len(token))  # byte-level: a character stands for a byte
        cutter = self.library.pre_tokenizer
        self.cuts_by_class = bool(getattr(cutter, "use_regex", False)) and not cutter.add_prefix_space and self.library.normalizer is None
        self.apart = [*_PAIRS, *added.values()]
        self.known: dict[str | bytes, bytes] = {}

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str] | list[bytes], after: bytes = b"") -> None:
        """Stretches joined into rows; what comes ``after`` each is one token or nothing."""
        rows = [new[i : i + _ROW] for i in range(0, len(new), _ROW)]
        data = [[s if isinstance(s, bytes) else s.encode() for s in row] for row in rows]
        for row, own, ids in zip(rows, data, self._ask([(after.join(d) + after).decode() for d in data])):
            ends = np.cumsum([len(s) + len(after) for s in own])
            cut = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 4).tolist()
            found = ids.tobytes()
            self.known.update(zip(row, [found[a : b - 4 * len(after)] for a, b in zip([0, *cut], cut)]))

    def _plain(self, text: str) -> bool:
        return self.cuts_by_class and not _UNPLAIN.search(text) and not any(x in text for x in self.apart)

    def _by_class(self, texts: list[bytes]) -> list[bytes]:
        parts = stretches(texts)
        new = set().union(*parts) - self.known.keys()
        self._learn([s for s in new if len(s) > 1 and s[0] == 32])
        self._learn([s for s in new if s[0] not in b" \n\t"], b"\n")
        alone = [s for s in new if s in (b" ", b"\n", b"\t")]
        self.known.update(zip(alone, [x.tobytes() for x in self._ask([s.decode() for s in alone])]))
        return [b"".join(map(self.known.__getitem__, x)) for x in parts]

    def _by_blank(self, texts: list[str]) -> list[bytes]:
        known = self.known
        parts = [None if "\x00" in t or _TWO_SPACES.search(t) else t.replace(" ", "\x00 ").split("\x00") for t in texts]
        new = set().union(*[x for x in parts if x is not None]) - known.keys()
        alone = [s for s in new if len(s) < 2 or s[0] != " "]
        self._learn([s for s in new if len(s) > 1 and s[0] == " "])
        known.update(zip(alone, [x.tobytes() for x in self._ask(alone)]))
        whole = iter(self._ask([t for t, x in zip(texts, parts) if x is None]))
        return [next(whole).tobytes() if x is None else b"".join(map(known.__getitem__, x)) for x in parts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        plain = [*map(self._plain, texts)]
        by_class = iter(self._by_class([t.encode() for t, p in zip(texts, plain) if p]))
        by_blank = iter(self._by_blank([t for t, p in zip(texts, plain) if not p]))
        return [next(by_class if p else by_blank) for p in plain]


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python process."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of at most ``capacity`` tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            encoder = encoder or _encoder(path)
            for part in slices(batch, 1, _GROUP):
                rows = []
                for name, ids in zip(part.column(0).to_pylist(), encoder(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cut = [0, *range(n - capacity * ((n - 1) // capacity), n, capacity), n]
                    rows += [(name, i, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(cut, cut[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_filling(price: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """Indexes of the lengths (with repetition) that bring the most within ``capacity``: knapsack by dynamic programming."""
    worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")  # lengths ascend
    for c in range(1, capacity + 1):
        k = usable[c]
        worth[c], pick[c] = worth[c - 1], -1
        if k:
            value = worth[c - lengths[:k]] + price[:k]
            best = int(value.argmax())
            if value[best] > worth[c]:
                worth[c], pick[c] = value[best], best
    out, c = [], capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(pick[c]))
            c -= int(lengths[pick[c]])
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 800) -> dict[tuple[int, ...], float]:
    """Fillings (indexes of lengths) with weights that cover the ``counts``: the linear program by multiplicative weights.

    A length's price starts at its share of a sequence and falls by a factor for
    every time that its pieces are covered; the filling that brings the most is
    added until everything is covered or the rounds are over, then scaled to cover
    no more than there is on average.
    """
    # few lengths allow small steps within the same rounds, and with them steep prices
    step = float(np.clip(len(lengths) / rounds, 0.004, 0.25))
    rate = min(20.0, 0.25 / step)
    covered = np.zeros(len(lengths))
    found: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        lag = covered / counts
        if lag.min() >= 1:
            break
        filling = tuple(sorted(best_filling(lengths / capacity * np.exp(-rate * (lag - lag.min())), lengths, capacity)))
        used, times = np.unique(filling, return_counts=True)
        add = step * float((counts[used] / times).min())
        covered[used] += add * times
        found[filling] = found.get(filling, 0.0) + add
    scale = min(1.0, 1.0 / float((covered / counts).mean()))
    return {f: x * scale for f, x in found.items()}


def fill_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings for what is left: the longest piece, then the fullest sequence that the rest allows, as often as it can be had."""
    out = []
    left = left.copy()
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        room = capacity - int(lengths[top])
        reach, steps, mask = 1, [], (1 << (room + 1)) - 1
        for i in np.flatnonzero(rest)[::-1].tolist():
            if reach >> room & 1:
                break
            size, many = int(lengths[i]), min(int(rest[i]), room // int(lengths[i]))
            for _ in range(many):
                steps.append((i, reach))
                more = (reach | reach << size) & mask
                if more == reach:
                    steps.pop()
                    break
                reach = more
        at, filling = reach.bit_length() - 1, [top]
        for i, before in reversed(steps):
            if not before >> at & 1:
                filling.append(i)
                at -= int(lengths[i])
        used, times = np.unique(filling, return_counts=True)
        many = int((left[used] // times).min())
        left[used] -= many * times
        out.append((tuple(sorted(filling)), many))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), holding every piece exactly once."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    if not len(lengths):
        return []
    solution = sorted(solve(lengths, counts.astype(float), capacity).items(), key=lambda fx: -fx[1])
    best: list[tuple[tuple[int, ...], int]] = []
    # rounded down to several shares of the solution: whichever leaves the rest easiest to fill
    for share in (1.0, 0.5, 0.25, 0.0):
        left, chosen = counts.copy(), []
        for filling, x in solution:
            used, times = np.unique(filling, return_counts=True)
            many = min(int(share * x), int((left[used] // times).min()))
            if many:
                left[used] -= many * times
                chosen.append((filling, many))
        chosen += fill_rest(lengths, left, capacity)
        if not best or sum(m for _, m in chosen) < sum(m for _, m in best):
            best = chosen
    return [(tuple(int(lengths[i]) for i in filling), many) for filling, many in best]


def _slots(fillings: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: number of its first piece, first sequence, pieces per sequence and offset, for each filling that has it."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for filling, many in fillings:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            times = filling.count(length)
            found.setdefault(length, []).append((taken.get(length, 0), sequence, times, offset))
            taken[length] = taken.get(length, 0) + times * many
            offset += times * length
        sequence += many
    return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in found.items()}


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rank`` from 0 among all rows with the same ``by``; ``rows`` must be saved.

    A row counts within its partition, and partitions add up, so a value that a
    third of all rows hold is not gathered anywhere.
    """
    placed = rows.withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part", by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", by, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", by).orderBy("doc_id", "piece"))
    return (
        placed.withColumn("_within", within).join(offsets, ["_part", by])
        .withColumn("rank", F.col("_before") + F.col("_within") - 1).drop("_part", "_n", "_before", "_within")
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    cut = saved(cut)
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = _slots(plan(histogram, capacity))

    @arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for one in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == one)
            first, base, times, begin = slots[one]
            k = np.searchsorted(first, ranks[at], side="right") - 1
            within = ranks[at] - first[k]
            sequence[at] = base[k] + within // times[k]
            offset[at] = begin[k] + within % times[k] * one
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    placed = numbered(cut, "length").withColumn("_place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
