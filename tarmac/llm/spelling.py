"""Spelling variants: words one edit apart, by composition of finite-state machines.

The vocabulary is an acceptor.  Composed with a transducer that makes exactly one
edit and with the acceptor again it accepts the pairs of words that are near.
The composition is cut into partitions by the state that its machines start in.
A pair of words whose shorter one has n code points either shares the first n // 2
of them (the acceptor has read them and stands in that state) or the remaining
n - n // 2 at the end (the same for the acceptor of reversed words).  So the words
of n and n + 1 code points fall into partitions by shared head and by shared tail,
and a pair belongs to exactly one of them: the tail's only if the heads differ.
A partition of more than ``most`` words is cut again in the same way, inside what
its words do not share, until it is small or that is a single code point.  No
partition grows with the corpus, no pair is lost.

In a partition the minimised acceptor of the unshared parts is built, its words
numbered in order (each state knows how many words it accepts), and the pairs are
put together from the last states to the first, as pairs of numbers.

Null texts have no words; a null id counts as the empty text in the checksum.  A
very long text goes through a task as a whole; a very long run is one word.  Rows
that repeat a document count each.  The largest n decides a form, ties go to the
smallest word.  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import saved, slices, text_bytes

#: Words of this many code points and more are taken.
LEAST_LENGTH = 7
#: A word has a form if that is so many times as frequent.
RATIO = 10
#: Words of a partition beyond which it is cut again.
MOST = 20_000
#: Distinct words a task holds before it passes its counts on.
_HELD = 400_000
_PIECE = 4 << 20

Edges = tuple[tuple[str, int], ...]


# --- words -------------------------------------------------------------------


def misspelt(run: str, start: int, every: int) -> str:
    """The run, without one of its code points where its checksum is a multiple of ``every``; ``start`` is the checksum of what precedes it."""
    h = zlib.crc32(run.encode(), start)
    return run if h % every else run[: (i := h % len(run))] + run[i + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, every: int = 31, twice: int = 2) -> DataFrame:
    """Rows ``word``, ``n``: words of ``least`` code points and ``twice`` occurrences or more."""
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for piece in slices(b, 1, _PIECE):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    start = zlib.crc32(f"{doc_id or ''}:".encode())
                    for found, n in Counter(runs.findall(text.lower().decode())).items():
                        word = misspelt(found, start, every)
                        if len(word) >= least:
                            tally[word] += n
                    if len(tally) >= _HELD:
                        yield told()
                        tally.clear()
        yield told()

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


# --- machines ----------------------------------------------------------------


class Acceptor:
    """The minimised acceptor of sorted distinct words.

    States are numbered so that targets come before sources.  ``sizes`` has the
    number of words that a state accepts, ``offsets`` the number of its words
    before each of its edges.
    """

    def __init__(self, words: list[str]):
        self.finals: list[bool] = []
        self.edges: list[Edges] = []
        self.sizes: list[int] = []
        self.offsets: list[dict[str, tuple[int, int]]] = []
        known: dict[tuple[bool, Edges], int] = {}
        open_states: list[list] = [[False, []]]

        def close() -> None:
            final, edges = open_states.pop()
            key = (final, tuple(edges))
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.finals)
                self.finals.append(final)
                self.edges.append(key[1])
                before, offsets = int(final), {}
                for label, target in edges:
                    offsets[label] = (target, before)
                    before += self.sizes[target]
                self.sizes.append(before)
                self.offsets.append(offsets)
            if open_states:
                label, _ = open_states[-1][1][-1]
                open_states[-1][1][-1] = (label, state)

        last = ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            while len(open_states) > shared + 1:
                close()
            for label in word[shared:]:
                open_states[-1][1].append((label, -1))
                open_states.append([False, []])
            open_states[-1][0] = True
            last = word
        while open_states:
            close()
        self.start = len(self.finals) - 1


def one_edit_pairs(a: Acceptor) -> list[tuple[int, int]]:
    """The acceptor composed with one edit and itself: pairs of word numbers, the shorter word first if lengths differ."""
    offsets, finals = a.offsets, a.finals
    met: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def meet(s: int, t: int, but: str | None = None) -> list[tuple[int, int]]:
        """Numbers, in s and in t, of the words both accept; none that begins with ``but``."""
        if but is None:
            while s != t:  # along stretches without a choice
                if finals[s] or finals[t] or len(offsets[s]) != 1 or len(offsets[t]) != 1:
                    break
                ((label, (s2, _)),), ((other, (t2, _)),) = offsets[s].items(), offsets[t].items()
                if label != other:
                    return []
                s, t = s2, t2
            if s == t:
                return [(i, i) for i in range(a.sizes[s])]
            if (found := met.get((s, t))) is not None:
                return found
        found = [(0, 0)] if finals[s] and finals[t] else []
        mine, yours = offsets[s], offsets[t]
        for label in mine.keys() & yours.keys():
            if label != but:
                (s2, i), (t2, j) = mine[label], yours[label]
                found += [(i + x, j + y) for x, y in meet(s2, t2)]
        if but is None:
            met[s, t] = found
        return found

    pairs: list[list[tuple[int, int]]] = []
    for state, edges in enumerate(a.edges):
        own, found = offsets[state], []
        # one code point for another
        for (b, s), (c, t) in combinations(edges, 2):
            if both := meet(s, t):
                i, j = own[b][1], own[c][1]
                found += [(i + x, j + y) for x, y in both]
        # one more code point, put behind its equals
        for b, t in edges:
            if both := meet(state, t, b):
                j = own[b][1]
                found += [(x, j + y) for x, y in both]
        # the edit comes later
        for label, target in edges:
            if later := pairs[target]:
                before = own[label][1]
                if before or found:
                    found += [(before + x, before + y) for x, y in later]
                else:  # nothing to add to: a long stretch without a choice passes them on
                    found = later if len(edges) == 1 else list(later)
        pairs.append(found)
    return pairs[a.start] if pairs else []


def near_in_partition(n: int, head: int, tail: int, words: dict[str, int]) -> Iterator[tuple[str, int, int, str]]:
    """Per word with near ones in its partition: the word, how many, the largest n of them and the smallest word that has it."""
    if not any(len(w) == n for w in words):
        return
    parts = sorted((w[head : len(w) - tail], w) for w in words)
    best: dict[str, list] = {}
    for i, j in one_edit_pairs(Acceptor([p for p, _ in parts])):
        (p, u), (q, v) = parts[i], parts[j]
        if min(len(u), len(v)) != n or (tail and len(u) != len(v) and q.startswith(p)):
            continue
        for x, y in ((u, v), (v, u)):
            m, b = words[y], best.get(x)
            if b is None:
                best[x] = [1, m, y]
            else:
                b[0] += 1
                if m > b[1] or (m == b[1] and y < b[2]):
                    b[1], b[2] = m, y
    for x, (k, m, y) in best.items():
        yield x, k, m, y


# --- partitions --------------------------------------------------------------


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """Rows ``key`` (base length, shared head and tail), ``head``, ``tail``, ``base``, ``word``, ``n``."""

    def keyed(df: DataFrame) -> DataFrame:
        shared = F.concat_ws(" ", "base", "head", "tail", F.expr("substring(word, 1, head)"), F.expr("right(word, tail)"))
        return df.withColumn("key", shared)

    def cut(df: DataFrame) -> DataFrame:
        """Rows of both halves of what the words of a partition do not share."""
        middle = F.expr("head + (base - head - tail) div 2").cast("int")
        halves = F.array(F.struct(middle.alias("head"), F.col("tail")), F.struct(F.col("head"), (F.col("base") - middle).cast("int").alias("tail")))
        return keyed(df.select("base", "word", "n", F.explode(halves).alias("h")).select("base", "h.head", "h.tail", "word", "n"))

    length = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("base")).withColumns({"head": F.lit(0), "tail": F.lit(0)})
    rows, done = cut(whole), None
    while True:
        crowded = saved(rows.groupBy("key").agg(F.count("*").alias("k"), F.first(F.expr("base - head - tail")).alias("free")).where((F.col("k") > most) & (F.col("free") > 1)).select("key"))
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rows = saved(rows)
        small = rows.join(crowded, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = cut(rows.join(crowded, "key", "left_semi"))


_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def near_counts(rows: DataFrame) -> DataFrame:
    """Rows ``word``, ``n_near``, ``near_n``, ``near`` of each partition."""

    def told(key: str, words: dict[str, int]) -> list[tuple]:
        base, head, tail, *_ = key.split(" ")
        return [(w, None, k, m, v) for w, k, m, v in near_in_partition(int(base), int(head), int(tail), words)]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_NEAR)], schema=_NEAR)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, out = None, {}, []
        for b in batches:
            for key, word, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                if key != now:
                    if len(words) > 1:
                        out += told(now, words)
                        if len(out) > 50_000:
                            yield batch(out)
                            out = []
                    now, words = key, {}
                words[word] = n
        if len(words) > 1:
            out += told(now, words)
        yield batch(out)

    dealt = rows.select("key", "word", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, n bigint, n_near bigint, near_n bigint, near string")


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """Per word ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    ``words`` has distinct words and their counts.  A form is ``ratio`` times as
    frequent as its word, so forms lead to a root in as many steps as the largest
    count has digits (to base ``ratio``), each of them one join.
    """
    words = saved(words)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))).alias("best")
    all_near = (
        words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
        .unionByName(near_counts(partitions(words, most)))
        .groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    )
    leads = -F.col("best.m") >= F.lit(ratio).cast("decimal(20,0)") * F.col("n")
    found = saved(all_near.select("word", "n", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")))
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    roots = steps
    while True:
        further = saved(roots.join(steps.toDF("root", "next"), "root").select("word", F.col("next").alias("root")))
        if further.isEmpty():
            break
        roots = saved(roots.join(further.select("word"), "word", "left_anti").unionByName(further))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
