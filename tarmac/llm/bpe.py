"""BPE encoding and decoding with a pair occurrence index.

A partition is worked through in groups of bounded size.  The distinct words of a
group lie in one row of symbols with links to their neighbours.  An index maps
each pair of neighbours that the merge table knows to all its places; the active
ranks are applied in ascending order, each to all its places at once, and the
pairs that arise are added to the lists of their ranks.  As every merge of the
table comes after those that make its parts (checked on loading), that gives the
same ids as merging each word by itself.

Normaliser, word splitting and special tokens are those of the tokenizer file.
Null texts are empty; there is one result row for every row.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import slices, text_bytes

GROUP_BYTES = 4 << 20
#: Stretches of text that a task remembers.
REMEMBERED = 250_000
_NONE = np.int64(1 << 40)

#: Fixed by the tokenizer file for ASCII text: its split pattern on lower-case bytes.
_ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\t-\ra-z0-9]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge table of a BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if self.end == "" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a tokenizer with word ends and plain special tokens is expected")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        made_by = np.full(max(self.vocab.values()) + 1, -1, dtype=np.int64)
        made_by[self.made] = np.arange(len(pairs))
        rank = np.arange(len(pairs))
        if len(set(self.made.tolist())) < len(pairs) or (made_by[self.left] >= rank).any() or (made_by[self.right] >= rank).any():
            raise ValueError("merges must come after those that make their parts")
        self.size = len(made_by)
        keys = self.left * self.size + self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([self.vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in chars], dtype=np.int64)
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        # with an ASCII pattern of its own only for the split this module knows
        pre = json.dumps(spec["pre_tokenizer"])
        self.ascii = "[^\\\\s\\\\p{L}\\\\p{N}]+" in pre and "'s|'t|'re|'ve|'m|'ll|'d" in pre and "Lowercase" in json.dumps(spec["normalizer"])

    def words(self, piece: bytes) -> list[bytes]:
        """The words of a stretch without ASCII space, normalised, as bytes."""
        if self.ascii and piece.isascii():
            return _ASCII_WORDS.findall(piece.lower())
        text = self.library.normalizer.normalize_str(piece.decode("utf-8"))
        return [bytes(self.byte_of[c] for c in word) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, data: bytes) -> list:
        """A text's stretches between ASCII spaces; special tokens are ``str``."""
        if self.split is None or b"<|" not in data:
            return data.split()
        out: list = []
        for i, part in enumerate(self.split.split(data.decode("utf-8"))):
            out += [part] if i % 2 else part.encode("utf-8").split()
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.by_key[at], _NONE)


def merge_words(words: list[bytes], table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row, and how many each word has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    data = np.frombuffer(b"".join(words), np.uint8)
    sym = np.full(n + 1, -1, dtype=np.int64)
    sym[:n] = table.inner[data]
    ends = np.cumsum(lengths)
    final = ends[lengths > 0] - 1
    sym[final] = table.last[data[final]]
    after = np.arange(1, n + 2)
    after[final] = n
    before = np.arange(-1, n)
    before[(ends - lengths)[lengths > 0]] = n
    before = np.append(before[:n], n)
    after[n] = n
    # the index: places of every known pair, by rank
    rank = table.ranks(sym[:n], sym[after[:n]])
    at = np.flatnonzero(rank < _NONE)
    at = at[np.argsort(rank[at], kind="stable")]
    of = rank[at]
    cut = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    places: dict[int, list[np.ndarray]] = {int(of[a]): [at[a:b]] for a, b in zip(cut[:-1], cut[1:])}
    active = sorted(places)
    while active:
        r = heapq.heappop(active)
        found = places.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b, new = table.left[r], table.right[r], table.made[r]
        at = at[(sym[at] == a) & (sym[after[at]] == b)]
        if a == b and len(at) > 1:
            at = _leftmost(at, after)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        sym[at], sym[gone] = new, -1
        after[at], before[beyond] = beyond, at
        ahead = before[at]
        left, right = ahead[ahead < n], at[beyond < n]
        arisen = np.concatenate([left, right])
        rank = table.ranks(np.concatenate([sym[left], np.full(len(right), new)]), np.concatenate([np.full(len(left), new), sym[after[right]]]))
        known = rank < _NONE
        arisen, rank = arisen[known], rank[known]
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            arisen, rank = arisen[order], rank[order]
        cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)] if len(rank) else []
        for s, e in zip(cut, cut[1:]):
            k = int(rank[s])
            if k not in places:
                places[k] = []
                heapq.heappush(active, k)
            places[k].append(np.sort(arisen[s:e]))
    alive = sym[:n] >= 0
    count = np.add.reduceat(np.append(alive, False).astype(np.int64), np.minimum(ends - lengths, n)) if len(words) else lengths
    count[lengths == 0] = 0
    return sym[:n][alive], count


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping places of a pair of equal symbols, every other one from the left."""
    taken, out = -1, []
    for p, q in zip(at.tolist(), after[at].tolist()):
        if p != taken:
            out.append(p)
            taken = q
    return np.array(out, dtype=np.int64)


class Encoder:
    """Encodes groups of texts; stretches between spaces that were met before are remembered, up to a number."""

    def __init__(self, table: Merges):
        self.table = table
        self._forget()

    def _forget(self) -> None:
        self.number: dict = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)
        self.shown: list[str] = []

    def _learn(self, pieces: list) -> None:
        words: list[bytes] = []
        n_words = np.zeros(len(pieces), dtype=np.int64)
        special: list[tuple[int, int]] = []
        for i, piece in enumerate(pieces):
            if isinstance(piece, str):
                special.append((i, self.table.special[piece]))
            else:
                w = self.table.words(piece)
                words += w
                n_words[i] = len(w)
        ids, per_word = merge_words(words, self.table)
        start = np.append(0, np.cumsum(per_word))[np.append(0, np.cumsum(n_words))]
        count = np.diff(start)
        if special:
            where, what = np.array(special).T
            ids = np.insert(ids, start[where], what)
            count[where] = 1
        start = np.append(0, np.cumsum(count))
        names = [self.table.names[i] for i in ids.tolist()]
        self.shown += [" ".join(names[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        self.start = np.append(self.start, self.start[-1] + start[1:])
        self.ids = np.append(self.ids, ids.astype(np.int32))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, each text's offset (one more at the end), and their decoded forms."""
        if len(self.number) > REMEMBERED:
            self._forget()
        known, number = len(self.number), self.number
        of_text = [[number.setdefault(p, len(number)) for p in self.table.pieces(t)] for t in texts]
        self._learn(list(islice(number, known, None)))
        shown = self.shown
        decoded = [" ".join([s for s in map(shown.__getitem__, x) if s]) for x in of_text]
        sizes = [len(x) for x in of_text]
        flat = np.fromiter(chain.from_iterable(of_text), np.int64, sum(sizes))
        del of_text
        n = np.diff(self.start)[flat]
        ends = np.cumsum(n)
        pick = np.repeat(self.start[:-1][flat] - (ends - n), n)
        pick += np.arange(len(pick))
        return self.ids[pick], np.append(0, ends)[np.append(0, np.cumsum(sizes, dtype=np.int64))], decoded


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row ``doc_id``, ``ids`` and ``decoded``; ``path`` is the tokenizer file, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Merges(path))
            for part in slices(batch, 1, group_bytes):
                ids, offsets, decoded = encoder(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
