"""Secrets in text, told apart by who else has them.

Patterns find the base kinds.  Beyond them every mixed token that looks like a live
credential is a candidate: letters of one or both cases with digits (base64, base32,
hex in either case, identifiers with dashes), shorter ones near a credential word.
Its hash is counted over the corpus by distinct repositories and owners.  What one
owner has is owner-specific and becomes a span of kind ``owned``, in however many of
its repositories it stands, as copies of a text do not make a secret an example; what
several owners have is an example or a placeholder and does not.  The base spans
carry the same counts (``n_examples``).

Counting is by distinct (hash, owner, repository), then by (hash, owner), then by
hash: a value that a third of all documents hold is pre-aggregated before every
shuffle.  Values themselves never leave the text, only their digests.

Null texts are empty; null repositories and owners count as one of their own.
Each row is scanned for itself, so repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tarmac.llm.common import saved

#: The base kinds, in their order.  Fixed patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "api")
# a maximal run is long enough or it fails as a whole, so the length can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
# a whole word, and between it and the token nothing but blanks, quotes, brackets, an assignment or "is"
_CREDENTIAL = re.compile(
    r"""(?<![A-Za-z])(?:passw(?:or)?d|pwd|secret|token|(?:api|access|private)[ _-]?key|credentials?|bearer|auth)(?:[ _-]?(?:key|token|secret))?(?![A-Za-z])(?:\s{1,4}(?:is|was)(?![A-Za-z]))?[\s"'`:=<>()\[\]{},]{1,8}""",
    re.IGNORECASE | re.ASCII,
)
_CHANGES = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_SEPARATED = re.compile(r"[+/_=-]")
_UPPER_HEX = re.compile(r"[0-9A-F]{16,}")

#: A candidate of at most so many owners is owner-specific.
OWNERS = 1
#: Bits per character from which a mixed token looks live: letters of both cases, of one case, next to a credential word.
ENTROPY, ENTROPY_ONE_CASE, ENTROPY_SHORT = 3.5, 3.0, 2.5
#: Characters of a token that needs no credential word.
LONG = 20

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("hash", T.StringType())])


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base kinds, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(found)]


def looks_live(token: str, near_word: bool = False) -> bool:
    """Letters and digits, mixed, and no repetition; shorter than ``LONG`` only hex or next to a credential word."""
    lower, upper = any(c.islower() for c in token), any(c.isupper() for c in token)
    if not (lower or upper) or not any(c.isdigit() for c in token):
        return False
    n = len(token)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    if near_word:  # "token covid-19" is prose: letters and digits change places twice at least
        return bits >= ENTROPY_SHORT and len(_CHANGES.findall(token)) >= 2
    if lower and upper and n >= LONG and bits >= ENTROPY:
        return True
    if n < LONG and not _UPPER_HEX.fullmatch(token):
        return False
    # words and numbers joined by dashes change from one to the other a few times only
    least = 4 if _SEPARATED.search(token) else 2
    return lower != upper and bits >= ENTROPY_ONE_CASE and len(_CHANGES.findall(token)) >= least


def scan_text(text: str) -> tuple[list[tuple], list[tuple]]:
    base = base_spans(text)
    taken = [(s, e) for s, _, e, _ in base]
    more, words = [], None
    for m in _TOKEN.finditer(text):
        if m[0].isalpha() or m[0].isdigit():
            continue
        if words is None:
            words = {w.end() for w in _CREDENTIAL.finditer(text)}
        if looks_live(m[0], m.start() in words) and not any(s < m.end() and m.start() < e for s, e in taken):
            more.append((m.start(), "owned", m.end(), m[0]))
    return base, more


def _as_spans(found: list[tuple]) -> list[dict]:
    return [{"start": s, "end": e, "kind": k, "hash": sha256(v.encode()).hexdigest()} for s, k, e, v in found]


_FOUND = T.StructType([T.StructField("base", T.ArrayType(_SPAN)), T.StructField("candidates", T.ArrayType(_SPAN))])
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.string())])


@arrow_udf(_FOUND)
def scan(texts: pa.Array) -> pa.Array:
    found = [scan_text(t) for t in texts.to_pylist()]
    parts = [pa.array([_as_spans(f[i]) for f in found], pa.list_(_ARROW_SPAN)) for i in range(2)]
    return pa.StructArray.from_arrays(parts, ["base", "candidates"])


def ownership(seen: DataFrame) -> DataFrame:
    """``hash``, ``n_repositories``, ``n_owners`` and ``specific`` from rows (hash, repository, owner)."""
    # structs, because a null owner or repository is one like any other
    pairs = seen.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counted = pairs.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    return counted.withColumn("specific", F.col("n_owners") <= OWNERS)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per row: ``doc_id``, ``repository``, ``text_key`` (of the text), ``base`` and ``added`` spans, ``n_examples`` and ``n_specific`` (of all candidates)."""
    found = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(repository_col).alias("repository"), F.col(owner_col).alias("owner"),
            F.xxhash64(text_col).alias("text_key"), scan(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("s"),
        ).select("doc_id", "repository", "owner", "text_key", "s.*")
    ).withColumn("row", F.monotonically_increasing_id())  # saved rows keep their places
    spans = found.select("row", "repository", "owner", F.explode(F.concat("base", "candidates")).alias("span"))
    judged = spans.join(ownership(spans.select("span.hash", "repository", "owner")), F.col("span.hash") == F.col("hash"))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("span.kind") == "owned") & F.col("specific"), F.col("span"))).alias("added"),
        F.count_if(~F.col("specific")).alias("n_examples"), F.count_if(F.col("specific")).alias("n_specific"),
    )
    rest = by_row.columns[1:]
    joined = found.join(by_row, "row", "left")
    return joined.select(
        "doc_id", "repository", "text_key", "base", F.coalesce("added", F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string,hash:string>>)")).alias("added"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in rest[1:]],
    )


@arrow_udf(T.StringType())
def _masked(texts: pa.Array, added: pa.Array) -> pa.Array:
    out = []
    for text, more in zip(texts.to_pylist(), added.to_pylist()):
        if text is not None:
            spans = [(s, e) for s, _, e, _ in base_spans(text)] + [(m["start"], m["end"]) for m in more or []]
            parts, at = [], 0
            for s, e in sorted(spans):
                if e > at:
                    parts += [text[at:s], "[SECRET]"] if s >= at else []
                    at = e
            text = "".join(parts) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``docs`` with every base and owner-specific span replaced by ``[SECRET]``; null texts stay null."""
    found = find(docs, id_col, text_col, id_col, owner_col).where(F.size("added") > 0)
    added = found.groupBy("doc_id", "text_key").agg(F.first("added").alias("added"))
    # whole rows are carried as one column, so that no name of theirs can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("own_key"))
    joined = keyed.join(added, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    return joined.select(F.col("row").withField(text_col, _masked("text", "added")).alias("row")).select("row.*")
