"""The named queries of this subpackage; those that SQL can express have theirs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.catalogue.entry import Catalogue
from tarmac.llm import anchor_dedup, bpe, collocations, decontaminate, line_dedup, lm_score, packing, prefix_free, quality_rules, secrets, simhash, spelling, topk
from tarmac.llm.common import table

catalogue = Catalogue()


@catalogue.add("op3_decision_list")
def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(f"_counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"),
    )


@catalogue.add("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@catalogue.add(
    "op8_fixed_anchors",
    """
    WITH d AS (
      SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
    ), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
    ), t AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY s) > 1 AS again
      FROM (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM p WHERE i + 34 <= len(w))
    ), g AS (
      SELECT doc_id, p.i, w[p.i] AS word,
        coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), FALSE) AS gone
      FROM p LEFT JOIN t USING (doc_id, i)
    ), k AS (
      SELECT doc_id, count_if(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op8_fixed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchor_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@catalogue.add("op10_prefix_free_dedup")
def op10_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@catalogue.add("op4_pair_index_bpe")
def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@catalogue.add("op6_configuration_packing")
def op6_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@catalogue.add("op1_secret_ownership")
def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    order = F.create_map(*[F.lit(x) for pair in zip((*secrets.KINDS, "owned"), range(4)) for x in pair])
    line = lambda spans: F.array_join(
        F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("k"), s["end"].alias("b"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *map(count, secrets.KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.concat("base", "added")).alias("spans"), "n_specific", "n_examples",
    )


@catalogue.add("op9_deleted_interpolation")
def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@catalogue.add(
    "op2_columnar_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
    """,
)
def op2_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@catalogue.add(
    "op5_deletion_lines",
    """
    WITH l AS (
      SELECT doc_id, line, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    ), v AS (
      SELECT {'doc_id': doc_id, 'line': line} AS spot, place, array_to_string(CASE WHEN place = 0 THEN w ELSE list_concat(w[1 : place - 1], w[place + 1 :]) END, ' ') AS key
      FROM (SELECT *, unnest(range(0, len(w) + 1)) AS place FROM l WHERE len(w) >= 5)
    ), e AS (SELECT key, place, min(spot) AS first FROM v GROUP BY key, place
    ), s AS (SELECT key, min(first) AS first FROM e WHERE place > 0 GROUP BY key
    ), gone AS (
      SELECT spot FROM v JOIN e USING (key, place) WHERE first < spot
      UNION SELECT v.spot FROM v JOIN e ON v.key = e.key AND e.place = 0 AND v.place > 0 WHERE e.first < v.spot
      UNION SELECT v.spot FROM v JOIN s ON v.key = s.key AND v.place = 0 WHERE s.first < v.spot
    )
    SELECT doc_id, count(*) AS n_lines, count(gone.spot) AS n_removed,
      sha256(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (gone.spot IS NULL), '')) AS kept_sha256
    FROM l LEFT JOIN gone ON gone.spot = {'doc_id': l.doc_id, 'line': l.line} GROUP BY doc_id
    """,
)
def op5_deletion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_near_lines(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@catalogue.add(
    "op11_winnowing_decontamination",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), b AS (
      SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark
    ), bw AS (
      SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0))
    ), hit AS (
      SELECT doc_id, i, k, s FROM (
        SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
      ) SEMI JOIN bw USING (s)
    ), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
    ), t AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM hit JOIN bw USING (s) WHERE item IS NOT NULL) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@catalogue.add(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
    ), o AS (
      SELECT doc_id, run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
      WHERE length(run) >= 7 GROUP BY ALL
    ), h AS (
      SELECT run, n, 4294967295 - list_reduce(
        list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) AS h
      FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM o), crc
    ), v AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), d AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS part FROM (SELECT *, unnest(range(length(word))) AS i FROM v)
    ), e AS (
      SELECT a.word AS a, b.word AS b FROM d AS a JOIN d AS b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON d.part = v.word
      UNION SELECT v.word, d.word FROM d JOIN v ON d.part = v.word
    ), f AS (
      SELECT v.word, v.n, count(e.b) AS n_near, min({'m': -w.n, 'word': w.word}) FILTER (w.n >= 10 * v.n) AS best
      FROM v LEFT JOIN e ON e.a = v.word LEFT JOIN v AS w ON w.word = e.b GROUP BY v.word, v.n
    ), r AS (
      SELECT word, best.word AS root, 1 AS step FROM f WHERE best IS NOT NULL
      UNION ALL SELECT r.word, f.best.word, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.best IS NOT NULL
    )
    SELECT f.word, f.best.word AS form, coalesce(z.root, f.word) AS root, f.n, f.n_near, -f.best.m AS form_n
    FROM f LEFT JOIN (SELECT word, max_by(root, step) AS root FROM r GROUP BY word) AS z USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@catalogue.add(
    "op13_phrase_collocations",
    r"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w
      FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)
    ), c AS (
      SELECT lang, phrase, count(*) AS a, any_value(m) AS m FROM (
        SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS v(m))
      ) GROUP BY lang, phrase HAVING count(*) >= 30
    ), cuts AS (
      SELECT x.lang, x.phrase, x.a, k, h.a AS l, t.a AS r, CAST(2000000 * CAST(x.a AS HUGEINT) // (h.a + t.a) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM c WHERE m > 1) AS x
      JOIN c AS h ON h.lang = x.lang AND h.phrase = array_to_string(w[1 : k], ' ')
      JOIN c AS t ON t.lang = x.lang AND t.phrase = array_to_string(w[k + 1 :], ' ')
    ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), subs AS (
      SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, a, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS m FROM c WHERE m > 2))
      GROUP BY ALL
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best LEFT JOIN subs USING (lang, phrase) JOIN (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang) USING (lang)
    WHERE longer IS NULL OR 100 * longer < 80 * a
    QUALIFY rank <= 2000
    """,
)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@catalogue.add("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # imports the operators of this subpackage

    return corpus_pipeline.run(spark, sf_dir)
