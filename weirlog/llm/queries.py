"""Registered queries of the package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import collocations, fuzzy_lines, hard_negatives, jaccard, main_text, phrase_index, pieces, quality_rules, repeats, simhash, site_quality, token_counts, token_files
from weirlog.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_repeats(spark, sf):
    cut = repeats.remove_repeats(table(spark, sf, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op1_repeats"] = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 49))) AS k FROM texts)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT doc_id, k FROM windows JOIN firsts USING (g) WHERE doc_id > first),
marked AS (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER w + 50 THEN 0 ELSE 1 END AS new FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
numbered AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
spans AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
joined AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN joined USING (doc_id)
"""


@query
def op2_token_files(spark, sf):
    out = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), out, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.index_tokens(spark, out)


@query
def op3_site_quality(spark, sf):
    return site_quality.site_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_sentencepiece(spark, sf):
    encoded = pieces.encode(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_tokens", "ids_crc32", "round_trip")


@query
def op5_quality_rules(spark, sf):
    rated = quality_rules.quality_rules(
        table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
    )
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "reason", "chars_per_piece", "chars_per_byte_token", "byte_share", "token_entropy",
    )


@query
def op6_phrase_index(spark, sf):
    found = phrase_index.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLES["op6_phrase_index"] = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
marks AS (
  SELECT item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM marks WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, phrase)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op7_jaccard_join(spark, sf):
    return jaccard.similar_documents(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op7_jaccard_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reached r JOIN ways ON other = x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reached r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY ALL
"""


@query
def op8_token_counts(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


@query
def op9_fuzzy_lines(spark, sf):
    kept = fuzzy_lines.dedup_lines(table(spark, sf, "documents"), shingle=5)
    return kept.selectExpr("doc_id", "n_lines", "n_removed", "sha2(text, 256) as text_sha256")


@query
def op10_main_text(spark, sf):
    return main_text.main_text(table(spark, sf, "pages"))


@query
def op11_hard_negatives(spark, sf):
    """Labels of every seventh row are shifted, as wrong labels are."""
    label = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), label=label)


ORACLES["op11_hard_negatives"] = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""


@query
def op12_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


@query
def op13_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


ORACLES["op13_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS lengths(k) WHERE len(w) >= k)
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100),
parts AS (
  SELECT lang, a, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS i FROM candidates, range(2, 5) AS sizes(size) WHERE size < k)),
cuts AS (
  SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n, (1000 * CAST(a AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN totals USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(w[1 : j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(w[j + 1 :], ' ')),
kept AS (
  SELECT * FROM cuts c WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""
