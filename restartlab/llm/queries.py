"""Registered queries of the text operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from restartlab.llm import ctw, decontaminate, fim, fingerprint, htmltext, language, near_dup, pieces, prefix_trie, pseudonyms, sharding, toxicity, warc
from restartlab.llm.common import held_out

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
KEY = "pseudonyms-of-this-corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.values_of(table(spark, sf_dir, "documents"), KEY)


def op4_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.scores(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0), depth=6)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of(table(spark, sf_dir, "documents"), shards=40)


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    return language.identify(docs, ~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.scores(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op11_capture_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place", "capture")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), prefix_trie.borrowed(F.col("conv_id")), block=4)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20).drop("output")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_main_text": op2_main_text,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_phrase_fingerprints": op4_phrase_fingerprints,
    "op5_context_tree": op5_context_tree,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_spaced_seeds": op7_spaced_seeds,
    "op8_language": op8_language,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
    "op11_capture_histories": op11_capture_histories,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

CAPTURE_HISTORIES_SQL = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') AS u FROM pages),
keyed AS (
  SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, sha1(p) AS payload_digest, max(page_id) OVER (PARTITION BY p) AS top,
    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\d*\.|:(80|443)$', '', 'g'), '.')), ',') || ')'
      || CASE WHEN regexp_replace(u, '^[^/?]*', '') = '' THEN '/' ELSE regexp_replace(u, '^[^/?]*', '') END AS url_key
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS place, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture
FROM keyed
"""

PREFIX_TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': r, 't': t} ORDER BY turn NULLS FIRST) AS l FROM turns GROUP BY c),
crc AS (
  SELECT c, l, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) % 6 AS h
  FROM own),
built AS (
  SELECT a.c, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l
  FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefixes AS (
  SELECT c, len(l) AS size, d, l[1:d] AS k FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(k[d].t)) END AS saved
  FROM prefixes GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (k, d)),
below AS (
  SELECT k[1:e] AS k, e AS d, sum(saved) AS saved, sum((n_children = 0)::INT) AS leaves
  FROM (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS e FROM full_nodes) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_nodes x JOIN below b USING (k, d) LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.k = x.k[1:x.d - 1]
"""

FILL_IN_MIDDLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM units),
ranks AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s
  FROM ranks)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""

ORACLES: dict[str, str] = {"op9_near_duplicates": NEAR_DUPLICATES_SQL, "op11_capture_histories": CAPTURE_HISTORIES_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL, "op13_fill_in_middle": FILL_IN_MIDDLE_SQL}
