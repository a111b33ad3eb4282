"""The thin queries over the intended tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, lattice, packing, quality, secrets, sharding, toxicity, warc, webp
from .common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizer files lie."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store_texts(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), adapt=True)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_secret_scans, op4_best_fit_packing, op5_media_columns, op6_ngram_jaccard, op7_bpe, op8_lm_scoring, op9_sharding, op10_warc)}

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, 10 * n_symbols > word_chars AS s_failed, 2 * n_dup_lines > n_lines AS l_failed FROM m),
r AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE f) AS k FROM
  (SELECT source, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, s_failed, l_failed]) AS f FROM b) GROUP BY ALL),
p AS (SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS squares, sum(k)::DOUBLE / sum(n) AS mean, sum(k::DOUBLE * k / n) AS q FROM r GROUP BY rule),
c AS (SELECT rule, mean, CASE WHEN n - squares / n - hosts + 1 > 1e-9 AND mean * (1 - mean) > 0
  THEN ((q - n * mean * mean) / (mean * (1 - mean)) - hosts + 1) / (n - squares / n - hosts + 1) ELSE 0 END AS corr FROM p),
s AS (SELECT rule, mean, CASE WHEN corr > 1e-9 THEN least(greatest(1 / corr - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM c),
v AS (SELECT source, max((k + mean * strength) / (n + strength)) >= 0.5 AS host_failed FROM r JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR s_failed OR l_failed) AND NOT (host_failed AND (n_words < 40 OR 100 * n_repeat_words > 15 * n_words OR 20 * n_symbols > word_chars OR 4 * n_dup_lines > n_lines)) AS kept, host_failed
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

ORACLES["op6_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = w.doc_id
"""

ORACLES["op10_warc"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER w AS keeper, row_number() OVER (w ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS place FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND keeper IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper IS NOT NULL AND place > 1 THEN keeper END AS refers_to FROM k
"""

ORACLES["op9_sharding"] = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS stratum FROM documents),
e AS (SELECT doc_id, stratum, octet_length(encode(text))::BIGINT + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT)),
    lambda r, b: xor(r >> 8, t[((xor(r, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, tbl),
c AS (SELECT *, md5('interleave-1:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32) AS h FROM e),
r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST) - 1 + ('0x' || substr(md5('interleave-1/' || stratum), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / (count(*) OVER (PARTITION BY stratum))::DOUBLE AS share FROM c),
a AS (SELECT *, row_number() OVER (ORDER BY share, h, stratum, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // n)::INTEGER AS shard, place - ((place * 8 // n) * n + 7) // 8 AS slot, NULL::INTEGER AS grown_shard FROM a
"""
