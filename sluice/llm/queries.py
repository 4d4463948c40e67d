"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard_join, langid, licenses, lm, packing, quality, sharding, token_orc, warc
from .common import Workspace, table


def default_tokenizer() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), Workspace(spark, "op1"), n=3, percent=90)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = sharding.shard_documents(table(spark, sf_dir, "documents"), "op2", target_bytes=64 << 20)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Workspace(spark, "op3"), tokenizer or default_tokenizer())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op5_token_orc(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = Workspace(spark, "op5").at("tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or default_tokenizer())
    return token_orc.digests(spark, path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    told = langid.identify(documents.select("doc_id", "text"), documents.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", told["lang_score"].alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.train_and_score(spark, table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), Workspace(spark, "op10"))
    read = warc.read_archives(manifest, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_license_scan": op4_license_scan,
    "op5_token_orc": op5_token_orc,
    "op6_language_id": op6_language_id,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS x FROM p),
d AS (SELECT page_id, n, x, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS dig FROM h),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.dig AS payload_digest, CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to FROM d JOIN f USING (x)
""",
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 90 * (len(a.s) + len(b.s) - c)),
bi AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, bi.y FROM r JOIN bi ON r.y = bi.x)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = doc_id
""",
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[i:i + 12] AS gram FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(gram) AS n FROM g),
p AS (SELECT doc_id, i, n, w[i:i + n - 1] AS gram FROM d, lens, unnest(range(1, len(w) - n + 2)) t(i)),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) u(j) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS win FROM d, unnest(range(1, len(w) - 3)) t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, unnest(range(0, 5)) u(j) GROUP BY doc_id),
l AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars, ' ' || regexp_replace(x, '[^0-9A-Za-z\x{80}-\x{10FFFF}]+', '  ', 'g') || ' ' AS bare FROM d, unnest(lines) v(x)),
f AS (SELECT doc_id, sum(chars) AS lost FROM l WHERE
        (len(regexp_extract_all(x, '[|»›•]')) >= 3 AND len(regexp_extract_all(x, '[^\x20\x09-\x0D|»›•]+')) <= 2 * (len(regexp_extract_all(x, '[|»›•]')) + 1))
        OR (length(x) <= 120 AND 2 * length(replace(regexp_replace(bare, '(?i) (all  rights  reserved|cookie  policy|cookie  settings|accept  cookies|privacy  policy|terms  of  use|terms  of  service|sign  up|log  in|subscribe  now|subscribe  to  our|newsletter|click  here|read  more|enable  javascript|share  this|share  on) ', '', 'g'), ' ', '')) <= length(replace(bare, ' ', '')))
        OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 100 > chars * 10
        OR NOT regexp_matches(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(f.lost, 0) AS BIGINT) AS lost_chars
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept FROM m
""",
}
