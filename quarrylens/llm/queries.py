"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, html_text, minhash, packing, pii, quality_model, quality_rules, substrings, warc
from .common import table

#: Folder of the public tokenizers' files on every machine.
TOKENIZERS = "/opt/tokenizers"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.apply_policy(found, quality_rules.BASE, out="base_kept")
    return quality_rules.apply_policy(base, quality_rules.STANDARD).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits"
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", decode_too=True)
    return found.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "text", "n_removed_words", spans.alias("removed_spans"), "first_in")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_columns(pii.find(table(spark, sf_dir, "documents"), keep_text=False))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), every=100)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_ann": op3_ann,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
}

#: SQL for the queries that SQL can express; tests hold the others against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
 h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
 c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(3) t(k) GROUP BY r),
 m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_bang_words, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS n_upper_words,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_adjacent_repeats, len(list_filter(ws, lambda x: regexp_full_match(x, '[#*$%&|<>]+'))) AS n_bare_symbol_words FROM w LEFT JOIN c ON c.r = w.r)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits
 FROM (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_bang_words > 3 * n_words THEN 8 ELSE 0 END + CASE WHEN n_words >= 20 AND 100 * n_upper_words > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_adjacent_repeats > 12 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_bare_symbol_words > 3 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 128 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words) THEN 256 ELSE 0 END AS bits FROM m)""",
}
