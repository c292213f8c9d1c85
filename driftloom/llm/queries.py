"""Queries opN_<name>, one for each operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftloom.llm.packing import pack_documents

    pieces = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.sharding import shard_rows

    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.secret_scan import digest, scan_secrets

    return digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op4_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.pii import digest, sanitise

    return digest(sanitise(read_table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.decontam import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.cascade import cascade

    return cascade(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.pu_quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftloom.llm.eflm import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


# ---- the base columns of some queries, which SQL can say ----


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii_sanitisation(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_cascade(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE = {f.__name__: f for f in (secret_base_counts, pii_base_counts, quality_base_counts)}
TEXTS = "SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents"
SECRET_SQL = rf"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM ({TEXTS})"""
DIGITS_OF = "list_transform(regexp_extract_all(t, '{}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
PII_SQL = rf"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
    len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255)))) AS n_ip,
    len(list_filter({DIGITS_OF.format(r'[0-9]([\x20-]?[0-9])+')}, lambda s: length(s) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(s)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(s[length(s) - i] AS INTEGER)
      WHEN CAST(s[length(s) - i] AS INTEGER) > 4 THEN 2 * CAST(s[length(s) - i] AS INTEGER) - 9 ELSE 2 * CAST(s[length(s) - i] AS INTEGER) END)) % 10 = 0)) AS n_card,
    len(list_filter({DIGITS_OF.format(r'\+[0-9][\x20().0-9-]+[0-9]')}, lambda s: length(s) BETWEEN 9 AND 15)) AS n_phone FROM ({TEXTS})"""
QUALITY_SQL = rf"""WITH w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM ({TEXTS})),
    g AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    k AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
    m AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k) GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(m.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(m.n, 0) > 50 * len(ws) AS base_failed FROM w LEFT JOIN m ON m.r = w.r"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | BASE


def oracle_sql() -> dict:
    """SQL for the base columns; the methods' own columns are held against plain versions in the tests."""
    return {"secret_base_counts": SECRET_SQL, "pii_base_counts": PII_SQL, "quality_base_counts": QUALITY_SQL}
