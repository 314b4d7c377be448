"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwelltrace.llm.bpe_codec import encode_documents
from dwelltrace.llm.common import scratch, table
from dwelltrace.llm.decision_list import judge_quality
from dwelltrace.llm.exact_dedup import exact_groups
from dwelltrace.llm.periodic_runs import periodic_runs
from dwelltrace.llm.repeated_spans import remove_repeats
from dwelltrace.llm.secret_scan import scan_secrets, secret_digest
from dwelltrace.llm.shards import place_in_shards
from dwelltrace.llm.simhash import near_groups
from dwelltrace.llm.source_mix import mix_sources
from dwelltrace.llm.spelling_variants import spelling_variants, word_counts
from dwelltrace.llm.token_files import read_token_files, write_token_files
from dwelltrace.llm.toxicity import is_held_out, learn_toxicity, score_toxicity
from dwelltrace.llm.weak_labels import weak_quality

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))


def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    write_token_files(docs, path, tokenizer, pattern=public_tokenizers.PATTERN, added_tokens=True)
    return read_token_files(spark, path).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "rule",
        "kept",
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def bpe_digest(docs: DataFrame) -> DataFrame:
    """Counts and hashes of the ids of documents and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents whose checksum ends in 0 with the words from some place on replaced by repeats of
    the first few of them."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    docs = docs.select("doc_id", "text", check.alias("h"), F.floor(check / 10).alias("g"), F.when(check % 10 == 0, words).alias("w"))
    docs = docs.withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int")), times.cast("int")))
    planted = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n"))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    order = F.transform("runs", lambda run: F.struct(run["length"], -run["start"], -run["period"]))
    longest = F.array_max(order)
    length, period = longest["length"], -longest["col3"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-longest["col2"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_in_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), alter=199).filter("n >= 5")
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


# -- parts of the operators above that SQL can express ---------------------------------------


def base_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules are learned on, and their fixed part."""
    return op4_quality_rules(spark, sf_dir).drop("rule", "kept")


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents and of their sources, and whether a document is taken within its bound."""
    mix = op5_source_mix(spark, sf_dir)
    return mix.select("doc_id", "source", "size", "source_size", (F.col("taken") <= 3 * F.col("size")).alias("bounded"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of each base kind a document holds."""
    return op8_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_quality_classifier,
        op2_repeated_spans,
        op3_token_files,
        op4_quality_rules,
        op5_source_mix,
        op6_exact_dedup,
        op7_simhash_near_dedup,
        op8_secret_scans,
        op9_bpe_codec,
        op10_toxicity,
        op11_periodic_runs,
        op12_sharding,
        op13_spelling_variants,
        base_text_statistics,
        mix_sizes,
        secret_base_counts,
    )
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT doc_id, sha256(content) AS text_sha256,
         min(doc_id) OVER (PARTITION BY content) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "base_text_statistics": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), triples AS (
  SELECT doc_id, i, words[i:i + 2] AS triple FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)
), again AS (
  SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, triple) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
""",
    "mix_sizes": r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
)
SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size, true AS bounded FROM s
""",
    "secret_base_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(text,
    '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM t
""",
}
