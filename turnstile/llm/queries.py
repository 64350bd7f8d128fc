"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import collocations, conversation_repair, decontaminate, line_dedup, ngram_join, oracles, piece_transducer, quality, registry, secrets, token_counts, token_files, url_filter, warc, wrapper
from turnstile.llm.common import read
from turnstile.llm.registry import query

PIECES, BYTE_PIECES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op1_redirect_equivalence", oracles.URLS)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judged(read(spark, sf_dir, "pages"), RULES, ["page_id"])
    return out.select("row.page_id", "host", "path", "rule", "verdict")


@query("op3_zstd_archives", oracles.ARCHIVES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("url")


@query("op2_piece_transducer")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document."""
    out = piece_transducer.encoded(read(spark, sf_dir, "documents"), PIECES, ["doc_id"])
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


@query("op4_robust_outliers", oracles.QUALITY)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", "base.n_words", "base.word_chars", "base.n_symbols", "base.n_dup_lines", "base.n_repeat_words", "base.base_failed", "kept")


@query("op5_trigram_index", oracles.SECRETS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read(spark, sf_dir, "documents"))


@query("op6_wrapper_induction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.extracted(read(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_seeded_alignment")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of every benchmark item found in a document."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_ranked_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), BYTE_PIECES)


@query("op9_minhash_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, copies of every document."""
    return ngram_join.classed(read(spark, sf_dir, "documents"))


@query("op10_line_neighbourhood")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text without the lines that repeat an earlier one, and how many of its lines went."""
    out = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("kept_text").alias("text"), "n_lines", "n_removed")


@query("op11_edit_lattice", oracles.CONVERSATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(read(spark, sf_dir, "conversations"))
    return conversation_repair.repaired(rows, dropped=F.col("dropped")).withColumnRenamed("key", "conv_id")


@query("op12_count_automata", oracles.COLLOCATIONS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(read(spark, sf_dir, "documents"))


@query("op13_pretoken_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.counted(read(spark, sf_dir, "documents"), BYTE_PIECES, ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


def queries():
    return dict(registry.SPARK)


def oracle_sql():
    return dict(registry.ORACLE)
