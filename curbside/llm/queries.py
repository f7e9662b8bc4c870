"""One query for each corpus operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curbside.llm import bound_packing, oracles, turn_repair
from curbside.llm.collocations import collocations
from curbside.llm.common import scratch
from curbside.llm.credential_scan import credential_scan, scan_report
from curbside.llm.decontaminate import contamination
from curbside.llm.language import language_ids
from curbside.llm.line_quality import BASE, line_quality
from curbside.llm.near_dedup import near_duplicates
from curbside.llm.packing import packed
from curbside.llm.suffix_dedup import repeated_passages
from curbside.llm.token_counts import token_counts
from curbside.llm.token_files import read_tokens, write_tokens
from curbside.llm.toxicity import toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("removed")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = line_quality(table(spark, sf_dir, "documents"))
    return verdict.select("doc_id", *BASE, "base_failed", "kept", "n_removed_words")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return read_tokens(spark, path)


def op8_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(credential_scan(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_bound_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair_report(rows, "copies")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_quality": op3_line_quality,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_token_files": op7_token_files,
    "op8_credential_scan": op8_credential_scan,
    "op9_token_counts": op9_token_counts,
    "op10_prob_minhash": op10_prob_minhash,
    "op11_collocations": op11_collocations,
    "op12_bound_packing": op12_bound_packing,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES = {
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op3_line_quality": oracles.LINE_QUALITY,
    "op8_credential_scan": oracles.CREDENTIALS,
    "op11_collocations": oracles.COLLOCATIONS,
}
