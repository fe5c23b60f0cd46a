"""The queries opN_* of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import bpe, collocations, compact_windows, decontamination, fingerprint, jaccard_join, language, pii, prefix_trie, quality, quotations, suffix_dedup, token_files


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(C.table(spark, sf_dir, "documents"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(C.table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(C.table(spark, sf_dir, "documents"))


def op5_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as mail that quotes two turns back, linked and stripped again."""
    return quotations.conversations(quotations.quoted_mail(C.table(spark, sf_dir, "conversations")))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(C.table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(C.table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(C.table(spark, sf_dir, "documents"))


def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(C.table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(C.table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(C.table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(C.table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_fingerprint, op3_compact_windows, op4_suffix_dedup, op5_quotations, op6_pii_surrogates,
        op7_compression_quality, op8_bpe, op9_jaccard_join, op10_language_profiles, op11_collocations, op12_token_files, op13_prefix_trie,
    )
}
ORACLES: dict[str, str] = {
    "op11_collocations": collocations.collocations_sql(),
    "op13_prefix_trie": prefix_trie.conversation_trie_sql(),
}
