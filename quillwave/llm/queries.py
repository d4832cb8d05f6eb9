"""The numbered queries: each applies one operator of this package, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwave.llm import decontaminate as _decontaminate
from quillwave.llm import mixing as _mixing
from quillwave.llm.common import table
from quillwave.llm.langid import identify
from quillwave.llm.licenses import license_digest
from quillwave.llm.media import media_columns
from quillwave.llm.neardup import ORACLE as _NEAR_ORACLE
from quillwave.llm.neardup import near_duplicates
from quillwave.llm.phrases import ORACLE as _PHRASES_ORACLE
from quillwave.llm.phrases import collocations
from quillwave.llm.pii import pii_digest
from quillwave.llm.prefixtrie import ORACLE as _TRIE_ORACLE
from quillwave.llm.prefixtrie import prefix_trie
from quillwave.llm.quality import quality
from quillwave.llm.substrings import ORACLE as _REPEATS_ORACLE
from quillwave.llm.substrings import without_repeats
from quillwave.llm.tokenfiles import token_files
from quillwave.llm.toxicity import toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_token_ids": op5_token_ids,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_substrings": op13_substrings,
}

ORACLES: dict[str, str] = {
    "op3_mixing": _mixing.ORACLE,
    "op6_decontamination": _decontaminate.ORACLE,
    "op10_near_duplicates": _NEAR_ORACLE,
    "op11_prefix_trie": _TRIE_ORACLE,
    "op12_phrases": _PHRASES_ORACLE,
    "op13_substrings": _REPEATS_ORACLE,
}
