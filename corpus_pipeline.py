"""Documents to a training corpus: toxic ones go, one of each group of near-duplicates stays, contaminated ones go,
sources are mixed to their weights, and the ids of what is left are written.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the
columns of `documents`; the last returns doc_id, start, n_tokens and ids_crc32 as read back from its files.

Rows are rejected by their id and text together, null ids like others: a row that shares its id with a rejected one
but not its text stays.  Null and empty texts pass the first three stages and are left out of the mix, which has
nothing to take of them.  Empty tables and extra columns, whatever their names, go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwave.llm.common import stash, table
from quillwave.llm.decontaminate import clean_documents
from quillwave.llm.mixing import mixed_documents
from quillwave.llm.neardup import one_of_each_group
from quillwave.llm.tokenfiles import token_files
from quillwave.llm.toxicity import reject_toxic
from quillwave.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(ship(spark), sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(ship(spark), sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixed_documents(docs)


def token_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_id_stage),
]

#: The scores of fitted trees and the ids of a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
