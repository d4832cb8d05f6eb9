"""Redundancy scores kept up to date: only what a change touches is compared again.

The score of a template is its distance, as a query, to the nearest other template of its command.  When templates
come, they are compared with their command in both directions; when templates go, only rows whose nearest one went are
compared anew.  All other pairs are known to be no nearer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.operators.pairing import PairCounts, pair_distances

NONE_NEAR = 1.7976931348623157e308
SCORES = "template_id string, command_id string, score double, nearest string"


def _nearest(queries: DataFrame, templates: DataFrame, band_ratio: float, counts: PairCounts | None) -> DataFrame:
    """(template_id, near struct<distance, template_id>): the nearest other template of the command, where one is met."""
    asked = queries.select(F.col("template_id").alias("query_id"), "command_id", "features")
    known = templates.select("template_id", "command_id", F.lit(0).cast("long").alias("created_at"), "features")  # ties go to the id, not to age
    pairs = pair_distances(asked, known, band_ratio, within="command_id", counts=counts, apart=True)
    return pairs.groupBy(F.col("query_id").alias("template_id")).agg(F.min(F.struct("distance", "template_id")).alias("near"))


def scored(templates: DataFrame, band_ratio: float = 0.1, counts: PairCounts | None = None) -> DataFrame:
    """SCORES of all templates, every pair compared; ties go to the smaller id."""
    found = templates.select("template_id", "command_id").join(_nearest(templates, templates, band_ratio, counts), "template_id", "left")
    return found.select("template_id", "command_id", F.coalesce(F.col("near.distance").cast("double"), F.lit(NONE_NEAR)).alias("score"), F.col("near.template_id").alias("nearest"))


def rescored(scores: DataFrame, templates: DataFrame, added: DataFrame, removed: DataFrame, band_ratio: float = 0.1, counts: PairCounts | None = None) -> DataFrame:
    """SCORES of `templates`, the table after a change, from the scores before it.

    `added`, `removed`: (template_id) of what the change put and took away; a template that was put again is in both.
    """
    removed = removed.select("template_id").distinct()
    added = added.select("template_id").distinct()
    old = scores.join(removed, "template_id", "left_anti").join(added, "template_id", "left_anti")
    orphaned = old.join(removed.unionByName(added).select(F.col("template_id").alias("nearest")), "nearest", "left_semi").select("template_id")
    anew = templates.join(added.unionByName(orphaned).distinct(), "template_id", "left_semi")
    fresh = templates.join(added, "template_id", "left_semi")
    commands = fresh.select("command_id").distinct()
    kept = old.join(orphaned, "template_id", "left_anti")
    others = templates.join(kept.select("template_id"), "template_id", "left_semi").join(commands, "command_id", "left_semi")

    whole = anew.select("template_id", "command_id").join(_nearest(anew, templates, band_ratio, counts), "template_id", "left")
    whole = whole.select("template_id", "command_id", F.coalesce(F.col("near.distance").cast("double"), F.lit(NONE_NEAR)).alias("score"), F.col("near.template_id").alias("nearest"))
    closer = kept.join(_nearest(others, fresh, band_ratio, counts), "template_id", "left")
    new = F.struct(F.col("near.distance").cast("double").alias("score"), F.col("near.template_id").alias("nearest"))
    is_new = F.col("near").isNotNull() & (F.col("nearest").isNull() | (new < F.struct("score", "nearest")))
    kept = closer.select("template_id", "command_id", F.when(is_new, new["score"]).otherwise(F.col("score")).alias("score"), F.when(is_new, new["nearest"]).otherwise(F.col("nearest")).alias("nearest"))
    return whole.unionByName(kept)
