"""From best distances to decisions: rank, threshold, confidence, reasons, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.config import WAKE_COMMAND, MatchConfig

INF = float("inf")


def ranked(best: DataFrame) -> DataFrame:
    """(query_id, command_id, template_id, distance, runner_up): each query's best command and the next one's distance."""
    order = Window.partitionBy("query_id").orderBy("distance", "command_id")
    return best.withColumn("rn", F.row_number().over(order)).withColumn("runner_up", F.lead("distance").over(order)).where("rn = 1").drop("rn")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def confidence(distance: Column, threshold: Column, runner_up: Column, margin_weight: float = 0.4) -> Column:
    """Weighted closeness to the threshold and margin to the runner-up; without a finite runner-up the margin is 1."""
    d, t, r = (c.cast("double") for c in (distance, threshold, runner_up))
    base = F.when(t > 0, clamp(1 - d / F.when(t > 0, t))).otherwise(F.lit(0.0))
    margin = F.when(r.isNull() | (r <= 0) | (r == F.lit(INF)), F.lit(1.0)).otherwise(clamp((r - d) / F.when(r > 0, r)))
    return clamp((1 - margin_weight) * base + margin_weight * margin)


def decide(queries: DataFrame, best: DataFrame, thresholds: DataFrame | None = None, config: MatchConfig = MatchConfig()) -> DataFrame:
    """A row for every query: kind, command_id, template_id, confidence, distance, reason and nearest_command_id.

    `queries`: (query_id, frame_count) and, where known, silent boolean.  Reasons in order: EMPTY_INPUT, SILENCE,
    NO_TEMPLATES (none, or none of the query's width), BELOW_CONFIDENCE.  `thresholds`: (command_id, threshold).
    """
    top = ranked(best)
    limit = F.lit(config.threshold).cast("float")
    if thresholds is not None:
        top = top.join(thresholds.select("command_id", F.col("threshold").cast("float").alias("own")), "command_id", "left")
        limit = F.coalesce("own", limit)
    asked = queries.select("query_id", "frame_count", *[c for c in queries.columns if c == "silent"])
    met = asked.join(top.withColumn("limit", limit), "query_id", "left")
    silent = F.coalesce(F.col("silent"), F.lit(False)) if "silent" in queries.columns else F.lit(False)
    reason = (
        F.when(silent, F.lit("SILENCE"))
        .when(F.col("frame_count") == 0, F.lit("EMPTY_INPUT"))
        .when(F.col("command_id").isNull(), F.lit("NO_TEMPLATES"))
        .when(F.col("distance") > F.col("limit"), F.lit("BELOW_CONFIDENCE"))
    )
    hit = F.col("reason").isNull()
    return met.withColumn("reason", reason).select(
        "query_id",
        F.when(hit, F.lit("MATCH")).otherwise(F.lit("NO_MATCH")).alias("kind"),
        F.when(hit, F.col("command_id")).alias("command_id"),
        F.when(hit, F.col("template_id")).alias("template_id"),
        F.when(hit, confidence(F.col("distance"), F.col("limit"), F.col("runner_up"), config.margin_weight)).alias("confidence"),
        F.coalesce("distance", F.lit(INF).cast("float")).alias("distance"),
        "reason",
        F.when(~hit, F.col("command_id")).alias("nearest_command_id"),
    )


def without_reserved(templates: DataFrame) -> DataFrame:
    return templates.where(F.col("command_id") != WAKE_COMMAND)


def wake_decision(results: DataFrame) -> DataFrame:
    """Wake or not, from results over the wake command's templates alone (see `wake_thresholds`)."""
    reason = F.when(F.col("kind") == "MATCH", F.lit(None).cast("string")).when(F.col("reason").isin("EMPTY_INPUT", "SILENCE"), F.lit("NO_SPEECH")).otherwise(F.lit("BELOW_THRESHOLD"))
    return results.select("query_id", (F.col("kind") == "MATCH").alias("wake"), F.when(F.col("kind") == "MATCH", F.col("distance")).alias("distance"), reason.alias("reason"))


def wake_thresholds(templates: DataFrame, threshold: float) -> DataFrame:
    """The wake threshold goes to the command of the first template only."""
    first = templates.agg(F.min_by("command_id", F.struct("created_at", "template_id")).alias("command_id"))
    return first.where(F.col("command_id").isNotNull()).withColumn("threshold", F.lit(threshold))


def backend_projection(results: DataFrame) -> DataFrame:
    """Results in terms that any recognition backend shares."""
    reason = (
        F.when(F.col("reason").isin("SILENCE", "EMPTY_INPUT"), F.lit("NO_SPEECH"))
        .when(F.col("reason") == "BELOW_CONFIDENCE", F.lit("LOW_CONFIDENCE"))
        .when(F.col("reason") == "NO_TEMPLATES", F.lit("BACKEND_UNAVAILABLE"))
    )
    return results.select("query_id", "command_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), reason.alias("rejection"))


def unavailable_backend(queries: DataFrame) -> DataFrame:
    """The backend that recognises nothing."""
    return queries.select("query_id", F.lit(None).cast("string").alias("command_id"), F.lit(0.0).alias("confidence"), F.lit("BACKEND_UNAVAILABLE").alias("rejection"))
