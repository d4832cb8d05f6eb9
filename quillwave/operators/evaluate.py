"""Evaluation of decisions against truth, calibration of thresholds, and comparison of front ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.config import SECONDS_PER_FALSE_ACCEPT, MatchConfig
from quillwave.operators.decide import ranked
from quillwave.operators.selection import kth_smallest

EPSILON = 1e-4
FALLBACK_DISTANCE = 8.0


def distinct_commands(enrolment: DataFrame) -> DataFrame:
    """(command_id, seq) in order of first appearance; `enrolment` has command_id and seq."""
    return enrolment.groupBy("command_id").agg(F.min("seq").alias("seq"))


def finite(best: DataFrame) -> DataFrame:
    """The distance table: commands that a query cannot reach are left out."""
    return best.where(F.col("distance") < float("inf"))


def decided(utterances: DataFrame, best: DataFrame, thresholds: DataFrame | None = None, default: float = MatchConfig().threshold) -> DataFrame:
    """`utterances` (query_id, truth, condition, duration_ms) with winner, winner_distance and predicted (null: rejected)."""
    top = ranked(finite(best)).select("query_id", F.col("command_id").alias("winner"), F.col("distance").alias("winner_distance"))
    limit = F.lit(default).cast("float")
    if thresholds is not None:
        top = top.join(thresholds.select(F.col("command_id").alias("winner"), F.col("threshold").cast("float").alias("own")), "winner", "left")
        limit = F.coalesce("own", limit)
    return utterances.join(top.withColumn("predicted", F.when(F.col("winner_distance") <= limit, F.col("winner"))).drop("own"), "query_id", "left")


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, predicted, n); OOV stands for negatives and REJECT for rejections."""
    return rows.groupBy(F.coalesce("truth", F.lit("OOV")).alias("truth"), F.coalesce("predicted", F.lit("REJECT")).alias("predicted")).agg(F.count("*").alias("n"))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def _false_reject() -> Column:
    """A positive that is rejected or taken for another command."""
    return F.col("truth").isNotNull() & ~F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))


def overall(rows: DataFrame) -> DataFrame:
    """One row: positives, false_rejects, frr, negatives, false_accepts, negative_seconds, far_per_hour."""
    negative = F.col("truth").isNull()
    counts = rows.agg(
        F.count_if(~negative).alias("positives"),
        F.count_if(_false_reject()).alias("false_rejects"),
        F.count_if(negative).alias("negatives"),
        F.count_if(negative & F.col("predicted").isNotNull()).alias("false_accepts"),
        (F.coalesce(F.sum(F.when(negative, F.col("duration_ms"))), F.lit(0)) / 1000.0).alias("negative_seconds"),
    )
    return counts.withColumn("frr", _rate(F.col("false_rejects"), F.col("positives"))).withColumn("far_per_hour", _rate(F.col("false_accepts") * 3600.0, F.col("negative_seconds")))


def frr_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, positives, frr) of groups that have positives."""
    return rows.where("truth IS NOT NULL").groupBy(key).agg(F.count("*").alias("positives"), F.avg(_false_reject().cast("int")).alias("frr"))


def frr_grouping_sets(rows: DataFrame) -> DataFrame:
    """By command, by condition and in all, in one aggregation."""
    positives = rows.where("truth IS NOT NULL").withColumn("false_reject", _false_reject().cast("int"))
    return positives.groupingSets([[F.col("truth")], [F.col("condition")], []], "truth", "condition").agg(F.count("*").alias("positives"), F.avg("false_reject").alias("frr"))


def budget(rows: DataFrame, seconds_per_accept: float) -> DataFrame:
    """One row: the false accepts allowed in all, at least one; `rows` are utterances, decided or not."""
    seconds = F.coalesce(F.sum(F.when(F.col("truth").isNull(), F.col("duration_ms"))), F.lit(0)) / 1000.0
    return rows.agg(F.greatest(F.lit(1), F.floor(seconds / seconds_per_accept + 0.5)).cast("long").alias("budget"))


def budget_split(commands: DataFrame, total: DataFrame) -> DataFrame:
    """(command_id, allowance): shares by cumulative rounding, which sum to the budget exactly.

    The running number of a command needs all commands in one task: a row a command, a vocabulary and not a corpus.
    """
    i, n = F.row_number().over(Window.orderBy("seq")) - 1, F.count("*").over(Window.partitionBy())
    placed = commands.withColumn("i", i).withColumn("n", n)
    share = F.floor((F.col("i") + 1) * F.col("budget") / F.col("n")) - F.floor(F.col("i") * F.col("budget") / F.col("n"))
    return placed.join(F.broadcast(total)).select("command_id", share.alias("allowance"))


def negatives_by_winner(rows: DataFrame) -> DataFrame:
    return rows.where("truth IS NULL AND winner IS NOT NULL").select(F.col("winner").alias("command_id"), "query_id", F.col("winner_distance").alias("distance"))


def calibrate(utterances: DataFrame, best: DataFrame, commands: DataFrame, seconds_per_accept: float = SECONDS_PER_FALSE_ACCEPT) -> DataFrame:
    """(command_id, allowance, threshold float) from one distance table.

    A command with more negatives than its allowance gets the next negative's distance less an epsilon; the others
    the largest distance in the table plus one.
    """
    rows = decided(utterances, best)
    shares = budget_split(commands, budget(utterances, seconds_per_accept))
    wanted = shares.select("command_id", (F.col("allowance") + 1).alias("k"))
    bounds = kth_smallest(negatives_by_winner(rows), wanted, "command_id", "distance")
    bounds = bounds.select("command_id", (F.col("value") - F.lit(EPSILON).cast("float")).cast("float").alias("bound"))
    largest = finite(best).agg(F.coalesce(F.max("distance"), F.lit(FALLBACK_DISTANCE).cast("float")).alias("largest"))
    free = (F.col("largest") + F.lit(1.0).cast("float")).cast("float")
    return shares.join(bounds, "command_id", "left").join(F.broadcast(largest)).select("command_id", "allowance", F.coalesce("bound", free).alias("threshold"))


def bake_off(tables: dict[str, DataFrame], utterances: DataFrame, default: float = MatchConfig().threshold) -> DataFrame:
    """(name, frr, false_accepts, negative_seconds) of each front end's distance table; no winner is named."""
    parts = [overall(decided(utterances, best, default=default)).select(F.lit(name).alias("name"), "frr", "false_accepts", "negative_seconds") for name, best in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _numbered(lines: DataFrame) -> DataFrame:
    """(line_no, line) of (part, key, line), as many as a page has."""
    return lines.select((F.row_number().over(Window.orderBy("part", "key")) - 1).alias("line_no"), "line")


def report_lines(rows: DataFrame, front_end: str, enrolment_failures: int = 0, synthetic: bool = False) -> DataFrame:
    """(line_no, line): a report in markdown of `decided` rows; the banner follows the parameter, not a default."""
    banner = ["> **SYNTHETIC: illustrative only, not a measurement on real voices.**", ""] if synthetic else []
    head = F.array(
        *[F.lit(x) for x in [*banner, f"# Recogniser evaluation: front end `{front_end}`", ""]],
        F.format_string(f"- Positives: %d, negatives: %d, enrolment failures: {enrolment_failures}", "positives", "negatives"),
        F.format_string("- **FRR: %.1f%%** (%d/%d rejected or substituted)", F.col("frr") * 100, "false_rejects", "positives"),
        F.format_string("- **False accepts: %d** over %.1f s of negative audio (about %.2f an hour)", "false_accepts", "negative_seconds", "far_per_hour"),
        F.lit(""),
    )
    lines = overall(rows).select(F.posexplode(head).alias("i", "line")).select(F.lit(0).alias("part"), F.format_string("%04d", "i").alias("key"), "line")
    fixed = rows.sparkSession.createDataFrame([(1, "", "## FRR by command"), (3, "", ""), (4, "", "## FRR by condition")], "part int, key string, line string")
    by_command = frr_by(rows, "truth").select(F.lit(2).alias("part"), F.col("truth").alias("key"), F.format_string("- `%s`: %.1f%%", "truth", F.col("frr") * 100).alias("line"))
    by_condition = frr_by(rows, "condition").select(F.lit(5).alias("part"), F.col("condition").alias("key"), F.format_string("- %s: %.1f%%", "condition", F.col("frr") * 100).alias("line"))
    return _numbered(lines.unionByName(fixed).unionByName(by_command).unionByName(by_condition))


def bake_off_lines(rows: DataFrame, synthetic: bool = False) -> DataFrame:
    """(line_no, line): a table in markdown of `bake_off` rows, in their names' order."""
    banner = ["> **SYNTHETIC: illustrative comparison, not a result on real voices.**", ""] if synthetic else []
    head = [*banner, "# Front-end bake-off", "", "| Front end | FRR | False accepts | Negative audio (s) |", "|---|---|---|---|"]
    top = rows.sparkSession.createDataFrame([(0, f"{i:04d}", x) for i, x in enumerate(head)], "part int, key string, line string")
    body = rows.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.format_string("| `%s` | %.1f%% | %d | %.1f |", "name", F.col("frr") * 100, "false_accepts", "negative_seconds").alias("line"))
    return _numbered(top.unionByName(body))
