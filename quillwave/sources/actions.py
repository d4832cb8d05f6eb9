"""The fixed dimension of device actions, routing to it, and a sink without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids and labels of the actions that a command can have.
ACTIONS = [
    ("HOME", "Go to home screen"),
    ("BACK", "Go back"),
    ("RECENTS", "Show recent apps"),
    ("NOTIFICATIONS", "Open notifications"),
    ("QUICK_SETTINGS", "Open quick settings"),
    ("POWER_DIALOG", "Show power menu"),
    ("LOCK_SCREEN", "Lock the screen"),
    ("SCROLL_FORWARD", "Scroll down"),
    ("SCROLL_BACK", "Scroll up"),
]


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, "action string, action_label string")


def routed(results: DataFrame, commands: DataFrame) -> DataFrame:
    """Matches to actions; a command or an action that is not known leads to nothing."""
    known = F.broadcast(actions(results.sparkSession))
    return results.where("kind = 'MATCH'").join(commands.select("command_id", "action"), "command_id").join(known, "action").select("query_id", "command_id", "action", "action_label")


def labelled(results: DataFrame, commands: DataFrame) -> DataFrame:
    """Results with the command's label, or its id where the command is gone."""
    return results.join(commands.select("command_id", "label"), "command_id", "left").withColumn("label", F.coalesce("label", "command_id"))


def publish(path: str):
    """A `foreachBatch` sink: each epoch has a folder of its own, which a repeated epoch writes anew.

    So what was delivered twice is there once, and nothing that was published is read again.  Within an epoch a query
    is there once; a stream that may bring one again later goes through `dropDuplicatesWithinWatermark` first.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["query_id"]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return write
