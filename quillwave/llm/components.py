"""Connected components of a link table by randomised contraction, all in joins and aggregates.

In each round every node is merged into the one of its neighbours (or itself) that comes first in an order drawn anew
by hashing; links are renamed after it, and loops and repeats go.  The nodes left fall by a constant factor a round
whatever the graph's shape or numbering, so there are O(log n) rounds; each is cut off by a written table.  (After
"In-database connected component analysis", Boegeholz, Brand and Todor, 2020.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import stash


def _ranked(turn: int, node: str) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), node).alias("rank"), F.col(node).alias("node"))


def _follow(links: DataFrame, steps: DataFrame, end: str) -> DataFrame:
    """`links` with the column `end` replaced by what `steps` (node, into) merges it into, if anything."""
    found = links.join(steps.select(F.col("node").alias(end), "into"), end, "left")
    return found.withColumn(end, F.coalesce("into", end)).drop("into")


def contract(links: DataFrame) -> DataFrame:
    """(node, into): for each end of the links (u long, v long) one node that stands for its component."""
    some = links.where("u <> v").select("u", "v")
    some = stash(some.union(some.select("v", "u")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not some.isEmpty():
        turn = len(rounds)
        first = some.groupBy("u").agg(F.min(_ranked(turn, "v")).alias("first"))
        step = stash(first.select(F.col("u").alias("node"), F.least("first", _ranked(turn, "u"))["node"].alias("into")), "merged")
        rounds.append(step)
        some = stash(_follow(_follow(some, step, "u"), step, "v").where("u <> v").distinct(), "edges")
    if not rounds:
        return some.select(F.col("u").alias("node"), F.col("v").alias("into"))
    into = rounds.pop()
    while rounds:
        into = stash(_follow(rounds.pop().withColumnRenamed("into", "by"), into, "by").withColumnRenamed("by", "into"), "merged")
    return into


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every end of a link; label is the smallest node reachable."""
    into = contract(links)
    least = into.groupBy("into").agg(F.least(F.min("node"), F.min("into")).alias("label"))
    return into.join(least, "into").select("node", "label")


def star_groups(links: DataFrame) -> DataFrame:
    """(node, label) as `components` gives, but for any node as a component's label, and for links of which each `u` has few.

    A node's links name its hubs, so one aggregate gives each node its first hub and the links among hubs; only the
    hubs, of which there are few, go through the rounds.
    """
    met = stash(links.where("u <> v").groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("hubs")), "hubs")
    hubs = met.select(F.explode("hubs").alias("u")).distinct()
    among = met.select(F.col("hubs")[0].alias("u"), F.explode(F.slice("hubs", 2, F.size("hubs"))).alias("v")).distinct()
    chained = met.join(hubs, "u", "left_semi").select("u", F.col("hubs")[0].alias("v"))
    of_hub = contract(among.union(chained))
    own = met.select(F.col("u").alias("node"), F.col("hubs")[0].alias("label")).union(hubs.join(met, "u", "left_anti").select("u", "u"))
    return stash(_follow(own, of_hub, "label"), "labels")
