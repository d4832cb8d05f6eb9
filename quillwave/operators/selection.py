"""The k-th smallest value of each group without sorting any group.

A float32 has an unsigned number of 32 bits that is in the same order.  Its upper 16 bits are counted by group, which each
task folds by itself, so a group of any size is at most 65,536 counts; their running sum names the half-number in which the
k-th value lies and how many are left to go.  The values there are counted by their lower 16 bits the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, LongType


@F.pandas_udf(LongType())
def sortable(values: pd.Series) -> pd.Series:
    """The place of a float32 among all of them; both zeros are one."""
    bits = (values.to_numpy(np.float32) + np.float32(0)).view(np.int32)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int32(-(1 << 31))).view(np.uint32).astype(np.int64))


@F.pandas_udf(FloatType())
def unsorted(places: pd.Series) -> pd.Series:
    """The float32 of a place."""
    bits = places.to_numpy().astype(np.uint32).view(np.int32)
    return pd.Series(np.where(bits < 0, bits ^ np.int32(-(1 << 31)), ~bits).astype(np.int32).view(np.float32))


def _reached(counts: DataFrame, wanted: DataFrame, key: str, digit: str) -> DataFrame:
    """(key, digit, k): the digit at which the running count of each group reaches its k, and what is left of k within it."""
    upto = Window.partitionBy(key).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("n").over(upto)).join(wanted, key)
    return running.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select(key, digit, (F.col("k") - F.col("upto") + F.col("n")).alias("k"))


def kth_smallest(rows: DataFrame, wanted: DataFrame, key: str, value: str | Column) -> DataFrame:
    """(key, value float) of `wanted` (key, k long from 1 on): the k-th smallest float of each group that has so many.

    Null values are left out; equal ones count as often as they are there.  `rows` is read twice.
    """
    named = rows.select(key, (F.col(value) if isinstance(value, str) else value).cast("float").alias("_value")).where("_value IS NOT NULL")
    placed = named.select(key, sortable("_value").alias("_place")).select(key, F.shiftright("_place", 16).alias("high"), F.col("_place").bitwiseAND(0xFFFF).alias("low"))
    high = _reached(placed.groupBy(key, "high").agg(F.count("*").alias("n")), wanted.select(key, "k"), key, "high")
    inner = placed.join(high.select(key, "high"), [key, "high"]).groupBy(key, "high", "low").agg(F.count("*").alias("n"))
    low = _reached(inner, high.select(key, "k"), key, "low").select(key, "low")
    return low.join(high.select(key, "high"), key).select(key, unsorted(F.shiftleft("high", 16) + F.col("low")).alias("value"))
