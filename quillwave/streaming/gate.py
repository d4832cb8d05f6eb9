"""The energy gate: a level counts as speech against a noise floor that only quiet levels move."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillwave.config import GateConfig

OUTPUT = "device_id long, seq long, level double, speech boolean, floor double"


def gate_fold(levels: Column, config: GateConfig = GateConfig()) -> Column:
    """array<struct<speech, floor>> of an ordered array<double> of levels; a null level is an empty frame."""
    start = F.struct(F.lit(config.floor).alias("floor"), F.array().cast("array<struct<speech:boolean,floor:double>>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        speech = F.coalesce(v >= F.greatest(F.lit(config.floor), s["floor"] * config.ratio), F.lit(False))
        floor = F.when(speech | v.isNull(), s["floor"]).otherwise((1 - config.adaptation) * s["floor"] + config.adaptation * v)
        return F.struct(floor.alias("floor"), F.concat(s["out"], F.array(F.struct(speech.alias("speech"), floor.alias("floor")))).alias("out"))

    return F.aggregate(levels, start, step, lambda s: s["out"])


def gate_batch(levels: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """`levels`: (device_id, seq, level).  The recurrence in order of seq, one state a device.

    It depends on every earlier level, so a device is one ordered run; rows stream through a task with the state of
    one device in memory, whatever the run's length.
    """
    ordered = levels.select(F.col("device_id").cast("long"), F.col("seq").cast("long"), F.col("level").cast("double")).repartition("device_id").sortWithinPartitions("device_id", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, floor = None, config.floor
        for pdf in frames:
            speech, floors = [], []
            for d, v in zip(pdf["device_id"].to_numpy(), pdf["level"].to_numpy(), strict=True):
                if d != device:
                    device, floor = d, config.floor
                said, floor = gate_step(v, floor, config)
                speech.append(said)
                floors.append(floor)
            yield pdf.assign(speech=speech, floor=floors)

    return ordered.mapInPandas(run, OUTPUT)


def gate_step(level: float | None, floor: float, config: GateConfig) -> tuple[bool, float]:
    if level is None or level != level:
        return False, floor
    if level >= max(config.floor, floor * config.ratio):
        return True, floor
    return False, (1 - config.adaptation) * floor + config.adaptation * level


class Gate(StatefulProcessor):
    """One floor and last sequence number a device; rows at or before that number are dropped as late.

    Columns beside device_id, seq and level go through as they are.
    """

    def __init__(self, config: GateConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", StructType([StructField("floor", DoubleType()), StructField("last", LongType())]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable").drop_duplicates("seq")
        floor, last = self.state.get() if self.state.exists() else (self.config.floor, -(2**62))
        pdf = pdf[pdf["seq"] > last]
        if not len(pdf):
            return
        speech, floors = [], []
        for v in pdf["level"]:
            said, floor = gate_step(v, floor, self.config)
            speech.append(said)
            floors.append(floor)
        self.state.update((float(floor), int(pdf["seq"].iloc[-1])))
        yield pdf.assign(device_id=key[0], speech=speech, floor=floors)

    def close(self) -> None:
        pass


def gate_stream(levels: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """The same over a stream of (device_id, seq, level) and perhaps more columns; needs the RocksDB state store."""
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in levels.schema.fields if f.name not in ("device_id", "seq", "level")]
    rows = levels.select("device_id", "seq", "level", *[c for c in levels.columns if c not in ("device_id", "seq", "level")])
    schema = ", ".join(["device_id long, seq long, level double", *more, "speech boolean, floor double"])
    return rows.groupBy("device_id").transformWithStateInPandas(Gate(config), outputStructType=schema, outputMode="Append", timeMode="None")
