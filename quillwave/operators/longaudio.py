"""Endpoints and features of recordings that are longer than a row.

A recording is rows of chunks: (recording_id, at, samples), `at` being the number of the chunk's first sample; chunks may
be of any length and need no order, but each sample is in one of them.  Work goes by blocks of equal length, each
with a halo of the samples before and after it that its frames reach: a chunk sends each block what it holds of it, so
one shuffle lines everything up, and a recording is spread over tasks like many short ones.

- Levels are worked out block by block.  The noise floor is the exact percentile over the recording (`kth_smallest`).
- Runs of loud frames inside a block are judged there; runs that touch a block's ends, two a block at most, are merged along
  the recording.
- Coefficients are worked out block by block too, with neighbours for the derivatives.  Their means are sums over blocks; a
  second pass subtracts them.

Results are those of one row a recording, but for the order in which the means are summed.  An empty recording has no
chunks and no result.  Null samples count as none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.config import CepstraConfig, EndpointConfig
from quillwave.functions.cepstra import coefficients, derivative, emphasised, log_energies, power, windowed_frames
from quillwave.functions.frames import frame_levels
from quillwave.operators.selection import kth_smallest
from quillwave.shared import stash

#: Frames that start in a block.
BLOCK_FRAMES = 4096


def blocks(chunks: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(recording_id, block, first, samples): block b holds the samples from b * size - before to (b + 1) * size + after."""
    rows = chunks.where("size(samples) > 0").select("recording_id", F.col("at").cast("long"), "samples")
    least = F.greatest(F.lit(0), F.floor((F.col("at") - after) / size))
    most = F.floor((F.col("at") + F.size("samples") - 1 + before) / size)
    met = rows.withColumn("block", F.explode(F.sequence(least, most)))
    start = F.greatest("at", F.col("block") * size - before)
    upto = F.least(F.col("at") + F.size("samples"), (F.col("block") + 1) * size + after)
    piece = F.struct(start.alias("at"), F.slice("samples", (start - F.col("at") + 1).cast("int"), F.greatest(F.lit(0), upto - start).cast("int")).alias("samples"))
    whole = met.where(upto > start).groupBy("recording_id", "block").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return whole.select("recording_id", "block", F.col("pieces")[0]["at"].alias("first"), F.flatten(F.transform("pieces", lambda p: p["samples"])).alias("samples"))


def _per_block(df: DataFrame, work, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """`work(block, first, samples)` of each row, as further columns (name, Arrow type, Spark type); None leaves the row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(b, at, x.values.to_numpy(zero_copy_only=False).astype(np.float32)) for b, at, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)]
            own = [i for i, m in enumerate(made) if m is not None]
            kept = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:2], *(pa.array([made[i][k] for i in own], kind) for k, (_, kind, _) in enumerate(columns))], names=["recording_id", "block", *(c for c, _, _ in columns)])

    ids = df.schema["recording_id"].dataType.simpleString()
    return df.mapInArrow(run, f"recording_id {ids}, block long, " + ", ".join(f"{c} {kind}" for c, _, kind in columns))


def levels(chunks: DataFrame, rate_hz: int, config: EndpointConfig = EndpointConfig(), block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, block, first long, levels array<float>): the levels of the frames from number `first` on."""
    length, shift = rate_hz * config.frame_ms // 1000, rate_hz * config.shift_ms // 1000

    def work(block: int, at: int, x: np.ndarray):
        found = frame_levels(x[block * block_frames * shift - at :], length, shift)[:block_frames]
        return (block * block_frames, found) if len(found) else None

    return _per_block(blocks(chunks, block_frames * shift, 0, max(0, length - shift)), work, [("first", pa.int64(), "long"), ("levels", pa.list_(pa.float32()), "array<float>")])


def _loud_runs(rows: DataFrame) -> DataFrame:
    """(recording_id, start, end, edge) of runs of frames at or over `limit`; `edge`: it touches an end of its block."""
    names = ["recording_id", "start", "end", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, edge = [], [], [], []
            for i, (first, level, limit) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
                loud = np.concatenate([[False], level.values.to_numpy() >= np.float32(limit), [False]])
                turns = np.flatnonzero(loud[1:] != loud[:-1]).reshape(-1, 2)
                row += [i] * len(turns)
                start += (first + turns[:, 0]).tolist()
                end += (first + turns[:, 1] - 1).tolist()
                edge += ((turns[:, 0] == 0) | (turns[:, 1] == len(loud) - 2)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edge, pa.bool_())], names=names)

    ids = rows.schema["recording_id"].dataType.simpleString()
    return rows.select("recording_id", "first", "levels", "limit").mapInArrow(run, f"recording_id {ids}, start long, end long, edge boolean")


def segments(chunks: DataFrame, rate_hz: int, config: EndpointConfig = EndpointConfig(), block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, start_sample long, end_sample long) of the speech in each recording that has any."""
    length, shift = rate_hz * config.frame_ms // 1000, rate_hz * config.shift_ms // 1000
    least, hang = -(-config.min_speech_ms // config.shift_ms), config.hangover_ms // config.shift_ms
    rows = stash(levels(chunks, rate_hz, config, block_frames), "levels")
    counts = rows.groupBy("recording_id").agg(F.sum(F.size("levels")).alias("n"))
    wanted = counts.select("recording_id", (F.floor(F.lit(config.percentile) * (F.col("n") - 1)) + 1).alias("k"))
    floors = kth_smallest(rows.select("recording_id", F.explode("levels").alias("level")), wanted, "recording_id", "level")
    limit = F.greatest((F.col("value") * F.lit(config.ratio)).cast("float"), F.lit(config.floor).cast("float"))
    runs = _loud_runs(rows.join(floors.select("recording_id", limit.alias("limit")), "recording_id"))
    in_order = Window.partitionBy("recording_id").orderBy("start")
    new = F.coalesce(F.col("start") > F.lag("end").over(in_order) + 1, F.lit(True)).cast("int")
    edges = runs.where("edge").withColumn("new", new).withColumn("island", F.sum("new").over(in_order))
    merged = edges.groupBy("recording_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    speech = merged.unionByName(runs.where("NOT edge").select("recording_id", "start", "end")).where(F.col("end") - F.col("start") + 1 >= least)
    ends = speech.groupBy("recording_id").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    sizes = chunks.groupBy("recording_id").agg(F.max(F.col("at") + F.size("samples")).alias("samples"))
    upto = F.least(F.least(F.col("n") - 1, F.col("last") + hang) * shift + length, F.col("samples"))
    return ends.join(counts, "recording_id").join(sizes, "recording_id").select("recording_id", (F.greatest(F.lit(0), F.col("first") - hang) * shift).alias("start_sample"), upto.alias("end_sample"))


def trimmed(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks of the segments, counted from their start; recordings without one have none."""
    met = chunks.join(found, "recording_id").where((F.col("at") < F.col("end_sample")) & (F.col("at") + F.size("samples") > F.col("start_sample")))
    start, upto = F.greatest("at", "start_sample"), F.least(F.col("at") + F.size("samples"), F.col("end_sample"))
    return met.select("recording_id", (start - F.col("start_sample")).alias("at"), F.slice("samples", (start - F.col("at") + 1).cast("int"), (upto - start).cast("int")).alias("samples"))


def features(chunks: DataFrame, config: CepstraConfig = CepstraConfig(), block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, block, first long, features array<array<float>>): the frames from number `first` on."""
    size, near = block_frames * config.shift, config.delta
    before, after = 1 + near * config.shift, max(0, config.frame - config.shift) + near * config.shift
    matrix, kind = pa.list_(pa.list_(pa.float32())), "array<array<float>>"

    def static(block: int, at: int, x: np.ndarray):
        """Coefficients of the block's frames and of `near` frames on either side, where there are any."""
        first = max(0, block * block_frames - near)
        y = emphasised(x, config)[first * config.shift - at :]
        c = coefficients(log_energies(power(windowed_frames(y, config), config), config), config)[: block * block_frames + block_frames + near - first]
        own = min(block_frames, len(c) - (block * block_frames - first))
        return None if own <= 0 else (first, own, c.tolist(), c[block * block_frames - first :][:own].sum(axis=0, dtype=np.float64).tolist())

    columns = [("first", pa.int64(), "long"), ("own", pa.int64(), "long"), ("static", matrix, kind), ("total", pa.list_(pa.float64()), "array<double>")]
    rows = stash(_per_block(blocks(chunks, size, before, after), static, columns), "static-features")
    width = config.coefficients
    means = rows.groupBy("recording_id").agg(F.array(*[(F.sum(F.col("total")[k]) / F.sum("own")).cast("float") for k in range(width)]).alias("mean"))
    if not config.subtract_mean:
        means = means.withColumn("mean", F.array_repeat(F.lit(0.0).cast("float"), width))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for block, first, own, c, mean in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                parts = [np.array(c, np.float32) - np.array(mean, np.float32)]
                for _ in range(near):
                    parts.append(derivative(parts[-1]))
                made.append(np.concatenate(parts, axis=1)[block * block_frames - first :][:own].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([b * block_frames for b in batch.column(1).to_pylist()], pa.int64()), pa.array(made, matrix)], names=["recording_id", "block", "first", "features"])

    ids = rows.schema["recording_id"].dataType.simpleString()
    return rows.join(means, "recording_id").select("recording_id", "block", "first", "own", "static", "mean").mapInArrow(finish, f"recording_id {ids}, block long, first long, features {kind}")
