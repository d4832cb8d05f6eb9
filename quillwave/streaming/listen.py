"""Listening windows over a stream of frames, with a gap after each match; the stages of a window are in `twostage`.

As a batch, a device's frames give runs of windows, one for each match and one for the empty ones between two; Spark makes the
windows of them, so that what passes through Python grows with the frames and not with the time they span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from quillwave.config import AFTER_MATCH_MS, WINDOW_MS

#: Windows that go out at a time, so that a long pause is no long list.
SLICE = 8192
#: Windows of a run at most: runs are cut where time passes a multiple of so many windows, the same for all devices.
PIECE = 512
OUTPUT = "device_id long, window_id long, start_ms long, end_ms long, matched boolean"
RUNS = "device_id long, window_id long, start_ms long, n long, matched boolean"


def next_windows(hits: list[tuple[int, bool]], start: int, window: int, gap: int, upto: int, most: int | None = None) -> tuple[list[tuple[int, int, bool]], int]:
    """Windows that end by `upto`, at most `most`: (start, end, matched), and the next start.

    `hits`: (time, hit) in order.  A match is followed by the gap.
    """
    out, i = [], 0
    while start + window <= upto and (most is None or len(out) < most):
        end = start + window
        while i < len(hits) and hits[i][0] < start:
            i += 1
        matched, j = False, i
        while j < len(hits) and hits[j][0] < end:
            matched |= hits[j][1]
            j += 1
        out.append((start, end, matched))
        start, i = end + (gap if matched else 0), j
    return out, start


def window_runs(hits: np.ndarray, start: int, window: int, gap: int, upto: int) -> tuple[list[tuple[int, int, bool]], int]:
    """The windows of `next_windows` as runs: (start of the first, how many, matched), and the next start.

    `hits`: times of hits in order.  A run has one match or empty windows, cut as by `pieces`.
    """
    out, i, left = [], 0, (upto - start) // window
    while left > 0:
        i += int(np.searchsorted(hits[i:], start))
        empty = min(left, (int(hits[i]) - start) // window) if i < len(hits) else left
        out.extend((first, n, False) for first, n in pieces(start, empty, window))
        start += empty * window
        if empty < left:
            out.append((start, 1, True))
            start += window + gap
        left = (upto - start) // window
    return out, start


def pieces(start: int, n: int, window: int) -> Iterator[tuple[int, int]]:
    """n windows from a start on as runs, (start of the first, how many), each of which starts within one part of time."""
    most = min(PIECE, SLICE)
    while n > 0:
        some = min(n, most - start // window % most)
        yield start, some
        start, n = start + some * window, n - some


def dealt(runs: DataFrame, start: str, window: int, tasks: int) -> DataFrame:
    """Runs by the part of time that they start in and by what their starts leave over a window, with k for each of their windows.

    So the windows of one device are not all made by one task.  And windows that start at one time come near each other, for
    which columns of times and numbers take less than half the room: a file has few of them, again and again.
    """
    part, phase = F.floor(F.col(start) / (min(PIECE, SLICE) * window)), F.pmod(F.col(start), F.lit(window))
    near = runs.repartition(tasks, part, phase).sortWithinPartitions(part, phase, "window_id")
    return near.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))


def spread(spark: SparkSession) -> int:
    """Tasks for devices: a named number, as few small rows make many windows and would be put together into few tasks."""
    return 4 * spark.sparkContext.defaultParallelism


def _table(windows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(windows, columns=["device_id", "window_id", "start_ms", "end_ms", "matched"])


def listen_batch(frames: DataFrame, window: int = WINDOW_MS, gap: int = AFTER_MATCH_MS) -> DataFrame:
    """`frames`: (device_id, at_ms, hit).  Windows of each device from its first frame to its last, in order."""
    tasks = spread(frames.sparkSession)
    ordered = frames.select("device_id", "at_ms", "hit").repartition(tasks, "device_id").sortWithinPartitions("device_id", "at_ms")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, start, number, held = None, 0, 0, np.empty(0, np.int64)
        for pdf in parts:
            out = []
            for d, rows in pdf.groupby("device_id", sort=False):
                at = rows["at_ms"].to_numpy()
                if d != device:
                    device, start, number, held = d, int(at[0]), 0, held[:0]
                hits = np.concatenate([held, at[rows["hit"].eq(True).to_numpy(bool)]])
                made, start = window_runs(hits, start, window, gap, int(at[-1]))
                for first, n, matched in made:
                    out.append((device, number, first, n, matched))
                    number += n
                held = hits[hits >= start]  # what windows to come can use
            yield pd.DataFrame(out, columns=["device_id", "window_id", "start_ms", "n", "matched"])

    each = dealt(ordered.mapInPandas(run, RUNS), "start_ms", window, tasks)
    start = F.col("start_ms") + F.col("k") * window
    return each.select("device_id", (F.col("window_id") + F.col("k")).alias("window_id"), start.alias("start_ms"), (start + window).alias("end_ms"), "matched")


class Listener(StatefulProcessor):
    """The next window's start and number, and the frames seen from there on, of each device."""

    def __init__(self, window: int, gap: int):
        self.window, self.gap = window, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", StructType([StructField("start", LongType()), StructField("number", LongType())]))
        self.open = handle.getListState("open", StructType([StructField("at_ms", LongType()), StructField("hit", LongType())]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("at_ms", kind="stable")
        start, number = self.place.get() if self.place.exists() else (int(pdf["at_ms"].iloc[0]), 0)
        held = [(int(t), bool(h)) for t, h in self.open.get()]
        hits = sorted(held + [(int(t), bool(h)) for t, h in zip(pdf["at_ms"], pdf["hit"], strict=True) if t >= start])
        upto, made = hits[-1][0] if hits else start, [None] * SLICE
        while len(made) == SLICE:
            made, start = next_windows(hits, start, self.window, self.gap, upto, SLICE)
            yield _table([(key[0], number + k, *w) for k, w in enumerate(made)])
            number, hits = number + len(made), [h for h in hits if h[0] >= start]
        self.place.update((int(start), int(number)))
        self.open.put([(t, int(h)) for t, h in hits])

    def close(self) -> None:
        pass


def listen_stream(frames: DataFrame, window: int = WINDOW_MS, gap: int = AFTER_MATCH_MS) -> DataFrame:
    """The same over a stream; needs the RocksDB state store."""
    return frames.groupBy("device_id").transformWithStateInPandas(Listener(window, gap), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
