"""Per-row array operators as column expressions: framing, levels, endpoints, emphasis, derivatives."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwave.config import EndpointConfig


def let(value: Column, then) -> Column:
    """`then(value)` with the value worked out once: a lambda's argument is a slot, not an expression to repeat."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalise_pcm(pcm: Column) -> Column:
    """16-bit samples to array<float> in [-1, 1)."""
    return F.transform(pcm, lambda x: (x / F.lit(32768.0)).cast("float"))


def duration_ms(samples: Column, rate: Column) -> Column:
    """Whole milliseconds; 0 where the rate is not positive."""
    return F.when(rate > 0, F.floor(F.size(samples).cast("long") * 1000 / rate)).otherwise(F.lit(0)).cast("long")


def framed(samples: Column, length: int, shift: int) -> Column:
    """Frames that fit whole; none of a shorter signal."""
    starts = F.sequence(F.lit(0), F.size(samples) - length, F.lit(shift))
    return F.when(F.size(samples) >= length, F.transform(starts, lambda s: F.slice(samples, s + 1, length))).otherwise(F.array().cast("array<array<float>>"))


def rms(frame: Column) -> Column:
    """Root mean square, summed in float64 and narrowed; 0 of an empty frame."""
    total = F.aggregate(frame, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.when(F.size(frame) > 0, F.sqrt(total / F.size(frame))).otherwise(F.lit(0.0)).cast("float")


def low_percentile(values: Column, p: float) -> Column:
    """The sorted value at index trunc(p * (n - 1)), without interpolation; null of no values."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int")))


def segment(samples: Column, rate_hz: int, config: EndpointConfig = EndpointConfig()) -> Column:
    """struct<start_sample int, end_sample int> of the speech in array<float>, or null."""
    length, shift = rate_hz * config.frame_ms // 1000, rate_hz * config.shift_ms // 1000
    least = math.ceil(config.min_speech_ms / config.shift_ms) if config.min_speech_ms % config.shift_ms else config.min_speech_ms // config.shift_ms
    hang = config.hangover_ms // config.shift_ms
    begin = F.struct(F.lit(0).alias("run"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"))

    def runs(levels: Column, level: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            run = F.when(v >= level, s["run"] + 1).otherwise(F.lit(0))
            counts = run >= least
            first = F.when(counts & (s["first"] < 0), s["i"] - least + 1).otherwise(s["first"])
            return F.struct(run.alias("run"), first.alias("first"), F.when(counts, s["i"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i"))

        return F.aggregate(levels, begin, step)

    def found(levels: Column) -> Column:
        level = F.greatest((low_percentile(levels, config.percentile) * F.lit(config.ratio)).cast("float"), F.lit(config.floor).cast("float"))
        return let(level, lambda x: let(runs(levels, x), lambda r: bounds(levels, r)))

    def bounds(levels: Column, r: Column) -> Column:
        start = F.greatest(F.lit(0), r["first"] - hang) * shift
        last = F.least(F.size(levels) - 1, r["last"] + hang)
        return F.when(r["first"] >= 0, F.struct(start.alias("start_sample"), F.least(last * shift + length, F.size(samples)).alias("end_sample")))

    return let(F.transform(framed(samples, length, shift), rms), found)


def frame_levels(x: np.ndarray, length: int, shift: int) -> np.ndarray:
    """`rms` of the frames that fit whole, in numpy, summed in the same order."""
    n = (len(x) - length) // shift + 1 if len(x) >= length else 0
    frames = x.astype(np.float64)[np.arange(n)[:, None] * shift + np.arange(length)]
    return np.sqrt(np.cumsum(frames * frames, axis=1)[:, -1] / length).astype(np.float32) if n else np.zeros(0, np.float32)


def speech_bounds(x: np.ndarray, rate_hz: int, config: EndpointConfig = EndpointConfig(), missing: np.ndarray | None = None) -> tuple[int, int] | None:
    """`segment` of one signal in numpy, for tasks that hold it as an array; `missing` tells which samples are null.

    As in Spark, a frame with a null has no level, which comes last and is not loud, and a level that is no number is over all others.
    """
    length, shift = rate_hz * config.frame_ms // 1000, rate_hz * config.shift_ms // 1000
    least, hang = -(-config.min_speech_ms // config.shift_ms), config.hangover_ms // config.shift_ms
    levels = frame_levels(x, length, shift)
    if not len(levels):
        return None
    known = np.ones(len(levels), bool)
    if missing is not None and missing.any():
        known = ~missing[np.arange(len(levels))[:, None] * shift + np.arange(length)].any(axis=1)
    low, level = np.sort(levels[known]), np.float32(config.floor)
    at = int(config.percentile * (len(levels) - 1))
    if at < len(low):
        level = np.maximum(np.float32(np.float64(low[at]) * config.ratio), level)  # no number, if the one is none
    loud = known & ((levels >= level) | np.isnan(levels))
    counts = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(loud, least).all(axis=1)) if len(loud) >= least else []
    if not len(counts):
        return None
    start, last = max(0, counts[0] - hang), min(len(levels) - 1, counts[-1] + least - 1 + hang)
    return int(start * shift), int(min(last * shift + length, len(x)))


def trim(samples: Column, found: Column) -> Column:
    """The samples of a segment; none where it is null."""
    cut = lambda f: F.when(f.isNotNull(), F.slice(samples, f["start_sample"] + 1, f["end_sample"] - f["start_sample"])).otherwise(F.array().cast("array<float>"))
    return let(found, cut)


def pre_emphasised(samples: Column, factor: float) -> Column:
    """y0 = x0, y[i] = x[i] - factor * x[i-1], in float32."""
    f = F.lit(factor).cast("float")
    return F.transform(samples, lambda x, i: F.when(i == 0, x).otherwise((x - f * F.element_at(samples, F.greatest(i, F.lit(1)))).cast("float")))


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) if n > 1 else 1.0 for i in range(n)]


def windowed(frame: Column, n: int) -> Column:
    table = F.array([F.lit(x).cast("float") for x in hamming(n)])
    return F.zip_with(frame, table, lambda x, w: (x * w).cast("float"))


def mean_subtracted(frames: Column) -> Column:
    """Each coefficient without its mean over the frames."""
    n, width = F.size(frames), F.size(F.element_at(frames, 1))
    sums = F.aggregate(frames, F.array_repeat(F.lit(0.0), width), lambda s, f: F.zip_with(s, f, lambda x, y: x + y.cast("double")))
    means = F.transform(sums, lambda s: (s / n).cast("float"))
    less = let(means, lambda m: F.transform(frames, lambda f: F.zip_with(f, m, lambda x, y: (x - y).cast("float"))))
    return F.when(n > 0, less).otherwise(frames)


def derivative(frames: Column) -> Column:
    """Half the difference of the neighbours, which stop at the ends."""
    return let(frames, _derivative)


def _derivative(frames: Column) -> Column:
    n = F.size(frames)
    return F.transform(frames, lambda _, i: F.zip_with(F.element_at(frames, F.least(i + 2, n)), F.element_at(frames, F.greatest(i, F.lit(1))), lambda a, b: ((a - b) / F.lit(2.0)).cast("float")))


def with_derivatives(frames: Column, order: int) -> Column:
    """Static coefficients, then first, then second derivatives, side by side."""

    def extend(joined: Column, last: Column, left: int) -> Column:
        if not left:
            return joined
        return let(derivative(last), lambda d: extend(F.zip_with(joined, d, lambda a, b: F.concat(a, b)), d, left - 1))

    return let(frames, lambda f: extend(f, f, order))
