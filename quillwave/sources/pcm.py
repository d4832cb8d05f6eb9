"""PCM sources: WAV files as a Spark data source, fixed-size frames, and a synthetic corpus."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.functions.frames import normalise_pcm


def wav_samples(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of the first channel; a cut file gives the samples that it has."""
    stream = io.BytesIO(raw)
    if stream.read(4) != b"RIFF":
        raise ValueError("not a RIFF file")
    stream.seek(12)
    rate, channels, samples = 0, 1, np.zeros(0, "<i2")
    while len(head := stream.read(8)) == 8:
        kind, size = head[:4], struct.unpack("<I", head[4:])[0]
        body = stream.read(size + size % 2)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if coding != 1 or bits != 16:
                raise ValueError("only 16-bit PCM")
        elif kind == b"data":
            samples = np.frombuffer(body[: len(body) // 2 * 2], "<i2")[::channels]
    return rate, samples


def _wav_rows(batches):
    for batch in batches:
        read = [wav_samples(raw.as_py()) for raw in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in read], pa.int32()), pa.array([s.tolist() for _, s in read], pa.list_(pa.int16()))], names=["path", "sample_rate_hz", "pcm"])


def _from_wav(files: DataFrame) -> DataFrame:
    pcm = files.select("path", "content").mapInArrow(_wav_rows, "path string, sample_rate_hz int, pcm array<smallint>")
    return pcm.select("path", "sample_rate_hz", normalise_pcm(F.col("pcm")).alias("samples"))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate_hz, samples array<float>) of the WAV files under a folder, one row a file."""
    return _from_wav(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path))


def capture_stream(spark: SparkSession, path: str, frame_ms: int, files_at_once: int = 100) -> DataFrame:
    """A stream of (device_id, seq, sample_rate_hz, samples): frames of the recordings that arrive in a folder.

    Recordings are named `device-number.wav`, numbered from 0 in the order of capture.  Frames are `frame_ms` long and
    the last one of a recording may be shorter; their numbers rise over a device's recordings.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.wav").option("maxFilesPerTrigger", files_at_once).load(path)
    name = F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.wav$", 1), F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.wav$", 2)
    audio = _from_wav(files).select(name[0].cast("long").alias("device_id"), name[1].cast("long").alias("number"), "sample_rate_hz", "samples")
    size = F.greatest(F.lit(1), (F.col("sample_rate_hz") * frame_ms / 1000).cast("int"))
    starts = F.sequence(F.lit(0), F.size("samples") - 1, size)
    pieces = F.when(F.size("samples") > 0, F.transform(starts, lambda s: F.slice("samples", s + 1, size)))
    frames = audio.select("device_id", "number", "sample_rate_hz", F.posexplode(pieces).alias("nth", "samples"))
    return frames.select("device_id", (F.col("number") * F.lit(1 << 32) + F.col("nth")).alias("seq"), "sample_rate_hz", "samples")


def chopped(audio: DataFrame, frame: int) -> DataFrame:
    """Consecutive frames of `samples`: (device_id, seq, samples); the last one may be shorter."""
    starts = F.sequence(F.lit(0), F.size("samples") - 1, F.lit(frame))
    pieces = F.when(F.size("samples") > 0, F.transform(starts, lambda s: F.slice("samples", s + 1, F.lit(frame))))
    return audio.select("device_id", F.posexplode(pieces).alias("seq", "samples"))


#: Sweep commands from and to these frequencies, and what the corpus holds of each kind.
SWEEPS = [("sweep_a", 300.0, 800.0), ("sweep_b", 1100.0, 500.0), ("sweep_c", 600.0, 1600.0)]
ENROL, POSITIVES, TIRED, NOISES, OFF_TARGET = 2, 3, 1, 6, 4
TONE_MS, PAD_MS, RATE = 400, 200, 16_000


#: Repeatable noise: a quadratic sequence modulo a prime, so that any engine with whole numbers makes the same.
NOISE_PRIME, NOISE_SQUARE, NOISE_STEP, NOISE_SEED = 2_000_003, 48_271, 69_621, 1_299_709


def _jitter(seed, i):
    """Noise in [-1, 1) by the row's seed and the sample's place."""
    return F.pmod(i * i * NOISE_SQUARE + i * NOISE_STEP + seed * NOISE_SEED, F.lit(NOISE_PRIME)) / F.lit(NOISE_PRIME / 2) - 1.0


def corpus_specs() -> list[tuple]:
    """(seq, kind, truth, condition, f0, f1, amp, noise) of each signal."""
    rows = []
    for name, f0, f1 in SWEEPS:
        rows += [("enrol", name, "NORMAL", f0, f1, 0.3, 0.0)] * ENROL
        rows += [("positive", name, "NORMAL", f0, f1, 0.3, 0.0)] * POSITIVES
        rows += [("positive", name, "TIRED", f0 * 0.95, f1 * 0.95, 0.22, 0.0)] * TIRED
    rows += [("negative", None, "NORMAL", 0.0, 0.0, 0.0, 0.25)] * NOISES + [("negative", None, "NORMAL", 2000.0, 2400.0, 0.3, 0.0)] * OFF_TARGET
    return [(i, *r) for i, r in enumerate(rows)]


def synthetic_corpus(spark: SparkSession) -> DataFrame:
    """(seq, kind, truth, condition, samples): enrolment, positive and negative signals, made on the executors."""
    specs = spark.createDataFrame(corpus_specs(), "seq long, kind string, truth string, condition string, f0 double, f1 double, amp double, noise double")
    return sounded(specs.repartition(4))


def sounded(specs: DataFrame, tone_ms: int = TONE_MS, pad_ms: int = PAD_MS) -> DataFrame:
    """(seq, kind, truth, condition, samples): a sweep from f0 to f1 with noise, between two quiet stretches."""
    tone, pad = RATE * tone_ms // 1000, RATE * pad_ms // 1000

    def sample(i):
        t = i / F.lit(float(RATE))
        phase = F.lit(2 * np.pi) * (F.col("f0") * t + (F.col("f1") - F.col("f0")) * t * t / (2 * tone_ms / 1000))
        return (F.col("amp") * F.sin(phase) + 0.15 * F.col("amp") * F.sin(2 * phase) + (F.col("noise") + 0.003) * _jitter(F.col("seq"), i)).cast("float")

    quiet = F.array_repeat(F.lit(0.0).cast("float"), pad)
    body = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(tone - 1).cast("long")), sample)
    return specs.select("seq", "kind", "truth", "condition", F.concat(quiet, body, quiet).alias("samples"))


#: Recordings that are made at a time, so that a batch stays at some MB.
MADE = 256


def sounded_blocks(specs: DataFrame, tone_ms: int = TONE_MS, pad_ms: int = PAD_MS) -> DataFrame:
    """`sounded` in numpy, block by block; a lambda for each sample costs some 30 times as much."""
    tone, pad = RATE * tone_ms // 1000, RATE * pad_ms // 1000
    i = np.arange(tone, dtype=np.int64)
    t = i / float(RATE)

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        f0, f1, amp, noise = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for c in ("f0", "f1", "amp", "noise"))
        seq = rows.column("seq").fill_null(0).to_numpy(zero_copy_only=False)[:, None]
        phase = 2 * np.pi * (f0 * t + (f1 - f0) * t * t / (2 * tone_ms / 1000))
        jitter = np.mod(i * i * NOISE_SQUARE + i * NOISE_STEP + seq * NOISE_SEED, NOISE_PRIME) / (NOISE_PRIME / 2) - 1.0
        samples = np.zeros((rows.num_rows, pad + tone + pad), np.float32)
        with np.errstate(invalid="ignore"):
            samples[:, pad : pad + tone] = amp * np.sin(phase) + 0.15 * amp * np.sin(2 * phase) + (noise + 0.003) * jitter
        unknown = np.zeros(samples.shape, bool)
        for c in ("f0", "f1", "amp", "noise", "seq"):
            unknown[rows.column(c).is_null().to_numpy(zero_copy_only=False), pad : pad + tone] = True
        flat = pa.array(samples.reshape(-1), mask=unknown.reshape(-1) if unknown.any() else None)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * samples.shape[1]), flat)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("seq", "kind", "truth", "condition")), lists], names=["seq", "kind", "truth", "condition", "samples"])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, MADE):
                yield block(batch.slice(lo, MADE))

    return specs.select("seq", "kind", "truth", "condition", "f0", "f1", "amp", "noise").mapInArrow(run, "seq long, kind string, truth string, condition string, samples array<float>")
