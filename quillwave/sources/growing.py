"""Capture as a streaming source: frames of PCM files that grow while they are recorded.

`spark.readStream.format("pcm_growing")` with the options

    path             a folder; each device writes 16-bit little-endian mono samples to `<device>.pcm`
    frame_ms         length of a frame (20)
    sample_rate_hz   of all files (16000)
    max_bytes        of a file that one batch takes at most (no limit)
    progress         a folder for planned offsets, needed for `max_bytes`

An offset is the number of bytes of each file that have been given out.  Only whole frames are; what is left of one waits
for the rest, or until the recorder adds an empty file `<device>.pcm.end`, and then comes as a short frame.  A frame is
known by its place in the file, so a batch that is repeated after a restart gives the same rows again, and no frame is
lost or given to two batches.  Long stretches are cut into partitions of `PARTITION_BYTES`.

Spark asks this kind of source for the newest offset without telling where the stream stands, so with `max_bytes` the
planned offset is written down before Spark logs it: it is never behind the stream's checkpoint, and after a crash one
batch may be larger by what was planned but not logged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "device_id long, seq long, at long, upto long, sample_rate_hz int, samples array<float>"
SAMPLE = 2
PARTITION_BYTES = 8 << 20
BATCH_FRAMES = 2048
_FILE = re.compile(r"([0-9]+)\.pcm(\.end)?")


class Stretch(InputPartition):
    """Bytes of one device's file."""

    def __init__(self, device: int, start: int, end: int):
        self.device, self.start, self.end = device, start, end


class GrowingPcm(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.rate = int(options.get("sample_rate_hz", 16_000))
        self.frame = self.rate * int(options.get("frame_ms", 20)) // 1000 * SAMPLE
        self.most = int(options["max_bytes"]) // self.frame * self.frame if "max_bytes" in options else None
        self.progress = options.get("progress")
        if self.frame <= 0 or self.most == 0:
            raise ValueError("frame_ms and max_bytes have to hold a sample and a frame")
        if self.most and not self.progress:
            raise ValueError("max_bytes needs a folder for progress")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Whole frames of each file as it is now, and all of a file that has ended."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        sizes, ended = {}, set()
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if found := _FILE.fullmatch(info.base_name):
                if found[2]:
                    ended.add(found[1])
                else:
                    sizes[found[1]] = info.size // SAMPLE * SAMPLE
        planned = self._planned() if self.most else {}
        out = {}
        for device, size in sorted(sizes.items()):
            whole = size // self.frame * self.frame
            upto = size if device in ended else whole
            out[device] = upto if self.most is None else min(upto, planned.get(device, 0) + self.most)
        if self.most and out != planned:
            self._plan(out)
        return out

    def _planned(self) -> dict:
        fs, root = pafs.FileSystem.from_uri(self.progress)
        name = f"{root}/planned.json"
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_stream(name) as f:
            return json.loads(f.read())

    def _plan(self, offset: dict) -> None:
        fs, root = pafs.FileSystem.from_uri(self.progress)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/planned.new") as f:
            f.write(json.dumps(offset).encode())
        fs.move(f"{root}/planned.new", f"{root}/planned.json")

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        step, out = max(self.frame, PARTITION_BYTES // self.frame * self.frame), []
        for device, upto in end.items():
            out += [Stretch(int(device), at, min(upto, at + step)) for at in range(start.get(device, 0), upto, step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{root}/{partition.device}.pcm") as f:
            for at in range(partition.start, partition.end, self.frame * BATCH_FRAMES):
                raw = f.read_at(min(self.frame * BATCH_FRAMES, partition.end - at), at)
                samples = np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32768)
                yield self._frames(partition.device, at, samples)

    def _frames(self, device: int, at: int, samples: np.ndarray) -> pa.RecordBatch:
        size = self.frame // SAMPLE
        starts = np.arange(0, len(samples), size)
        bounds = np.append(starts, len(samples))
        first = at // SAMPLE
        n = len(starts)
        frames = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(samples))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, device)), pa.array(starts // size + at // self.frame), pa.array(first + bounds[:-1]), pa.array(first + bounds[1:]),
            pa.array(np.full(n, self.rate, np.int32)), frames,
        ], names=["device_id", "seq", "at", "upto", "sample_rate_hz", "samples"])

    def commit(self, end: dict) -> None:
        pass


def growing_capture(spark: SparkSession, path: str, frame_ms: int = 20, sample_rate_hz: int = 16_000, **options: str | int):
    """The stream of frames of a folder of growing recordings."""
    spark.dataSource.register(GrowingPcm)
    return spark.readStream.format("pcm_growing").options(path=path, frame_ms=frame_ms, sample_rate_hz=sample_rate_hz, **options).load()
