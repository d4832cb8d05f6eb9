"""Media columns: texts as 8-bit sound members of archives, read back through the archive data source.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit mono WAV file
whose extra chunk holds the unpadded length.  Each task packs its files into archives (see `archives`); the data
source reads them back; every column but the id comes from the bytes read back.

`feature`: mean and root mean square of the centred samples, rate of sign changes, and the strongest bin and
centroid of the mean power spectrum of 64-sample frames.

Null texts count as empty.  Equal texts have equal values.  Repeated rows give a row each; null ids are kept.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillwave.llm import archives
from quillwave.llm.common import fresh_path, stash, tidy

FRAME = 64
SAMPLE_RATE = 8000
_PREAMBLE = struct.Struct("<4sI4s4sIHHIIHH4sIQ4sI")


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0), len(raw)


def to_wav(payload: bytes, length: int) -> bytes:
    return _PREAMBLE.pack(b"RIFF", _PREAMBLE.size - 8 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"tlen", 8, length, b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[bytes, int]:
    head = _PREAMBLE.unpack_from(media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[14] != b"data" or head[15] != len(media) - _PREAMBLE.size:
        raise ValueError("not one of these sound files")
    return media[_PREAMBLE.size :], head[13]


def feature(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    x -= 128
    sign = x >= 0
    power = np.zeros(FRAME // 2 + 1)
    for at in range(0, len(x), FRAME * 4096):
        frames = x[at : at + FRAME * 4096].reshape(-1, FRAME)
        power += (np.abs(np.fft.rfft(frames, axis=1)) ** 2).sum(axis=0)
    body = power[1:]
    centroid = float((body * np.arange(1, len(power))).sum() / max(float(body.sum()), 1e-9))
    return f"mean={x.mean(dtype=np.float64):.3f};rms={float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))):.3f};turns={float((sign[1:] != sign[:-1]).mean()):.5f};peak={int(body.argmax()) + 1};centroid={centroid:.3f}"


def _store(folder: str):
    def run(batches):
        out = archives.ArchiveWriter(folder)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 256):
                for doc_id, text in zip(ids[lo : lo + 256], batch.column(1).slice(lo, 256).to_pylist(), strict=True):
                    out.add(doc_id, to_wav(*payload_of(text)))
        out.close()
        yield pa.RecordBatch.from_pylist(out.made, schema=pa.schema([("file", pa.string()), ("members", pa.int64()), ("directory", pa.int64())]))

    return run


def _measure(batches):
    for batch in batches:
        rows = []
        for media in batch.column(1):
            media = media.as_py()
            payload, length = from_wav(media)
            rows.append((length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(documents: DataFrame, folder: str) -> None:
    """Write the archives of all texts; only one record an archive comes to the driver."""
    manifest = stash(documents.select("doc_id", "text").mapInArrow(tidy(_store(folder)), "file string, members long, directory long"), "archives")
    archives.write_index(folder, [r.asDict() for r in manifest.collect()])


def read(spark, folder: str) -> DataFrame:
    """doc_id, name and media of every member."""
    spark.dataSource.register(archives.MediaArchiveSource)
    return spark.read.format("media_archive").option("path", folder).load()


def media_columns(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores all texts in `folder` (a fresh shared one by default), reads them back and measures them."""
    folder = folder or fresh_path(documents.sparkSession, "media")
    store(documents, folder)
    return read(documents.sparkSession, folder).select("doc_id", "media").mapInArrow(tidy(_measure), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
