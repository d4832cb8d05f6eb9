"""A token-ID section: static range asymmetric numeral system over independent interleaved blocks.

A section holds the ids of a run of documents.  One frequency table, quantised to 2^16, is shared by all of its
blocks.  A block is `STEPS` x `LANES` ids dealt in turn to `LANES` coder states that share one stream of 16-bit
words.  Each block's entry in the checkpoint table has the place of its words, its final states and a crc32 of
both, so blocks can be decoded in any order and in parallel; here all blocks of a section run as one vector.

Layout, little-endian: magic, header (documents, ids, blocks, symbols, sizes of the three tables), then zstandard
frames with the frequency table (symbols u2, frequencies minus one u2) and the document table (null flag u1, id
i8, length u4), the checkpoint table (first word u8, crc32 u4, states u4 x LANES) and the words (u2).  The header
and the two tables have a crc32 of their own.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import zstandard

MAGIC = b"RANSIDS1"
LANES, STEPS = 128, 128
BLOCK = LANES * STEPS
BITS = 16
_HEAD = struct.Struct("<8sIQIIIIII")


class CorruptSection(ValueError):
    """A checksum or a size of a section does not hold."""


@dataclass
class Section:
    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


def quantise(counts: np.ndarray) -> np.ndarray:
    """Positive frequencies that sum to 2^16, near the share of each count."""
    total, room = int(counts.sum()), 1 << BITS
    if len(counts) > room:
        raise ValueError("more symbols than the frequency table has room for")
    freq = np.maximum(1, counts * room // total).astype(np.int64)
    over = int(freq.sum()) - room
    if over < 0:
        freq[np.argmax(counts)] -= over
    while over > 0:
        spare = freq - 1
        cut = np.minimum(spare, np.maximum(1, spare * over // max(1, int(spare.sum()))))
        order = np.argsort(-freq, kind="stable")
        cut = cut[order]
        cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        over = int(freq.sum()) - room
    return freq


def encode(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """`ids`: the u2 ids of all documents in a row; `lengths`: ids of each document."""
    n = len(ids)
    counts = np.bincount(ids, minlength=1 << BITS)
    symbols = np.flatnonzero(counts)
    place = np.zeros(1 << BITS, np.int64)
    place[symbols] = np.arange(len(symbols))
    place, counts = place[ids], counts[symbols]
    blocks = -(-n // BLOCK)
    freq = quantise(counts) if n else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    f_of, c_of = freq.astype(np.uint32), start.astype(np.uint32)
    padded = np.full(blocks * BLOCK, int(np.argmax(counts)) if n else 0, dtype=np.int64)
    padded[:n] = place
    by_step = np.ascontiguousarray(padded.reshape(blocks, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, -1)
    x = np.full(blocks * LANES, 1 << BITS, dtype=np.uint32)
    low = np.empty((STEPS, blocks * LANES), dtype=np.uint16)
    out = np.empty((STEPS, blocks * LANES), dtype=bool)
    for t in range(STEPS - 1, -1, -1) if n else ():
        f = f_of[by_step[t]]
        emit = (x >> np.uint32(BITS)) >= f
        low[t], out[t] = x & np.uint32(0xFFFF), emit
        x = np.where(emit, x >> np.uint32(BITS), x)
        q = x // f
        x = (q << np.uint32(BITS)) + (x - q * f) + c_of[by_step[t]]
    low = low.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)
    out = out.reshape(STEPS, blocks, LANES).transpose(1, 0, 2)
    states = x.reshape(blocks, LANES)
    points, words, at = [], [], 0
    for b in range(blocks):
        own = low[b][out[b]].astype("<u2").tobytes()
        kept = states[b].astype("<u4").tobytes()
        points.append(struct.pack("<QI", at, zlib.crc32(own, zlib.crc32(kept))) + kept)
        words.append(own)
        at += len(own) // 2
    pack = zstandard.ZstdCompressor(level=3).compress
    table = pack(symbols.astype("<u2").tobytes() + (freq - 1).astype("<u2").tobytes())
    docs = pack(b"".join((np.array([d is None for d in doc_ids], "u1").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths).astype("<u4").tobytes())))
    head = _HEAD.pack(MAGIC, len(doc_ids), n, blocks, len(symbols), len(table), len(docs), at & 0xFFFFFFFF, zlib.crc32(docs, zlib.crc32(table)))
    return b"".join((head, struct.pack("<I", zlib.crc32(head)), table, docs, *points, *words))


def decode(raw: bytes) -> Section:
    """The documents and ids of a section; raises CorruptSection where a checksum does not hold."""
    if len(raw) < _HEAD.size + 4 or struct.unpack_from("<I", raw, _HEAD.size)[0] != zlib.crc32(raw[: _HEAD.size]):
        raise CorruptSection("header")
    magic, n_docs, n, blocks, n_symbols, table_size, docs_size, _, crc = _HEAD.unpack_from(raw)
    at = _HEAD.size + 4
    table, docs = raw[at : at + table_size], raw[at + table_size : at + table_size + docs_size]
    if magic != MAGIC or zlib.crc32(docs, zlib.crc32(table)) != crc:
        raise CorruptSection("tables")
    at += table_size + docs_size
    unpack = zstandard.ZstdDecompressor().decompress
    table, docs = unpack(table), unpack(docs)
    symbols = np.frombuffer(table, "<u2", n_symbols)
    freq = np.frombuffer(table, "<u2", n_symbols, 2 * n_symbols).astype(np.uint32) + np.uint32(1)
    none, ids_of, lengths = np.frombuffer(docs, "u1", n_docs), np.frombuffer(docs, "<i8", n_docs, n_docs), np.frombuffer(docs, "<u4", n_docs, 9 * n_docs)
    doc_ids = [None if gone else int(d) for gone, d in zip(none, ids_of, strict=True)]
    entry = 12 + 4 * LANES
    points = np.frombuffer(raw, np.dtype([("at", "<u8"), ("crc", "<u4"), ("states", "<u4", (LANES,))]), blocks, at)
    words = np.frombuffer(raw, "<u2", -1, at + blocks * entry)
    ends = np.append(points["at"][1:], len(words)).astype(np.int64)
    for b in range(blocks):
        if zlib.crc32(words[int(points["at"][b]) : ends[b]].tobytes(), zlib.crc32(points["states"][b].tobytes())) != points["crc"][b]:
            raise CorruptSection(f"block {b}")
    ids = _decode_blocks(points["states"], points["at"].astype(np.int64), words, symbols, freq)[:n] if blocks else np.zeros(0, np.uint16)
    return Section(doc_ids, lengths.astype(np.int64), ids)


def _decode_blocks(states: np.ndarray, first: np.ndarray, words: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """All ids of the given blocks."""
    blocks = len(states)
    start = (np.cumsum(freq) - freq).astype(np.uint32)
    of_slot = np.repeat(np.arange(len(freq)), freq)
    f_slot, shift, s_slot = freq[of_slot], (np.arange(1 << BITS, dtype=np.uint32) - start[of_slot]), symbols[of_slot]
    words = np.append(words, np.uint16(0)).astype(np.uint32)
    x, at = states.astype(np.uint32), first.copy()
    out = np.empty((STEPS, blocks, LANES), dtype=np.uint16)
    for t in range(STEPS):
        slot = x & np.uint32(0xFFFF)
        out[t] = s_slot[slot]
        x = f_slot[slot] * (x >> np.uint32(BITS)) + shift[slot]
        need = x < np.uint32(1 << BITS)
        upto = np.cumsum(need, axis=1)
        place = np.minimum(at[:, None] + upto - 1, len(words) - 1)
        x = np.where(need, (x << np.uint32(BITS)) | words[np.maximum(place, 0)], x)
        at += upto[:, -1]
    return out.transpose(1, 0, 2).reshape(-1)
