"""Removal of repeated substrings by seeds and extension.

A window is `WINDOW` words of one text.  It is repeated if its words also start earlier: in a document that comes before,
or earlier in its own.  Words covered by a repeated window go; windows are judged on the input, not on what is left.

1. Seeds: of the `SEEDS` grams of `GRAM` words in a window the one with the least hash is its anchor, the last one if
   several are equal.  Equal windows have equal anchors at equal places, so only windows whose anchor occurs elsewhere can
   be repeated.  Neighbouring windows mostly share one; such a run goes out as one row: hash of the anchor, hash of all
   words that the run covers, place.  A repeat of any length over the threshold is a sequence of such runs.
2. Rows meet by anchor.  Where all of an anchor's runs cover equal words, the match extends over the whole run to both
   sides: every run but the first is repeated.  Anchors met once are dropped here, which is most of a corpus.
3. Where the words around an anchor differ, the first run of each wording is extended window by window: it goes back to
   its text, and its windows meet by their own hash.  The first window of each stays, the others are repeated.
   So a maximal repeat ends where its last common window ends, and no two occurrences are ever paired with each other:
   each meets only the first of its group.
4. Repeated runs go back to their texts, and the words that they cover are left out.

Before anything is shuffled a task folds what it sees of a slice of texts: of runs that cover equal words only the first
goes out, and an anchor with several wordings in one slice goes out as one notice, its windows at once by their own
hash.  So a key has at most one row a slice (`tk.SLICE_BYTES`) at a time, however often a line occurs, and ranking within it
streams.  Hashes are compared by two numbers of 64 bits.

Null and wordless texts have no words; shorter ones than a window are left as they are.  Documents are ordered by doc_id,
null first, and rows that share an id by a hash of their text.  Rows equal in both are one document: neither removes the
other's words, and each gets the document's result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.common import stash, tidy

WINDOW, GRAM = 20, 8
SEEDS = WINDOW - GRAM + 1
#: Words in a piece of one text; the places of anchors are told by so many numbers.
PIECE = 1 << 22
_PLACES = np.uint64((1 << 24) - 1)

#: Kinds of rows: a run to judge; a notice that its anchor has several wordings; a window to judge; a repeated run; a run to extend.
RUN, NOTICE, SINGLE, REPEATED, EXTEND = range(5)
ROW = "kind int, key long, check long, doc long, at long, n int"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
NO_ID = -(1 << 63)


def _table(kind: int, key: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(doc), pa.array(at), pa.array(n.astype(np.int32))], names=_NAMES)


def _repeated(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs that are known to be repeated, neighbours in one row."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
    cut = np.flatnonzero(new)
    total = np.add.reduceat(n, cut) if len(cut) else n
    return _table(REPEATED, at[cut], doc[cut], doc[cut], at[cut], total)


def _firsts(doc: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then document and place; where a group starts; which rows (in that order) come after the group's first."""
    order = np.lexsort((at, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, new, (doc[order] != doc[first]) | (at[order] != at[first])


class Slice:
    """The words of some texts, and the anchor of each window."""

    def __init__(self, doc: np.ndarray, twin: np.ndarray, data: np.ndarray, offsets: np.ndarray, low: int = 0, high: int | None = None):
        starts, ends, rows = tk.word_bounds(data, offsets, tk.NON_SPACE)
        self.total = len(starts)
        self.begins = np.searchsorted(rows, np.arange(len(doc)))
        starts, ends, self.rows = starts[low:high], ends[low:high], rows[low:high]
        self.low, self.words = low, tk.span_hashes(data, starts, ends)
        self.doc, self.twin = doc, twin
        n = len(self.words) - WINDOW + 1
        self.p = np.flatnonzero(self.rows[:n] == self.rows[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.grams = tk.gram_hashes(self.words, GRAM)
        if len(self.p):
            places = np.arange(len(self.grams), dtype=np.uint64)
            least = tk.sliding_min((self.grams & ~_PLACES) | (_PLACES - places), SEEDS)
            self.anchor = (_PLACES - (least & _PLACES)).astype(np.int64)[: len(self.rows) - WINDOW + 1]

    def place(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and place (hash of the text, then number of the word in it) of the windows that start at p."""
        row = self.rows[p]
        return self.doc[row], self.twin[row] << 32 | (p + self.low - self.begins[row])

    def windows(self, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows to judge, once for each wording of this slice; later ones are repeated."""
        key, check = tk.sequence_hashes(self.words, p, p + WINDOW), self.grams[self.anchor[p]]
        doc, at = self.place(p)
        order, new, later = _firsts(doc, at, key, check)
        one = order[new]
        yield _table(SINGLE, key[one], check[one], doc[one], at[one], np.ones(len(one)))
        rest = order[later]
        yield _repeated(doc[rest], at[rest], np.ones(len(rest)))

    def runs(self) -> Iterator[pa.RecordBatch]:
        """Runs to judge, notices, windows of anchors with several wordings, and what is repeated within the slice."""
        if not len(self.p):
            return
        p, anchor = self.p, self.anchor[self.p]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
        low, n = p[cut], np.diff(np.append(cut, len(p)))
        key, check = self.grams[anchor[cut]], tk.sequence_hashes(self.words, low, low + n + WINDOW - 1)
        doc, at = self.place(low)
        order, new, later = _firsts(doc, at, key, check)
        yield _repeated(doc[order[later]], at[order[later]], n[order[later]])
        one = order[new]
        same = key[one][1:] == key[one][:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        alone, many = one[~several], one[several]
        yield _table(RUN, key[alone], check[alone], doc[alone], at[alone], n[alone])
        if len(many):
            told = many[np.concatenate([[True], key[many][1:] != key[many][:-1]])]
            yield _table(NOTICE, key[told], np.zeros(len(told), np.uint64), doc[told], at[told], np.zeros(len(told)))
            yield from self.windows(spread(low[many], n[many]))


def spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, low + n)."""
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc, twin, text."""
    for batch in batches:
        for lo, hi in tk.slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            doc, twin = (part.column(i).to_numpy() for i in range(2))
            data, offsets = tk.text_bytes(part.column(2))
            whole = Slice(doc, twin, data, offsets, 0, PIECE)
            yield from whole.runs()
            for low in range(PIECE - WINDOW + 1, whole.total - WINDOW + 1, PIECE - WINDOW + 1):
                yield from Slice(doc, twin, data, offsets, low, low + PIECE).runs()


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle that brings runs back to them."""
    for batch in batches:
        packed = [_PACK.compress(t.encode()) if t else None for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]], names=batch.schema.names[:2] + ["packed"] + batch.schema.names[3:])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the texts of their column 2, each with a space at its end: (rows, bytes, offsets)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            for blob in batch.column(2).slice(at).to_pylist():
                texts.append((_UNPACK.decompress(blob) if blob else b"") + b" ")
                size += len(texts[-1])
                if size >= tk.SLICE_BYTES:
                    break
            yield batch.slice(at, len(texts)), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            at += len(texts)


def _ranges(column: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (as words of the slice) and lengths of the runs listed for each text; null lists are empty."""
    lists = column.fill_null([]) if column.null_count else column
    flat = lists.flatten()
    each = lists.value_lengths().to_numpy(zero_copy_only=False)
    low, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    return low + np.repeat(begins, each), n


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc, twin, packed, runs: the windows of these runs."""
    for part, data, offsets in _unpacked(batches):
        doc, twin = (part.column(i).to_numpy() for i in range(2))
        begins = None
        low = 0
        while begins is None or low < whole - WINDOW + 1:
            piece = Slice(doc, twin, data, offsets, low, low + PIECE)
            if begins is None:
                begins, whole = piece.begins, piece.total
                p = np.unique(spread(*_ranges(part.column(3), begins)))
            own = p[(p >= low) & (p < low + PIECE - WINDOW + 1)] - low
            own = own[np.isin(own, piece.p, assume_unique=True)]
            if len(own):
                yield from piece.windows(own)
            low += PIECE - WINDOW + 1


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc, twin, packed, runs, doc_id: what is left of each text."""
    for part, data, offsets in _unpacked(batches):
        starts, ends, rows = tk.word_bounds(data, offsets, tk.NON_SPACE)
        bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
        low, n = _ranges(part.column(3), bounds[:-1])
        steps = np.zeros(len(starts) + 1, np.int64)
        np.add.at(steps, low, 1)
        np.add.at(steps, np.minimum(low + n + WINDOW - 1, len(starts)), -1)
        gone = np.cumsum(steps[:-1]) > 0
        kept_before = np.concatenate([[0], np.cumsum(~gone)])
        text = np.where(tk.NON_SPACE[data], data, np.uint8(0x20))
        edges = np.zeros(len(data) + 2, np.int8)
        edges[starts[~gone]] += 1
        edges[ends[~gone] + 1] -= 1  # with the space after it
        stays = np.cumsum(edges[: len(data)], dtype=np.int8) > 0
        shas = []
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            out = text[a:b][stays[a:b]].tobytes().strip(b" ")
            shas.append(hashlib.sha256(out).hexdigest())
        words, removed = np.diff(bounds), np.diff(bounds) - np.diff(kept_before[bounds])
        yield pa.RecordBatch.from_arrays([part.column(4), pa.array(words), pa.array(removed), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(0x7FFFFFFF).alias("twin"), "text", "doc_id")


def _by_text(runs: DataFrame) -> DataFrame:
    run = F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).alias("low"), F.col("n").alias("n"))
    return runs.groupBy("doc", F.shiftright("at", 32).alias("twin")).agg(F.collect_list(run).alias("runs"))


def _after_first(rows: DataFrame) -> DataFrame:
    """SINGLE rows: those after the first of their wording become repeated; the others go.  REPEATED ones pass."""
    place = F.rank().over(Window.partitionBy("kind", "key", "check").orderBy("doc", "at"))
    return rows.withColumn("place", place).where(f"kind = {REPEATED} OR place > 1").select("doc", "at", "n")


def repeated_runs(documents: DataFrame) -> DataFrame:
    """(doc, at, n): n repeated windows in a row from a place on, of documents keyed as by `_keyed`."""
    rows = documents.select("doc", "twin", "text").mapInArrow(tidy(_seeds), ROW)
    of_key = Window.partitionBy("key", "judged")
    wording = Window.partitionBy("key", "judged", "check").orderBy("doc", "at")
    met = rows.withColumn("judged", F.col("kind") <= NOTICE).withColumns({
        "place": F.rank().over(wording),
        "least": F.min(F.when(F.col("kind") == RUN, F.col("check"))).over(of_key), "most": F.max(F.when(F.col("kind") == RUN, F.col("check"))).over(of_key), "told": F.max("kind").over(of_key),
    })
    verdict = F.when(~F.col("judged"), F.col("kind")).when((F.col("kind") == RUN) & (F.col("place") > 1), REPEATED).when((F.col("kind") == RUN) & ((F.col("least") != F.col("most")) | (F.col("told") == NOTICE)), EXTEND)
    met = stash(met.withColumn("kind", verdict).where("kind IS NOT NULL").select(*_NAMES), "met-runs")
    texts = documents.select("doc", "twin", "text").mapInArrow(_pack, "doc long, twin long, packed binary")
    windows = texts.join(_by_text(met.where(f"kind = {EXTEND}")), ["doc", "twin"]).mapInArrow(tidy(_extend), ROW)
    return met.where(f"kind = {REPEATED}").select("doc", "at", "n").union(_after_first(met.where(f"kind = {SINGLE}").union(windows)))


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each document."""
    keyed = _keyed(documents)
    runs = _by_text(repeated_runs(keyed))
    texts = keyed.select("doc", "twin", "text", "doc_id").mapInArrow(_pack, "doc long, twin long, packed binary, doc_id long")
    both = texts.join(runs, ["doc", "twin"], "left").select("doc", "twin", "packed", "runs", "doc_id")
    return both.mapInArrow(tidy(_kept), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS seq FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS p FROM w)),
repeats AS (SELECT doc_id, p FROM (SELECT doc_id, p, rank() OVER (PARTITION BY seq ORDER BY doc_id NULLS FIRST, p) AS place FROM starts) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM repeats),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS left_over, count(*) AS n FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
