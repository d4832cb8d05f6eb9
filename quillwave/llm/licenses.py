"""Licence scans: winnowed fingerprints pick candidates from an inverted index, banded alignment confirms them.

Texts are runs of words.  Of the hashes of a notice's `gram` consecutive words the smallest of every `window`
consecutive ones (the rightmost of equals) is kept.  Both are chosen for each notice so that one fingerprint stays
whole wherever changed words fall, as long as the rest makes up `COVERAGE`; `GRAM` and `WINDOW` are their upper bounds.
The notices' fingerprints form an inverted index (fingerprint to notices and places), small and of fixed size, that
goes to every task and is asked for every gram of the texts.  A shared fingerprint gives a diagonal.  A stretch of
neighbouring diagonals with `piece` different fingerprints of a notice is a piece; pieces less than the notice's length
apart form a region, which is a candidate where it has as many different fingerprints as changed words can't take away.
All candidates of a notice in a slice are aligned with it at once, word by word, in the bands of `band` diagonals around
their pieces.  An alignment goes on from one band to another at the price of the words left out or put in between, so
that a text with a passage left out or put in is still one match, as in an alignment without bands.  The best local
alignment of each start gives matched words, their share of the notice and the span in code points.  Matches from
`COVERAGE` on are reported; of matches that overlap, the one with more matched words stays, or else more coverage.
Unchanged runs of fewer than about a dozen words (a hundredth of a long licence) are not followed to a band of their own.

All words of all texts are looked up, and time is in proportion to the text even where it is made of notices.  Null
and empty texts have no matches and give a row with none.  Repeated rows give a row each; null ids are kept; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.common import tidy
from quillwave.llm.license_texts import all_notices

GRAM, WINDOW = 3, 3
BAND = 6
COVERAGE = 0.8
#: Different fingerprints of a piece at most, but for notices of which a match has more than PART times as many.
PIECE, PART = 4, 32
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of text that are aligned with a notice at a time; a region of more diagonals is cut, with cuts that overlap.
ALIGN_WORDS = 1 << 20


def changes(n_words: int) -> int:
    """How many words of a notice may be changed."""
    return n_words - math.ceil(COVERAGE * n_words - 1e-9)


def sizes(n_words: int) -> tuple[int, int]:
    """Gram and window for a notice: changed words that COVERAGE allows leave gram + window - 1 in a row somewhere."""
    changed = changes(n_words)
    run = -(-(n_words - changed) // (changed + 1))
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


def winnow(hashes: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the kept hashes; rows with fewer than `window` hashes keep their smallest."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.searchsorted(rows, rows, side="left")
    end = np.searchsorted(rows, rows, side="right")
    # The window that begins here, cut to the row; only full windows count unless the row is shorter than one.
    start = np.arange(n)
    full = (start + window <= end) | (start == begin)
    best, place = hashes.copy(), start.copy()
    for step in range(1, window):
        at = np.minimum(start + step, n - 1)
        better = (start + step < end) & (hashes[at] <= best)
        best, place = np.where(better, hashes[at], best), np.where(better, at, place)
    return np.unique(place[full])


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    by_gram: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # fingerprints, sorted; notice and place of each
    band: np.ndarray  # diagonals that a match of the notice may drift by
    need: np.ndarray  # different fingerprints that a match of the notice has
    piece: np.ndarray  # and that a piece of it has


def build_index(notices: dict[str, str]) -> Index:
    names = sorted(notices)
    words = []
    for name in names:
        data, offsets = tk.text_bytes(pa.array([notices[name]]))
        low = tk.lower(data)
        starts, ends, _ = tk.word_bounds(low, offsets, tk.ALNUM)
        words.append(tk.span_hashes(low, starts, ends))
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    band, need = np.zeros(len(names), np.int64), np.ones(len(names), np.int64)
    for i, own in enumerate(words):
        if not len(own):
            continue
        gram, window = sizes(len(own))
        changed, run = changes(len(own)), gram + window - 1
        band[i] = min(BAND, changed)
        # Each changed word spoils at most `run` windows; those left share a fingerprint `window` by `window`.
        need[i] = max(1, -(-(len(own) - run + 1 - changed * run) // window))
        hashes, first = tk.shingle_hashes(own, np.zeros(len(own), np.int64), gram)
        kept = winnow(hashes, np.zeros(len(hashes), np.int64), window)
        found.setdefault(gram, []).append((hashes[kept], np.full(len(kept), i), first[kept]))
    by_gram = {}
    for gram, parts in found.items():
        hashes, notice, place = (np.concatenate(column) for column in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        by_gram[gram] = hashes[order], notice[order], place[order]
    return Index(names, words, by_gram, band, need, np.maximum(np.minimum(need, PIECE), need // PART))


def align(text: np.ndarray, notice: np.ndarray, lo: np.ndarray, hi: np.ndarray, region: np.ndarray, diagonal: np.ndarray) -> list[np.ndarray]:
    """(region, matched words, first word, end word) of the best local alignment of each start, from COVERAGE on.

    `region` and `diagonal` are sorted and distinct: the notice's first word may meet text[diagonal], and its others those
    that follow; a region's alignments stay in text[lo:hi] of the region.  From one diagonal an alignment goes on to any
    other at a GAP for each word left out between them.  Of equal scores more matched words and the later start count.
    """
    n, enough = len(notice), math.ceil(COVERAGE * len(notice) - 1e-9)
    # The regions' texts one after another, so far apart that no alignment gets across.
    new = np.flatnonzero(np.diff(region, prepend=-1))
    left, right = diagonal[new], diagonal[np.append(new[1:], len(diagonal)) - 1] + n
    base = np.cumsum(right - left + 2 * n + 2) - (right - left) - n
    flat = np.zeros(int(base[-1] + right[-1] - left[-1] + n + 2), dtype=np.uint64)
    known = np.zeros(len(flat), dtype=bool)
    for at, a, x, y in zip(base, left, np.maximum(left, lo[region[new]]), np.minimum(right, hi[region[new]]), strict=True):
        flat[at + x - a : at + max(x, y) - a] = text[x : max(x, y)]
        known[at + x - a : at + max(x, y) - a] = True
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(diagonal))))
    column = base[of] + diagonal - left[of]
    # A cell is one number: its score above its matched words above its start.
    bits = len(flat).bit_length()
    high = bits + n.bit_length()
    assert high + (len(flat) + 2 * n).bit_length() < 63
    one, word = 1 << high, 1 << bits
    cells, above, along = column.copy(), np.zeros(len(flat), np.int64), column << high
    ends: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for i in range(n):
        at = column + i
        equal = (flat[at] == notice[i]) & known[at]
        cells = np.maximum(cells + np.where(equal, MATCH * one + word, MISMATCH * one), above[at] + GAP * (i + 1) * one)
        cells = np.maximum.accumulate(cells - GAP * along) + GAP * along
        cells = np.where(cells < one, at + 1, cells)
        above[at] = np.maximum(above[at], cells - GAP * (i + 1) * one)
        if i + 1 >= enough:
            good = np.flatnonzero(equal)
            good = good[(cells[good] >> bits & (1 << high - bits) - 1) >= enough]
            ends.append((cells[good], at[good] + 1))
    cell, end = (np.concatenate(c) for c in zip(*ends, strict=True))
    start = cell & word - 1
    order = np.lexsort((end, -cell, start))
    order = order[np.diff(start[order], prepend=-1) > 0]
    start, end, matched = start[order], end[order], cell[order] >> bits & (1 << high - bits) - 1
    of = np.searchsorted(base, start, side="right") - 1
    move = left[of] - base[of]
    return [region[new][of], matched, start + move, end + move]


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows, in order."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def _candidates(words: np.ndarray, rows: np.ndarray, index: Index) -> list[np.ndarray]:
    """(row, notice, region, diagonal) of all diagonals to align on, in order; regions are numbered within the call."""
    hits: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for gram, (fingerprints, notice, place) in index.by_gram.items():
        hashes, first = tk.shingle_hashes(words, rows, gram)
        a = np.searchsorted(fingerprints, hashes, side="left")
        b = np.searchsorted(fingerprints, hashes, side="right")
        at = np.flatnonzero(b > a)
        each = (b - a)[at]
        entry = np.repeat(a[at], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        hits.append((np.repeat(first[at], each), notice[entry], place[entry]))
    word, notice, place = (np.concatenate(c) for c in zip(*hits, strict=True))
    # A stretch s is of the band + 1 diagonals from s * (band + 1) on and as many after.
    stretch = (word - place) // (index.band[notice] + 1)
    row = rows[word]
    row, notice, stretch, place = _distinct(np.tile(row, 2), np.tile(notice, 2), np.concatenate([stretch, stretch - 1]), np.tile(place, 2))
    begin = _first_of_each(row, notice, stretch)
    count = np.diff(np.append(begin, len(row)))
    kept = np.repeat(count >= index.piece[notice[begin]], count)
    row, notice, stretch, place = row[kept], notice[kept], stretch[kept], place[kept]
    size = np.array([len(w) for w in index.words])[notice]
    diagonal = stretch * (index.band[notice] + 1)
    apart = np.zeros(len(row), dtype=bool)
    apart[_first_of_each(row, notice)] = True
    apart[1:] |= np.diff(diagonal) > (size + 3 * index.band[notice] + 3)[1:]
    region = np.cumsum(apart)
    # Long regions are cut; a cut holds what begins in it, and no match reaches over three notices' lengths of text.
    offset = diagonal - diagonal[apart][region - 1]
    cut = offset // ALIGN_WORDS
    twice = np.flatnonzero((cut > 0) & (offset % ALIGN_WORDS < 3 * size))
    row, notice, region, cut, stretch, place = (np.concatenate([c, c[twice] - d]) for c, d in ((row, 0), (notice, 0), (region, 0), (cut, 1), (stretch, 0), (place, 0)))
    row, notice, region, cut, place, stretch = _distinct(row, notice, region, cut, place, stretch)
    new = np.zeros(len(row), dtype=bool)
    new[_first_of_each(region, cut)] = True
    region = np.cumsum(new) - 1
    different = np.bincount(region[_first_of_each(region, place)], minlength=int(new.sum()))
    kept = (different >= index.need[notice[new]])[region]
    row, notice, region, stretch = _distinct(row[kept], notice[kept], region[kept], stretch[kept])
    band = index.band[notice]
    wide = 4 * band + 3
    diagonal = np.repeat(stretch * (band + 1) - band, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return _distinct(np.repeat(row, wide), np.repeat(notice, wide), np.repeat(region, wide), diagonal)


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """Places where a new run of equal rows begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def matches(words: np.ndarray, rows: np.ndarray, index: Index) -> list[np.ndarray]:
    """(row, notice, matched words, first word, end word) of all reported matches, by row and place."""
    row, notice, region, diagonal = _candidates(words, rows, index)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 5]
    for i in np.unique(notice):
        own, text = notice == i, index.words[i]
        places = diagonal[own]
        begin = _first_of_each(region[own])
        end = np.append(begin[1:], len(places))
        of_row = row[own][begin]
        lo, hi = np.searchsorted(rows, of_row, side="left"), np.searchsorted(rows, of_row, side="right")
        # Whole regions, about ALIGN_WORDS at a time.
        part = np.cumsum(places[end - 1] - places[begin] + 3 * len(text)) // ALIGN_WORDS
        for a in _first_of_each(part):
            b = np.searchsorted(part, part[a], side="right")
            nth, matched, first, last = align(words, text, lo, hi, np.repeat(np.arange(a, b), end[a:b] - begin[a:b]), places[begin[a] : end[b - 1]])
            found.append((of_row[nth], np.full(len(nth), i), matched, first, last))
    row, notice, matched, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    # Of those that overlap the one with more matched words stays; equals by coverage, place and name.
    taken, kept = np.zeros(len(words), dtype=bool), []
    coverage = matched / np.array([len(w) for w in index.words])[notice]
    for x in np.lexsort((notice, first, -coverage, -matched)):
        if not taken[first[x] : last[x]].any():
            taken[first[x] : last[x]] = True
            kept.append(x)
    kept = np.array(kept, dtype=np.int64)
    kept = kept[np.argsort(first[kept], kind="stable")]
    return [c[kept] for c in (row, notice, matched, first, last)]


_MATCH = pa.struct([("license", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(index: Index):
    def run(batches):
        for batch in batches:
            for lo, hi in tk.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                data, offsets = tk.text_bytes(part.column(1))
                low = tk.lower(data)
                starts, ends, rows = tk.word_bounds(low, offsets, tk.ALNUM)
                out: list[list[dict]] = [[] for _ in range(hi - lo)]
                found = matches(tk.span_hashes(low, starts, ends), rows, index)
                if len(found[0]):
                    # Code points before each byte.
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for r, notice, matched, first, last in zip(*(c.tolist() for c in found), strict=True):
                        base = points[offsets[r]]
                        out[r].append({"license": index.names[notice], "matched": matched, "coverage": matched / len(index.words[notice]), "start": int(points[starts[first]] - base), "end": int(points[ends[last - 1]] - base)})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(_MATCH))], names=["doc_id", "matches"])

    return run


def scan_licenses(documents: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id and matches array<struct<license, matched, coverage, start, end>> of every row of `documents`."""
    return documents.select("doc_id", "text").mapInArrow(tidy(_scan(build_index(notices or all_notices()))), "doc_id long, matches array<struct<license string, matched int, coverage double, start int, end int>>")


def license_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses, best coverage and spans as text."""
    found = scan_licenses(documents)
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"), spans.alias("spans"))
