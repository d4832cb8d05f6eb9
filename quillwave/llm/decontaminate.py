"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is `WINDOW` consecutive words of an item (an item of fewer words is one window).  Equal windows are one, with
a list of its items.  A document contains a window only if it contains every word shingle of it, so of each window's
shingles, ordered by their frequency in all documents, the rarest one alone is the necessary prefix.  Documents are
joined on these prefix shingles; the place of the shingle in its window and the document's length bound where the
window can lie; what is left is verified word by word over the whole window.

Two scans of the texts, whatever the benchmark's size, and no shuffle of texts: the first counts the items' shingles
over all documents, the second finds the places of prefix shingles, which Spark joins with the windows.  A shingle of a
window no longer than itself needs no words around it: such places go out as one list for each document and shingle.  Of
others the words around go along, as far as the windows reach.  Both scans know the shingles by two bits each of a bitmap
of 16 to 32 bits a shingle (about one word in 100 or fewer passes without need and is dropped by the join), which is
broadcast and holds 2 ** `BITMAP_BITS` bits (64 MB) at most; beyond 32 million shingles more words pass.  A prefix that
has more than a `SHARES`th of all places is dealt to as many keys of the join as it has such shares.  Hits, ranges of
words and lists of items are joined and aggregated by Spark too.

Null texts have no words; such documents and empty ones are returned with zero counts.  Items without words
contribute nothing; an item with a null id counts under the empty string, and items that share an id are one item.
Repeated documents give a row each.  Extra columns are ignored.  `spans` gives the hit stretches as word ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.bitmaps import Bitmap
from quillwave.llm.common import TEXT_KEY, stash, text_key, tidy, without

WINDOW = 13
SHINGLE = 4
#: A document is contaminated if 20 times its hit words are at least its words.
SHARE = 20
SHARES = 1024
#: Rows that go out of a task at a time.
ROWS = 4096


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the index of each text's first word (n+1)."""
    data, offsets = tk.text_bytes(column)
    low = tk.lower(data)
    starts, ends, rows = tk.word_bounds(low, offsets, tk.ALNUM)
    return tk.span_hashes(low, starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _runs(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of words[first : first + size]."""
    ends = np.cumsum(size)
    at = np.repeat(first, size) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), _longs(words[at]))


def _item_windows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            words, _ = text_words(batch.column(1).slice(i, 1))
            size = min(WINDOW, len(words))
            for lo in range(0, len(words) - size + 1 if size else 0, ROWS):
                first = np.arange(lo, min(lo + ROWS, len(words) - size + 1))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(first)), _runs(words, first, np.full(len(first), size))], names=["item", "words"])


def _shingles(batches):
    for batch in batches:
        lists = batch.column(1)
        cut = np.asarray(lists.offsets)
        words, cut = np.asarray(lists.values).view(np.uint64)[cut[0] : cut[-1]], cut - cut[0]
        rows = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        for size in range(1, SHINGLE + 1):
            hashes, first = tk.shingle_hashes(words, rows, size)
            own = np.minimum(np.diff(cut), SHINGLE)[rows[first]] == size
            row, place = rows[first][own], (first - cut[rows[first]])[own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), size, np.int32)), pa.array(place.astype(np.int32)), _longs(hashes[own])], names=["wid", "size", "place", "hash"])


def _tally(shared, sizes: list[int]):
    def run(batches):
        bitmap = shared.value
        for batch in batches:
            for lo, hi in tk.slices(batch.column(0)):
                words, cut = text_words(batch.column(0).slice(lo, hi - lo))
                rows = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                for size in sizes:
                    hashes, _ = tk.shingle_hashes(words, rows, size)
                    known, count = np.unique(hashes[bitmap.maybe(hashes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([_longs(known), pa.array(count)], names=["hash", "n"])

    return run


_FOUND = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("places", pa.list_(pa.int64())), ("left", pa.int64()), ("around", pa.list_(pa.int64()))])


def _search(shared, sizes: list[int], before: int, after: int):
    """A row for each document, and for its prefix shingles rows of hash and places (first words).

    Where windows reach beyond their shingle, by `before` words before and `after` from its first word on, a place has a
    row of its own with the words around it from word `left` on.
    """

    def run(batches):
        bitmap, rid = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in tk.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words, cut = text_words(part.column(1))
                rows, ids = np.repeat(np.arange(hi - lo), np.diff(cut)), np.arange(rid, rid + hi - lo)
                rid += hi - lo
                yield _batch({"rid": pa.array(ids), "doc_id": part.column(0), TEXT_KEY: part.column(2), "n_words": pa.array(np.diff(cut))})
                for size in sizes:
                    hashes, first = tk.shingle_hashes(words, rows, size)
                    found = bitmap.maybe(hashes)
                    if size < SHINGLE or before + after <= SHINGLE:
                        word, own = first[found], hashes[found]
                        order = np.lexsort((word, own, rows[word]))
                        word, own = word[order], own[order]
                        new = np.ones(len(word), dtype=bool)
                        new[1:] = (own[1:] != own[:-1]) | (rows[word[1:]] != rows[word[:-1]])
                        head = np.flatnonzero(new)
                        places = pa.ListArray.from_arrays(pa.array(np.append(head, len(word)), pa.int32()), pa.array(word - cut[rows[word]]))
                        yield _batch({"rid": pa.array(ids[rows[word[head]]]), "hash": _longs(own[head]), "places": places})
                        continue
                    for some in np.split(found, range(ROWS, len(found), ROWS)):
                        word = first[some]
                        begin = cut[rows[word]]
                        left = np.maximum(word - before, begin)
                        right = np.minimum(word + after, cut[rows[word] + 1])
                        places = pa.ListArray.from_arrays(pa.array(np.arange(len(word) + 1), pa.int32()), pa.array(word - begin))
                        yield _batch({"rid": pa.array(ids[rows[word]]), "hash": _longs(hashes[some]), "places": places, "left": pa.array(left - begin), "around": _runs(words, left, right - left)})

    return run


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(columns["rid"])
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _FOUND], schema=_FOUND)


def _item_tables(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The items' windows (item, wid, words), equal ones under one wid, and their shingles (wid, size, place, hash); both written."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    raw = items.mapInArrow(tidy(_item_windows), "item string, words array<long>").distinct()
    windows = stash(raw.select("item", F.md5(F.array_join(F.col("words").cast("array<string>"), ",").cast("binary")).alias("wid"), "words"), "item-windows")
    return windows, stash(_once(windows).mapInArrow(tidy(_shingles), "wid string, size int, place int, hash long"), "window-shingles")


def _once(windows: DataFrame) -> DataFrame:
    return windows.groupBy("wid").agg(F.first("words").alias("words"))


def _prefixes(documents: DataFrame, windows: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(hash, n, place, wid, words): of each window whose shingles all occur, the rarest one and its places in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(Bitmap(shingles, shingles.count()))
    counts = documents.select("text").mapInArrow(tidy(_tally(shared, sizes)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = shingles.join(counts, "hash", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("rarest"))
    return stash(counted.where("rarest.n > 0").join(_once(windows), "wid").select("rarest.hash", "rarest.n", "rarest.place", "wid", "words"), "prefixes")


def _met(found: DataFrame, prefixes: DataFrame, total: int) -> DataFrame:
    """Rows of places with the windows of their shingle; frequent shingles are dealt to several keys."""
    own = F.greatest(F.lit(1), F.ceil(F.col("n") * SHARES / F.lit(max(1, total)))).cast("int")
    dealt = prefixes.select("hash", "place", "wid", "words", F.explode(F.sequence(F.lit(0), own - 1)).alias("part"))
    # Fewer than SHARES of them: each has more than that share of all places.
    often = prefixes.groupBy("hash").agg(F.max(own).alias("parts")).where("parts > 1")
    places = found.where("hash IS NOT NULL").select("rid", "hash", "places", "left", "around").join(F.broadcast(often), "hash", "left")
    return places.withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts").cast("long")).cast("int"), F.lit(0))).join(dealt, ["hash", "part"])


def _judged(documents: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    windows, shingles = _item_tables(benchmark, id_col, text_col)
    sizes = sorted(r.size for r in shingles.select("size").distinct().collect())
    prefixes = _prefixes(documents, windows, shingles, sizes)
    size, long = F.size("words"), F.size("words") > SHINGLE
    known = prefixes.groupBy("hash").agg(F.max("n").alias("n"), F.max(F.when(long, F.col("place"))).alias("before"), F.max(F.when(long, size - F.col("place"))).alias("after"))
    n, total, before, after = known.agg(F.count("*"), F.sum("n"), F.max("before"), F.max("after")).first()
    shared = documents.sparkSession.sparkContext.broadcast(Bitmap(prefixes, n))
    texts = documents.select("doc_id", "text", text_key(F.col("text")).alias(TEXT_KEY))
    schema = f"rid long, doc_id long, {TEXT_KEY} long, n_words long, hash long, places array<long>, left long, around array<long>"
    found = stash(texts.mapInArrow(tidy(_search(shared, sizes, before or 0, max(SHINGLE, after or 0))), schema), "found")
    # Where the window begins in the words around; before them it begins before the document.
    into = (F.col("places")[0] - F.col("left") - F.col("place")).cast("int")
    whole = F.when(F.col("around").isNull(), size <= SHINGLE).otherwise((into >= 0) & (F.slice("around", F.greatest(into, F.lit(0)) + 1, size) == F.col("words")))
    met = _met(found, prefixes, total or 0).where(whole)
    hits = stash(met.select("rid", "wid", F.explode("places").alias("at"), "place", size.alias("size")).select("rid", "wid", (F.col("at") - F.col("place")).alias("lo"), (F.col("at") - F.col("place") + F.col("size")).alias("hi")), "hits")
    ranges = _merged(hits.select("rid", "lo", "hi").distinct()).groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    named = hits.select("rid", "wid").distinct().join(windows.select("wid", "item"), "wid").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = found.where("hash IS NULL").select("rid", "doc_id", TEXT_KEY, "n_words").join(ranges, "rid", "left").join(named, "rid", "left")
    none = F.lit(0).cast("long")
    spans = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["lo"].cast("string"), r["hi"].cast("string"))), ",")
    n_hit: Column = F.coalesce("n_hit", none)
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items").cast("long"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce(spans, F.lit("")).alias("spans"), TEXT_KEY,
    )


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges (lo, hi) of each rid with overlapping and touching ones joined."""
    by_place = Window.partitionBy("rid").orderBy("lo", "hi")
    before = F.max("hi").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("fresh", F.when(F.col("lo") <= before, 0).otherwise(1))
    return fresh.withColumn("run", F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans of every row of `documents`."""
    return _judged(documents, benchmark).drop(TEXT_KEY)


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, that aren't contaminated."""
    return without(documents, stash(_judged(documents, benchmark).where("contaminated").select("doc_id", TEXT_KEY), "contaminated"))


ORACLE = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM sized)
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM low, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
), spans AS (
  SELECT doc_id, string_agg((lo - 1)::VARCHAR || ':' || (hi - 1)::VARCHAR, ',' ORDER BY lo) AS spans FROM (
    SELECT doc_id, run, min(i) AS lo, max(i + n) AS hi FROM (
      SELECT doc_id, i, n, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i, n) AS run FROM (
        SELECT doc_id, i, n, CASE WHEN i <= max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM (SELECT DISTINCT doc_id, i, n FROM hits)))
    GROUP BY doc_id, run) GROUP BY doc_id
)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
