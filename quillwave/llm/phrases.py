"""Collocations: phrases of two and three words that occur more often than their parts would let one expect.

1. Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and each piece is written with single
   spaces.  Identical pieces of a language become one with a multiplicity, by a Spark aggregate.
2. Each distinct piece gives its n-grams (a slice of its bytes each) with its multiplicity as weight.  A task folds what
   it sees of a chunk of pieces (by a 64-bit hash and the length) and deals the rest to buckets by hash, a compressed
   block a bucket.
3. A bucket's blocks are counted in duckdb, which spills to the task's scratch folder beyond `MEMORY`; that folder is
   private to the task and removed at its end.  Only grams of `LEAST` or more go out: the parts of a phrase occur as
   often as the phrase, so nothing else is ever asked for.
4. For each cut of each candidate a request goes to where its first part and its rest are counted, by a shuffled join;
   the answers meet at the candidate, and its lowest-scoring cut counts.  A two-word phrase inside a three-word candidate
   that has at least half its occurrences is dropped.
5. Ranks: the first `TOP` of each part of a language, then of the language.

Scores are whole numbers, worked out in decimals of 38 digits; counts may go up to 10**16 for that.  Null and empty texts
have no words; a null language is `und`.  Repeated rows count as often as they are there.  Extra columns are ignored.
"""

from __future__ import annotations

import shutil
import string
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.common import stash, tidy

WORDS, LEAST, TOP = 3, 10, 2000
COVERED = (50, 100)
SCALE = 1_000_000
#: Bytes of pieces that a task folds at a time, and duckdb's memory.
CHUNK_BYTES, MEMORY = 8 << 20, "256MB"
LANGUAGES = 1 << 16
_WORD = ~tk.byte_class([0x20])
_BLOCK = pa.schema([("lang", pa.uint16()), ("gram", pa.string()), ("weight", pa.int64())])
#: A block as it is sent: sizes instead of offsets, which compress badly, and the letters beside them.
_SENT = pa.schema([("lang", pa.uint16()), ("size", pa.uint32()), ("weight", pa.int64())])
#: Grams whose letters are copied at a time.
SPANS = 1 << 15
#: Parts in which a language is ranked first.
RANK_PARTS = 64


def pieces(documents: DataFrame) -> DataFrame:
    """(lang, piece, weight): distinct pieces of each language, words between single spaces."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    split = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    clean = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return split.select("lang", clean.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("weight"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array]]:
    """Rows of about `CHUNK_BYTES` and their languages, of which a chunk has no more than a block can number."""

    def chunk() -> Iterator[tuple[pa.Table, pa.Array]]:
        table = pa.Table.from_batches(held)
        languages = table.column("lang").unique()
        for lo in range(0, len(languages), LANGUAGES):
            some = languages.slice(lo, LANGUAGES)
            yield (table if len(languages) <= LANGUAGES else table.filter(pc.is_in(table.column("lang"), some))), some

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from chunk()
            held, size = [], 0
    if held:
        yield from chunk()


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.ChunkedArray:
    """data[start:end] as strings, copied in chunks."""
    out = []
    for lo in range(0, len(starts), SPANS):
        first, sizes = starts[lo : lo + SPANS], ends[lo : lo + SPANS] - starts[lo : lo + SPANS]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        copied = data[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]
        out.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(copied)))
    return pa.chunked_array(out, pa.string())


def folded(table: pa.Table, languages: pa.Array) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """For each length of grams: their hashes, and their (place of lang, gram, weight), each once but for clashing hashes."""
    names, offsets = tk.text_bytes(languages)
    lang_hash = tk.span_hashes(names, offsets[:-1], offsets[1:])
    code, weight = pc.index_in(table.column("lang"), languages).to_numpy(), table.column("weight").to_numpy()
    data, offsets = tk.text_bytes(table.column("piece"))
    starts, ends, rows = tk.word_bounds(data, offsets, _WORD)
    words = tk.span_hashes(data, starts, ends)
    for n in range(1, WORDS + 1):
        first = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
        if not len(first):
            continue
        own = rows[first]
        hashes = tk.mix(tk.gram_hashes(words, n)[first] ^ lang_hash[code[own]])
        order = np.argsort(hashes, kind="stable")
        hashes, first, own = hashes[order], first[order], own[order]
        sizes = ends[first + n - 1] - starts[first]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (sizes[1:] != sizes[:-1])])
        cut = np.flatnonzero(new)
        total = np.add.reduceat(weight[own], cut)
        at, n_lang = first[cut], code[own[cut]]
        yield hashes[cut], pa.table([pa.array(n_lang.astype(np.uint16)), spans(data, starts[at], ends[at + n - 1]), pa.array(total)], schema=_BLOCK)


def packed(grams: pa.Table) -> tuple[bytes, bytes]:
    """The numbers and the letters of a block."""
    sink, letters = pa.BufferOutputStream(), pa.concat_arrays(grams.column("gram").chunks)
    offsets = np.frombuffer(letters.buffers()[1], np.int32)[letters.offset : letters.offset + len(letters) + 1]
    numbers = pa.table([grams.column("lang"), pa.array(np.diff(offsets).astype(np.uint32)), grams.column("weight")], schema=_SENT)
    with pa.ipc.new_stream(sink, _SENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(numbers.combine_chunks())
    return sink.getvalue().to_pybytes(), pa.Codec("zstd").compress(letters.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])), asbytes=True)


def unpacked(numbers: pa.Buffer, letters: pa.Buffer, languages: pa.Array) -> pa.Table:
    """(lang, gram, weight) of a block."""
    held = pa.ipc.open_stream(numbers).read_all()
    offsets = np.concatenate([[0], np.cumsum(held.column("size").to_numpy())]).astype(np.int32)
    data = pa.Codec("zstd").decompress(letters, decompressed_size=int(offsets[-1]))
    grams = pa.StringArray.from_buffers(held.num_rows, pa.py_buffer(offsets), data)
    return pa.table([languages.take(held.column("lang")), grams, held.column("weight")], names=_BLOCK.names)


def _dealt(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, languages in _chunks(batches):
            for hashes, grams in folded(table, languages):
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                grams, bounds = grams.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(bounds)):
                    numbers, letters = packed(grams.slice(bounds[b], bounds[b + 1] - bounds[b]))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([languages.to_pylist()], pa.list_(pa.string())), pa.array([numbers], pa.binary()), pa.array([letters], pa.binary())], names=["bucket", "languages", "numbers", "letters"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one task's buckets: (lang, gram, f) of frequent grams, and as gram '' the words of each language."""
    import duckdb

    scratch = tempfile.mkdtemp(prefix="phrases-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
    try:
        con.execute("CREATE TABLE grams (lang VARCHAR, gram VARCHAR, weight BIGINT)")
        for batch in batches:
            for languages, numbers, letters in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                con.register("held", unpacked(numbers.as_buffer(), letters.as_buffer(), languages.values))
                con.execute("INSERT INTO grams SELECT * FROM held")
                con.unregister("held")
        counts = f"SELECT lang, gram, CAST(sum(weight) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING sum(weight) >= {LEAST}"
        totals = "SELECT lang, '' AS gram, CAST(sum(weight) AS BIGINT) AS f FROM grams WHERE NOT contains(gram, ' ') GROUP BY lang"
        for query in (counts, totals):
            for found in con.sql(query).to_arrow_reader(65536):
                yield found.cast(pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())]))
    finally:
        con.close()
        shutil.rmtree(scratch, ignore_errors=True)


def gram_counts(documents: DataFrame) -> DataFrame:
    """(lang, gram, f) of all n-grams of up to `WORDS` words that occur `LEAST` times; gram '' has parts of the words in all."""
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pieces(documents).mapInArrow(tidy(_dealt(buckets)), "bucket int, languages array<string>, numbers binary, letters binary")
    return stash(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(_counted), "lang string, gram string, f long"), "gram-counts")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly."""
    a, left, right = (x.cast("decimal(16,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), left * right)


def collocations(documents: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `TOP` phrases."""
    counts = gram_counts(documents)
    totals = counts.where("gram = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = counts.where("gram <> ''").withColumn("n_words", F.size(F.split("gram", " ")))
    candidates = grams.where("n_words > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "n_words")

    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    words = F.split("phrase", " ")
    part = lambda first, start, length: F.struct(F.lit(first).alias("first"), F.array_join(F.slice(words, start, length), " ").alias("gram"))
    sides = F.array(part(True, F.lit(1), F.col("k")), part(False, F.col("k") + 1, F.size(words) - F.col("k")))
    requests = cuts.select("lang", "phrase", "a", "k", F.inline(sides))
    answers = requests.join(grams.select("lang", "gram", "f"), ["lang", "gram"])
    by_cut = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    best = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("b")
    scored = by_cut.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.score", "b.l", "b.r")

    inside = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda i: F.array_join(F.slice(words, i, 2), " ")))
    longer = candidates.where("n_words > 2").select("lang", F.col("a").alias("longer"), F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.col("longer") * COVERED[1] >= F.col("a") * COVERED[0]
    left = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= TOP)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT *, row_number() OVER () AS id FROM pieces)),
lined AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, gram, k, count(*) AS f FROM (
  SELECT lang, w AS gram, 1 AS k FROM lined UNION ALL SELECT lang, w || ' ' || w2, 2 FROM lined WHERE w2 IS NOT NULL UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3 FROM lined WHERE w3 IS NOT NULL) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, gram AS phrase, k, f AS a FROM grams WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, i, array_to_string(string_split(phrase, ' ')[1:i], ' ') AS head, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') AS rest FROM candidates c, range(1, 3) r(i) WHERE i < k),
scored AS (SELECT c.lang, c.phrase, c.a, c.i, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.gram = c.head JOIN grams y ON y.lang = c.lang AND y.gram = c.rest),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM scored) WHERE nth = 1),
longer AS (SELECT lang, sub, max(a) AS longer FROM (SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS sub FROM candidates, range(1, 3) r(i) WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.sub = b.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
