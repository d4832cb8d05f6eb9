"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are laid end to end in a shuffled order (by a hash of the id); that stream of words,
repeated, is cut into blocks of `BLOCK_WORDS` words.  The mix is a list of slots, as many as blocks make up all words.
Slot i takes the point frac(i * golden ratio); the cumulative target weights map it to a source; the slot's rank among
the slots of its source names the block that it takes.  So the schedule alone decides how many blocks a source gives
and in which order; the points are spread so evenly that this stays within a few blocks of the target whatever the
size.  Ranks are joined to blocks, and a document is taken as far as the blocks of its occurrences reach.  A stream
ends after `REPEATS` rounds of its source; slots past its end stay empty.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words.  A target stops at
`REPEATS` times its source's size and what is left is shared by weight among the others, until none is above.

Scale: the texts are read once, for word counts.  Ranks and positions are two-step prefix sums (within buckets of
about the root of the rows, then over buckets), so one hot source is spread over many tasks.  Sums over the table of
sources, a row a source, run in one task: that table is the list of names that the mix is defined by.

Null texts, empty texts and texts of white space have no words and nothing is taken of them.  Sources of no words
have target 0.  Repeated rows are rows of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm.common import BROADCAST_IDS, TEXT_KEY, stash

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 128
#: The golden ratio's fractional part in units of 2^-32, so that points are exact integers.
GOLDEN = 2654435769
UNIT = 1 << 32
#: Cells of [0, UNIT) by which points meet the sources' weight intervals.
CELLS = 1024
#: Up to so many sources the table of sources is broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _row_key() -> Column:
    """A hash of what is taken alike besides the id: source and text."""
    return F.xxhash64(F.col("source").isNull(), "source", "text")


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes`: (source, source_size), a row a source.  Adds sid (its place by code point), weight and target double."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    weighed = weighed.withColumn("weight", F.element_at(F.array([F.lit(w) for w in WEIGHTS]), F.pmod("sid", F.lit(len(WEIGHTS))) + 1).cast("long"))
    # By size a weight, the sources that stop at their cap come first; `rest` and `open_weight` are what is left when all before have stopped.
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    filled = (
        weighed.withColumn("nth", F.row_number().over(order))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * REPEATS).over(before), none))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none))
    )
    is_open = F.col("rest") * F.col("weight") <= F.col("source_size") * REPEATS * F.col("open_weight")
    first = F.min(F.when(is_open, F.struct("nth", "rest", "open_weight"))).over(everything)
    target = F.when(F.col("nth") < F.col("first.nth"), (F.col("source_size") * REPEATS).cast("double")).otherwise(F.col("first.rest").cast("double") / F.col("first.open_weight").cast("double") * F.col("weight"))
    return filled.withColumn("first", first).select("source", "source_size", "sid", "weight", target.alias("target"))


def _prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Exclusive prefix sum of `value` over (bucket, order) within `group`, in two steps."""
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    buckets = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select(*[F.col(c).alias(f"_{c}") for c in [*group, bucket]], F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, bucket]]
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(base, match).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in", *[f"_{c}" for c in [*group, bucket]])


def points(i: Column) -> Column:
    """The point of slot i, in units of 1 / UNIT."""
    return F.pmod(F.pmod(i, F.lit(2**31)) * F.lit(GOLDEN), F.lit(UNIT))


def schedule(shares: DataFrame, n_slots: int, small: bool) -> DataFrame:
    """(sid, rank, slot): which source each slot of the mix draws from, and its rank among that source's slots."""
    by_place = Window.orderBy("sid")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Intervals of [0, UNIT); the last one takes what rounding leaves.
    share = F.sum("target").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(everything)
    cut = shares.where("target > 0").select("sid", F.when(F.col("sid") == F.max("sid").over(everything), F.lit(UNIT)).otherwise(F.floor(share * UNIT)).alias("hi"))
    cut = cut.withColumn("lo", F.coalesce(F.lag("hi").over(by_place), F.lit(0))).where("lo < hi")
    width = UNIT // CELLS
    cells = cut.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    drawn = cut.sparkSession.range(n_slots).withColumn("point", points(F.col("id"))).withColumn("cell", F.floor(F.col("point") / width))
    drawn = drawn.join(F.broadcast(cells) if small else cells, (drawn.cell == cells.cell) & (drawn.point >= cells.lo) & (drawn.point < cells.hi)).select("sid", F.col("id").alias("slot"))
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / max(1, math.isqrt(n_slots))))
    return _prefix(drawn, ["sid"], "chunk", [F.col("slot")], F.lit(1), "rank").select("sid", "rank", "slot")


def _occurrences(documents: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their source's numbers; each row of words at its `place`; and the occurrences that the mix takes.

    An occurrence has its source and place, which round it is of, the words taken, its blocks and its first slot.
    """
    sized = stash(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row_key().alias(TEXT_KEY)), "sizes")
    shares = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n_rows, n_words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    small = shares.count() <= BROADCAST_SOURCES
    s = shares.withColumnRenamed("source", "of")
    named = sized.join(F.broadcast(s) if small else s, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    n_buckets = 2 * math.isqrt(n_rows) + 1
    bucketed = named.where("size > 0").withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * n_buckets / (1 << 28)).cast("int"))
    # Every document at its place in its source's stream of words.
    placed = _prefix(bucketed, ["sid"], "bucket", [F.col("key"), F.col("size"), F.col(TEXT_KEY)], F.col("size"), "place").drop("key", "bucket")
    rounds = placed.select("sid", "place", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("round"))
    begin = rounds.withColumn("start", F.col("round") * F.col("source_size") + F.col("place")).withColumn("end", F.col("start") + F.col("size"))
    pieces = begin.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
    drawn = pieces.join(schedule(shares, -(-n_words // block_words), small), ["sid", "rank"])
    words = F.least(F.col("end"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("start"), F.col("rank") * block_words)
    taken = drawn.groupBy("sid", "place", "round").agg(F.sum(words).alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"))
    return named, placed, taken


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_slots and first_slot of every row of `documents`.

    `n_slots` counts the pieces of the mix that the document lies in, `first_slot` is where it first comes.
    """
    named, placed, taken = _occurrences(documents, block_words)
    of_row = taken.groupBy("sid", "place").agg(F.sum("taken").alias("taken"), F.sum("n_slots").alias("n_slots"), F.min("first_slot").alias("first_slot"))
    none = F.lit(0).cast("long")
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("n_slots", none).alias("n_slots"), "first_slot"]
    nothing = named.where("size = 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("taken", "n_slots", "first_slot")])
    return placed.join(of_row, ["sid", "place"], "left").select(columns).unionByName(nothing.select(columns))


def mixed_documents(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as whole documents, all columns, in the schedule's order: each occurrence of which half or more is taken.

    Only a source's last occurrence can be cut, so at most one document a source differs from the words taken.  Rows
    that share id, source and text are taken alike, as often as the one of them that is taken most.  Tasks hold
    stretches of the mix in order, and so do the files written of them.
    """
    _, placed, taken = _occurrences(documents, block_words)
    whole = taken.join(placed.select("sid", "place", "doc_id", "size", TEXT_KEY), ["sid", "place"]).where("2 * taken >= size")
    slots = whole.groupBy("doc_id", TEXT_KEY, "round").agg(F.min("first_slot").alias("slot"))
    slots = stash(slots.select(F.col("doc_id").alias("id"), F.col(TEXT_KEY).alias("key"), "slot"), "slots")  # rows of three numbers
    # Only these names are free of the documents' own, whatever their columns are called.
    rows = documents.select(F.struct("*").alias("row"), "doc_id", _row_key().alias("key_of"))
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key_of") == F.col("key"))
    met = rows.join(F.broadcast(slots) if slots.count() <= BROADCAST_IDS else slots, match).select("row", "slot")
    return met.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), filled AS (
  SELECT *, row_number() OVER o AS nth,
    CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open_weight
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), opened AS (
  SELECT nth, rest, open_weight FROM filled WHERE rest * weight <= source_size * 3 * open_weight ORDER BY nth LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN filled.nth < opened.nth THEN CAST(source_size * 3 AS DOUBLE) ELSE CAST(opened.rest AS DOUBLE) / CAST(opened.open_weight AS DOUBLE) * weight END AS target FROM filled, opened
), cuts AS (
  SELECT source, CASE WHEN row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 THEN 4294967296
    ELSE CAST(floor(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * 4294967296) AS BIGINT) END AS hi
  FROM targets WHERE target > 0
), intervals AS (
  SELECT source, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, hi FROM cuts
), slots AS (
  SELECT CAST(i AS BIGINT) AS slot, i % 2147483648 * 2654435769 % 4294967296 AS point FROM (SELECT unnest(range((SELECT CAST(ceil(sum(size) / 128.0) AS BIGINT) FROM sized))) AS i)
), schedule AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN intervals ON point >= lo AND point < hi
), placed AS (
  SELECT row_number() OVER () AS r, doc_id, sized.source, size, source_size, target,
    CAST(coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), pieces AS (
  SELECT r, source, b, greatest(b * 128, start) AS lo, least(b * 128 + 128, start + size) AS hi FROM (
    SELECT r, source, size, start, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS b FROM (
      SELECT r, source, size, k * source_size + place AS start FROM placed, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0))
), drawn AS (
  SELECT r, CAST(sum(hi - lo) AS BIGINT) AS taken, count(*) AS n_slots, min(slot) AS first_slot
  FROM pieces JOIN schedule ON rank = b AND pieces.source IS NOT DISTINCT FROM schedule.source GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_slots, 0) AS n_slots, first_slot FROM placed LEFT JOIN drawn USING (r)
"""
