"""Query by template distances: blocks of sequences meet in a grid, the kernel runs on whole blocks.

`queries`: (query_id, features); `templates`: (template_id, command_id, created_at, features), features being
array<array<float>>.  A hash of its id gives each query a row and each template a column of a square grid.  Where they
lie, rows are packed into blocks of some hundred sequences of one width; a block of queries is sent to every cell of
its row, one of templates to every cell of its column.  So each pair meets once, pairs of other widths never do, one
common width is spread over the whole grid, and a block is copied as often as the grid is wide (the root of the number
of tasks), not as often as the other side has blocks.

Where only the best template of each command is asked for, most pairs need no exact warping.  A bound from below by the
recurrence in float32 over matrix products costs a small part of the exact one and is close to it; the pair of each (query,
command) with the least bound is compared first, and then only those whose bound does not pass the best distance so far, each
abandoned at the row where it does.  The best so far is kept from one pair of blocks to the next; where there is one of all, a
looser bound at less than half the cost leaves few pairs, and the closer one is not made.  What is left out is
farther away than what goes out, so the rows after `best_per_command` are the same.  Recognition needs the first two
commands of a query only, so there the second best distance bounds all the others; rates need the first one.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.functions.dtw import SLACK, Metric, band_cells, block_distances, euclidean, listed_distances, lower_bounds, near_bounds, rounded_distances, row_bounds

#: Sequences of a block at most, and where only the best of a pair of blocks goes out, so that more pairs share what a pair of blocks costs.
BLOCK, BEST_BLOCK = 512, 1024
#: Frames in a block at most, but for a single longer sequence.
BLOCK_FRAMES = 1 << 16
CELLS_A_CORE = 4
#: Cells of the recurrence a row from which boxes around frames bound a pair instead, and blocks of queries whose best distances are kept.
BOXES_FROM, KEPT = 64, 4
#: Values of a frame of all pairs from which it pays to look at pairs one by one, and the share of them that is tried first.
PRUNE_SIZE, TRIED = 1 << 14, 8
#: The looser bound decides where it leaves no more than this part of the pairs; more are cheaper by the closer one.
FEW = 32


class PairCounts(NamedTuple):
    """How many pairs met, and how many of them were warped to their end."""

    met: Accumulator
    warped: Accumulator

    @staticmethod
    def of(spark: SparkSession) -> PairCounts:
        return PairCounts(spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))


def _blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[dict[str, pa.Array | int | str | bytes]]:
    """Blocks of one width, part and place in the grid, ordered by length; the last column is the features."""
    names = batch.schema.names[3:-1]
    frames = batch.column(batch.num_columns - 1)
    lengths = frames.value_lengths().to_numpy(zero_copy_only=False)
    width, place, part = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).dictionary_encode()
    code = part.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((lengths, place, code, width))
    flat = frames.take(pa.array(order)).flatten().flatten().to_numpy(zero_copy_only=False).astype("<f4")
    width, place, code, lengths = width[order], place[order], code[order], lengths[order]
    at = np.concatenate([[0], np.cumsum(lengths * width)])
    new = np.flatnonzero((width[1:] != width[:-1]) | (place[1:] != place[:-1]) | (code[1:] != code[:-1])) + 1
    for lo, hi in zip([0, *new], [*new, len(order)], strict=True):
        while lo < hi:
            total = np.cumsum(lengths[lo : min(hi, lo + most)])
            upto = lo + max(1, int(np.searchsorted(total, BLOCK_FRAMES, side="right")))
            rows = pa.array(order[lo:upto])
            yield {"width": int(width[lo]), "place": int(place[lo]), "part": part.dictionary[int(code[lo])].as_py() if code[lo] >= 0 else None, "lengths": lengths[lo:upto].tolist(), "data": flat[at[lo] : at[upto]].tobytes(), **{n: batch.column(n).take(rows).to_pylist() for n in names}}
            lo = upto


def _packed(df: DataFrame, key: str, columns: list[str], part: str | None, side: int, sides: DataFrame | None, most: int) -> DataFrame:
    """(width, place, part, lengths, data, a list of each of `columns`), a row a block.

    With `sides` (_part, _side), parts have grids of their own size, and rows of a part and place are brought together first.
    """
    within = (F.col(part).cast("string") if part else F.lit("")).alias("part")
    if sides is not None:
        df = df.join(sides, df[part].cast("string") == F.col("_part"))
    place = F.pmod(F.xxhash64(key), F.col("_side") if sides is not None else F.lit(side)).cast("int").alias("place")
    rows = df.where(F.size("features") > 0).select(F.size(F.element_at("features", 1)).alias("width"), place, within, *columns, F.col("features").cast("array<array<float>>"))
    if sides is not None:
        rows = rows.repartition("width", "part", "place")
    lists = ", ".join(f"`{c}` array<{df.schema[c].dataType.simpleString()}>" for c in columns)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for block in _blocks(batch, most):
                    yield pa.RecordBatch.from_pylist([block], schema=schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([("width", pa.int32()), ("place", pa.int32()), ("part", pa.string()), ("lengths", pa.list_(pa.int32())), ("data", pa.binary()), *((c, pa.list_(kinds[df.schema[c].dataType.simpleString()])) for c in columns)])
    return rows.mapInArrow(run, f"width int, place int, part string, lengths array<int>, data binary, {lists}")


def _sides_of(templates: DataFrame, within: str, side: int) -> DataFrame:
    """(_part, _side): a part of up to a block's templates is one cell, a larger one gets a grid as wide as its blocks, `side` at most."""
    own = F.least(F.lit(side), F.ceil(F.count("*") / F.lit(BLOCK)))
    return templates.where(F.size("features") > 0).groupBy(F.col(within).cast("string").alias("_part")).agg(own.alias("_side"))


def _by_length(lengths: np.ndarray, data: bytes, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of one frame count, which lie together, and their (rows, frames, width) features."""
    flat, at = np.frombuffer(data, "<f4"), 0
    cuts = np.flatnonzero(lengths[1:] != lengths[:-1]) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
        n = int(lengths[lo])
        size = (hi - lo) * n * width
        yield slice(lo, hi), flat[at : at + size].reshape(hi - lo, n, width)
        at += size


def pair_distances(queries: DataFrame, templates: DataFrame, band_ratio: float = 0.1, metric: Metric = euclidean, best_only: bool = True, within: str | None = None, counts: PairCounts | None = None, top: int | None = None, prune_size: int = PRUNE_SIZE, apart: bool = False) -> DataFrame:
    """(query_id, command_id, template_id, created_at, distance float) of pairs of equal width.

    With `best_only` each pair of blocks gives its best template of each (query, command), by distance, age and id:
    the partial step of `best_per_command`.  Infinite distances are kept.  With `within`, a column of both sides, only
    pairs that agree on it meet, each part of them on a grid that fits its size.  With `top`, commands that are
    sure not to be among a query's first so many may be left out with `best_only`.  Pairs of blocks are pruned where they
    have more than `prune_size` values a frame; fewer are done faster whole.  With `apart`, sequences don't meet themselves:
    pairs of one id are left out.  `counts` tells after an action how many pairs were pruned.
    """
    met, query_type = _met(queries, templates, within, BEST_BLOCK if best_only else BLOCK), queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        kept: OrderedDict[tuple, dict[str, np.ndarray]] = OrderedDict()
        for batch in batches:
            for row in range(batch.num_rows):
                pair = batch.slice(row, 1)
                yield best_of_blocks(pair, band_ratio, metric, kept, counts, top, prune_size, apart) if best_only else _pair_of_blocks(pair, band_ratio, metric, counts, apart)

    return met.mapInArrow(run, f"query_id {query_type}, command_id string, template_id string, created_at long, distance float")


def rounded_pairs(queries: DataFrame, templates: DataFrame, digits: int, band_ratio: float = 0.1) -> DataFrame:
    """(query_id, template_id, distance double): all pairs of `pair_distances`, Euclidean, rounded to so many decimal digits.

    Rounded where they are made, as Spark's `round` costs more than a pair, and only with the columns asked for.
    """
    met, query_type = _met(queries, templates, None, BLOCK), queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _rounded_pair_of_blocks(batch.slice(row, 1), digits, band_ratio)

    return met.mapInArrow(run, f"query_id {query_type}, template_id string, distance double")


def cell_side(spark: SparkSession) -> int:
    """How wide the grid is, so that each core gets some of its cells."""
    return math.isqrt(CELLS_A_CORE * spark.sparkContext.defaultParallelism - 1) + 1


def _met(queries: DataFrame, templates: DataFrame, within: str | None, most: int) -> DataFrame:
    """A row for each two blocks that meet, of at most `most` sequences each."""
    side = cell_side(queries.sparkSession)
    sides = _sides_of(templates, within, side) if within else None
    q, t = _packed(queries, "query_id", ["query_id"], within, side, sides, most), _packed(templates, "template_id", ["template_id", "command_id", "created_at"], within, side, sides, most)
    if sides is not None:
        q, t = (df.join(sides, df["part"] == F.col("_part")) for df in (q, t))
    others = F.explode(F.sequence(F.lit(0), (F.col("_side").cast("int") if sides is not None else F.lit(side)) - 1))
    q = q.select("width", "part", F.col("place").alias("row"), others.alias("col"), F.col("lengths").alias("q_lengths"), F.col("data").alias("q_data"), "query_id")
    t = t.select("width", "part", others.alias("row"), F.col("place").alias("col"), F.col("lengths").alias("t_lengths"), F.col("data").alias("t_data"), "template_id", "command_id", "created_at")
    cell = ["width", "part", "row", "col"]
    tasks = 2 * side * side
    return q.repartition(tasks, *cell).join(t.repartition(tasks, *cell), cell).select("width", "q_lengths", "q_data", "t_lengths", "t_data", "query_id", "template_id", "command_id", "created_at")


def _sides(row: pa.RecordBatch) -> tuple[dict[str, pa.Array], list, list]:
    """Lists of the two blocks, and the runs of one length of either side with their features."""
    width, lists = row.column(0)[0].as_py(), {name: row.column(name)[0].values for name in ("query_id", "template_id", "command_id", "created_at")}
    runs = [list(_by_length(np.asarray(row.column(f"{side}_lengths")[0].values), row.column(f"{side}_data")[0].as_py(), width)) for side in "qt"]
    return lists, *runs


def _rows(lists: dict[str, pa.Array], q: np.ndarray, t: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    at = pa.array(t)
    return pa.RecordBatch.from_arrays([lists["query_id"].take(pa.array(q)), *(lists[n].take(at) for n in ("command_id", "template_id", "created_at")), pa.array(distances.astype(np.float32))], names=["query_id", "command_id", "template_id", "created_at", "distance"])


def _pair_of_blocks(row: pa.RecordBatch, band_ratio: float, metric: Metric, counts: PairCounts | None, apart: bool) -> pa.RecordBatch:
    lists, queries, templates = _sides(row)
    dist = np.empty((len(lists["query_id"]), len(lists["template_id"])), dtype=np.float32)
    for rows, left in queries:
        for cols, right in templates:
            dist[rows, cols] = block_distances(left, right, band_ratio, metric)
    if counts is not None:
        counts.met.add(dist.size)
        counts.warped.add(dist.size)
    q, t = np.nonzero(~_same(lists)) if apart else np.indices(dist.shape).reshape(2, -1)
    return _rows(lists, q, t, dist[q, t])


def _rounded_pair_of_blocks(row: pa.RecordBatch, digits: int, band_ratio: float) -> pa.RecordBatch:
    lists, queries, templates = _sides(row)
    ids, names = lists["query_id"], lists["template_id"]
    dist = np.empty((len(ids), len(names)))
    for rows, left in queries:
        for cols, right in templates:
            dist[rows, cols] = rounded_distances(left, right, digits, band_ratio)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), len(names)))), pa.concat_arrays([names] * len(ids)), pa.array(dist.reshape(-1))], names=["query_id", "template_id", "distance"])


def _same(lists: dict[str, pa.Array]) -> np.ndarray:
    """Which pairs of two blocks are one sequence."""
    return np.array(lists["query_id"].to_pylist(), object)[:, None] == np.array(lists["template_id"].to_pylist(), object)[None, :]


def best_of_blocks(row: pa.RecordBatch, band_ratio: float, metric: Metric, kept: OrderedDict, counts: PairCounts | None, top: int | None, prune_size: int, apart: bool) -> pa.RecordBatch:
    """The best template of each (query, command) of two blocks, where it is not worse than what was found before."""
    lists, queries, templates = _sides(row)
    ids, names = lists["query_id"], lists["template_id"]
    block, coded = (ids[0].as_py(), ids[-1].as_py(), len(ids)), lists["command_id"].dictionary_encode(null_encoding="encode")
    commands, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    known = kept.pop(block, {})
    best = np.stack([known[c] if c in known else np.full(len(ids), np.inf) for c in commands], axis=1)
    here = set(commands)
    elsewhere = [x for c, x in known.items() if c not in here] if top else []
    skip, found = _same(lists) if apart else None, []
    for rows, left in queries:
        for cols, right in templates:
            others = [x[rows] for x in elsewhere]
            q, t, d = _nearest(left, right, best[rows], code[cols], skip[rows, cols] if apart else None, band_ratio, metric, top, others, prune_size)
            q, t = q + rows.start, t + cols.start
            np.minimum.at(best, (q, code[t]), d)
            found.append((q, t, d))
    q, t, d = (np.concatenate([f[i] for f in found]) for i in range(3))
    if counts is not None:
        counts.met.add(len(ids) * len(names))
        counts.warped.add(len(d))
    narrow = d.astype(np.float32)
    near = narrow <= best[q, code[t]].astype(np.float32)
    q, t, narrow = q[near], t[near], narrow[near]
    order = np.lexsort((_ages(lists, t), narrow, code[t], q))  # the first of equals is the one to take
    q, t, narrow = q[order], t[order], narrow[order]
    new = _starts(q, code[t])
    known.update((c, best[:, k]) for k, c in enumerate(commands))
    kept[block] = known
    while len(kept) > KEPT:
        kept.popitem(last=False)
    return _rows(lists, q[new], t[new], narrow[new])


def _ages(lists: dict[str, pa.Array], t: np.ndarray) -> np.ndarray:
    """The place of each of some templates by age and id."""
    some, own = np.unique(t, return_inverse=True)
    order = pc.sort_indices(pa.table([lists[n].take(pa.array(some)) for n in ("created_at", "template_id")], names=["created_at", "template_id"]), [("created_at", "ascending"), ("template_id", "ascending")], null_placement="at_start")
    rank = np.empty(len(some), np.int64)
    rank[order.to_numpy()] = np.arange(len(some))
    return rank[own]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _nearest(left: np.ndarray, right: np.ndarray, best: np.ndarray, code: np.ndarray, skip: np.ndarray | None, band_ratio: float, metric: Metric, top: int | None, others: list[np.ndarray], prune_size: int = PRUNE_SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, template, distance) of all pairs that can be the best of their command, and of others on the way.

    With `top`, of pairs that can be among a query's `top` commands; `others` are best distances of further commands.
    Pairs of `skip` are left out.
    """
    (a, n, _), (b, m, _) = left.shape, right.shape
    cells, bound, best = band_cells(n, m, band_ratio), None, best.copy()

    def limits() -> np.ndarray:
        """What the distance of each (query, command) may be at most."""
        if not top:
            return best
        every_best = np.column_stack([best, *others])
        return best if every_best.shape[1] < top else np.minimum(best, np.partition(every_best, top - 1, axis=1)[:, top - 1 : top])

    if metric is euclidean and left.shape[2] * a * b > prune_size:
        few = _few(left, right, limits(), code, skip, cells)
        if few is not None:
            return few
        bound = (lower_bounds if sum(map(len, cells)) > BOXES_FROM * n else near_bounds)(left, right, cells)
    if bound is None:
        return _whole(left, right, skip, band_ratio, metric)

    can = _within(bound, limits() * SLACK, code)
    if skip is not None:
        can &= ~skip
    if np.isinf(bound).all():  # the band reaches no end
        q, t = np.nonzero(can)
        return q, t, np.full(len(q), np.inf)
    q, t = _first(bound, can, code, top)
    dist = listed_distances(left, right, q, t, cells, np.full(len(q), np.inf))
    np.minimum.at(best, (q, code[t]), dist)
    limit = limits()
    can[q, t] = False
    rest_q, rest_t = _places(can & _within(bound, limit * SLACK, code))
    limit, found, tried = limit[rest_q, code[rest_t]], [(q, t, dist)], len(rest_q) // TRIED
    for some in (slice(0, tried), slice(tried, None)):
        q, t, own = rest_q[some], rest_t[some], limit[some]
        dist = listed_distances(left, right, q, t, cells, own)
        done = np.isfinite(dist) | np.isinf(own)
        if not some.start and 2 * len(rest_q) > a * b and 2 * done.sum() > len(q):  # bounds tell little here, and rows don't either
            return _whole(left, right, skip, band_ratio, metric)
        found.append((q[done], t[done], dist[done]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _few(left: np.ndarray, right: np.ndarray, limits: np.ndarray, code: np.ndarray, skip: np.ndarray | None, cells: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """As `_nearest`, where every (query, command) has a limit already and the looser bound leaves few pairs; else None."""
    a, b = len(left), len(right)
    if not np.isfinite(limits).all():
        return None
    found, n = [], 0
    for at, bound in row_bounds(left, right, cells):
        rows = slice(at, at + len(bound))
        can = _within(bound, limits[rows] * SLACK, code)
        if skip is not None:
            can &= ~skip[rows]
        q, t = _places(can)
        n += len(q)
        if FEW * n > (at + len(bound)) * b:
            return None
        found.append((q + at, t))
    if not found:
        return None
    q, t = (np.concatenate(x) for x in zip(*found, strict=True))
    own = limits[q, code[t]]
    dist = listed_distances(left, right, q, t, cells, own)
    done = dist <= own * SLACK
    return q[done], t[done], dist[done]


def _places(can: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.nonzero` of a matrix with few of them, several times as fast."""
    return np.divmod(np.flatnonzero(can), can.shape[1])


def _first(bound: np.ndarray, can: np.ndarray, code: np.ndarray, top: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that `can` be the best, the one with the least bound of each (query, command); with `top`, of the commands with
    the least ones only."""
    if 8 * np.count_nonzero(can) > can.size:  # by command, as sorting them all would take longer than the bounds
        by = np.argsort(code, kind="stable")
        groups, may = np.flatnonzero(_starts(code[by])), can[:, by]
        least = np.where(may, bound[:, by], np.inf)
        sizes = np.diff(np.append(groups, len(by)))
        q, t = np.nonzero(may & (least == np.repeat(np.minimum.reduceat(least, groups, axis=1), sizes, axis=1)))
        t = by[t]
    else:
        q, t = _places(can)
        order = np.lexsort((bound[q, t], code[t], q))
        q, t = q[order], t[order]
    one = _starts(q, code[t])
    q, t = q[one], t[one]
    if top:
        order = np.lexsort((bound[q, t], q))
        starts = np.flatnonzero(_starts(q[order]))
        order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < top]
        q, t = q[order], t[order]
    return q, t


def _within(bound: np.ndarray, limits: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which bounds don't pass the limit of their (query, command); some that do by a rounding may be among them."""
    if bound.dtype == np.float32:  # the limits as float32, rounded up, and no copy of them where one holds for all commands
        with np.errstate(over="ignore"):
            limits = np.nextafter(limits.astype(np.float32), np.float32(np.inf))
    one = limits[:, :1]
    return bound <= (one if (limits == one).all() else limits.take(code, axis=1))


def _whole(left: np.ndarray, right: np.ndarray, skip: np.ndarray | None, band_ratio: float, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, t = np.indices((len(left), len(right))).reshape(2, -1) if skip is None else np.nonzero(~skip)
    return q, t, block_distances(left, right, band_ratio, metric)[q, t]


def pairs_met(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """(query_id, met long): how many templates of its width each query meets, of queries that meet any; no pair is made."""
    width = lambda df, *columns: df.where(F.size("features") > 0).select(F.size(F.element_at("features", 1)).alias("width"), *columns)
    known = width(templates).groupBy("width").agg(F.count("*").alias("met"))
    return width(queries, "query_id").join(F.broadcast(known), "width").select("query_id", "met")


def best_per_command(pairs: DataFrame) -> DataFrame:
    """(query_id, command_id, template_id, distance): the best template of each command; ties go to age, then id."""
    best = F.min(F.struct("distance", "created_at", "template_id")).alias("b")
    return pairs.groupBy("query_id", "command_id").agg(best).select("query_id", "command_id", "b.template_id", "b.distance")
