"""Banded dynamic time warping: a numpy kernel over blocks of sequences, and the same recurrence as SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance over the last axis: float32 differences, float64 squares."""
    d = (a - b).astype(np.float64)
    return np.sqrt((d * d).sum(axis=-1))


def band_cells(n: int, m: int, band_ratio: float) -> list[list[int]]:
    """Columns that each of n rows may use, both counted from 0.  No ratio (0 or less): no band."""
    if band_ratio <= 0:
        return [list(range(m))] * n
    band, slope = max(1, int(band_ratio * max(n, m))), m / n
    rows = []
    for i in range(n):
        centre = int(i * slope)
        rows.append([j for j in range(max(0, centre - band), min(m, centre + band)) if abs(i - int(j / slope)) <= band])
    return rows


#: Cells of the recurrence's two rows that are held at a time, and values of pairs that are worked on together.
TILE, STACKED = 1 << 21, 1 << 16


def block_distances(left: np.ndarray, right: np.ndarray, band_ratio: float = 0.1, metric: Metric = euclidean) -> np.ndarray:
    """Normalised path costs of all pairs: left (a, n, w) float32, right (b, m, w) float32, result (a, b) float64.

    Empty sequences and pairs whose end the band does not reach are at infinite distance.  Pairs are worked on in tiles,
    so memory follows `TILE`, whatever the lengths.
    """
    (a, n, _), (b, m, _) = left.shape, right.shape
    out = np.full((a, b), np.inf)
    if not n or not m:
        return out
    cells = band_cells(n, m, band_ratio)
    tile_b = min(b, max(1, TILE // (m + 1)))
    tile_a = min(a, max(1, TILE // ((m + 1) * tile_b)))
    for x in range(0, a, tile_a):
        for y in range(0, b, tile_b):
            out[x : x + tile_a, y : y + tile_b] = _tile(left[x : x + tile_a], right[y : y + tile_b], cells, metric)
    return out


def _summed(squares: np.ndarray) -> np.ndarray:
    """Sums over the first axis, one value after the other; of a lone pair numpy would add them in another order."""
    return squares.sum(axis=0) if squares[0].size > 1 else np.add.accumulate(squares, axis=0)[-1]


def _costs(left: np.ndarray, right: np.ndarray, metric: Metric) -> Callable[[int, int], np.ndarray]:
    """The cost of frame i against frame j for all pairs; the array is reused from call to call."""
    if metric is not euclidean:
        return lambda i, j: metric(left[:, None, i], right[None, :, j])
    # Frame by frame and value by value, so that every step runs along whole rows of pairs.
    by_value, against = np.ascontiguousarray(left.transpose(1, 2, 0)), np.ascontiguousarray(right.transpose(1, 2, 0))
    if left.shape[2] * len(left) * len(right) <= STACKED:
        # Few pairs: all values of a frame at once, summed in the same order.
        small, other = by_value[:, :, :, None], against[:, :, None, :]

        def together(i: int, j: int) -> np.ndarray:
            d = small[i] - other[j]
            return np.sqrt(_summed(np.multiply(d, d, dtype=np.float64)))

        return together
    shape = len(left), len(right)
    narrow, wide, total = np.empty(shape, np.float32), np.empty(shape), np.empty(shape)

    def cost(i: int, j: int) -> np.ndarray:
        total.fill(0)
        for x, y in zip(by_value[i], against[j], strict=True):
            np.subtract(x[:, None], y[None, :], out=narrow)
            np.multiply(narrow, narrow, out=wide, dtype=np.float64)
            np.add(total, wide, out=total)
        return np.sqrt(total, out=total)

    return cost


def _tile(left: np.ndarray, right: np.ndarray, cells: list[list[int]], metric: Metric) -> np.ndarray:
    n, m = len(cells), right.shape[1]
    before, now = (np.full((m + 1, len(left), len(right)), np.inf) for _ in range(2))
    before[0], used = 0.0, (0, 1)  # the corner; later rows start at infinity
    cost, least = _costs(left, right, metric), np.empty((len(left), len(right)))
    for i, columns in enumerate(cells):
        for j in columns:
            np.minimum(before[j + 1], before[j], out=least)
            np.minimum(least, now[j], out=least)
            np.add(least, cost(i, j), out=now[j + 1])
        before[used[0] : used[1]] = np.inf
        before, now, used = now, before, (columns[0] + 1, columns[-1] + 2) if columns else (0, 0)
    return before[m] / (n + m)


def lower_bounds(left: np.ndarray, right: np.ndarray, cells: list[list[int]]) -> np.ndarray:
    """What the Euclidean path cost of each pair is at least, of sequences as in `block_distances`: (a, b) float64.

    A path has a cell in every row, within the columns that the row may use.  So each row costs at least the distance of its
    frame from the box around the frames of those columns.  Rounding is monotone, so the bound holds to the last bit
    of the differences; only sums differ in their order.  Rows without columns make a pair unreachable, at no bound.
    """
    (a, n, width), (b, m, _) = left.shape, right.shape
    total, by_value = np.zeros((a, b)), np.ascontiguousarray(left.transpose(1, 2, 0))
    step = max(1, STACKED // (width * b))
    for i, columns in enumerate(cells):
        if not columns:
            continue
        some = right[:, columns[0] : columns[-1] + 1]
        least, most = (np.ascontiguousarray(x.T)[:, None, :] for x in (some.min(axis=1), some.max(axis=1)))
        for lo in range(0, a, step):
            x = by_value[i, :, lo : lo + step, None]
            out = np.maximum(np.maximum(x - most, least - x), np.float32(0))
            total[lo : lo + step] += np.sqrt(np.einsum("kab,kab->ab", out, out, dtype=np.float64))
    return total / (n + m)


#: Rows and columns of pairs whose lower bounds are worked on together, values of their frames' products (few, so that one
#: thread makes them), and the largest squared frame that they allow.
NEAR, NEAR_SIZE, NEAR_MOST = 128, 1 << 18, 1e36
#: Values of the products of `row_bounds`, whose steps gain by longer rows.
ROW_SIZE = 1 << 20
_UNIT = 2.0**-24


def _factors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """x (n, a, w + 2) and y (m, w + 2, b), whose products are the squared distances of frames from below; see `near_bounds`."""
    (a, n, width), (b, m, _) = left.shape, right.shape
    less = np.float32(1 - 4 * (width + 6) * _UNIT)
    with np.errstate(over="ignore", invalid="ignore"):
        x2, y2 = (np.einsum("ijk,ijk->ij", x, x) for x in (left, right))
    if not (x2.max() < NEAR_MOST and y2.max() < NEAR_MOST):
        return None
    x, y = np.empty((n, a, width + 2), np.float32), np.empty((m, width + 2, b), np.float32)
    x[:, :, :width], y[:, :width] = left.transpose(1, 0, 2) * np.float32(-2), right.transpose(1, 2, 0)
    x[:, :, width], x[:, :, width + 1] = x2.T * less - np.float32(1e-36), 1
    y[:, width], y[:, width + 1] = 1, y2.T * less - np.float32(1e-36)
    return x, y


def near_bounds(left: np.ndarray, right: np.ndarray, cells: list[list[int]]) -> np.ndarray | None:
    """Path costs of all pairs from below, within about 1e-5 for frames that are not almost equal: (a, b) float32.

    The recurrence in float32, with frame costs from matrix products of a row's frames and those that its band allows.
    A product of w + 2 terms is off by (w + 2) units of the sum of their sizes at most, that is of 2 (|x|^2 + |y|^2); the squares
    are lessened by twice that, and by what underflow may hide, and the path by twice what its n + m steps may round up.  So
    the bound is never over `block_distances`.  None where values are no numbers or too large for float32.
    """
    (a, n, width), (b, m, _) = left.shape, right.shape
    factors = _factors(left, right)
    if factors is None:
        return None
    x, y = factors
    out, most = np.empty((a, b), np.float32), max(map(len, cells))
    side = max(1, min(NEAR, math.isqrt(NEAR_SIZE // (width + 2))))
    # Only the columns of two rows that a path reaches are held; a constant as an array keeps the steps fast.
    held, spare, zeros = np.empty((2, most, side * side), np.float32), np.empty(side * side, np.float32), np.zeros(side * side, np.float32)
    for lo in range(0, b, side):
        some = np.ascontiguousarray(y[:, :, lo : lo + side])
        for at in range(0, a, side):
            shape = min(side, a - at), some.shape[2]
            size = shape[0] * shape[1]
            rows, least, zero = held[:, :, :size].reshape(2, most, *shape), spare[:size].reshape(shape), zeros[:size].reshape(shape)
            before: dict[int, np.ndarray] = {-1: zero}  # the corner
            for i, columns in enumerate(cells):
                now: dict[int, np.ndarray] = {}
                if columns:
                    cost = rows[i % 2, : len(columns)]
                    np.matmul(x[i, at : at + shape[0]], some[columns[0] : columns[-1] + 1], out=cost)
                    np.sqrt(np.maximum(cost, zero, out=cost), out=cost)
                    for j, own in zip(columns, cost, strict=True):
                        ways = [way[k] for way, k in ((before, j), (before, j - 1), (now, j - 1)) if k in way]
                        if ways:
                            for way in ways[1:]:
                                ways[0] = np.minimum(ways[0], way, out=least)
                            now[j] = np.add(own, ways[0], out=own)
                before = now
            out[at : at + shape[0], lo : lo + shape[1]] = before.get(m - 1, np.inf)
    return out * np.float32((1 - 4 * (n + m) * _UNIT) / (n + m))


def row_bounds(left: np.ndarray, right: np.ndarray, cells: list[list[int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Path costs of all pairs from below, looser than `near_bounds` at less than half its cost: (first row, (rows, b) float32), tile by tile.

    A path has a cell in every row, so each row costs at least the least of its cells; the first and the last row have the
    corners.  The least is taken of squares, so a row takes one root.  Squares of almost equal frames may come out below 0;
    a tile with such is made again with these at 0.  Nothing goes out where a row has no cell, the band leaves a corner out or
    `near_bounds` gives none.
    """
    (a, n, width), (b, m, _) = left.shape, right.shape
    factors = _factors(left, right) if all(cells) and cells[0][0] == 0 and cells[-1][-1] == m - 1 else None
    if factors is None:
        return
    x, y = factors
    ways = [*cells[:-1], cells[-1][-1:]]
    ways[0] = ways[0][:1]
    side, clear = min(a, max(1, ROW_SIZE // (b * (width + 2)))), False
    held, sums, zero = np.empty((2, side, b), np.float32), np.empty((side, b), np.float32), np.zeros((side, b), np.float32)

    @np.errstate(invalid="ignore")
    def tile(at: int) -> np.ndarray:
        size = min(side, a - at)
        two, total = held[:, :size], sums[:size]
        for i, columns in enumerate(ways):
            own, start = x[i, at : at + size], columns[0]
            np.matmul(own, y[start], out=two[0])
            for j in columns[1:]:
                np.minimum(two[0], np.matmul(own, y[j], out=two[1]), out=two[0])
            if clear:
                np.maximum(two[0], zero[:size], out=two[0])
            np.sqrt(two[0], out=two[0] if i else total)
            if i:
                np.add(total, two[0], out=total)
        return total

    shrink = np.float32((1 - 4 * (n + m) * _UNIT) / (n + m))
    for at in range(0, a, side):
        total = tile(at)
        if not clear and np.isnan(total.sum()):
            clear = True
            total = tile(at)
        yield at, np.multiply(total, shrink, out=total)


#: Pairs listed one by one are abandoned where this factor on the best distance is passed: far over what rounding can do.
SLACK = 1 + 1e-5
#: Values of a batch of listed pairs, and rows between two looks at what can be abandoned.
LISTED, LOOK = 1 << 22, 4


def listed_distances(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray, cells: list[list[int]], limits: np.ndarray) -> np.ndarray:
    """The distances of listed pairs, bit for bit those of `block_distances`; infinite where a pair is sure to pass its limit.

    Every path crosses every row, so a pair whose row minimum is over the limit is abandoned there.
    """
    (_, n, width), m = left.shape, right.shape[1]
    out = np.full(len(rows), np.inf)
    step = max(1, LISTED // ((n + m) * width + 2 * m + 2))
    for lo in range(0, len(rows), step):
        own = np.arange(lo, min(len(rows), lo + step))
        x, y = np.ascontiguousarray(left[rows[own]].transpose(1, 2, 0)), np.ascontiguousarray(right[cols[own]].transpose(1, 2, 0))
        bound = limits[own] * SLACK * (n + m)
        before, now = (np.full((m + 1, len(own)), np.inf) for _ in range(2))
        before[0], used = 0.0, (0, 1)
        for i, columns in enumerate(cells):
            for j in columns:
                d = x[i] - y[j]
                total = _summed(np.multiply(d, d, dtype=np.float64))
                now[j + 1] = np.minimum(np.minimum(before[j + 1], before[j]), now[j]) + np.sqrt(total)
            before[used[0] : used[1]] = np.inf
            before, now, used = now, before, (columns[0] + 1, columns[-1] + 2) if columns else (0, 0)
            if i % LOOK == LOOK - 1 and i < n - 1:
                alive = before[used[0] : used[1]].min(axis=0, initial=np.inf) <= bound
                if 2 * alive.sum() < len(alive):
                    own, bound, before, now, x, y = own[alive], bound[alive], before[:, alive], now[:, alive], x[:, :, alive], y[:, :, alive]
                    if not len(own):
                        break
        out[own] = before[m] / (n + m)
    return out


#: Rows and columns of pairs that `rounded_distances` works on together, and the part of pairs near a boundary from which it leaves off.
ROUNDED, UNSURE = (64, 256), 8


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """float32 values rounded to so many decimal digits (6 at most) as Spark's `round` does: float64.

    A float32 value times a power of ten is exact in float64, so that ties are seen as such.  From 2^24 on values are whole.
    """
    wide = values.astype(np.float64)
    return np.where(wide < 2.0**24, np.floor(wide * 10**digits + 0.5) / 10**digits, wide)


def rounded_distances(left: np.ndarray, right: np.ndarray, digits: int, band_ratio: float = 0.1) -> np.ndarray:
    """`half_up` of `block_distances` as float32, at a part of its cost: (a, b) float64.

    The recurrence in float64 with frame costs from matrix products.  A product of w + 2 terms and the squares in it are off by
    2w + 8 units of (|x| + |y|)^2 at most, a root by that over twice the least root of the tile, or by its root at most; a path, divided by
    its n + m steps, by no more than a cell.  `block_distances` is off by a float32 unit of a difference, the cast by another.  Pairs that
    are nearer than that to where rounding changes are warped exactly, and all of them where these are many.
    """
    (a, n, width), (b, m, _) = left.shape, right.shape

    def exact() -> np.ndarray:
        return half_up(block_distances(left, right, band_ratio).astype(np.float32), digits)

    if not n or not m or width * a * b <= STACKED:
        return exact()
    x, y = np.empty((n, a, width + 2)), np.empty((m, width + 2, b))
    x[:, :, :width], y[:, :width] = left.transpose(1, 0, 2), right.transpose(1, 2, 0)
    x2, y2 = np.einsum("iak,iak->ia", x[:, :, :width], x[:, :, :width]), np.einsum("jkb,jkb->jb", y[:, :width], y[:, :width])
    most = (np.sqrt(x2.max()) + np.sqrt(y2.max())) ** 2
    if not most < NEAR_MOST:
        return exact()
    x[:, :, :width] *= -2
    x[:, :, width], x[:, :, width + 1], y[:, width], y[:, width + 1] = x2, 1, 1, y2
    off, cells = (2 * width + 8) * 2.0**-53 * most, band_cells(n, m, band_ratio)
    out, unsure = np.empty((a, b)), []
    held, spare = np.empty((2, max(1, *map(len, cells)), ROUNDED[0] * ROUNDED[1])), np.empty(ROUNDED[0] * ROUNDED[1])
    for lo in range(0, b, ROUNDED[1]):
        some = np.ascontiguousarray(y[:, :, lo : lo + ROUNDED[1]])
        for at in range(0, a, ROUNDED[0]):
            shape = min(ROUNDED[0], a - at), some.shape[2]
            size = shape[0] * shape[1]
            rows, least, low = held[:, :, :size].reshape(2, -1, *shape), spare[:size].reshape(shape), np.inf
            before: dict[int, np.ndarray | float] = {-1: 0.0}  # the corner
            for i, columns in enumerate(cells):
                now: dict[int, np.ndarray] = {}
                if columns:
                    cost = rows[i % 2, : len(columns)]
                    np.matmul(x[i, at : at + shape[0]], some[columns[0] : columns[-1] + 1], out=cost)
                    low = min(low, cost.min())
                    np.sqrt(np.abs(cost, out=cost), out=cost)
                    for j, own in zip(columns, cost, strict=True):
                        ways = [way[k] for way, k in ((before, j), (before, j - 1), (now, j - 1)) if k in way]
                        if ways:
                            for way in ways[1:]:
                                ways[0] = np.minimum(ways[0], way, out=least)
                            now[j] = np.add(own, ways[0], out=own)
                before = now
            if m - 1 not in before:  # the band reaches no end
                return np.full((a, b), np.inf)
            radius = np.sqrt(off) if low < 4 * off else off / (2 * np.sqrt(low - off))
            scaled = np.multiply(before[m - 1], 10**digits / (n + m), out=before[m - 1])
            whole = np.floor(scaled, out=least)
            np.divide(np.add(whole, scaled - whole >= 0.5), 10**digits, out=out[at : at + shape[0], lo : lo + shape[1]])
            reach = scaled.max() * 2.2 * 2.0**-24 + radius * 10**digits
            q, t = np.divmod(np.flatnonzero(np.abs(scaled - whole - 0.5) <= reach), shape[1])
            unsure.append((q + at, t + lo))
    q, t = (np.concatenate(p) for p in zip(*unsure, strict=True))
    if UNSURE * len(q) > a * b:
        return exact()
    out[q, t] = half_up(listed_distances(left, right, q, t, cells, np.full(len(q), np.inf)).astype(np.float32), digits)
    return out


def distance(a: np.ndarray, b: np.ndarray, band_ratio: float = 0.1, metric: Metric = euclidean) -> float:
    """One pair of (frames, width) sequences; differing widths are an error."""
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    if not len(a) or not len(b):
        return float("inf")
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"widths differ: {a.shape[1]} and {b.shape[1]}")
    return float(block_distances(a[None], b[None], band_ratio, metric)[0, 0])


def frame_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array<float> columns, on the JVM."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, v: s + v))


def distance_expression(a: Column, b: Column, band_ratio: float = 0.1) -> Column:
    """The same distance of two array<array<float>> columns without leaving the JVM; for small inputs and checks."""
    n, m, inf = F.size(a), F.size(b), F.lit(float("inf"))
    band = F.greatest(F.lit(1), F.floor(F.lit(band_ratio) * F.greatest(n, m)).cast("int"))
    slope = m.cast("double") / n.cast("double")

    def row(before: Column, i: Column) -> Column:
        centre = F.floor((i - 1) * slope)

        def cell(now: Column, j: Column) -> Column:
            inside = (j > centre - band) & (j <= centre + band) & (F.abs((i - 1) - F.floor((j - 1) / slope)) <= band)
            cost = frame_distance(F.element_at(a, i), F.element_at(b, j))
            best = F.least(F.element_at(before, j + 1), F.element_at(now, j), F.element_at(before, j))
            return F.concat(now, F.array(F.when(inside, cost + best).otherwise(inf)))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(inf), cell)

    # The row above the first one: reachable at its corner only.
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(inf, m))
    last = F.aggregate(F.sequence(F.lit(1), n), first, row)
    return F.when((n <= 0) | (m <= 0), inf).otherwise(F.element_at(last, -1) / (n + m))


def rounded_expression(distance: Column, digits: int) -> Column:
    """`half_up` of a float column, a double; Spark's `round` goes by decimals, which costs as much as a small pair."""
    wide = distance.cast("double")
    return F.when(wide < 2.0**24, F.floor(wide * 10.0**digits + 0.5).cast("double") / 10.0**digits).otherwise(wide)


def regular(features: Column, frames: int, width: int) -> Column:
    """Whether a sequence has so many frames, all of them so many values, and none of these is null."""
    whole = F.forall(features, lambda x: (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull()))
    return F.coalesce((F.size(features) == frames) & whole, F.lit(False))


def values(features: Column, frames: int, width: int, name: str) -> list[Column]:
    """The values of a regular sequence as columns name_0, name_1 and so on."""
    one = lambda i, k: F.coalesce(F.get(F.get(features, F.lit(i)), F.lit(k)), F.lit(0).cast("float"))
    return [one(i, k).alias(f"{name}_{i * width + k}") for i in range(frames) for k in range(width)]


def packed_values(features: Column, frames: int, width: int) -> Column:
    """The same as one struct of v_0, v_1 and so on, which a join copies as a whole."""
    return F.struct(*values(features, frames, width, "v"))


def with_distance(pairs: DataFrame, keep: list[str], shape: tuple[int, int, int], band_ratio: float = 0.1) -> DataFrame:
    """`keep` and the distance of the sequences of one shape, (frames of a and of b, width), whose `packed_values` are a and b or `values` a_0, ... and b_0, ....

    The recurrence of `distance_expression` with a column for each cell of the band, so that no lambda runs for a pair and
    cells that the band leaves out cost nothing.  All frame costs are made by one projection, after which the values go, as
    rows with over a hundred columns are copied from step to step; the steps of the recurrence are fused.
    """
    n, m, width = shape
    inf, every = F.lit(float("inf")), [(i, j) for i, columns in enumerate(band_cells(n, m, band_ratio)) for j in columns]

    one = lambda name, k: F.col(f"{name}.v_{k}" if name in pairs.columns else f"{name}_{k}")

    def square(i: int, j: int) -> Column:
        total = F.lit(0.0)
        for k in range(width):
            d = (one("a", i * width + k) - one("b", j * width + k)).cast("double")
            total = total + d * d
        return total.alias(f"square_{i}_{j}")

    pairs, held = pairs.select(*keep, *[square(i, j) for i, j in every]), []
    cell = lambda i, j: F.lit(0.0) if i == j == -1 else F.col(f"cell_{i}_{j}") if (i, j) in held else inf
    for at, (i, j) in enumerate(every):
        new = F.sqrt(f"square_{i}_{j}") + F.least(cell(i - 1, j), cell(i, j - 1), cell(i - 1, j - 1))
        held = [(x, y) for x, y in held if x >= i - 1]
        pairs = pairs.select(*keep, *[f"cell_{x}_{y}" for x, y in held], new.alias(f"cell_{i}_{j}"), *[f"square_{x}_{y}" for x, y in every[at + 1 :]])
        held = [*held, (i, j)]
    held = [(x, y) for x, y in held if x == n - 1]
    return pairs.select(*keep, (cell(n - 1, m - 1) / (n + m)).alias("distance"))
