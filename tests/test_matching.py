import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.functions import dtw
from quillwave.functions.dtw import band_cells, block_distances, distance, distance_expression, half_up, listed_distances, near_bounds, rounded_distances, row_bounds, values, with_distance
from quillwave.operators import decide as D
from quillwave.operators import enrol as N
from quillwave.operators import evaluate as E
from quillwave.operators import pairing
from quillwave.operators.pairing import PairCounts, _first, best_per_command, pair_distances, pairs_met, rounded_pairs
from quillwave.operators.recognise import recognise
from quillwave.config import MatchConfig
from quillwave.plans import views
from quillwave.plans.queries import QUERIES
from tests.conftest import SF


def test_distance_of_a_sequence_to_itself_is_zero():
    assert distance([[1, 2], [3, 4], [5, 6]], [[1, 2], [3, 4], [5, 6]]) == 0


def test_warped_copy_is_nearer_than_another_shape():
    a = [[0], [1], [2], [3]]
    assert distance(a, [[0], [0], [1], [2], [3], [3]], 0.5) < distance(a, [[3], [2], [1], [0]], 0.5)


def test_empty_and_unreachable_and_unequal_widths():
    assert distance([[1]], np.zeros((0, 1))) == math.inf
    ten = np.arange(10.0)[:, None]
    assert distance(ten, np.arange(12.0)[:, None]) == math.inf
    assert distance(ten, np.arange(15.0)[:, None]) == math.inf
    assert distance(ten, np.arange(20.0)[:, None]) < math.inf
    with pytest.raises(ValueError):
        distance([[1]], [[1, 2]])


def test_full_band_is_symmetric_and_no_band_is_unconstrained():
    a, b = [[1], [2], [5]], [[1], [1], [4], [5]]
    assert abs(distance(a, b, 1.0) - distance(b, a, 1.0)) < 1e-6
    assert distance(np.arange(10.0)[:, None], np.arange(10.0)[:, None], 0) == 0
    assert band_cells(8, 8, 0.1)[3] == [2, 3]


def test_expression_agrees_with_the_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(int(n), 3)).astype("float32").tolist(), rng.normal(size=(int(m), 3)).astype("float32").tolist()) for i, (n, m) in enumerate(rng.integers(3, 12, size=(40, 2)))]
    df = spark.createDataFrame(rows, "i int, a array<array<float>>, b array<array<float>>")
    for r in df.select("i", distance_expression(F.col("a"), F.col("b")).alias("d")).collect():
        want = distance(rows[r.i][1], rows[r.i][2])
        assert r.d == want or abs(r.d - want) < 1e-9


def test_tiles_and_other_metrics_give_the_same_distances(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(7, 9, 3)).astype("float32"), rng.normal(size=(5, 12, 3)).astype("float32")
    whole = dtw.block_distances(left, right)
    plain = lambda a, b: np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=-1))
    assert np.allclose(dtw.block_distances(left, right, metric=plain), whole, rtol=1e-12)
    monkeypatch.setattr(dtw, "TILE", 30)
    assert (dtw.block_distances(left, right) == whole).all()
    alone = [[distance(x, y) for y in right] for x in left]
    assert np.array(alone) == pytest.approx(whole) or (np.isinf(whole) == np.isinf(alone)).all()


def test_cells_as_columns_agree_with_the_kernel(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *(rng.normal(size=(n, 3)).astype("float32").tolist() for n in (6, 5))) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<array<float>>, b array<array<float>>")
    pairs = df.select("i", *values(F.col("a"), 6, 3, "a"), *values(F.col("b"), 5, 3, "b"))
    for band in (0.1, 0.5):
        met = with_distance(pairs, ["i"], (6, 5, 3), band)
        assert "lambda" not in met._jdf.queryExecution().executedPlan().toString()
        for r in met.collect():
            assert r.distance == distance(rows[r.i][1], rows[r.i][2], band)


def test_other_sequences_than_regular_ones_go_by_the_expression(spark, tmp_path):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=64).astype("float32").tolist(), i % 3) for i in range(12)]
    vectors += [(20, vectors[0][1][:60], 1), (21, vectors[1][1][:56], 1), (22, [*vectors[2][1][:63], None], 1), (23, None, 1), (30, vectors[3][1][:59], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seq = views.sequences(spark, str(tmp_path))
    every = views.queries(seq).alias("q").crossJoin(views.templates(seq).alias("t")).where("size(q.features[0]) = size(t.features[0])")
    want = every.select("query_id", F.col("t.template_id"), F.round(distance_expression(F.col("q.features"), F.col("t.features")).cast("float").cast("double"), 5).alias("distance"))
    got = QUERIES["dtw_expression"](spark, str(tmp_path))
    as_text = lambda df: sorted(map(str, df.collect()))
    assert as_text(got) == as_text(want) and got.count() > 40


def test_a_lone_pair_has_the_bits_that_it_has_among_others():
    rng = np.random.default_rng(4)
    left, right = (rng.normal(size=(20, n, 8)).astype(np.float32) for n in (8, 7))
    every, cells, none = block_distances(left, right), band_cells(8, 7, 0.1), np.array([np.inf])
    for i, j in np.ndindex(20, 20):
        assert block_distances(left[i : i + 1], right[j : j + 1])[0, 0] == every[i, j]
        assert listed_distances(left, right, np.array([i]), np.array([j]), cells, none)[0] == every[i, j]


def test_pairs_of_ragged_widths_and_parts_against_the_kernel(spark):
    """Every pair of equal width once, whatever blocks and grid; with `within` only those that agree; any metric."""
    rng = np.random.default_rng(5)
    make = lambda i: rng.normal(size=(int(rng.integers(1, 9)), 2 + i % 2)).astype("float32").tolist()
    q, t = [(i, f"c{i % 3}", make(i)) for i in range(40)], [(f"t{i}", f"c{i % 3}", i, make(i)) for i in range(50)]
    qs = spark.createDataFrame([*q, (99, "c0", []), (98, "c1", None)], "query_id long, command_id string, features array<array<float>>").repartition(3)
    ts = spark.createDataFrame(t, "template_id string, command_id string, created_at long, features array<array<float>>")
    city = lambda a, b: np.abs(a - b).sum(axis=-1).astype(np.float64)
    for within, metric in ((None, dtw.euclidean), ("command_id", city)):
        want = {(a[0], b[0]): distance(a[2], b[3], metric=metric) for a in q for b in t if len(a[2][0]) == len(b[3][0]) and (not within or a[1] == b[1])}
        rows = pair_distances(qs, ts, metric=metric, best_only=False, within=within).collect()
        assert len(rows) == len(want) and all(r.distance == pytest.approx(want[r.query_id, r.template_id], rel=1e-6) for r in rows)


A, B, GARBAGE = [[1.0, 0.0]] * 3, [[0.0, 1.0]] * 3, [[9.0, 9.0]] * 3


def _templates(spark, rows):
    return spark.createDataFrame(rows, "template_id string, command_id string, created_at long, features array<array<float>>")


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, features array<array<float>>").withColumn("frame_count", F.size("features"))


def test_match_reasons_in_order(spark):
    t = _templates(spark, [("a", "A", 1, A), ("poor", "A", 0, [[2.0, 0.0]] * 3), ("b", "B", 2, B), ("w", "B", 3, [[1.0]] * 3)])
    q = _queries(spark, [(1, A), (2, B), (3, GARBAGE), (4, []), (5, [[1.0, 2.0, 3.0]])])
    got = {r.query_id: r for r in recognise(q, t, config=MatchConfig(threshold=5.0)).collect()}
    assert (got[1].kind, got[1].template_id) == ("MATCH", "a") and got[2].command_id == "B"
    assert got[3].reason == "BELOW_CONFIDENCE" and got[3].nearest_command_id in "AB"
    assert got[4].reason == "EMPTY_INPUT" and got[5].reason == "NO_TEMPLATES"
    none = recognise(q, t.limit(0)).collect()
    assert {r.reason for r in none} == {"EMPTY_INPUT", "NO_TEMPLATES"}


def test_strict_threshold_of_one_command(spark):
    t, q = _templates(spark, [("a", "A", 1, A)]), _queries(spark, [(1, [[1.5, 0.0]] * 3)])
    limits = spark.createDataFrame([("A", 0.1)], "command_id string, threshold double")
    assert recognise(q, t, limits).first().kind == "NO_MATCH" and recognise(q, t).first().kind == "MATCH"


def test_ties_go_to_age_then_id(spark):
    t = _templates(spark, [("z", "A", 1, A), ("y", "A", 1, A), ("x", "A", 5, A)])
    assert best_per_command(pair_distances(_queries(spark, [(1, A)]), t)).first().template_id == "y"


def test_confidence_without_a_finite_runner_up(spark):
    rows = spark.createDataFrame([(2.0, 8.0, None), (2.0, 8.0, math.inf), (2.0, 8.0, 4.0), (2.0, 0.0, 4.0)], "d double, t double, r double")
    got = [x[0] for x in rows.select(D.confidence(F.col("d"), F.col("t"), F.col("r"))).collect()]
    assert got == pytest.approx([0.6 * 0.75 + 0.4, 0.6 * 0.75 + 0.4, 0.6 * 0.75 + 0.2, 0.2])


def _utterances(spark):
    u = spark.createDataFrame([(1, "A", "NORMAL", 700), (2, "A", "NORMAL", 700), (3, None, "NORMAL", 700), (4, None, "NORMAL", 700)], "query_id long, truth string, condition string, duration_ms long")
    best = spark.createDataFrame([(1, "A", "t", 1.0), (1, "B", "t", 5.0), (2, "A", "t", 9.0), (2, "B", "t", 5.0), (3, "A", "t", 2.0), (4, "A", "t", 12.0)], "query_id long, command_id string, template_id string, distance float")
    return u, best


def test_known_rows_give_known_rates(spark):
    u, best = _utterances(spark)
    got = E.overall(E.decided(u, best)).first()
    assert (got.positives, got.negatives, got.frr, got.false_accepts, got.negative_seconds) == (2, 2, 0.5, 1, 1.4)
    strict = spark.createDataFrame([("A", 1.0)], "command_id string, threshold double")
    assert E.overall(E.decided(u, best, strict)).first().false_accepts == 0


def test_calibration_takes_the_next_negative_less_an_epsilon(spark):
    u, best = _utterances(spark)
    commands = spark.createDataFrame([("A", 0), ("B", 1)], "command_id string, seq long")
    got = {r.command_id: r for r in E.calibrate(u, best, commands).collect()}
    assert sum(r.allowance for r in got.values()) == 1
    assert got["A"].threshold == pytest.approx(2.0 - 1e-4, abs=1e-6) and got["B"].threshold == 13.0


def test_a_budget_needs_no_match(spark):
    plan = QUERIES["budget_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_no_utterances_give_zero_rates(spark):
    u, best = _utterances(spark)
    got = E.overall(E.decided(u.limit(0), best)).first()
    assert (got.frr, got.far_per_hour, got.positives) == (0.0, 0.0, 0)


def test_adaptation_removes_the_older_of_the_redundant(spark):
    rows = [("A", "n1", "NORMAL", 10, 0.1), ("A", "n2", "NORMAL", 20, 0.1), ("A", "tired", "TIRED", 30, 4.9), ("A", "ill", "ILL", 40, 4.0)]
    existing = spark.createDataFrame(rows, "command_id string, template_id string, condition string, created_at long, score double")
    new = spark.createDataFrame([("A", "c")], "command_id string, template_id string")
    assert {(r.op, r.template_id) for r in N.adaptation(existing, new, 4).collect()} == {("add", "c"), ("remove", "n1")}
    assert {r.op for r in N.adaptation(existing, new, 5).collect()} == {"add"}
    alone = existing.where("template_id <> 'n2'").unionByName(spark.createDataFrame([("A", "o", "OTHER", 5, 0.0)], existing.schema))
    assert {r.op for r in N.adaptation(alone, new, 4).collect()} == {"add"}
    with pytest.raises(ValueError):
        N.adaptation(existing, new, 3)


@pytest.mark.parametrize("n, m, width, band, scale", [(8, 8, 8, 0.1, 1.0), (5, 8, 8, 0.1, 1e-3), (38, 35, 39, 0.1, 50.0), (16, 16, 4, 0.25, 1e-22), (12, 20, 3, 0.0, 1e9)])
def test_near_bounds_are_close_and_never_over(n, m, width, band, scale):
    rnd = np.random.default_rng(n * m)
    left, right = ((rnd.normal(size=(k, f, width)) * scale).astype(np.float32) for k, f in ((150, n), (140, m)))
    right[:9] = np.resize(left[0, :1], right[:9].shape)  # frames that are equal
    full, near = block_distances(left, right, band), near_bounds(left, right, band_cells(n, m, band))
    assert (near <= full).all() and np.array_equal(np.isinf(near), np.isinf(full))
    some = np.isfinite(full[1:, 9:])
    assert scale < 1e-9 or (near[1:, 9:][some] >= (1 - 1e-4) * full[1:, 9:][some]).all()
    left[3, 0, 0] = 1e30
    assert near_bounds(left, right, band_cells(n, m, band)) is None


@pytest.mark.parametrize("n, m, width, band, scale", [(8, 8, 8, 0.1, 1.0), (1, 1, 8, 0.1, 1.0), (38, 38, 39, 0.1, 50.0), (16, 16, 4, 0.25, 1e-22), (12, 20, 3, 0.0, 1e9), (5, 8, 8, 0.1, 1.0)])
def test_row_bounds_are_never_over(monkeypatch, n, m, width, band, scale):
    monkeypatch.setattr(dtw, "ROW_SIZE", 1 << 12)  # several tiles
    rnd = np.random.default_rng(n + m)
    left, right = ((rnd.normal(size=(k, f, width)) * scale).astype(np.float32) for k, f in ((50, n), (40, m)))
    right[:9] = np.resize(left[20, :1], right[:9].shape)  # frames that are equal
    right[9] = np.resize(left[30], right[9].shape)
    cells, full = band_cells(n, m, band), block_distances(left, right, band)
    tiles = [(at, x.copy()) for at, x in row_bounds(left, right, cells)]
    if not all(cells) or cells[0][0] or cells[-1][-1] != m - 1:
        assert not tiles
        return
    bound = np.concatenate([x for _, x in tiles])
    assert [at for at, _ in tiles] == np.cumsum([0, *(len(x) for _, x in tiles[:-1])]).tolist()
    assert bound.shape == full.shape and (bound >= 0).all() and (bound <= full).all()
    some = near_bounds(left, right, cells) > 0
    assert scale < 1e-9 or np.median(bound[some] / full[some]) > 0.3
    left[3, 0, 0] = 1e30
    assert not list(row_bounds(left, right, cells))


@pytest.mark.parametrize("top", [None, 1, 2])
def test_known_distances_make_the_closer_bound_needless(monkeypatch, top):
    rnd = np.random.default_rng(8)
    left = rnd.normal(size=(120, 8, 8)).astype(np.float32)
    right = np.concatenate([left + rnd.normal(0, 0.3, left.shape) for _ in range(4)] + [rnd.normal(size=(400, 8, 8))]).astype(np.float32)
    code = np.concatenate([np.repeat(np.arange(4), 120), rnd.integers(0, 4, 400)])
    full = block_distances(left, right)
    best = np.stack([1.2 * full[:, code == c].min(axis=1) for c in range(4)], axis=1)  # what was found before is a little farther
    monkeypatch.setattr(pairing, "near_bounds", None)
    q, t, d = pairing._nearest(left, right, best, code, None, 0.1, pairing.euclidean, top, [], 0)
    assert np.array_equal(d, full[q, t]) and len(d) < 0.05 * full.size
    got = set(zip(q.tolist(), t.tolist(), strict=True))
    for i in range(120):
        first = [int(np.where(code == c, full[i], np.inf).argmin()) for c in range(4)]
        assert {(i, j) for j in sorted(first, key=lambda j: full[i, j])[: top or 4]} <= got


def test_bounds_hold_the_columns_of_the_band_only():
    left, right = (np.random.default_rng(k).normal(size=(128, 300, 2)).astype(np.float32) for k in range(2))
    cells = band_cells(300, 300, 0.02)
    tracemalloc.start()
    near = near_bounds(left, right, cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(near, block_distances(left, right, 0.02), rtol=1e-3) and peak < 16 << 20  # all columns of two rows: 39 MB


@pytest.mark.parametrize("share", [0.02, 0.9])
@pytest.mark.parametrize("top", [None, 1, 2])
def test_first_pairs_have_the_least_bounds(share, top):
    rnd = np.random.default_rng(5)
    bound, can, code = rnd.normal(size=(40, 50)).astype(np.float32), rnd.random((40, 50)) < share, rnd.integers(0, 7, 50)
    bound[:, 1], code[1] = bound[:, 0], code[0]  # equal bounds
    want = set()
    for i in range(40):
        least = sorted(min((bound[i, j], j) for j in range(50) if can[i, j] and code[j] == c) for c in set(code[can[i]]))
        want |= {(i, j) for _, j in least[:top]}
    got = list(zip(*(x.tolist() for x in _first(bound, can, code, top)), strict=True))
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("top", [None, 1, 2])
def test_narrow_bands_are_pruned(spark, top):
    rnd = np.random.default_rng(3)
    row = lambda: rnd.normal(size=(8, 8)).astype(np.float32).tolist()
    t = spark.createDataFrame([(f"t{i}", f"c{i % 4}", i // 2, row()) for i in range(400)], "template_id string, command_id string, created_at long, features array<array<float>>")
    q = spark.createDataFrame([(i, row()) for i in range(100)], "query_id long, features array<array<float>>")
    counts = PairCounts.of(spark)
    some, every = best_per_command(pair_distances(q, t, counts=counts, top=top, prune_size=0)), best_per_command(pair_distances(q, t, best_only=False))
    first = lambda df: sorted([x[:2] for x in sorted(g)][: top or 4] for g in _by_query(df).values())
    assert first(some) == first(every)
    assert counts.met.value == 40_000 and counts.warped.value < 0.5 * counts.met.value


def _by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.distance, r.template_id, r.command_id))
    return out


def test_a_sequence_does_not_meet_itself(spark):
    rows = spark.createDataFrame([(f"t{i}", f"c{i % 2}", i, [[float(i * i % 7)]]) for i in range(40)], "template_id string, command_id string, created_at long, features array<array<float>>").withColumn("query_id", F.col("template_id"))
    every = pair_distances(rows, rows, best_only=False, within="command_id").where("query_id <> template_id")
    for size in (0, 1 << 14):
        assert sorted(best_per_command(pair_distances(rows, rows, within="command_id", apart=True, prune_size=size)).collect()) == sorted(best_per_command(every).collect())
    assert pair_distances(rows, rows, best_only=False, within="command_id", apart=True).count() == every.count() == 40 * 19


def test_counting_what_meets_makes_no_pair(spark):
    kind = "template_id string, command_id string, created_at long, features array<array<float>>"
    t = spark.createDataFrame([("a", "c", 1, [[1.0]]), ("b", "c", 1, [[1.0], [2.0]]), ("w", "c", 1, [[1.0, 2.0]]), ("e", "c", 1, [])], kind)
    q = spark.createDataFrame([(1, [[3.0]]), (2, [[3.0, 1.0]] * 4), (3, [[1.0] * 5]), (4, [])], "query_id long, features array<array<float>>")
    met = pairs_met(q, t)
    assert {tuple(r) for r in met.collect()} == {(1, 2), (2, 1)}
    counted = pair_distances(q, t, best_only=False).groupBy("query_id").agg(F.count("*").alias("met"))
    assert sorted(met.collect()) == sorted(counted.collect())


def test_half_up_is_spark_s_round(spark):
    rng = np.random.default_rng(7)
    some = np.concatenate([rng.random(4000), rng.integers(0, 1 << 20, 4000) / 2.0 ** rng.integers(0, 20, 4000), 10 ** rng.uniform(-8, 12, 4000), [0, 5e-6, 0.015625, 0.046875, 2**24, np.inf]]).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in some], "v double").select(F.round("v", 5).alias("r"))
    assert half_up(some, 5).tolist() == [r.r for r in df.collect()]


@pytest.mark.parametrize(("n", "m", "width", "band", "scale"), [(8, 8, 8, 0.1, 0.125), (5, 8, 8, 0.1, 0.125), (8, 5, 8, 0.3, 0.125), (6, 6, 3, 0, 1e-5), (8, 8, 8, 0.1, 3e3), (8, 8, 8, 0.1, 1e19), (10, 15, 4, 0.1, 1), (7, 7, 1, 0.5, 1)])
def test_rounded_distances_are_the_rounded_ones_of_the_kernel(n, m, width, band, scale):
    rng = np.random.default_rng(n * m)
    left, right = (scale * rng.normal(size=(300, n, width))).astype(np.float32), (scale * rng.normal(size=(270, m, width))).astype(np.float32)
    k = min(n, m)
    left[:9, :k] = right[:9, :k]  # frames that are the same, and almost
    right[9, :k] = np.nextafter(left[9, :k], np.float32(9e30))
    with np.errstate(over="ignore"):
        want = half_up(block_distances(left, right, band).astype(np.float32), 5)
        assert np.array_equal(rounded_distances(left, right, 5, band), want, equal_nan=True)
        left[3, 0, 0] = np.nan
        assert np.array_equal(rounded_distances(left, right, 5, band), half_up(block_distances(left, right, band).astype(np.float32), 5), equal_nan=True)


def test_values_halfway_between_two_digits_are_rounded_up():
    left, right = np.zeros((200, 1, 1), np.float32), np.arange(200, dtype=np.float32).reshape(200, 1, 1) / 64
    assert rounded_distances(left, right, 5)[0].tolist() == [math.floor(k / 128 * 1e5 + 0.5) / 1e5 for k in range(200)]


def test_few_pairs_are_warped_exactly_to_be_rounded(monkeypatch):
    asked = []
    monkeypatch.setattr(dtw, "block_distances", lambda *a: pytest.fail("all pairs were warped exactly"))
    monkeypatch.setattr(dtw, "listed_distances", lambda left, right, rows, *rest: asked.append(len(rows)) or listed_distances(left, right, rows, *rest))
    rng = np.random.default_rng(1)
    left, right = (rng.normal(size=(512, 8, 8)).astype(np.float32) / 8 for _ in range(2))
    rounded_distances(left, right, 5)
    assert sum(asked) < 0.02 * 512 * 512


def test_rounded_pairs_are_all_pairs_rounded(spark):
    for shape in ("fixed", "ragged"):
        seq = views.sequences(spark, SF, shape)
        q, t = views.queries(seq), views.templates(seq)
        want = pair_distances(q, t, best_only=False).select("query_id", "template_id", F.round(F.col("distance").cast("double"), 5).alias("distance"))
        made = rounded_pairs(q, t, 5)
        assert made.schema == want.schema and sorted(made.collect()) == sorted(want.collect())


def test_a_rounded_expression_is_spark_s_round(spark):
    rng = np.random.default_rng(8)
    some = np.concatenate([rng.random(2000), rng.integers(0, 1 << 20, 2000) / 2.0 ** rng.integers(0, 20, 2000), 10 ** rng.uniform(-8, 12, 2000), [0, 5e-6, 0.015625, 0.046875, 2**24, np.inf]]).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in some] + [(None,)], "v float")
    rows = df.select(dtw.rounded_expression(F.col("v"), 5).alias("mine"), F.round(F.col("v").cast("double"), 5).alias("theirs")).collect()
    assert [r.mine for r in rows] == [r.theirs for r in rows]


def test_a_pair_s_values_are_read_by_one_step_only(spark):
    """They are a few hundred bytes, which no step of the recurrence has to copy."""
    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(2, 5, 8, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(left, right, strict=True))], "i int, a array<array<float>>, b array<array<float>>")
    pairs = df.select("i", dtw.packed_values(F.col("a"), 8, 8).alias("a"), dtw.packed_values(F.col("b"), 8, 8).alias("b")).repartition(2, "i")
    met = with_distance(pairs, ["i"], (8, 8, 8))
    assert {r.i: r.distance for r in met.collect()} == pytest.approx({i: distance(x, y) for i, (x, y) in enumerate(zip(left, right, strict=True))}, rel=1e-12)
    above = met._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0].splitlines()
    assert sum(".v_63" in line for line in above) == 1
    assert sum(" a#" in line or "a_0#" in line for line in above) <= 1
