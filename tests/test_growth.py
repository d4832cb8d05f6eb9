"""What keeps work small as tables grow: pruned matching, a store of parts, scores kept up to date, selection, long audio."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.config import CepstraConfig, EndpointConfig
from quillwave.functions.cepstra import cepstra
from quillwave.functions.dtw import band_cells, block_distances, listed_distances, lower_bounds
from quillwave.functions.frames import speech_bounds
from quillwave.operators import longaudio
from quillwave.operators.decide import decide, ranked
from quillwave.operators.pairing import PairCounts, best_per_command, pair_distances
from quillwave.operators.recognise import recognise
from quillwave.operators.selection import kth_smallest
from quillwave.operators.upkeep import rescored, scored
from quillwave.sources.store import INLINE, TEMPLATE_SCHEMA, TemplateStore

SHAPES = [(5, 5, 0.5), (12, 15, 0.3), (40, 44, 0.1), (60, 30, 0.2), (10, 12, 0.1), (1, 1, 0.1), (30, 30, 0.0)]


def _walks(rnd, n, frames, width=3):
    return rnd.normal(size=(n, frames, width)).astype(np.float32).cumsum(axis=1)


@pytest.mark.parametrize("n, m, band", SHAPES)
def test_bounds_hold_and_listed_pairs_are_the_same(n, m, band):
    rnd = np.random.default_rng(n * m)
    left, right = _walks(rnd, 7, n), _walks(rnd, 9, m)
    full, cells = block_distances(left, right, band), band_cells(n, m, band)
    assert (lower_bounds(left, right, cells) <= full + 1e-9).all()
    rows, cols = (x.ravel() for x in np.indices(full.shape))
    assert np.array_equal(listed_distances(left, right, rows, cols, cells, np.full(63, np.inf)).reshape(full.shape), full)
    limit = np.median(full)
    some = listed_distances(left, right, rows, cols, cells, np.full(63, limit)).reshape(full.shape)
    assert ((some == full) | ((full > limit) & np.isinf(some))).all()


def _sequences(spark, rnd, n, name, commands=4, lengths=(30, 34)):
    rows = []
    for i in range(n):
        c = i % commands
        x = np.sin(np.linspace(0, 3 + 2 * c, lengths[i % len(lengths)]))[:, None] * np.array([1.0, 0.5]) + rnd.normal(0, 0.05, (lengths[i % len(lengths)], 2))
        rows.append((f"{name}{i:03d}", f"c{c}", i // 2, x.astype(np.float32).tolist()))
    return spark.createDataFrame(rows, "template_id string, command_id string, created_at long, features array<array<float>>")


def test_pruned_rows_are_those_of_all_pairs(spark):
    rnd = np.random.default_rng(1)
    walk = lambda n: _walks(rnd, 1, n)[0].tolist()
    rows = [(f"t{i:03d}", f"c{i % 2}", i // 2, walk(40 if i % 3 else 44)) for i in range(240)]
    rows += [(f"s{name}", *more) for name, *more in rows[:10]]  # equal distances, other ids
    templates = spark.createDataFrame(rows, "template_id string, command_id string, created_at long, features array<array<float>>")
    near = [(np.array(rows[7 * i][3]) + rnd.normal(0, 0.3, (len(rows[7 * i][3]), 3))).tolist() for i in range(20)]
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(near + [walk(42) for _ in range(10)])], "query_id long, features array<array<float>>")
    for band in (0.1, 0.25):
        counts = PairCounts.of(spark)
        got = sorted(tuple(r) for r in best_per_command(pair_distances(queries, templates, band, counts=counts, prune_size=0)).collect())
        assert got == sorted(tuple(r) for r in best_per_command(pair_distances(queries, templates, band, best_only=False)).collect())
        assert counts.met.value == 30 * 250 and counts.warped.value < 0.6 * counts.met.value, counts


def test_the_first_two_commands_need_few_pairs(spark):
    rnd = np.random.default_rng(6)
    shapes = [_walks(rnd, 1, 40)[0] for _ in range(12)]
    noisy = lambda c: (shapes[c] + rnd.normal(0, 0.2, (40, 3))).tolist()
    templates = spark.createDataFrame([(f"t{i:03d}", f"c{i % 12:02d}", i, noisy(i % 12)) for i in range(240)], "template_id string, command_id string, created_at long, features array<array<float>>")
    queries = spark.createDataFrame([(i, noisy(i % 12), 40) for i in range(30)] + [(99, [], 0)], "query_id long, features array<array<float>>, frame_count int")
    counts = PairCounts.of(spark)
    some = best_per_command(pair_distances(queries, templates, counts=counts, top=2, prune_size=0))
    every = best_per_command(pair_distances(queries, templates, best_only=False))
    two = lambda df: sorted((r.query_id, r.command_id, r.template_id, r.distance, r.runner_up) for r in ranked(df).collect())
    assert two(some) == two(every) and counts.warped.value < 0.5 * counts.met.value, counts
    assert sorted(tuple(r) for r in recognise(queries, templates).collect()) == sorted(tuple(r) for r in decide(queries, every).collect())


def test_unreachable_pairs_keep_their_row(spark):
    t = spark.createDataFrame([("b", "c", 2, [[1.0]] * 12), ("a", "c", 2, [[1.0]] * 12)], "template_id string, command_id string, created_at long, features array<array<float>>")
    q = spark.createDataFrame([(1, [[1.0]] * 10)], "query_id long, features array<array<float>>")
    row = best_per_command(pair_distances(q, t)).first()
    assert row.template_id == "a" and row.distance == float("inf")


# Store


def _rows(spark, *rows):
    return spark.createDataFrame([(t, c, "NORMAL", k, [[float(k)]]) for k, (t, c) in enumerate(rows)], TEMPLATE_SCHEMA)


def _ids(df):
    return sorted((r.template_id, r.command_id) for r in df.collect())


def _keys(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    s = TemplateStore(spark, f"file://{tmp_path}/store")
    first = s.add_templates(_rows(spark, *[(f"t{i}", f"c{i % 9}") for i in range(100)]))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    n = s.add_templates(_rows(spark, ("new", "c1")))
    written = [p for p in tmp_path.rglob("*.parquet") if p not in before]
    assert len(written) == 1 and spark.read.parquet(str(written[0])).count() == 1
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    s.delete_templates(_keys(spark, "template_id", "t1", "none"))
    assert len(list(tmp_path.rglob("*.parquet"))) == len(before) + 1  # keys that go are named in the version file
    assert s.templates().count() == 100 and s.templates(first).count() == 100 and s.templates(n).count() == 101
    assert ("t1", "c1") in _ids(s.templates(first)) and ("t1", "c1") not in _ids(s.templates())


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    s = TemplateStore(spark, f"file://{tmp_path}/store", buckets=8)
    s.add_templates(_rows(spark, *[(f"t{i}", f"c{i % 40}") for i in range(400)]))
    s.add_templates(_rows(spark, ("t3", "c7"), ("t999", "c3")))  # t3 moves to another command's bucket
    found = s.templates_for("c3")
    assert _ids(found) == sorted((f"t{i}", "c3") for i in [*range(43, 400, 40), 999])
    every, own = len(s.templates().inputFiles()), len(found.inputFiles())
    assert every == len(list(tmp_path.rglob("*.parquet"))) and own <= 2 < 8 <= every
    assert s.templates_for("nobody").count() == 0


@pytest.mark.parametrize("many", [3, INLINE + 50])
def test_random_changes_equal_a_plain_table(spark, tmp_path, many):
    rnd, plain = random.Random(many), {}
    s = TemplateStore(spark, f"file://{tmp_path}/store", buckets=4)
    versions = []
    for step in range(9):
        some = sorted({f"t{rnd.randrange(3 * many)}" for _ in range(many)})
        kind = ["put", "put", "gone", "command"][step % 4]
        if kind == "put":
            rows = [(t, f"c{rnd.randrange(5)}") for t in some]
            n = s.add_templates(_rows(spark, *rows))
            plain |= dict(rows)
        elif kind == "gone":
            n = s.delete_templates(_keys(spark, "template_id", *some[::2]))
            plain = {t: c for t, c in plain.items() if t not in some[::2]}
        else:
            n = s.delete_commands(_keys(spark, "command_id", "c1", "c2"))
            plain = {t: c for t, c in plain.items() if c not in ("c1", "c2")}
        versions.append((n, sorted(plain.items())))
        if step == 5:
            s.compact()
    assert _ids(s.templates()) == versions[-1][1]
    for n, want in versions[:6:2]:
        assert _ids(s.templates(n)) == want
    assert s.vacuum() > 0 and _ids(s.templates()) == versions[-1][1]


def test_writers_at_the_same_time_and_compaction(spark, tmp_path, monkeypatch):
    s = TemplateStore(spark, f"file://{tmp_path}/store")
    s.add_templates(_rows(spark, ("a", "x")))
    commit, turns = s._commit, []

    def late(n, state):
        if not turns:  # another writer comes first
            turns.append(TemplateStore(spark, s.folder).add_templates(_rows(spark, ("b", "x"))))
        return commit(n, state)

    monkeypatch.setattr(s, "_commit", late)
    s.compact()
    assert _ids(s.templates()) == [("a", "x"), ("b", "x")] and [p["kind"] for p in s.latest()[1]["templates"]] == ["base", "put"]
    monkeypatch.setattr("quillwave.sources.store.COMPACT_AT", 3)
    for i in range(3):
        s.add_templates(_rows(spark, (f"n{i}", "x")))
    assert len(s.latest()[1]["templates"]) < 4 and s.templates().count() == 5


def test_a_follower_is_told_what_changed(spark, tmp_path):
    s, told = TemplateStore(spark, f"file://{tmp_path}/store"), []
    s.add_templates(_rows(spark, ("a", "x"), ("b", "y")))
    running = s.live_changes(lambda name, puts, gone, n: told.append((name, sorted(r[0] for r in puts.collect()), sorted(tuple(r) for r in gone.collect()))), f"file://{tmp_path}/cp").start()
    try:
        running.processAllAvailable()
        s.add_templates(_rows(spark, ("c", "x")))
        running.processAllAvailable()
        s.delete_commands(_keys(spark, "command_id", "x"))
        running.processAllAvailable()
    finally:
        running.stop()
    templates = [t[1:] for t in told if t[0] == "templates"]
    assert templates == [(["a", "b"], []), (["c"], []), ([], [("command_id", "x")])]


# Scores kept up to date


def test_upkeep_equals_the_full_recount(spark):
    rnd = np.random.default_rng(5)
    everything = _sequences(spark, rnd, 48, "t", commands=3, lengths=(8, 9)).persist()
    pick = random.Random(2)
    names = [f"t{i:03d}" for i in range(48)]
    now = set(pick.sample(names, 30))
    of = lambda some: everything.where(F.col("template_id").isin(sorted(some)))
    scores = scored(of(now), 0.5)
    counts, full = PairCounts.of(spark), PairCounts.of(spark)
    for _ in range(3):
        gone, new = set(pick.sample(sorted(now), 3)), set(pick.sample(sorted(set(names) - now), 2))
        again = {pick.choice(sorted(now - gone))}  # put again
        now = (now - gone) | new
        scores = spark.createDataFrame(rescored(scores, of(now), of(new | again).select("template_id"), of(gone | again).select("template_id"), 0.5, counts).collect(), "template_id string, command_id string, score double, nearest string")
        assert sorted(tuple(r) for r in scores.collect()) == sorted(tuple(r) for r in scored(of(now), 0.5, full).collect())
    assert counts.met.value < 0.7 * full.met.value


def test_the_last_of_a_command_has_no_neighbour(spark):
    rows = _sequences(spark, np.random.default_rng(0), 3, "t", commands=2)
    scores = scored(rows)
    after = rescored(scores, rows.where("template_id <> 't000'"), rows.where("false"), rows.where("template_id = 't000'")).collect()
    assert {r.template_id: r.nearest for r in after} == {"t001": None, "t002": None} and all(r.score > 1e300 for r in after)


# Selection


def test_kth_smallest_of_groups_with_a_hot_one(spark):
    rnd = random.Random(8)
    values = [("hot", float(np.float32(rnd.choice([rnd.gauss(0, 1e-3), rnd.gauss(0, 5), 2.5])))) for _ in range(5000)]
    values += [("few", x) for x in (3.0, -0.0, 0.0, float("inf"), -7.5)] + [("one", 1.0), ("none", None)]
    wanted = [("hot", 1), ("few", 2), ("one", 2), ("gone", 1)]
    df = spark.createDataFrame(values, "g string, v float").repartition(5)
    got = lambda w: {r.g: r.value for r in kth_smallest(df, spark.createDataFrame(w, "g string, k long"), "g", "v").collect()}
    hot = sorted(v for g, v in values if g == "hot")
    assert got(wanted) == {"hot": hot[0], "few": 0.0}
    for k in (2, 1700, 2500, 5000):
        assert got([("hot", k), ("few", 5), ("one", 1)]) == {"hot": hot[k - 1], "few": float("inf"), "one": 1.0}
    plan = kth_smallest(df, spark.createDataFrame(wanted, "g string, k long"), "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


# Long audio


def _recordings():
    rnd = np.random.default_rng(3)
    part = lambda a, ms: rnd.normal(0, a, 16 * ms)
    return {
        1: np.concatenate([part(1e-4, 500), part(0.2, 700), part(1e-4, 300), part(0.3, 90), part(1e-4, 600)]).astype(np.float32),
        2: part(1e-4, 700).astype(np.float32),
        3: np.concatenate([part(1e-3, 40), part(0.2, 2000), part(1e-3, 400)]).astype(np.float32),
        4: part(0.1, 10).astype(np.float32),
    }


def _chunks(spark, lengths, rnd):
    rows = []
    for i, x in _recordings().items():
        at = 0
        while at < len(x):
            n = rnd.choice(lengths)
            rows.append((i, at, [float(v) for v in x[at : at + n]]))
            at += n
    rnd.shuffle(rows)
    return spark.createDataFrame(rows + [(9, 0, []), (9, 0, None)], "recording_id long, at long, samples array<float>")


@pytest.mark.parametrize("lengths, block", [([16_000], 50), ([37, 900, 4001], 7), ([1 << 20], 4096), ([161], 1)])
def test_long_recordings_equal_single_rows(spark, lengths, block):
    if block == 1:
        config, endpoint = CepstraConfig(delta=1), EndpointConfig()
    else:
        config, endpoint = CepstraConfig(delta=2), EndpointConfig(min_speech_ms=60)
    chunks = _chunks(spark, lengths, random.Random(block)).persist()
    audio = _recordings()
    found = longaudio.segments(chunks, 16_000, endpoint, block)
    got = {r.recording_id: (r.start_sample, r.end_sample) for r in found.collect()}
    want = {i: b for i, x in audio.items() if (b := speech_bounds(x, 16_000, endpoint))}
    assert got == want and set(want) == {1, 3}
    rows = longaudio.features(longaudio.trimmed(chunks, found), config, block).orderBy("recording_id", "first").collect()
    for i, (a, b) in want.items():
        own = [r for r in rows if r.recording_id == i]
        mine = np.concatenate([np.array(r.features, np.float32) for r in own])
        plain = cepstra(audio[i][a:b], config)
        assert [r.first for r in own] == [k * block for k in range(len(own))] and mine.shape == plain.shape
        assert np.abs(mine - plain).max() < 2e-5
