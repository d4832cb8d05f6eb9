"""Functions in SQL, and decisions on audio, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.config import FRONT_ENDS, CepstraConfig, MatchConfig
from quillwave.functions.cepstra import cepstra
from quillwave.functions.dtw import block_distances, distance
from quillwave.functions.frames import speech_bounds
from quillwave.operators.recognise import bake_off_audio, recognise
from quillwave.plans import views
from quillwave.plans.queries import recognize_audio
from quillwave.sqlfunctions import register
from tests.conftest import SF


def test_functions_in_sql(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate([np.zeros(3000), rnd.normal(0, 0.2, 8000), np.zeros(3000)]).astype(np.float32)
    pairs = [(rnd.normal(size=(n, 2)).astype(np.float32).tolist(), rnd.normal(size=(m, 2)).astype(np.float32).tolist()) for n, m in [(5, 6), (5, 6), (9, 9), (3, 8)]]
    register(spark)
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(8, [], [[1.0]]), (9, [[1.0]], [[1.0, 2.0]]), (10, None, [[1.0]])], "i int, a array<array<float>>, b array<array<float>>").createOrReplaceTempView("pairs")
    got = {r.i: r.d for r in spark.sql("SELECT i, dtw_distance(a, b, 0.3D) AS d FROM pairs").collect()}
    assert all(got[i] == pytest.approx(distance(np.array(a), np.array(b), 0.3), rel=1e-6) for i, (a, b) in enumerate(pairs))
    assert got[8] == got[9] == float("inf") and got[10] is None
    spark.createDataFrame([(1, [float(v) for v in x]), (2, [0.0] * 500), (3, None)], "i int, samples array<float>").createOrReplaceTempView("sound")
    rows = {r.i: r for r in spark.sql("SELECT i, vad(samples, 16000) AS v, mfcc(samples, 1) AS m FROM sound").collect()}
    assert tuple(rows[1].v) == speech_bounds(x, 16_000) and rows[3].m is None and rows[3].v.start_sample is None and rows[2].v.end_sample is None
    assert np.array_equal(np.array(rows[1].m, np.float32), cepstra(x, CepstraConfig(delta=1)))


def _plain(recordings, config):
    """(command, distance) of the nearest template of each recording that is asked and has speech."""
    heard = {}
    for r in recordings:
        x = np.array(r.samples, np.float32)
        bounds = speech_bounds(x, 16_000)
        heard[r.seq] = cepstra(x[slice(*bounds)], config) if bounds else np.zeros((0, 0), np.float32)
    by_length = {}
    for r in recordings:
        if r.kind == "enrol" and len(heard[r.seq]) >= 8:
            by_length.setdefault(len(heard[r.seq]), []).append(r)
    out = {}
    for r in recordings:
        if r.kind != "enrol" and len(heard[r.seq]):
            near = []
            for rows in by_length.values():
                d = block_distances(heard[r.seq][None], np.stack([heard[t.seq] for t in rows]))[0].astype(np.float32)
                near += [(x, t.truth) for x, t in zip(d, rows, strict=True)]
            x, command = min(near)
            out[r.seq] = command, float(x)
    return out


def test_decisions_on_audio_are_those_of_a_plain_recount(spark):
    recordings = views.recordings(spark, SF).collect()
    want = _plain(recordings, CepstraConfig())
    got = {r.query_id: r for r in recognize_audio(spark, SF).collect()}
    assert set(got) == {r.seq for r in recordings if r.kind != "enrol"} and len(want) > 20
    limit = np.float32(MatchConfig().threshold)
    for i, (command, d) in want.items():
        assert (got[i].kind == "MATCH") == (d <= limit) and got[i].distance == pytest.approx(d, abs=2e-3)
        assert (got[i].command_id or got[i].nearest_command_id) == command
    assert all(got[i].reason in ("SILENCE", "EMPTY_INPUT") for i in set(got) - set(want))


def test_front_ends_over_audio_are_those_of_a_plain_recount(spark):
    corpus = views.recordings(spark, SF).where("seq < 120").persist()
    recordings = corpus.collect()
    got = {r.name: r for r in bake_off_audio(corpus, threshold=20.0).collect()}
    for name, config in FRONT_ENDS.items():
        found = {i: command for i, (command, d) in _plain(recordings, config).items() if d <= np.float32(20.0)}
        positives = [r for r in recordings if r.kind == "positive"]
        rejects = sum(found.get(r.seq) != r.truth for r in positives)
        assert got[name].frr == pytest.approx(rejects / len(positives))
        assert got[name].false_accepts == sum(r.seq in found for r in recordings if r.kind == "negative")
    assert corpus.select(F.max(F.size("samples"))).first()[0] == 6400


def test_recognize_in_sql_compares_blocks(spark):
    rnd = np.random.default_rng(4)
    row = lambda i: rnd.normal(size=(6 + i % 3, 4)).astype(np.float32).tolist()
    spark.createDataFrame([(f"t{i}", f"c{i % 5}", i // 2, row(i)) for i in range(900)], "template_id string, command_id string, created_at long, features array<array<float>>").createOrReplaceTempView("many_templates")
    asked = spark.createDataFrame([(i, row(i), 6 + i % 3) for i in range(300)] + [(300, [], 0), (301, [[1.0]], 1)], "query_id long, features array<array<float>>, frame_count int")
    asked.createOrReplaceTempView("many_queries")
    register(spark, "many_queries", "many_templates")
    got = spark.sql("SELECT * FROM recognize(threshold => 1.2, band_ratio => 0.3)")
    want = recognise(asked, spark.table("many_templates"), config=MatchConfig(threshold=1.2, band_ratio=0.3))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().toString()
    assert "nearest_in_blocks" in plan and "dtw_distance" not in plan
