"""The listening loop, the growing capture source and the action bus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.config import WAKE_COMMAND, CepstraConfig, EndpointConfig, MatchConfig
from quillwave.functions.cepstra import cepstra
from quillwave.functions.frames import segment, speech_bounds
from quillwave.operators.recognise import audio_features, enrol_audio, recognise
from quillwave.sources.growing import GrowingReader, growing_capture
from quillwave.streaming import bus, listen
from quillwave.streaming.listen import listen_batch, next_windows
from quillwave.streaming.loop import INPUT, AudioDecision, Change, Loop, LoopConfig, PeakDecision, Template, loop_batch, loop_stream

RATE = 16_000


def tone(hz, ms, amp=0.3):
    return (amp * np.sin(2 * np.pi * hz * np.arange(RATE * ms // 1000) / RATE)).astype("float32")


def said(hz):
    """A window of 1.5 s with a tone in its middle."""
    return np.concatenate([np.zeros(RATE // 2, "float32"), tone(hz, 500), np.zeros(RATE // 2, "float32")])


def test_endpoints_in_numpy_are_those_of_the_expression(spark):
    rnd = np.random.default_rng(2)
    signals = [np.concatenate([rnd.normal(0, a, n) for a, n in zip(rnd.choice([1e-4, 1e-3, 0.2], 4), rnd.integers(0, 4000, 4), strict=True)]).astype("float32") for _ in range(40)] + [np.zeros(0, "float32"), tone(440, 500)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(signals)], "i int, samples array<float>")
    for config in (EndpointConfig(), EndpointConfig(min_speech_ms=25, hangover_ms=30, ratio=2.0, percentile=0.3)):
        got = {r.i: r.s for r in df.select("i", segment(F.col("samples"), RATE, config).alias("s")).collect()}
        for i, x in enumerate(signals):
            want = speech_bounds(x, RATE, config)
            assert (None if got[i] is None else tuple(got[i])) == want, i
    assert any(speech_bounds(x, RATE) for x in signals)


def _templates(spark):
    """Templates of two commands and the wake word, as the store has them."""
    rows = [(1, "go", said(700)), (2, "stop", said(1500)), (3, "go", said(720))]
    df = spark.createDataFrame([(i, c, "NORMAL", [float(v) for v in x]) for i, c, x in rows], "seq long, command_id string, condition string, samples array<float>")
    return enrol_audio(df, prefix="t")[0]


def test_a_window_is_decided_as_the_batch_operators_do(spark):
    templates = _templates(spark).persist()
    asked = {1: said(705), 2: said(1490), 3: said(3000), 4: np.zeros(RATE, "float32")}
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in asked.items()], "query_id long, samples array<float>")
    want = {r.query_id: r for r in recognise(audio_features(df), templates).collect()}
    mine = [Template(r.template_id, r.command_id, r.created_at, np.array(r.features, np.float32)) for r in templates.collect()]
    for i, x in asked.items():
        got, _ = AudioDecision()(x, mine, 0.0)
        assert (got.kind, got.reason) == (want[i].kind, want[i].reason)
        assert got.distance == pytest.approx(want[i].distance, rel=1e-5)
        if got.kind == "MATCH":
            assert (got.command_id, got.template_id) == (want[i].command_id, want[i].template_id) and got.confidence == pytest.approx(want[i].confidence, rel=1e-5)


def test_wake_word_and_gate_come_first():
    wake = Template("w", WAKE_COMMAND, 1, cepstra(said(300), CepstraConfig()))
    x = said(1200)
    a, b = speech_bounds(x, RATE)
    go = Template("g", "go", 2, cepstra(x[a:b], CepstraConfig()))
    decide = AudioDecision(wake_threshold=1.0)
    assert decide(np.zeros(RATE, "float32"), [wake, go], 1e-3)[0].reason == "QUIET"
    assert decide(said(1200), [go], 1e-3)[0].reason == "NO_WAKE_ENROLLED"
    assert decide(said(1200), [wake, go], 1e-3)[0].reason == "BELOW_THRESHOLD"
    assert decide(said(300), [wake, go], 1e-3)[0].reason == "BELOW_CONFIDENCE"
    assert decide(said(300), [wake], 1e-3)[0].reason == "NO_TEMPLATES"
    assert AudioDecision(wake_threshold=1e9)(said(1200), [wake, go], 1e-3)[0].command_id == "go"


def _put(at, name, value, command="c"):
    return Change(at, "put", Template(name, command, at, np.array([[value]], np.float32)))


def test_idle_steps_windows_and_gaps():
    loop = Loop(LoopConfig(), PeakDecision(MatchConfig(threshold=0.5)))
    frames = [(t, t, np.array([9.0 if t == 3000 else 1.0], np.float32)) for t in range(0, 20_000, 100)]
    made = list(loop.feed(frames, [_put(1700, "t", 9.0), Change(9000, "drop", Template("t", None, 0, None)), _put(12_000, "u", 1.0)]))
    # 0, 800, 1600 are idle; the first window starts at 2400, matches, and the next one starts 600 later; the template goes at 9000
    assert [(r[1], r[3], r[4]) for r in made[:5]] == [(2400, 3, "MATCH"), (4500, 0, "NO_MATCH"), (6000, 0, "NO_MATCH"), (7500, 0, "NO_MATCH"), (12_200, 4, "MATCH")]
    assert [r[0] for r in made] == list(range(len(made))) and made[5][1] == 12_200 + 2100


def test_a_year_without_templates_is_skipped_at_once():
    loop = Loop(LoopConfig(), PeakDecision())
    year = 365 * 86_400_000
    x = np.zeros(1, np.float32)
    assert list(loop.feed([(0, 0, x), (year, year, x)], [_put(year // 2 + 1, "t", 0.0)])) != []
    loop = Loop(LoopConfig(), PeakDecision())
    assert list(loop.feed([(0, 0, x), (year, year, x)], [])) == [] and loop.idle == year // 800 and len(loop.frames) == 1


def test_pieces_of_any_size_give_the_same_windows():
    rnd = random.Random(4)
    frames = [(t, t + 40, np.full(40, rnd.random(), np.float32)) for t in range(0, 30_000, 40) if not 9000 < t < 14_000]
    changes = sorted([_put(rnd.randrange(25_000), f"t{i}", 0.8 + 0.2 * rnd.random(), f"c{i % 3}") for i in range(6)] + [Change(rnd.randrange(25_000), "drop", Template(f"t{i}", None, 0, None)) for i in range(5)], key=lambda c: c.at)
    run = lambda loop, a, b: list(loop.feed([f for f in frames if a <= f[0] < b], [c for c in changes if a <= c.at < b]))
    fresh = lambda: Loop(LoopConfig(), PeakDecision(MatchConfig(threshold=0.02)))
    want = run(fresh(), 0, 40_000)
    assert any(r[4] == "MATCH" for r in want) and any(r[3] for r in want)
    for step in (40, 700, 9999):
        loop = fresh()
        assert [r for a in range(0, 40_000, step) for r in run(loop, a, a + step)] == want


def test_a_long_pause_goes_out_in_slices(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 60_000_000, True), (1, 60_009_000, False), (2, 0, True)], "device_id long, at_ms long, hit boolean")
    rows = listen_batch(df).orderBy("window_id").collect()
    assert [r.window_id for r in rows] == list(range(len(rows))) and len(rows) > 40_000
    assert [r.start_ms for r in rows if r.matched] == [60_000_000] and rows[-1].end_ms <= 60_009_000 and rows[40_001].start_ms == 60_002_100


def _loop_rows(spark):
    """Two devices: sound in frames of 100 ms, and templates that come and go."""
    rows, step = [], RATE // 10
    sounds = {1: np.concatenate([said(700), said(1500), said(700), said(3000), said(1500), said(700)]), 2: np.concatenate([np.zeros(RATE, "float32"), said(1500), said(700), said(1500)])}
    for device, x in sounds.items():
        rows += [(device, a, a + step, [float(v) for v in x[a : a + step]], None, None, None, None, None) for a in range(0, len(x), step)]
    for t in _templates(spark).collect():
        rows.append((1, 100 if t.command_id == "go" else 60_000, 100, None, "put", t.template_id, t.command_id, t.created_at, t.features))
        rows.append((2, 5, 5, None, "put", t.template_id, t.command_id, t.created_at, t.features))
    rows.append((1, 110_000, 110_000, None, "drop", "t1", None, None, None))
    return spark.createDataFrame(rows, INPUT)


def test_the_stream_equals_the_batch(spark, tmp_path):
    rows = _loop_rows(spark).persist()
    config, decide = LoopConfig.of_rate(RATE), AudioDecision()
    want = sorted(tuple(r) for r in loop_batch(rows, decide, config).collect())
    assert {r[5] for r in want} == {"MATCH", "NO_MATCH"} and {r[6] for r in want if r[5] == "MATCH"} == {"go", "stop"}
    for k, (lo, hi) in enumerate([(0, 30_000), (30_000, 61_000), (61_000, 1 << 40)]):
        rows.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run(files, name):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{files}")
        q = loop_stream(stream, decide, config).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)

    run("*", "first")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


# Growing files


def _grow(folder, device, samples):
    with open(folder / f"{device}.pcm", "ab") as f:
        f.write(np.asarray(samples, "<i2").tobytes())


def test_growing_files_give_each_frame_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = growing_capture(spark, f"file://{folder}", frame_ms=1)

    def run():
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.read.parquet(f"{tmp_path}/out").orderBy("device_id", "at").collect()

    _grow(folder, 7, range(40))  # two frames of 16 and a half
    _grow(folder, 8, range(16))
    assert [(r.device_id, r.seq, r.at, r.upto) for r in run()] == [(7, 0, 0, 16), (7, 1, 16, 32), (8, 0, 0, 16)]
    _grow(folder, 7, range(40, 61))
    got = run()
    assert [(r.device_id, r.seq) for r in got] == [(7, 0), (7, 1), (7, 2), (8, 0)]
    _grow(folder, 9, [5])
    (folder / "7.pcm.end").touch()
    (folder / "9.pcm.end").touch()
    got = run()
    samples = [round(v * 32768) for r in got if r.device_id == 7 for v in r.samples]
    assert samples == list(range(61)) and [len(r.samples) for r in got if r.device_id == 9] == [1]
    assert len(run()) == len(got)


def test_batches_are_bounded_and_never_behind(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _grow(folder, 1, range(1000))
    with pytest.raises(ValueError):
        GrowingReader({"path": f"file://{folder}", "frame_ms": "1", "max_bytes": "64"})
    options = {"path": f"file://{folder}", "frame_ms": "1", "max_bytes": "64", "progress": f"file://{tmp_path}/progress"}
    assert [GrowingReader(options).latestOffset() for _ in range(2)] == [{"1": 64}, {"1": 128}]  # also by a new reader, as after a restart
    sizes = []
    q = growing_capture(spark, f"file://{folder}", frame_ms=1, max_bytes=512, progress=f"file://{tmp_path}/other").writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sizes == [16, 16, 16, 14]


# Action bus


def _actions(spark, ids, at=0, device=1):
    return spark.createDataFrame([(device, i, at + k, "c", "HOME") for k, i in enumerate(ids)], bus.ACTION)


def test_killed_and_repeated_epochs_give_each_action_once(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    writer = bus.ActionBusWriter({"path": path})
    write = lambda ids: writer.write(iter(_actions(spark, ids).toArrow().to_batches()))
    first = [write(["a", "b"]), write([])]
    writer.commit(first, 0)
    writer.commit([write(["a", "b"])], 0)  # the epoch came again after its commit
    killed = write(["c"])  # the driver died before the commit: nobody reads this file
    writer.commit([write(["c"])], 1)
    writer.abort([write(["d"]), None], 2)
    assert killed.rows == 1 and sorted(r.query_id for r in bus.delivered(spark, path).collect()) == ["a", "b", "c"]
    assert bus.delivered(spark, f"file://{tmp_path}/none").collect() == []


def test_what_is_seen_again_is_dropped():
    kept, seen = bus.first_of_each({}, [(5, "b"), (1, "a"), (9, "a")], 100, 16)
    assert kept == [1, 0] and seen == {"a": 1, "b": 5}
    kept, seen = bus.first_of_each(seen, [(200, "c"), (50, "a")], 100, 16)
    assert kept == [0] and seen == {"c": 200}  # the old ones are forgotten
    assert bus.first_of_each(seen, [(60, "a"), (150, "d")], 100, 16)[0] == [1]  # older than what is remembered
    kept, seen = bus.first_of_each({}, [(i, str(i)) for i in range(20)], 100, 16)
    assert kept == list(range(16)) and bus.first_of_each(seen, [(18, "18")], 100, 16)[0] == []


def test_stream_to_the_bus_over_a_restart(spark, tmp_path):
    schema = _actions(spark, ["x"]).schema

    def run(*batches):
        for ids, at in batches:
            _actions(spark, ids, at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = bus.publish_stream(stream, f"file://{tmp_path}/bus", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(200)
        return sorted(r.query_id for r in bus.delivered(spark, f"file://{tmp_path}/bus").collect())

    assert run((["a", "b"], 0)) == ["a", "b"]
    assert run((["b", "c"], 1000)) == ["a", "b", "c"]
    assert run(([f"n{i:02d}" for i in range(20)], 2000)) == ["a", "b", "c", *(f"n{i:02d}" for i in range(16))]


def test_empty_windows_of_a_pause_are_decided_once():
    asked = []

    def decide(samples, templates, floor):
        asked.append(len(samples))
        return PeakDecision()(samples, templates, floor)

    rnd = random.Random(4)
    template = lambda k: Template(f"t{k}", "c", k, np.array([[50.0]], np.float32))
    at = sorted(rnd.sample(range(4_000_000), 40))
    frames = [(t, t, np.array([rnd.choice([50.0, 90.0])], np.float32)) for t in at]
    changes = [Change(rnd.randrange(at[-1]), rnd.choice(["put", "put", "drop"]), template(k % 5)) for k in range(30)]
    rows = list(Loop(LoopConfig(), decide).feed(frames, changes))
    one = Loop(LoopConfig(), decide)
    one._alike = lambda: 0
    quick, asked[:] = len(asked), []
    assert rows == list(one.feed(frames, changes)) and len(rows) > 500
    assert len(asked) == len(rows) and quick < 150


def test_devices_of_few_rows_are_spread(spark):
    frames = spark.range(400).selectExpr("id % 40 AS device_id", "id * 1000 AS at_ms", "id % 3 = 0 AS hit")
    made = listen_batch(frames).groupBy(F.spark_partition_id()).count()
    assert made.count() > 4


def test_runs_of_windows_are_the_windows_one_by_one(monkeypatch):
    monkeypatch.setattr(listen, "SLICE", 7)
    rnd = random.Random(9)
    for _ in range(200):
        at = sorted(rnd.choices(range(0, rnd.choice([3_000, 40_000, 400_000]), 50), k=rnd.randrange(1, 60)))
        frames = [(t, rnd.random() < 0.3) for t in at]
        made, start = listen.window_runs(np.array([t for t, hit in frames if hit], np.int64), at[0], 1500, 600, at[-1])
        assert all(1 <= n <= 7 and (n == 1 or not matched) for _, n, matched in made)
        assert ([(s + k * 1500, s + (k + 1) * 1500, matched) for s, n, matched in made for k in range(n)], start) == next_windows(frames, at[0], 1500, 600, at[-1])


def test_one_device_s_windows_are_made_by_many_tasks(spark):
    frames = spark.createDataFrame([(1, 0, False), (1, 300_000_000, False)], "device_id long, at_ms long, hit boolean")
    made = listen_batch(frames).groupBy(F.spark_partition_id()).count()
    assert made.count() > 4 and made.agg(F.sum("count")).first()[0] == 200_000


def test_a_pause_of_the_loop_is_few_runs_and_its_windows_are_made_by_many_tasks(spark):
    long = 300_000_000
    template = Template("t", "c", 0, np.array([[9.0]], np.float32))
    frames = [(t, t, np.array([50.0], np.float32)) for t in (0, long)]
    runs = list(Loop(LoopConfig(), PeakDecision()).runs(frames, [Change(0, "put", template)]))
    windows = list(Loop(LoopConfig(), PeakDecision()).feed(frames, [Change(0, "put", template)]))
    assert sum(n for n, *_ in runs) == len(windows) == long // 1500 and len(runs) < 400
    rows = [(1, t, t, [50.0], None, None, None, None, None) for t in (0, long)] + [(1, 0, 0, None, "put", "t", "c", 0, [[9.0]])]
    made = loop_batch(spark.createDataFrame(rows, INPUT), PeakDecision()).persist()
    assert made.groupBy(F.spark_partition_id()).count().count() > 4
    assert [tuple(r)[1:] for r in made.orderBy("window_id").collect()] == windows
    made.unpersist()


def test_windows_of_one_time_lie_near_each_other_on_disk(spark, tmp_path):
    """Times and numbers of windows are the same for many devices; written by device, each took eight bytes before compression."""
    frames = spark.range(300).selectExpr("id AS device_id", "explode(array(id * 50, 6000000 + id * 50)) AS at_ms", "false AS hit")
    listen_batch(frames).coalesce(2).write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == rows.distinct().count() == 300 * 4000 and size < 3 * 300 * 4000
    assert rows.where("end_ms - start_ms <> 1500 OR start_ms <> window_id * 1500 + device_id * 50").count() == 0
