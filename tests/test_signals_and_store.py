import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.config import CepstraConfig, EndpointConfig, GateConfig
from quillwave.functions import cepstra as C
from quillwave.functions.frames import framed, rms, segment, trim
from quillwave.operators.enrol import numbered
from quillwave.operators.recognise import audio_features, enrol_audio
from quillwave.sources import actions, pcm, store
from quillwave.streaming.gate import gate_batch, gate_fold, gate_step, gate_stream
from quillwave.streaming.listen import listen_batch, listen_stream, next_windows
from quillwave.streaming.twostage import two_stage_batch, two_stage_stream


def tone(hz, ms, amp=0.3, rate=16000):
    return (amp * np.sin(2 * np.pi * hz * np.arange(rate * ms // 1000) / rate)).astype("float32")


def test_widths_frames_and_static_block():
    x = tone(440, 500)
    wide = [C.cepstra(x, CepstraConfig(delta=k)) for k in range(3)]
    assert [w.shape for w in wide] == [(48, 13), (48, 26), (48, 39)]
    assert (wide[2][:, :13] == wide[0]).all() and (wide[2][:, :26] == wide[1]).all()
    assert C.cepstra(tone(440, 10), CepstraConfig()).shape[0] == 0
    assert np.abs(C.cepstra(x, CepstraConfig()).mean(axis=0)).max() < 1e-4


def test_second_derivative_of_a_ramp_is_flat():
    ramp = np.repeat(np.arange(20, dtype=np.float32)[:, None], 4, axis=1)
    assert np.abs(C.derivative(C.derivative(ramp))[2:18]).max() == 0


def test_spectrum_peaks_where_the_tone_is():
    c = CepstraConfig(sample_rate_hz=64, frame_ms=1000)
    frame = np.cos(2 * np.pi * 5 * np.arange(64) / 64)[None].astype("float32")
    assert c.fft == 64 and C.power(frame, c).shape == (1, 33) and C.power(frame, c)[0].argmax() == 5


def test_endpointing(spark):
    pad = np.zeros(3200, "float32")
    rows = [(1, np.concatenate([pad, tone(440, 400), pad]).tolist()), (2, pad.tolist()), (3, tone(440, 500).tolist()), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "i int, samples array<float>").select("i", segment(F.col("samples"), 16000).alias("s"), F.size(trim(F.col("samples"), segment(F.col("samples"), 16000))).alias("n"))
    got = {r.i: r for r in df.collect()}
    assert got[1].s is not None and got[1].s.start_sample < 3200 < got[1].s.end_sample < 12800
    assert all(got[i].s is None and got[i].n == 0 for i in (2, 3, 4, 5))  # a tone without silence is its own floor


def test_frames_of_short_signals(spark):
    df = spark.createDataFrame([([1.0] * n,) for n in (0, 3, 4, 7)], "x array<float>")
    assert sorted(r[0] for r in df.select(F.size(framed(F.col("x"), 4, 2))).collect()) == [0, 0, 1, 2]
    assert spark.range(1).select(rms(F.array().cast("array<float>"))).first()[0] == 0


def test_codec_round_trip_and_short_bytes():
    frames = [[1.5, -2.25, 0.0], [3.125, 4.0, -5.5]]
    assert store.decode_features(store.encode_features(frames)) == frames
    assert store.decode_features(b"") == [] and store.decode_features(None) == [] and store.encode_features([]) == struct.pack("<ii", 0, 0)
    with pytest.raises(ValueError):
        store.decode_features(store.encode_features(frames)[:-4])


def test_store_upsert_keeps_templates_and_delete_cascades(spark, tmp_path):
    s = store.TemplateStore(spark, f"file://{tmp_path}/store")
    commands = spark.createDataFrame([("a", "Alpha", "HOME"), ("b", "Beta", "BACK")], store.COMMAND_SCHEMA)
    s.upsert_commands(commands)
    s.add_templates(spark.createDataFrame([("t1", "a", "NORMAL", 1, [[1.0]]), ("t2", "b", "ODD", 2, [[2.0]])], store.TEMPLATE_SCHEMA))
    s.upsert_commands(commands.where("command_id = 'a'").withColumn("label", F.lit("New")))
    assert s.templates().count() == 2 and s.commands().where("label = 'New'").count() == 1
    s.delete_commands(spark.createDataFrame([("a",)], "command_id string"))
    assert [r.template_id for r in s.templates().collect()] == ["t2"] and s.commands().count() == 1
    counts = store.template_counts(commands, s.templates()).collect()
    assert {r.command_id: r.templates for r in counts} == {"a": 0, "b": 1}


def test_store_changes_by_two_writers_are_both_kept(spark, tmp_path):
    s = store.TemplateStore(spark, f"file://{tmp_path}/store")
    row = lambda i: spark.createDataFrame([(i, i.upper(), "HOME")], store.COMMAND_SCHEMA)
    s.upsert_commands(row("a"))
    turns = []

    def slow(commands, templates):
        if not turns:  # another writer comes first
            store.TemplateStore(spark, s.folder).upsert_commands(row("b"))
        turns.append(commands.count())
        return {"commands": store.upsert(commands, row("c"), "command_id")}

    assert s.change(slow) == 3 and turns == [1, 2]
    assert sorted(r.command_id for r in s.commands().collect()) == ["a", "b", "c"]


def test_live_query_sees_changes(spark, tmp_path):
    s, seen = store.TemplateStore(spark, f"file://{tmp_path}/store"), []
    s.upsert_commands(spark.createDataFrame([("a", "A", "HOME")], store.COMMAND_SCHEMA))
    running = s.live(lambda commands, templates, epoch: seen.append(sorted(r.command_id for r in commands.collect())), f"{tmp_path}/cp").start()
    try:
        running.processAllAvailable()
        s.upsert_commands(spark.createDataFrame([("b", "B", "HOME")], store.COMMAND_SCHEMA))
        running.processAllAvailable()
    finally:
        running.stop()
    assert seen == [["a"], ["a", "b"]]


def test_codec_of_columns_agrees_with_the_functions(spark):
    rows = [(1, [[1.5, -2.0], [3.0, 4.0]]), (2, []), (3, None), (4, [[0.25]])]
    df = spark.createDataFrame(rows, "i int, features array<array<float>>")
    raw = {r.i: bytes(r.raw) for r in store.with_encoded(df).collect()}
    assert raw == {i: store.encode_features(f) for i, f in rows}
    assert {r.i: r.features for r in store.with_decoded(store.with_encoded(df)).collect()} == {i: f or [] for i, f in rows}


def test_published_epochs_are_written_once(spark, tmp_path):
    sink = actions.publish(f"file://{tmp_path}/out")
    batch = spark.createDataFrame([(1, "HOME"), (1, "HOME"), (2, "BACK")], "query_id long, action string")
    for epoch in (0, 0, 1):
        sink(batch.where("query_id = 2") if epoch else batch, epoch)
    assert sorted((r.epoch, r.query_id) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(0, 1), (0, 2), (1, 2)]


def _wav(samples):
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_capture_stream_chops_recordings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7-0.wav").write_bytes(_wav(tone(440, 50)))
    (tmp_path / "in" / "7-1.wav").write_bytes(_wav(tone(440, 20)))
    q = pcm.capture_stream(spark, f"{tmp_path}/in", 20).writeStream.format("memory").queryName("captured").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.device_id, r.seq, len(r.samples)) for r in spark.table("captured").collect())
    assert got == [(7, 0, 320), (7, 1, 320), (7, 2, 160), (7, 1 << 32, 320)]


def test_audio_enrolment_gives_templates_or_reasons(spark):
    pad = np.zeros(3200, "float32")
    good = np.concatenate([pad, tone(440, 400), pad])
    short = np.concatenate([pad, tone(440, 90), pad])
    rows = [(1, "A", good, 16000), (2, "A", [], 16000), (3, "B", pad, 16000), (4, "B", good, 8000), (5, "B", short, 16000)]
    df = spark.createDataFrame([(i, c, "NORMAL", [float(v) for v in x], r) for i, c, x, r in rows], "seq long, command_id string, condition string, samples array<float>, sample_rate_hz int")
    templates, rejected = enrol_audio(df, min_frames=40)
    assert [(r.template_id, r.command_id, r.created_at) for r in templates.collect()] == [("eval-1", "A", 1)]
    assert {r.seq: r.reason for r in rejected.collect()} == {2: "TOO_SHORT", 3: "SILENT", 4: "WRONG_RATE", 5: "TOO_FEW_FRAMES"}


def test_numbers_follow_the_order_whatever_the_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = sorted((r.seq, r.k) for r in numbered(df, "k").collect())
    assert got == [(i + 1, k) for i, k in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))]


def _two_stage_fixture(spark):
    """Windows of two devices: silence, the wake word alone, a command after it, and noise that the gate stops."""
    pad = np.zeros(3200, "float32")
    wake, command = np.concatenate([pad, tone(300, 400), pad]), np.concatenate([pad, tone(1200, 400), pad])
    windows = [(1, 0, pad), (1, 1, wake), (1, 2, command), (2, 0, command), (2, 1, wake), (2, 2, [])]
    df = spark.createDataFrame([(d, s, [float(v) for v in x]) for d, s, x in windows], "device_id long, seq long, samples array<float>")
    t = spark.createDataFrame([(1, "__wake__", "NORMAL", [float(v) for v in wake]), (2, "go", "NORMAL", [float(v) for v in command])], "seq long, command_id string, condition string, samples array<float>")
    untrimmed = audio_features(t.where("seq = 1"), endpoint=None).select(F.lit("w").alias("template_id"), "command_id", "condition", F.col("seq").alias("created_at"), "features")
    return df, untrimmed.unionByName(enrol_audio(t.where("seq = 2"))[0])


def test_two_stages_let_only_woken_windows_through(spark, tmp_path):
    windows, templates = _two_stage_fixture(spark)
    got = {(r.device_id, r.seq): (r.wake, r.wake_reason, r.command_id, r.rejection) for r in two_stage_batch(windows, templates, 1.0).collect()}
    assert got.keys() == {(1, 1), (1, 2), (2, 0), (2, 1)}  # silence and the empty window stop at the gate
    assert got[1, 2] == (False, "BELOW_THRESHOLD", None, None) and got[2, 0][0] is False
    assert got[1, 1][0] is True and got[1, 1][3] == "LOW_CONFIDENCE"  # it woke, and is none of the commands
    wide = {(r.device_id, r.seq): r.command_id for r in two_stage_batch(windows, templates, 1000.0).collect()}
    assert wide[1, 2] == "go" and wide[2, 0] == "go"
    none = two_stage_batch(windows, templates.where("command_id = 'go'"), 1.0).collect()
    assert {r.wake_reason for r in none} == {"NO_WAKE_ENROLLED"} and len(none) == 4
    windows.where("seq < 2").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    windows.where("seq = 2").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept = templates.persist()
    out = []
    q = two_stage_stream(stream, lambda: kept, 1.0, lambda batch, epoch: out.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert {(r.device_id, r.seq): (r.wake, r.wake_reason, r.command_id, r.rejection) for r in out} == got


def test_listening_stream_agrees_with_the_batch(spark, tmp_path):
    rows = [(d, t, (t + d) % 1700 == 0) for d in (1, 2) for t in range(0, 9000, 100)]
    df = spark.createDataFrame(rows, "device_id long, at_ms long, hit boolean")
    want = sorted(tuple(r) for r in listen_batch(df).collect())
    df.where("at_ms < 4000").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df.where("at_ms >= 4000").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = listen_stream(stream).writeStream.format("memory").queryName("listened").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("listened").collect()) == want


def test_wav_source(spark, tmp_path):
    body = struct.pack("<4h", 0, 16384, -32768, 32767)
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(body))
    (tmp_path / "x.wav").write_bytes(head + body)
    row = pcm.read_wav(spark, f"file://{tmp_path}").first()
    assert row.sample_rate_hz == 16000 and row.samples[:3] == [0.0, 0.5, -1.0] and row.samples[3] < 1


def test_route_drops_what_is_not_known(spark):
    results = spark.createDataFrame([(1, "MATCH", "a"), (2, "MATCH", "gone"), (3, "NO_MATCH", None), (4, "MATCH", "odd")], "query_id long, kind string, command_id string")
    commands = spark.createDataFrame([("a", "A", "HOME"), ("odd", "O", "FLY")], "command_id string, label string, action string")
    assert [r.query_id for r in actions.routed(results, commands).collect()] == [1]


def test_gate_step():
    c = GateConfig()
    assert gate_step(None, 0.5, c) == (False, 0.5) and gate_step(0.1, 1e-3, c) == (True, 1e-3)
    said, floor = gate_step(2e-3, 1e-3, c)
    assert not said and floor == pytest.approx(1.05e-3)


LEVELS = [(d, i, float((i * 7 + d * 3) % 11)) for d in (1, 2) for i in range(40)]


def test_gate_forms_agree(spark, tmp_path):
    df = spark.createDataFrame(LEVELS, "device_id long, seq long, level double")
    c = GateConfig(floor=1.0)
    batch = {(r.device_id, r.seq): (r.speech, round(r.floor, 9)) for r in gate_batch(df, c).collect()}
    fold = df.groupBy("device_id").agg(gate_fold(F.transform(F.array_sort(F.collect_list(F.struct("seq", "level"))), lambda x: x["level"]), c).alias("o"))
    for r in fold.collect():
        assert [(o.speech, round(o.floor, 9)) for o in r.o] == [batch[r.device_id, i] for i in range(40)]
    df.where("seq < 20").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df.where("seq >= 15").coalesce(1).write.parquet(f"{tmp_path}/in/b")  # five late rows a device
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = gate_stream(stream, c).writeStream.format("memory").queryName("gate_out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.device_id, r.seq): (r.speech, round(r.floor, 9)) for r in spark.table("gate_out").collect()}
    assert got == batch  # late rows were dropped, the state went on


def test_windows_leave_a_gap_after_a_match(spark):
    hits = [(t, t == 1000) for t in range(0, 8000, 100)]
    made, start = next_windows(hits, 0, 1500, 600, 8000)
    assert made[:2] == [(0, 1500, True), (2100, 3600, False)] and start == 6600
    df = spark.createDataFrame([(1, t, h) for t, h in hits], "device_id long, at_ms long, hit boolean")
    assert [(r.start_ms, r.end_ms, r.matched) for r in listen_batch(df).orderBy("window_id").collect()] == next_windows(hits, 0, 1500, 600, 7900)[0]


def test_recordings_made_in_blocks_are_those_of_the_expression(spark):
    rnd = np.random.default_rng(3)
    specs = [(i, "enrol", f"c{i % 3}" if i % 5 else None, "NORMAL", 300.0 + 900 * rnd.random(), 1500 * rnd.random(), 0.3 * rnd.random(), 0.25 * (i % 2)) for i in range(600)]
    specs += [(600, "negative", None, "TIRED", None, 1.0, 0.3, 0.0), (601, "negative", None, "TIRED", float("nan"), 1.0, 0.3, 0.0)]
    df = spark.createDataFrame(specs, "seq long, kind string, truth string, condition string, f0 double, f1 double, amp double, noise double").coalesce(1)
    want = [tuple(r) for r in pcm.sounded(df, 20, 10).collect()]
    made = pcm.sounded_blocks(df, 20, 10)
    assert "lambdafunction" not in made._jdf.queryExecution().toString()
    assert list(map(repr, want)) == [repr(tuple(r)) for r in made.collect()] and None in want[600][4]


def test_endpoints_beside_the_features_are_those_of_the_expression(spark):
    """Also of signals with nulls and with values that are no numbers; no lambda runs for a sample."""
    rnd = np.random.default_rng(4)
    config, endpoint = CepstraConfig(), EndpointConfig()
    signals = [[float(v) for a, n in zip(rnd.choice([1e-4, 1e-3, 0.2], 4), rnd.integers(0, 2500, 4), strict=True) for v in rnd.normal(0, a, n).astype(np.float32)] for _ in range(30)]
    for x in signals[:24]:
        for at in rnd.integers(0, max(1, len(x)), rnd.integers(1, 5)) if x else []:
            x[at] = rnd.choice(np.array([None, math.nan, math.inf], object))
    signals[28:] = [None, []]
    df = spark.createDataFrame(list(enumerate(signals)), "i int, samples array<float>")
    made = audio_features(df, config, endpoint)
    assert "lambdafunction" not in made._jdf.queryExecution().toString()
    cut = df.withColumn("samples", trim(F.col("samples"), segment(F.col("samples"), config.sample_rate_hz, endpoint)))
    want = {r.i: r for r in C.with_features(cut, config, "samples", ["i"]).collect()}
    rows = made.collect()
    assert [repr(r.features) for r in rows] == [repr(want[r.i].features) for r in rows]
    assert sum(r.frame_count > 0 for r in rows) > 5 and [r.silent for r in rows if r.i >= 28] == [False, False]
