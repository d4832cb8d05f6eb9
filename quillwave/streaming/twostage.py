"""Two stages over captured windows: an energy gate and the wake word let a window through to the commands.

`windows`: (device_id, seq, samples array<float>).  Each stage works on what the one before let through, so the dear
ones see little: the gate needs a level a window, the wake stage compares with the wake command's templates alone, and
only windows that wake are trimmed and compared with the other commands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.config import WAKE_COMMAND, CepstraConfig, EndpointConfig, GateConfig, MatchConfig
from quillwave.functions.frames import rms
from quillwave.operators.decide import backend_projection, decide, wake_decision, wake_thresholds, without_reserved
from quillwave.operators.pairing import best_per_command, pair_distances
from quillwave.operators.recognise import audio_features, recognise
from quillwave.streaming.gate import gate_batch, gate_stream

Sink = Callable[[DataFrame, int], None]


def with_level(windows: DataFrame) -> DataFrame:
    """An empty window has no level and is never speech."""
    return windows.withColumn("level", F.when(F.size("samples") > 0, rms(F.col("samples")).cast("double")))


def wake_stage(spoken: DataFrame, templates: DataFrame, threshold: float, config: CepstraConfig = CepstraConfig(), match: MatchConfig = MatchConfig()) -> DataFrame:
    """(query_id, wake, distance, reason) of windows (query_id, samples) that passed the gate; they are taken untrimmed."""
    wake = templates.where(F.col("command_id") == WAKE_COMMAND)
    heard = audio_features(spoken.select("query_id", "samples"), config, endpoint=None)
    best = best_per_command(pair_distances(heard, wake, match.band_ratio))
    found = wake_decision(decide(heard, best, wake_thresholds(wake, threshold), match))
    enrolled = wake.agg((F.count("*") > 0)).scalar()
    return found.withColumn("reason", F.when(~enrolled, F.lit("NO_WAKE_ENROLLED")).otherwise(F.col("reason")))


def recognise_spoken(spoken: DataFrame, templates: DataFrame, wake_threshold: float, config: CepstraConfig = CepstraConfig(), endpoint: EndpointConfig = EndpointConfig(), match: MatchConfig = MatchConfig(), thresholds: DataFrame | None = None) -> DataFrame:
    """Both stages over windows (device_id, seq, samples) that passed the gate.

    device_id, seq, wake, wake_reason, and of windows that woke command_id, confidence and rejection.
    """
    keyed = spoken.select("device_id", "seq", F.concat_ws("/", "device_id", "seq").alias("query_id"), "samples")
    woke = wake_stage(keyed, templates, wake_threshold, config, match).withColumnRenamed("reason", "wake_reason")
    let_in = keyed.join(woke.where("wake").select("query_id"), "query_id", "left_semi")
    asked = audio_features(let_in.select("query_id", "samples"), config, endpoint)
    found = backend_projection(recognise(asked, without_reserved(templates), thresholds, match))
    return keyed.select("device_id", "seq", "query_id").join(woke.select("query_id", "wake", "wake_reason"), "query_id").join(found, "query_id", "left")


def two_stage_batch(windows: DataFrame, templates: DataFrame, wake_threshold: float, gate: GateConfig = GateConfig(), **options) -> DataFrame:
    """Gate, wake word and commands over windows that are all there; one row a window that the gate let through."""
    gated = gate_batch(with_level(windows).select("device_id", "seq", "level"), gate).where("speech").select("device_id", "seq")
    return recognise_spoken(windows.join(gated, ["device_id", "seq"], "left_semi"), templates, wake_threshold, **options)


def two_stage_stream(windows: DataFrame, templates: Callable[[], DataFrame], wake_threshold: float, sink: Sink, gate: GateConfig = GateConfig(), **options):
    """The same over a stream, as a writer to start: the gate keeps its state, each batch asks for the templates anew.

    So a template enrolled while it runs counts from the next batch on.
    """
    spoken = gate_stream(with_level(windows), gate).where("speech").select("device_id", "seq", "samples")
    return spoken.writeStream.foreachBatch(lambda batch, epoch: sink(recognise_spoken(batch, templates(), wake_threshold, **options), epoch))
