"""Parameters of the engine; the defaults decide results and are fixed values of the recogniser that it matches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CepstraConfig:
    """Front end: `delta` is 0 for static coefficients, 1 with first and 2 with second derivatives."""

    sample_rate_hz: int = 16_000
    frame_ms: int = 25
    shift_ms: int = 10
    filters: int = 26
    coefficients: int = 13
    pre_emphasis: float = 0.97
    low_hz: float = 20.0
    high_hz: float | None = None
    lifter: int = 22
    subtract_mean: bool = True
    delta: int = 0

    @property
    def frame(self) -> int:
        return self.sample_rate_hz * self.frame_ms // 1000

    @property
    def shift(self) -> int:
        return self.sample_rate_hz * self.shift_ms // 1000

    @property
    def fft(self) -> int:
        size = 1
        while size < self.frame:
            size *= 2
        return size

    @property
    def width(self) -> int:
        return self.coefficients * (1 + self.delta)


@dataclass(frozen=True)
class EndpointConfig:
    """Voice-activity endpointing."""

    frame_ms: int = 20
    shift_ms: int = 10
    ratio: float = 3.0
    floor: float = 1e-3
    min_speech_ms: int = 80
    hangover_ms: int = 80
    percentile: float = 0.10


@dataclass(frozen=True)
class MatchConfig:
    threshold: float = 8.0
    band_ratio: float = 0.1
    margin_weight: float = 0.4


@dataclass(frozen=True)
class GateConfig:
    """Streaming energy gate."""

    floor: float = 1e-3
    ratio: float = 3.0
    adaptation: float = 0.05


MIN_ENROL_FRAMES = 8
TEMPLATES_PER_COMMAND = 5
SECONDS_PER_FALSE_ACCEPT = 1800.0
WAKE_COMMAND = "__wake__"
WINDOW_MS, IDLE_MS, AFTER_MATCH_MS = 1500, 800, 600
FRONT_ENDS = {"static": CepstraConfig(), "delta": CepstraConfig(delta=1), "delta_delta": CepstraConfig(delta=2)}
CONDITIONS = ("NORMAL", "TIRED", "ILL", "OTHER")
