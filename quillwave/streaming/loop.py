"""The listening loop as one stateful stream: windows of audio, decided inside the state step, placing the next window.

Rows of one device come in the order of time, as one table: frames, and changes of the device's templates among them.

    device_id, at, upto          the frame's first tick and the one after its last (equal for a single reading)
    samples array<float>         of a frame
    change                       null for a frame, `put` or `drop` for a template
    template_id, command_id, created_at, features    of the template

A tick is whatever `at` counts: samples of audio, or milliseconds of readings; `LoopConfig` is in the same unit.

The loop, for each device, from its first frame on:
1. Changes up to now are applied.  Without templates it sleeps for the idle time and looks again.
2. With templates it waits until frames reach the end of the window, and decides on what they hold between its ends.
3. After a match the next window starts later by the gap, else at once.

So a template counts from the first window that starts after it was put, and never in the middle of one.  Frames that end
before the window's start are late, or lie in a gap, and are left out; of frames with one start the first counts; a
device's pause is a window with what little it holds.  A pause without templates is skipped by arithmetic, however long.

As a batch, the empty windows of a pause go out as one run, of which Spark makes the windows; so what passes through Python
grows with the rows that come in and not with the time they span.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import takewhile
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillwave.config import AFTER_MATCH_MS, IDLE_MS, WAKE_COMMAND, WINDOW_MS, CepstraConfig, EndpointConfig, GateConfig, MatchConfig
from quillwave.functions.cepstra import cepstra
from quillwave.functions.dtw import block_distances
from quillwave.functions.frames import speech_bounds
from quillwave.streaming.gate import gate_step
from quillwave.streaming.listen import SLICE, dealt, pieces, spread

INPUT = "device_id long, at long, upto long, samples array<float>, change string, template_id string, command_id string, created_at long, features array<array<float>>"
OUTPUT = "device_id long, window_id long, start long, end long, idle_steps long, kind string, command_id string, template_id string, distance float, confidence double, reason string"
RUNS = f"n long, {OUTPUT}"
_COLUMNS, _RUN_COLUMNS = ([c.split()[0] for c in x.split(", ")] for x in (OUTPUT, RUNS))
INF = float("inf")


@dataclass(frozen=True)
class LoopConfig:
    """In ticks; the defaults are for ticks of a millisecond."""

    window: int = WINDOW_MS
    idle: int = IDLE_MS
    after_match: int = AFTER_MATCH_MS

    @staticmethod
    def of_rate(rate_hz: int) -> LoopConfig:
        return LoopConfig(*(ms * rate_hz // 1000 for ms in (WINDOW_MS, IDLE_MS, AFTER_MATCH_MS)))


class Template(NamedTuple):
    template_id: str
    command_id: str
    created_at: int
    features: np.ndarray


class Decision(NamedTuple):
    kind: str
    command_id: str | None = None
    template_id: str | None = None
    distance: float = INF
    confidence: float | None = None
    reason: str | None = None


class Change(NamedTuple):
    at: int
    op: str
    template: Template


#: What a window is decided by: its samples, the templates, and the noise floor so far; gives the floor on.
Decide = Callable[[np.ndarray, list[Template], float], tuple[Decision, float]]


def best_match(features: np.ndarray, templates: Iterable[Template], match: MatchConfig, threshold: float | None = None) -> Decision:
    """The nearest command by its nearest template; ties go to command, age and id.  Templates of another width are skipped."""
    best: dict[str, tuple] = {}
    by_length: dict[int, list[Template]] = {}
    for t in templates:
        if len(t.features) and t.features.shape[1] == features.shape[1]:
            by_length.setdefault(len(t.features), []).append(t)
    for some in by_length.values():
        near = block_distances(features[None], np.stack([t.features for t in some]), match.band_ratio)[0].astype(np.float32)
        for d, t in zip(near, some, strict=True):
            found = (d, t.created_at, t.template_id)
            best[t.command_id] = min(best.get(t.command_id, found), found)
    if not best:
        return Decision("NO_MATCH", reason="NO_TEMPLATES")
    order = sorted((*found, command) for command, found in best.items())
    order.sort(key=lambda x: (x[0], x[3]))
    d, _, template, command = order[0]
    limit = np.float32(match.threshold if threshold is None else threshold)
    if d > limit:
        return Decision("NO_MATCH", command, template, float(d), None, "BELOW_CONFIDENCE")
    clamp = lambda x: min(max(x, 0.0), 1.0)
    d, limit, runner_up = float(d), float(limit), float(order[1][0]) if len(order) > 1 else INF
    base = clamp(1 - d / limit) if limit > 0 else 0.0
    margin = 1.0 if runner_up <= 0 or runner_up == INF else clamp((runner_up - d) / runner_up)
    return Decision("MATCH", command, template, d, clamp((1 - match.margin_weight) * base + match.margin_weight * margin))


@dataclass(frozen=True)
class AudioDecision:
    """Audio of one rate; with a wake threshold, an energy gate and the wake word let a window through to the commands."""

    config: CepstraConfig = CepstraConfig()
    endpoint: EndpointConfig = EndpointConfig()
    match: MatchConfig = MatchConfig()
    wake_threshold: float | None = None
    gate: GateConfig = GateConfig()

    def __call__(self, samples: np.ndarray, templates: list[Template], floor: float) -> tuple[Decision, float]:
        if self.wake_threshold is not None:
            level = float(np.sqrt((samples.astype(np.float64) ** 2).mean())) if len(samples) else None
            spoken, floor = gate_step(level, floor, self.gate)
            if not spoken:
                return Decision("NO_MATCH", reason="QUIET"), floor
            reason = self._asleep(samples, [t for t in templates if t.command_id == WAKE_COMMAND])
            if reason:
                return Decision("NO_MATCH", reason=reason), floor
            templates = [t for t in templates if t.command_id != WAKE_COMMAND]
        bounds = speech_bounds(samples, self.config.sample_rate_hz, self.endpoint)
        heard = cepstra(samples[slice(*bounds)], self.config) if bounds else np.zeros((0, 0), np.float32)
        if not len(heard):
            return Decision("NO_MATCH", reason="SILENCE" if len(samples) else "EMPTY_INPUT"), floor
        return best_match(heard, templates, self.match), floor

    def _asleep(self, samples: np.ndarray, wake: list[Template]) -> str | None:
        if not wake:
            return "NO_WAKE_ENROLLED"
        heard = cepstra(samples, self.config)
        if not len(heard):
            return "NO_SPEECH"
        first = min(wake, key=lambda t: (t.created_at, t.template_id))
        found = best_match(heard, [t for t in wake if t.command_id == first.command_id], self.match, self.wake_threshold)
        return None if found.kind == "MATCH" else "BELOW_THRESHOLD"


@dataclass(frozen=True)
class PeakDecision:
    """Readings instead of audio: the window's highest one is a sequence of one frame and one value."""

    match: MatchConfig = MatchConfig()

    def __call__(self, samples: np.ndarray, templates: list[Template], floor: float) -> tuple[Decision, float]:
        if not len(samples):
            return Decision("NO_MATCH", reason="EMPTY_INPUT"), floor
        return best_match(samples.max().astype(np.float32).reshape(1, 1), templates, self.match), floor


@dataclass
class Loop:
    """One device: where the next window starts, and what is held for it.  `feed` gives the windows that became complete."""

    config: LoopConfig
    decide: Decide
    place: int | None = None
    number: int = 0
    idle: int = 0
    known: int = -(1 << 62)
    floor: float = GateConfig().floor
    frames: deque[tuple[int, int, np.ndarray]] = field(default_factory=deque)
    changes: list[Change] = field(default_factory=list)
    templates: dict[str, Template] = field(default_factory=dict)

    def feed(self, frames: Iterable[tuple[int, int, np.ndarray]], changes: Iterable[Change]) -> Iterator[tuple]:
        for n, number, start, end, *found in self.runs(frames, changes):
            for k in range(n):
                past = k * self.config.window
                yield number + k, start + past, end + past, *found

    def runs(self, frames: Iterable[tuple[int, int, np.ndarray]], changes: Iterable[Change]) -> Iterator[tuple]:
        """The windows of `feed` with those that are decided alike as one, cut as by `pieces`: how many, and the first of them."""
        self.changes = sorted([*self.changes, *changes], key=lambda c: c.at)
        for frame in frames:
            if self.place is None:
                self.place = frame[0]
            if frame[1] > self.place or frame[0] >= self.place:
                self._hold(frame)
            self.known = max(self.known, frame[1])
        while self.place is not None:
            while self.changes and self.changes[0].at <= self.place:
                self._apply(self.changes.pop(0))
            step = self._sleep() if not self.templates else None
            if step is None:
                if self.known < self.place + self.config.window:
                    return
                yield from self._windows()
            elif not step:
                return
            while self.frames and self.frames[0][0] < self.place and self.frames[0][1] <= self.place:
                self.frames.popleft()

    def _hold(self, frame: tuple[int, int, np.ndarray]) -> None:
        """Frames are held in the order of their starts; mostly the new one is the last."""
        later = []
        while self.frames and self.frames[-1][0] > frame[0]:
            later.append(self.frames.pop())
        if not self.frames or self.frames[-1][0] != frame[0]:
            self.frames.append(frame)
        self.frames.extend(reversed(later))

    def _apply(self, change: Change) -> None:
        if change.op == "put":
            self.templates[change.template.template_id] = change.template
        else:
            self.templates.pop(change.template.template_id, None)

    def _sleep(self) -> int:
        """Idle steps that are over by now, up to the next change."""
        steps = max(0, (self.known - self.place) // self.config.idle)
        if self.changes:
            steps = min(steps, -((self.place - self.changes[0].at) // self.config.idle))
        self.place += steps * self.config.idle
        self.idle += steps
        return steps

    def _windows(self) -> Iterator[tuple]:
        """The next window, and those after it that nothing is heard in and no change reaches: they are decided alike."""
        start, end, floor = self.place, self.place + self.config.window, self.floor
        parts = [samples[max(0, start - at) : max(1, end - at)] for at, upto, samples in takewhile(lambda f: f[0] < end, self.frames) if upto > start or at >= start]
        found, self.floor = self.decide(np.concatenate(parts) if parts else np.zeros(0, np.float32), sorted(self.templates.values(), key=lambda t: (t.created_at, t.template_id)), self.floor)
        yield 1, self.number, start, end, self.idle, *found
        self.place, self.number, self.idle = end + (self.config.after_match if found.kind == "MATCH" else 0), self.number + 1, 0
        if not parts and found.kind != "MATCH" and self.floor == floor:
            for first, n in pieces(self.place, self._alike(), self.config.window):
                yield n, self.number, first, first + self.config.window, 0, *found
                self.place, self.number = first + n * self.config.window, self.number + n

    def _alike(self) -> int:
        """How many windows from here on are complete, without frames, and begin before the next change."""
        until = next((at for at, upto, _ in self.frames if upto > self.place or at >= self.place), self.known)
        count = (min(until, self.known) - self.place) // self.config.window
        if self.changes:
            count = min(count, -((self.place - self.changes[0].at) // self.config.window))
        return max(0, count)


def _told(rows: pd.DataFrame) -> tuple[list[tuple[int, int, np.ndarray]], list[Change]]:
    """Frames and changes of rows of one device."""
    frame = rows["change"].isna()
    told = rows[~frame]
    frames = [(int(a), int(b), np.asarray(x if x is not None else [], np.float32)) for a, b, x in zip(*(rows.loc[frame, c] for c in ("at", "upto", "samples")), strict=True)]
    matrix = lambda f: np.array([np.asarray(r, np.float32) for r in f], np.float32) if f is not None and len(f) else np.zeros((0, 0), np.float32)
    made = (Template(t, c, 0 if pd.isna(n) else int(n), matrix(f)) for t, c, n, f in zip(*(told[c] for c in ("template_id", "command_id", "created_at", "features")), strict=True))
    return sorted(frames, key=lambda f: f[0]), [Change(int(a), op, t) for a, op, t in zip(told["at"], told["change"], made, strict=True)]


def _table(device: int, made: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(device, *row) for row in made], columns=_COLUMNS)


def _run_table(made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(made, columns=_RUN_COLUMNS)


def loop_batch(rows: DataFrame, decide: Decide, config: LoopConfig = LoopConfig()) -> DataFrame:
    """The loop over rows that are all there; a device is one ordered run that streams through a task."""
    columns, tasks = [c.split()[0] for c in INPUT.split(", ")], spread(rows.sparkSession)
    ordered = rows.select(*columns).repartition(tasks, "device_id").sortWithinPartitions("device_id", "at", "change")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, loop = None, Loop(config, decide)
        for pdf in parts:
            out = []
            for d, own in pdf.groupby("device_id", sort=False):
                if d != device:
                    device, loop = d, Loop(config, decide)
                for n, *row in loop.runs(*_told(own)):
                    out.append((n, device, *row))
                    if len(out) == SLICE:
                        yield _run_table(out)
                        out = []
            yield _run_table(out)

    each = dealt(ordered.mapInPandas(run, RUNS), "start", config.window, tasks)
    steps = {"window_id": F.col("k"), "start": F.col("k") * config.window, "end": F.col("k") * config.window}
    return each.select(*[(F.col(c) + steps[c]).alias(c) if c in steps else c for c in _COLUMNS])


class Listening(StatefulProcessor):
    """`Loop` with its fields in the state store."""

    PLACE = "place long, number long, idle long, known long, floor double"
    FRAME = "at long, upto long, samples binary"
    TEMPLATE = "at long, op string, template_id string, command_id string, created_at long, frames int, features binary"

    def __init__(self, config: LoopConfig, decide: Decide):
        self.config, self.decide = config, decide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", self.PLACE)
        self.frames = handle.getListState("frames", self.FRAME)
        self.changes = handle.getListState("changes", self.TEMPLATE)
        self.templates = handle.getListState("templates", self.TEMPLATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        loop = Loop(self.config, self.decide)
        if self.place.exists():
            place, loop.number, loop.idle, loop.known, loop.floor = self.place.get()
            loop.place = None if place == self._NONE else place
        loop.frames = deque((at, upto, np.frombuffer(raw, np.float32)) for at, upto, raw in self.frames.get())
        loop.changes = [self._change(row) for row in self.changes.get()]
        loop.templates = {c.template.template_id: c.template for c in map(self._change, self.templates.get())}
        made = _table(key[0], loop.feed(*_told(pd.concat(list(rows)))))
        self.place.update((self._NONE if loop.place is None else loop.place, loop.number, loop.idle, loop.known, loop.floor))
        self._keep(self.frames, [(at, upto, samples.astype(np.float32).tobytes()) for at, upto, samples in loop.frames])
        self._keep(self.changes, [self._row(c) for c in loop.changes])
        self._keep(self.templates, [self._row(Change(0, "put", t)) for t in loop.templates.values()])
        yield made

    _NONE = -(1 << 63)

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    @staticmethod
    def _row(c: Change) -> tuple:
        return c.at, c.op, c.template.template_id, c.template.command_id, c.template.created_at, len(c.template.features), c.template.features.astype(np.float32).tobytes()

    @staticmethod
    def _change(row) -> Change:
        at, op, template, command, created, n, raw = row
        return Change(at, op, Template(template, command, created, np.frombuffer(raw, np.float32).reshape(n, -1) if n else np.zeros((0, 0), np.float32)))

    def close(self) -> None:
        pass


def loop_stream(rows: DataFrame, decide: Decide, config: LoopConfig = LoopConfig()) -> DataFrame:
    """The same over a stream; needs the RocksDB state store."""
    return rows.groupBy("device_id").transformWithStateInPandas(Listening(config, decide), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
