"""Keyed-state processors.

An ordering processor per machine holds rows back until the watermark has passed
their time, so that what depends on the previous row sees rows in order of time
however they arrive. What it hands on goes to finer keys: windows per machine
and sensor, cooldowns per machine and rule, so a busy machine keeps several
tasks busy and the ordering step does little per row.

Rows cross to Python and back as one text column: a few numbers, then what the
processor need not read, as JSON. Every further column would cost more than the
work on it. For the same reason the grouping key is a bucket of machines (of
sensors, of rules) and state a map inside it, one entry per machine (machine and
sensor, machine and rule): a group's fixed cost is paid per bucket.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from math import isfinite
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wearline.functions.windowing import MICROS
from wearline.streaming.windows import SensorWindows

#: Waiting rows in one stored text.
PACKED = 4096
#: ``at`` of a row without a time, and the state's name of rows without a machine.
NO_TIME, NOBODY = "-", "\x00"


def _grouped(rows: Iterable[tuple]) -> dict[Any, list[tuple]]:
    """Rows by their first element, the rest of each in a list."""
    out: dict[Any, list[tuple]] = {}
    for key, *rest in rows:
        out.setdefault(key, []).append(tuple(rest))
    return out


class InOrder(StatefulProcessor):
    """Rows of a bucket of machines, each machine's by ``(at, seq)``; a row's ``body`` is ``at seq marks json``.

    With ``waits`` a row is kept until the watermark reaches its time ``at``
    (microseconds); a timer then hands on all rows that are due, in order. A row
    whose time the watermark has passed already is late: it is handed on at once,
    marked, and touches no state. Without ``waits`` rows are handed on as they
    come, in order within a micro-batch. Rows without a time count as late.

    Subclasses give ``known_schema`` (its first column is the time of the last
    row), ``opened`` (the state when there is none), ``step`` (state and row to
    state and output) and ``late`` (the output of a late row); ``read`` and
    ``written`` turn a stored entry into the state and back. ``idle_ms``: a
    machine without rows for so long is forgotten, by event time with ``waits``
    (a sweep of the bucket's entries) and by processing time without.

    Waiting rows are stored as texts of up to ``PACKED`` rows, with their earliest
    time: a row's own list entry would cost more than its step, and a text that is
    not due yet is passed over unread.
    """

    known_schema: str

    def __init__(self, waits: bool, idle_ms: int | None = None):
        self.waits, self.idle = waits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.waits else self.idle
        self.known = handle.getMapState("known", "machine string", self.known_schema, ttl)
        schema = "first long, rows string"
        self.pending = handle.getListState("pending", schema) if self.waits else None
        self.sweep = handle.getValueState("sweep", "at long") if self.waits and self.idle is not None else None

    def opened(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, at: int, seq: int, body: str) -> tuple[tuple, str]:
        raise NotImplementedError

    def late(self, at: str, seq: str, body: str) -> str:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 if self.waits else 0
        fresh = []
        for _, machine, text in rows:
            at, seq, body = text.split(" ", 2)
            if at == NO_TIME or (passed > 0 and int(at) <= passed):
                yield Row(machine_id=machine, body=self.late(at, seq, body))
            else:
                fresh.append((machine, int(at), int(seq), body))
        if not fresh:
            return
        if self.waits:
            texts = self._packed(fresh)
            self.pending.appendList(texts)
            self.handle.registerTimer(self._due(min(first for first, _ in texts)))
        else:
            yield from self._hand_on(fresh, timerValues)

    @staticmethod
    def _packed(rows: list[tuple]) -> list[tuple[int, str]]:
        rows = sorted(rows, key=lambda r: r[1])
        parts = [rows[i : i + PACKED] for i in range(0, len(rows), PACKED)]
        return [(part[0][1], json.dumps(part)) for part in parts]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        texts = [tuple(t) for t in self.pending.get()] if self.pending.exists() else []
        rest, due = [], []
        for first, text in texts:
            if first > passed:
                rest.append((first, text))
            else:
                rows = json.loads(text)
                due += [r for r in rows if r[1] <= passed]
                rest += self._packed([r for r in rows if r[1] > passed])
        if due:
            if rest:
                self.pending.put(rest)
                self.handle.registerTimer(self._due(min(first for first, _ in rest)))
            else:
                self.pending.clear()
            yield from self._hand_on(due, timerValues)
        if self.sweep is not None:
            self._forget(passed // 1000)

    def _forget(self, now: int) -> None:
        """Once every ``idle`` milliseconds of event time, drop the machines that were silent for as long."""
        planned = self.sweep.get()
        if planned is not None and now < planned[0]:
            return
        if planned is not None:
            for machine, state in list(self.known.iterator()):
                if self._due(state[0]) + self.idle <= now:
                    self.known.removeKey(machine)
        self.sweep.update((now + self.idle,))
        self.handle.registerTimer(now + self.idle)

    @staticmethod
    def _due(at: int) -> int:
        """The first millisecond that is not before ``at``."""
        return -(-at // 1000)

    def _hand_on(self, rows: Iterable[tuple], timerValues: Any) -> Iterator[Row]:
        self.now = None if self.waits or self.idle is None else timerValues.getCurrentProcessingTimeInMs()
        for machine, own in _grouped(rows).items():
            name = (NOBODY if machine is None else machine,)
            state = self.known.getValue(name)
            state = self.opened() if state is None else self.read(tuple(state))
            for at, seq, body in sorted(own):
                state, out = self.step(state, at, seq, body)
                yield Row(machine_id=machine, body=out)
            self.known.updateValue(name, self.written(state))

    def read(self, entry: tuple) -> tuple:
        return entry

    def written(self, state: tuple) -> tuple:
        return state


#: What an ordering step gives: the row's machine, and its text.
ORDERED = "machine_id string, body string"


class ReadingOrder(InOrder):
    """What a reading's quality takes from the accepted reading before it: duplicate times, values to fill.

    ``marks`` are three digits: rejected, reset, and whether a value is missing.
    The JSON holds ``readings``; where a value is missing, the output's holds
    ``filled`` as well. Output: ``at seq segment marks json`` with the marks late,
    rejected, duplicate. ``segment`` counts the machine's resets, which forget the
    last reading. The last reading is kept as text and read when a value is missing.
    """

    known_schema = "last_row long, at long, readings string, segment long"

    def opened(self) -> tuple:
        return None, None, None, 0

    def step(self, state, at, seq, body):
        _, last_at, last, segment = state
        marks, _, content = body.partition(" ")
        rejected, reset, gaps = (m == "1" for m in marks)
        if reset:
            last_at, last, segment = None, None, segment + 1
        duplicate = last_at == at
        if not rejected:
            last_at = at
            if gaps:
                known = _values(last) if last else {}
                filled = {k: known.get(k, 0.0) if _absent(v) else v for k, v in _values(content).items()}
                content = f'{content[:-1]},"filled":{json.dumps(filled)}}}'
            last = content
        out = f"{at} {seq} {segment} 0{int(rejected)}{int(duplicate)} {content}"
        return (at, last_at, last, segment), out

    def late(self, at, seq, body):
        marks, _, content = body.partition(" ")
        return f"{at} {seq} 0 1{marks[0]}0 {content}"


def _absent(value) -> bool:
    """Missing: null, or NaN, which JSON writes as a word."""
    return value is None or value == "NaN" or value != value


def _shown(x: float) -> str:
    """A number in JSON, with the words that Spark reads for what is none."""
    return repr(x) if isfinite(x) else '"NaN"' if x != x else '"Infinity"' if x > 0 else '"-Infinity"'


def _values(content: str) -> dict:
    """The values of a reading after filling."""
    found = json.loads(content)
    return found.get("filled", found.get("readings")) or {}


class SensorState:
    """Windows and cumulative values of a sensor: what is kept of it and how a sample is taken in.

    Kept per machine and sensor: the samples of the longest window plus
    ``delay_s``, and the cumulative mean and maximum; a new ``segment`` clears them.
    """

    SCHEMA = "times binary, values binary, segment long, n long, mean double, top double"

    def __init__(self, windows_s: list[int], sampled: list[str], delay_s: int):
        self.windows, self.sampled = sorted(windows_s), set(sampled)
        self.keep = (max(windows_s) + delay_s) * MICROS

    def read(self, entry: tuple | None) -> list:
        if entry is None:
            return [None, None, 0, 0.0, float("-inf")]
        return [SensorWindows(self.windows, self.keep, entry[0], entry[1]), *entry[2:]]

    @staticmethod
    def written(held: list) -> tuple:
        buffer, *rest = held
        return (*buffer.packed(), *rest)

    def push(self, held: list, sensor: str, at: int, segment: int, value: float) -> str:
        """Takes in a sample; members of a JSON object: per window its length, size and the statistics of two samples or more."""
        if held[0] is None or held[1] != segment:
            held[:] = [SensorWindows(self.windows, self.keep), segment, 0, 0.0, float("-inf")]
        buffer = held[0]
        buffer.push(at, value)
        held[2] += 1
        held[3] += (value - held[3]) / held[2]
        held[4] = max(held[4], value)
        found = buffer.at(at)
        windows = [f"[{','.join(map(_shown, (w, size, *(s or ()))))}]" for w, (size, s, _) in zip(self.windows, found)]
        out = f'"mean":{_shown(held[3])},"top":{_shown(held[4])},"w":[{",".join(windows)}]'
        if sensor in self.sampled:
            samples = [list(buffer.values[low:high]) if high - low >= 2 else None for _, _, (low, high) in found]
            out = f'{out},"s":{json.dumps(samples)}'
        return out


class ReadingProcessor(ReadingOrder):
    """Order, quality context and windows of a machine's readings in one step; the JSON gets the sensors' statistics as ``x``.

    A machine's sensors are one text in its entry: read and written once, however
    many there are. A sensor's entry ends with the processing time it was last
    written, by which an idle one is forgotten when state expires by that time.
    """

    known_schema = f"{ReadingOrder.known_schema}, sensors binary"

    def __init__(self, waits: bool, idle_ms: int | None, sensors: SensorState):
        super().__init__(waits, idle_ms)
        self.sensors = sensors

    def opened(self) -> tuple:
        return *super().opened(), ({}, {})

    def read(self, entry: tuple) -> tuple:
        *known, packed = entry
        stored = pickle.loads(packed)
        if self.now is not None:
            stored = {k: e for k, e in stored.items() if e[-1] is None or e[-1] + self.idle > self.now}
        return *known, (stored, {})

    def written(self, state: tuple) -> tuple:
        *known, (stored, held) = state
        fresh = {k: (*self.sensors.written(h), self.now) for k, h in held.items()}
        return *known, pickle.dumps(stored | fresh, pickle.HIGHEST_PROTOCOL)

    def step(self, state, at, seq, body):
        *known, (stored, held) = state
        known, out = super().step(known, at, seq, body)
        _, _, segment, marks, content = out.split(" ", 4)
        if marks[1] == "0":
            part, own = int(segment), []
            for sensor, value in _values(content).items():
                if sensor not in held:
                    entry = stored.get(sensor)
                    held[sensor] = self.sensors.read(None if entry is None else entry[:-1])
                own.append(f"{json.dumps(sensor)}:{{{self.sensors.push(held[sensor], sensor, at, part, float(value))}}}")
            out = f'{out[:-1]},"x":{{{",".join(own)}}}}}'
        return (*known, (stored, held)), out


#: The windows' output: a reading's text as it came (no sensor), or the statistics of one of its sensors.
PARTS = "machine_id string, sensor string, body string"


class WindowProcessor(StatefulProcessor):
    """The windows of each sensor of each machine; a row's body is ``at seq segment value``.

    Rows without a sensor are readings on their way past the windows.
    """

    def __init__(self, sensors: SensorState, ttl_ms: int | None):
        self.sensors, self.ttl = sensors, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("sensors", "machine string, sensor string", self.sensors.SCHEMA, self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        samples = []
        for _, machine, sensor, body in rows:
            if sensor is None:
                yield Row(machine_id=machine, sensor=None, body=body)
            else:
                at, seq, segment, value = body.split(" ")
                samples.append((int(at), int(seq), int(segment), float(value), machine, sensor))
        held: dict[tuple, list] = {}
        for at, seq, segment, value, machine, sensor in sorted(samples):
            name = (machine, sensor)
            if name not in held:
                held[name] = self.sensors.read(self.state.getValue(name))
            out = self.sensors.push(held[name], sensor, at, segment, value)
            yield Row(machine_id=machine, sensor=sensor, body=f'{{"at":{at},"seq":{seq},{out}}}')
        for name, one in held.items():
            self.state.updateValue(name, self.sensors.written(one))


class PredictionOrder(InOrder):
    """The remaining life that the prediction before stated.

    ``marks`` is that life of the row itself, ``-`` without one. Output:
    ``at seq late previous json``.
    """

    known_schema = "last_row long, rul string"

    def opened(self) -> tuple:
        return None, NO_TIME

    def step(self, state, at, seq, body):
        rul, _, content = body.partition(" ")
        return (at, rul), f"{at} {seq} 0 {state[1]} {content}"

    def late(self, at, seq, body):
        return f"{at} {seq} 1 {NO_TIME} {body.partition(' ')[2]}"


#: A fired rule, or a late prediction on its way past the cooldown.
FIRED = "machine_id string, rule_id string, window_start long, notify boolean, body string"


class CooldownProcessor(StatefulProcessor):
    """Cooldown and aggregation window of each rule on each machine; a hit's body is ``at seq cooldown json``.

    Rows without a rule are late predictions.
    """

    def __init__(self, window_s: int, ttl_ms: int | None):
        self.window, self.ttl = window_s * MICROS, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("rules", "machine string, rule string", "fired long, opened long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        hits = []
        for _, machine, rule, body in rows:
            at, seq, cooldown, content = body.split(" ", 3)
            if rule is None:
                yield Row(machine_id=machine, rule_id=None, window_start=None, notify=False, body=content)
            else:
                hits.append(((machine, rule), int(at), int(seq), int(cooldown), content))
        for (machine, rule), own in _grouped(hits).items():
            name = (NOBODY if machine is None else machine, rule)
            known = self.state.getValue(name)
            before = fired, opened = (None, None) if known is None else tuple(known)
            for at, _, cooldown, content in sorted(own):
                if fired is not None and at - fired < cooldown * MICROS:
                    continue
                notify = opened is None or at - opened > self.window
                if notify:
                    opened = at
                fired = at
                yield Row(machine_id=machine, rule_id=rule, window_start=opened, notify=notify, body=content)
            if (fired, opened) != before:
                self.state.updateValue(name, (fired, opened))
