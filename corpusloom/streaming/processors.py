"""Stateful operators: job watch and a delay queue in groups of keys (state.in_slots); fan-in, alert holds and model buffers on Spark's state API.

Those on the state API keep small named state variables in RocksDB and use event-time timers, so state that is no longer needed goes alone and
nothing is rewritten that didn't change; a call costs about 0.4 ms, so their keys are few or large.  Times inside are whole milliseconds or microseconds
since the epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.state import PROVIDER, ROCKSDB, SLOTS, in_slots

DAY_MS = 86_400_000
TERMINAL = ("completed", "failed", "cancelled")


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """The processor over rows by keys; the state API needs the RocksDB store, which is set for the session."""
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime")


class _Timed(StatefulProcessor):
    """A processor with one event-time timer for each key, kept in the value state `due`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def set_timer(self, due: int | None, held: int | None) -> None:
        """Move the key's timer from `held` to `due`."""
        if due == held:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if due is None:
            self.due.clear()
        else:
            self.handle.registerTimer(due)
            self.due.update((due,))

    def held_timer(self) -> int | None:
        held = self.due.get()
        return held[0] if held else None

    def close(self) -> None:
        pass


def _frames(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    held = list(rows)
    all_rows = held[0] if len(held) == 1 else pd.concat(held)
    return all_rows.sort_values(list(order), kind="stable") if order else all_rows


def job_watch(events: DataFrame, stuck_after_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """Fold events (job_id, ts, event_id, event_type, stage) into (job_id, status, step, error, n_events, steps), in update mode.

    Terminal states stay; steps has the last status of each step as 'step:status', by name.  When the watermark passes a job's
    last event by stuck_after_ms, a job without an end gives a failed row, and the job's state goes.  Jobs share a group's state (in_slots).
    """
    columns = ["job_id", "status", "step", "error", "n_events", "steps"]

    def row(job: str, j: list, error: str | None) -> tuple:
        listed = ",".join(f"{k}:{v}" for k, v in sorted(j[4].items()))
        return job, "failed" if error else j[0], j[1], error, j[2], listed

    def fold(held: dict, new: pd.DataFrame | None, now: int) -> tuple[pd.DataFrame, int]:
        changed: dict[str, list] = {}
        if new is not None:
            events = new.sort_values(["at_us", "event_id"], kind="stable")
            for job, kind, stage, us in zip(*(events[c].tolist() for c in ("job_id", "event_type", "stage", "at_us")), strict=True):
                j = changed.get(job)
                if j is None:
                    j = changed[job] = held.setdefault(job, ["pending", None, 0, 0, {}, 0])  # status, step, events, last seen, steps, due
                j[2], j[3] = j[2] + 1, max(j[3], us // 1000)
                if stage is not None and kind in ("stage.started", "stage.completed", "stage.failed"):
                    j[4][stage] = "processing" if kind == "stage.started" else kind[6:]
                if j[0] in TERMINAL:
                    continue
                if kind == "stage.started":
                    j[0], j[1] = "processing", stage
                elif kind == "stage.failed" and stage == "extraction":
                    j[0], j[1] = "failed", stage
                elif kind == "stage.completed" and stage == "inferences":
                    j[0], j[1] = "completed", stage
                elif kind == "job_cancelled":
                    j[0] = "cancelled"
        for j in changed.values():
            j[5] = max(j[3] + stuck_after_ms, now + 1)
        out = [row(job, j, None) for job, j in changed.items()]
        for job in [k for k, j in held.items() if j[5] <= now]:
            j = held.pop(job)
            if j[0] not in TERMINAL:
                out.append(row(job, j, f"Job timeout after {stuck_after_ms // 1000} s"))
        return pd.DataFrame(out, columns=columns), min((j[5] for j in held.values()), default=0)

    rows = events.withWatermark("ts", late).select("job_id", "ts", "event_id", "event_type", "stage", F.unix_micros("ts").alias("at_us"))
    return in_slots(rows, "job_id", fold, "job_id string, status string, step string, error string, n_events long, steps string", "update")


class _FanIn(_Timed):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.got = handle.getValueState("got", "got long, expected long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got, expected = self.got.get() or (0, 0)
        known, new = got > 0, _frames(rows)
        got, expected = got + len(new), max(expected, int(new["expected"].max()))
        timer = self.held_timer() if known else None
        if 0 < expected <= got:
            if known:
                self.got.clear()
                self.set_timer(None, timer)
            yield pd.DataFrame({"job_id": [key[0]], "got": [got]})
            return
        self.got.update((got, expected))
        self.set_timer(max(int(new["at_ms"].max()) + self.keep_ms, timer or 0), timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.got.clear()
        self.due.clear()
        return iter(())


def fan_in(chunks: DataFrame, keep: str = "24 hours") -> DataFrame:
    """(job_id, chunk, expected, ts) -> (job_id, got) once, with the row that brings a job's last chunk; in append mode.

    A chunk that is delivered again within `keep` counts once: each has an entry of its own in the state, which expires alone.
    Of a job only the count is held, until it is complete or nothing has come for `keep`.  For messages that carry their own time only; where they
    carry their job's, state.fan_in needs no Python.
    """
    first = chunks.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["job_id", "chunk"])
    rows = first.select("job_id", "expected", "ts", F.unix_millis("ts").alias("at_ms"))
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return _with_state(rows, ["job_id"], _FanIn(keep_ms), "job_id long, got long", "append")


@dataclass(frozen=True)
class Rule:
    """A ratio rule: it is hot in a window where `bad` events are more than `share` of `bad` and `good` ones, and fires in the last of `hold` hot windows in a row."""

    name: str
    bad: str = "stage.failed"
    good: str = "stage.completed"
    share: float = 0.5
    hold: int = 2


class _AlertHold(StatefulProcessor):
    def __init__(self, rules: list[Rule], step_us: int) -> None:
        self.hold, self.step_us = {r.name: r.hold for r in rules}, step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "last_us long, streak long, firing boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, streak, firing = self.run.get() or (None, 0, False)
        windows, states = _frames(rows, "window_us"), []
        if last is not None:  # a window that was judged is not judged again
            windows = windows[windows["window_us"] > last]
        for at, hot in zip(windows["window_us"], windows["hot"], strict=True):
            if last is not None and at - last != self.step_us:
                streak = 0
            streak = streak + 1 if hot else 0
            now = streak >= self.hold[key[0]]
            states.append("firing" if now else "pending" if hot else "resolved" if firing else "inactive")
            last, firing = int(at), now
        if len(windows):
            self.run.update((last, streak, firing))
            yield windows.assign(state=states)[["rule", "window_us", "bad", "good", "hot", "state"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def rule_windows(events: DataFrame, rules: list[Rule], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(rule, w, bad, good, hot) for each window and rule; on a stream when the watermark has passed the window."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = [c.alias(f"{side}{k}") for k, r in enumerate(rules) for side, c in (("bad", count(r.bad)), ("good", count(r.good)))]
    g = e.groupBy(F.window("ts", size, slide or size).alias("w")).agg(*counts)

    def judged(k: int, r: Rule) -> Column:
        bad, good = F.col(f"bad{k}"), F.col(f"good{k}")
        return F.struct(F.lit(r.name).alias("rule"), bad.alias("bad"), good.alias("good"), (bad > r.share * (bad + good)).alias("hot"))

    return g.select("w", F.explode(F.array(*[judged(k, r) for k, r in enumerate(rules)])).alias("x")).select("w", "x.*")


def alert_states(events: DataFrame, rules: list[Rule], size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(rule, window_us, bad, good, hot, state) of a stream of events (ts, event_type), in append mode; state: inactive, pending, firing or resolved.

    A window aggregate feeds a state machine for each rule, which holds three values.  A window without events breaks a hold.
    """
    step_us = int(pd.Timedelta(slide or size).total_seconds() * 1_000_000)
    w = rule_windows(events, rules, size, slide, late).select("rule", "w", F.unix_micros(F.col("w.start")).alias("window_us"), "bad", "good", "hot")
    return _with_state(w, ["rule"], _AlertHold(rules, step_us), "rule string, window_us long, bad long, good long, hot boolean, state string", "append")


#: Works on the payloads of messages at an attempt; says of each whether it succeeded.
Work = Callable[[list[str], int], list[bool]]


#: Messages of one call of the work.
CALL = 1000


def delay_queue(messages: DataFrame, work: Work, slots: int = SLOTS, most: int = 3, longest: int = 60, late: str = "10 seconds") -> DataFrame:
    """Messages (id long, payload string, ts) are worked on; one that fails comes back when it is due and is worked on again, in append mode.

    After failure number a (from 0) a message waits min(2^a, longest) seconds of event time, at most `most` times; then it is
    dead, as is the message of a work that raises.  Returns (id, attempt, route, at_us, payload): a row 'retry' at each due time, and
    'done' or 'dead' at the end.  Messages wait in `slots` queues, each message in the slot of its id's hash, under the millisecond in which they are due.
    A queue has one timer, for the soonest of them; all that are due then are worked on together.
    """

    def tried(waiting: dict, part: list[tuple], attempt: int, out: list[tuple]) -> None:
        """Work on messages (id, payload, time); those that fail wait, by the millisecond in which they are due, or are dead."""
        for at in range(0, len(part), CALL):
            some = part[at : at + CALL]
            try:
                good = work([m[1] for m in some], attempt)
            except Exception:
                good = [False] * len(some)
            for (name, payload, us), done in zip(some, good, strict=True):
                if done or attempt >= most:
                    out.append((name, attempt, "done" if done else "dead", us, payload))
                    continue
                again = us + 1_000_000 * min(2**attempt, longest)
                waiting.setdefault(-(-again // 1000), []).append((name, payload, again, attempt + 1))

    def fold(waiting: dict, new: pd.DataFrame | None, now: int) -> tuple[pd.DataFrame, int]:
        out: list[tuple] = []
        if new is not None:
            tried(waiting, list(zip(*(new[c].tolist() for c in ("id", "payload", "at_us")), strict=True)), 0, out)
        while due := sorted(ms for ms in waiting if ms <= now):
            rounds: dict[int, list[tuple]] = {}
            for ms in due:
                for name, payload, us, attempt in waiting.pop(ms):
                    rounds.setdefault(attempt, []).append((name, payload, us))
            for attempt, part in sorted(rounds.items()):
                out += [(name, attempt, "retry", us, payload) for name, payload, us in part]
                tried(waiting, part, attempt, out)
        return pd.DataFrame(out, columns=["id", "attempt", "route", "at_us", "payload"]), min(waiting, default=0)

    rows = messages.withWatermark("ts", late).select("id", "payload", "ts", F.unix_micros("ts").alias("at_us"))
    return in_slots(rows, "id", fold, "id long, attempt long, route string, at_us long, payload string", "append", slots)


class _FillBuffer(_Timed):
    def __init__(self, answer: Callable[[list[str]], list[str]], most: int, wait_ms: int) -> None:
        self.answer, self.most, self.wait_ms = answer, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "id long, text string, us long")

    def sent(self, messages: list[tuple]) -> pd.DataFrame:
        try:
            replies = self.answer([m[1] for m in messages])
        except Exception:
            replies = [None] * len(messages)
        return pd.DataFrame({"id": [m[0] for m in messages], "reply": replies, "n_batch": [len(messages)] * len(messages)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timer = self.held_timer()
        new = _frames(rows, "at_us", "id")
        waiting = [tuple(m) for m in self.held.get()] if timer is not None else []
        before = len(waiting)
        waiting += zip(new["id"].tolist(), new["text"].tolist(), new["at_us"].tolist(), strict=True)
        full = len(waiting) // self.most * self.most
        for at in range(0, full, self.most):
            yield self.sent(waiting[at : at + self.most])
        if full:
            self.held.clear()
        rest = waiting[full:]
        if full and rest:
            self.held.put(rest)
        elif not full:
            self.held.appendList(waiting[before:])
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        self.set_timer(max(min(m[2] for m in rest) // 1000 + self.wait_ms, soonest) if rest else None, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        waiting = [tuple(m) for m in self.held.get()]
        self.held.clear()
        self.due.clear()
        yield self.sent(waiting)


def model_buffers(
    messages: DataFrame, answer: Callable[[list[str]], list[str]], queues: list[str], most: int = 32, wait: str = "5 minutes", slots: int = 8, late: str = "1 minute"
) -> DataFrame:
    """(id, reply, n_batch) of messages (id long, text, ts, *queues): the model answers `most` messages of a queue at once, in append mode.

    Messages are held over triggers until a call is full, or until the watermark passes the oldest of them by `wait`; then the rest goes.  A queue
    has `slots` buffers, one for each id modulo slots, so that a hot one keeps as many tasks busy.  A call that fails gives null replies.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    slot = F.pmod("id", F.lit(slots)).alias("slot")
    rows = messages.withWatermark("ts", late).select(*queues, slot, "id", "text", "ts", F.unix_micros("ts").alias("at_us"))
    return _with_state(rows, [*queues, "slot"], _FillBuffer(answer, most, wait_ms), "id long, reply string, n_batch long", "append")
