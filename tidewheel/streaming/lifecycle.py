"""Streams with a state of their own for each key: session lifecycles with timers, and curated prompts that go on after a restart.

Both need the RocksDB state store (``ROCKSDB``). Their batch forms are ``operators.lifecycle`` and ``operators.curation``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewheel.operators.lifecycle import PHASES, TERMINAL

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENT = "session_id long, ts timestamp, seq int, event string, status string, reason string"
RECORD = "session_id long, status string, reason string, submit_ts double, finalized_ts double, " + ", ".join(f"{p}_s double" for p in PHASES) + ", open_spans long"


class SessionProcessor(StatefulProcessor):
    """Holds a session from its submit to its end, or until nothing has happened to it for ``idle_s`` seconds of event time.

    A value has the session's head, a map each phase's open start, its ended seconds and how many spans stayed open.
    Both go when the session ends; what comes after that has no session and is left out.
    """

    def __init__(self, idle_s: float):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "submit_ts double, status string, reason string, finalized_ts double, last_ts double")
        self.phases = handle.getMapState("phases", "phase string", "open_ts double, seconds double, ended long, left_open long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        at = events["ts"].astype("int64") / 10 ** {"s": 0, "ms": 3, "us": 6, "ns": 9}[events["ts"].dt.unit]
        head = self.head.get()
        for ts, event, status, reason in zip(at, events["event"], events["status"], events["reason"], strict=True):
            if head is None:
                if event == "submit":
                    head = (ts, "pending", None, None, ts)
                continue
            submit, known, why, finalized, _ = head
            if event == "finalized":
                known, why, finalized = (status if pd.notna(status) else known), (reason if pd.notna(reason) else why), ts
            elif event and event.endswith(("_start", "_end")):
                self._step(*event.rsplit("_", 1), ts)
            head = (submit, known, why, finalized, ts)
            if event == "finalized" and known in TERMINAL:
                yield self._record(key, head)
                self._forget()
                head = None
        if head is not None:
            self.head.update(head)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((head[4] + self.idle_s) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get()
        if head is not None:
            yield self._record(key, (head[0], "dropped", "idle", head[3], head[4]))
            self._forget()

    def _step(self, phase: str, role: str, ts: float) -> None:
        begun, seconds, ended, left = self.phases.getValue((phase,)) if self.phases.containsKey((phase,)) else (None, 0.0, 0, 0)
        if role == "start":
            begun, left = ts, left + (begun is not None)
        else:
            begun, seconds, ended = None, seconds + (ts - begun if begun is not None else 0.0), ended + 1
        self.phases.updateValue((phase,), (begun, seconds, ended, left))

    def _record(self, key, head: tuple) -> pd.DataFrame:
        of = {k[0]: v for k, v in self.phases.iterator()}
        seconds = {f"{p}_s": [of[p][1] if p in of and of[p][2] else None] for p in PHASES}
        still = sum(v[3] + (v[0] is not None) for v in of.values())
        return pd.DataFrame({"session_id": [key[0]], "status": [head[1]], "reason": [head[2]], "submit_ts": [head[0]], "finalized_ts": [head[3]], **seconds, "open_spans": [still]})

    def _forget(self) -> None:
        self.head.clear()
        self.phases.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)


def follow_sessions(events: DataFrame, *, idle_s: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """A record of each session of ``EVENT`` rows as it ends; ones that nothing happens to for ``idle_s`` are dropped as idle.

    Sessions are followed in the order of their events within a batch. The watermark (``late``) moves the timers.
    """
    keyed = events.withWatermark("ts", late).groupBy("session_id")
    return keyed.transformWithStateInPandas(SessionProcessor(idle_s), RECORD, "append", "EventTime")


STATE = "streak long, kind string, success double"
DECISION = "prompt_id string, version int, " + STATE


class PromptProcessor(StatefulProcessor):
    """Each prompt's streak of outcomes without signal and its success average; a prompt unseen for ``ttl_ms`` is forgotten."""

    def __init__(self, decay: float, ttl_ms: int | None):
        self.decay, self.ttl_ms = decay, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("prompt", STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.iloc[-1]
        self.state.update((int(last["streak"]), last["kind"] if pd.notna(last["kind"]) else None, float(last["success"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, kind, success = self.state.get() or (0, None, 0.0)
        outcomes, version = pd.concat(list(rows)).sort_values("version", kind="stable"), None
        for version, rewards in zip(outcomes["version"], outcomes["rewards"], strict=True):
            if max(rewards) - min(rewards) > 1e-8:
                streak, kind = 0, None
            else:
                now = "easy" if sum(rewards) / len(rewards) > 0.5 else "hard"
                streak, kind = (streak + 1 if now == kind else 1), now
            success = self.decay * success + (1 - self.decay) * sum(r > 0 for r in rewards) / len(rewards)
        self.state.update((streak, kind, success))
        yield pd.DataFrame({"prompt_id": [key[0]], "version": [version], "streak": [streak], "kind": [kind], "success": [success]})


def curate_on(rollouts: DataFrame, saved: DataFrame | None = None, *, decay: float = 0.9, ttl_ms: int | None = None) -> DataFrame:
    """Prompts' states after each batch, from those of a ``saved`` table (``prompt_id, streak, kind, success``) on.

    A job that starts anew from the last table goes on where the one before it ended; with ``ttl_ms`` a prompt that
    nothing comes for goes, so that the state follows the prompts in use and not all ever seen.
    """
    keyed = rollouts.where(F.size("rewards") > 0).groupBy("prompt_id")
    initial = saved.select("prompt_id", "streak", "kind", "success").groupBy("prompt_id") if saved is not None else None
    return keyed.transformWithStateInPandas(PromptProcessor(decay, ttl_ms), DECISION, "update", "ProcessingTime" if ttl_ms else "None", initial)
