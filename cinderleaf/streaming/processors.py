"""Stateful processors for request, frame, nonce and prompt streams.

Every processor keeps one small value per key and applies the same rule as the table operator.
Rows of a micro-batch are ordered by time and id first; a row older than the key's newest one is
answered as late and leaves the state alone. A key's state goes by event time: a timer fires once the
watermark has passed the newest row by as long as the rule can look back.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.operators.folds import (
    Admitted,
    LastFrame,
    LastUse,
    admit_step,
    frame_step,
    nonce_step,
)


class OrderedProcessor(StatefulProcessor):
    """Orders the rows of a key, loads and stores its state, and leaves the rule to subclasses."""

    state_schema = ""
    columns: list[str] = []

    def __init__(self, key: str, t: str, tie: str, keep_ms: int | None = None, carry: Sequence[str] = ()) -> None:
        self.key, self.t, self.tie, self.keep_ms, self.carry = key, t, tie, keep_ms, list(carry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"newest bigint, {self.state_schema}")

    def close(self) -> None:
        pass

    def load(self, saved: tuple | None) -> None:
        raise NotImplementedError

    def save(self) -> tuple:
        raise NotImplementedError

    def judge(self, t: int, row: object) -> str:
        raise NotImplementedError

    def counts(self, row: object) -> bool:
        """Whether a row meets the rule at all; those with a false `counted` column get the verdict `passed`."""
        return bool(getattr(row, "counted", True))

    passed = "ok"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).sort_values([self.t, self.tie])
        saved = self.state.get() if self.state.exists() else None
        before = newest = saved[0] if saved else None
        self.load(saved[1:] if saved else None)
        verdicts = []
        for row in batch.itertuples(index=False):
            t = int(getattr(row, self.t))
            if not self.counts(row):
                verdicts.append(self.passed)
            elif newest is not None and t < newest:
                verdicts.append("late")
            else:
                newest = t
                verdicts.append(self.judge(t, row))
        if newest is not None:
            self.state.update((newest, *self.save()))
        if self.keep_ms is not None and newest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.keep_ms)
            self.handle.registerTimer(newest + self.keep_ms)
        out = batch[[self.key, self.tie, *self.carry]].copy()
        out["verdict"] = verdicts
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])


class RateLimit(OrderedProcessor):
    """Sliding window with burst blocks: ok, limited, burst or blocked."""

    state_schema = "times array<bigint>, until bigint"

    def load(self, saved):
        self.times = deque(saved[0]) if saved else deque()
        self.until = saved[1] if saved else None

    def save(self):
        return list(self.times), self.until

    def judge(self, t, row):
        if self.until is not None and t < self.until:
            return "blocked"
        while self.times and t - self.times[0] >= rules.RATE_WINDOW_MS:
            self.times.popleft()
        self.times.append(t)
        recent = sum(1 for seen in self.times if t - seen < rules.BURST_WINDOW_MS)
        if recent >= rules.BURST_LIMIT:
            self.until = t + rules.BLOCK_MS
            return "burst"
        return "limited" if len(self.times) > rules.RATE_LIMIT else "ok"


class Admission(OrderedProcessor):
    """Window that counts admitted calls only: ok or limited."""

    state_schema = "times array<bigint>"

    def load(self, saved):
        self.rule = Admitted(deque(saved[0]) if saved else deque())

    def save(self):
        return (list(self.rule.times),)

    def judge(self, t, row):
        admitted = admit_step(self.rule, t, rules.ADMIT_LIMIT, rules.RATE_WINDOW_MS)
        return "ok" if admitted else "limited"


class FrameThrottle(OrderedProcessor):
    """Accepted frames only: needs a `signature` column."""

    state_schema = "last bigint, signature string"

    def load(self, saved):
        self.rule = LastFrame(*saved) if saved else LastFrame()

    def save(self):
        return self.rule.t, self.rule.signature

    def judge(self, t, row):
        accepted = frame_step(self.rule, t, row.signature, rules.THROTTLE_MS)
        return "ok" if accepted else "skipped"


class NonceGuard(OrderedProcessor):
    """One use of a nonce per horizon: ok or replay."""

    state_schema = "last bigint"

    def load(self, saved):
        self.rule = LastUse(saved[0]) if saved else LastUse()

    def save(self):
        return (self.rule.t,)

    def judge(self, t, row):
        return "ok" if nonce_step(self.rule, t, rules.NONCE_MS) else "replay"


class MultiTurn(OrderedProcessor):
    """Escalation over the last five turns: needs `score` and `status` columns.

    Rows with a false `counted` column stay out of the history and are SAFE.
    """

    passed = "SAFE"
    state_schema = "scores array<int>, harmful array<boolean>"

    def load(self, saved):
        size = rules.TURN_WINDOW
        self.scores = deque(saved[0] if saved else [], maxlen=size)
        self.harmful = deque(saved[1] if saved else [], maxlen=size)
        self.last = None

    def handleInputRows(self, key, rows, timerValues):
        saved = self.state.get() if self.state.exists() else None
        self.before = saved[0] if saved else None
        yield from super().handleInputRows(key, rows, timerValues)

    def save(self):
        return list(self.scores), list(self.harmful)

    def judge(self, t, row):
        if self.before is not None and t - self.before > rules.SESSION_IDLE_MS:
            self.scores.clear()
            self.harmful.clear()
        self.before = t
        self.scores.append(int(row.score))
        self.harmful.append(row.status == "HARMFUL_CONTENT")
        hits, total = sum(s > 0 for s in self.scores), sum(self.scores)
        if hits >= 3 or total >= 50:
            return "INJECTION_ATTEMPT"
        if hits >= 2 or total >= 30:
            return "SUSPICIOUS"
        return "HARMFUL_CONTENT" if any(self.harmful) else "SAFE"
