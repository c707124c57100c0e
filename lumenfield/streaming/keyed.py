"""Keyed state that ends: processors with timers and expiry for feeds that follow jobs, messages and users.

A processor sees the rows of one key of a micro-batch in pieces, in no order. Where a decision only needs the first or
the fifth row, the pieces are folded one by one; where it needs all rows in order, their numbers are sorted as
arrays. Event-time timers clear what no later row can change. State lives in the RocksDB store, so keys that are not
in a batch cost it nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from lumenfield.operators.jobs import TERMINAL

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def stamps(us) -> pd.Series:
    return pd.Series(np.atleast_1d(np.asarray(us, np.int64)).astype("datetime64[us]"))


def pieces(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """Columns of all pieces as arrays; the first name is a timestamp and becomes microseconds."""
    parts = [[micros(p[names[0]]), *[p[n].to_numpy() for n in names[1:]]] for p in rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


class Expiring(StatefulProcessor):
    """A processor with one event-time timer a key, which later rows move."""

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def wake(self, ms: int) -> None:
        """Set the key's timer; it never lies in the past of the watermark."""
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


class JobStates(Expiring):
    """Accepted transitions of a job: running once, then one terminal state that absorbs the rest.

    The state goes ``keep_ms`` after the terminal event, or ``idle_ms`` after the last event of a job that never ended.
    """

    def __init__(self, keep_ms: int, idle_ms: int):
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues):
        now = self.status.get()[0] if self.status.exists() else "queued"
        if now in TERMINAL:
            return
        end = run = None
        last = 0
        for p in rows:
            t, n, s = micros(p["ts"]), p["poll_id"].to_numpy(), p["status"].to_numpy()
            last = max(last, int(t.max()))
            for mask, is_end in ((np.isin(s, list(TERMINAL)), True), (s == "running", False)):
                if mask.any():
                    at = np.flatnonzero(mask)
                    i = at[np.lexsort((n[at], t[at]))[0]]
                    found = (int(t[i]), int(n[i]), s[i])
                    if is_end:
                        end = found if end is None else min(end, found)
                    else:
                        run = found if run is None else min(run, found)
        out = []
        if now == "queued" and run and (end is None or run[:2] < end[:2]):
            out.append(run)
        if end:
            out.append(end)
        if out:
            yield pd.DataFrame({"job_id": key[0], "ts": stamps([o[0] for o in out]), "status": [o[2] for o in out]})
        self.status.update((out[-1][2] if out else now,))
        self.wake(end[0] // 1000 + self.keep_ms if end else last // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.status.clear()
        self.timer.clear()
        yield from ()


class DeadLetters(Expiring):
    """The time of a message's receive number ``limit``; forgotten ``keep_ms`` after its last receive."""

    def __init__(self, limit: int, keep_ms: int):
        self.limit, self.keep_ms = limit, keep_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "n int, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        need, count, first = self.limit - n, 0, []
        for p in rows:
            t = micros(p["ts"])
            count, last = count + len(t), max(last, int(t.max()))
            if need > 0:  # only the earliest few of the batch can be the one
                first = sorted([*first, *np.sort(t)[:need].tolist()])[:need]
        if 0 < need <= count:
            yield pd.DataFrame({"photo_id": [key[0]], "dead_at": stamps(first[need - 1])})
        self.seen.update((min(n + count, self.limit), last))
        self.wake(last // 1000 + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        self.timer.clear()
        yield from ()


class ProgressFeed(Expiring):
    """Changes of (status, progress) of a job until its first terminal state or ``cap_ms`` after its first poll.

    A finished job is remembered for ``keep_ms`` more, so that late polls start no second feed.
    """

    def __init__(self, cap_ms: int, keep_ms: int):
        self.cap_ms, self.keep_ms = cap_ms, keep_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "first bigint, status string, progress double, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        first, status, progress, done = self.job.get() if self.job.exists() else (None, None, None, False)
        if done:
            return
        t, n, s, p = pieces(rows, ["ts", "poll_id", "status", "progress"])
        order = np.lexsort((n, t))
        t, s, p = t[order], s[order], np.round(p[order].astype(float), 4)
        first = int(t[0]) if first is None else first
        cap = first + self.cap_ms * 1000
        live = int(np.searchsorted(t, cap, "right"))
        ends = np.flatnonzero(np.isin(s[:live], list(TERMINAL)))
        cut = int(ends[0]) + 1 if len(ends) else live
        before_s, before_p = np.concatenate([[status], s[: max(cut - 1, 0)]]), np.concatenate([[np.nan if progress is None else progress], p[: max(cut - 1, 0)]])
        changed = np.flatnonzero((s[:cut] != before_s[:cut]) | (p[:cut] != before_p[:cut]))
        out = [(t[i], "progress", s[i], p[i]) for i in changed]
        if len(ends):
            out.append((t[cut - 1], "done", s[cut - 1], None))
        elif live < len(t):
            out.append((cap, "timeout", None, None))
        done = bool(len(ends)) or live < len(t)
        if out:
            yield self.events(key[0], out)
        if cut:
            status, progress = s[cut - 1], float(p[cut - 1])
        self.job.update((first, status, progress, done))
        self.wake((out[-1][0] // 1000 + self.keep_ms) if done else cap // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first, status, progress, done = self.job.get()
        self.timer.clear()
        if done:
            self.job.clear()
            return
        cap = first + self.cap_ms * 1000
        yield self.events(key[0], [(cap, "timeout", None, None)])
        self.job.update((first, status, progress, True))
        self.wake(max(cap // 1000, expiredTimerInfo.getExpiryTimeInMs()) + self.keep_ms)

    @staticmethod
    def events(job: int, out: list[tuple]) -> pd.DataFrame:
        when, event, status, progress = zip(*out, strict=True)
        return pd.DataFrame({"job_id": job, "ts": stamps(when), "event": event, "status": pd.Series(status, dtype=object), "progress": pd.Series(progress, dtype="float64")})


class RateLimit(StatefulProcessor):
    """Admission of a user's requests; what is held are the admitted times of one day, at most the limit.

    It has no timer: an event-time one needs a watermark, which would drop late requests without a decision, and a
    processing-time one keeps a stream that should end at the end of its input running.
    """

    def __init__(self, limit_active: int):
        self.limit_active = limit_active

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "at array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        from lumenfield.streaming.twins import admissions

        t, event, active = pieces(rows, ["ts", "event_id", "n_active"])
        order = np.lexsort((event, t))
        kept = [int(k) for k in self.kept.get()[0]] if self.kept.exists() else []
        ok = np.zeros(len(t), bool)
        open_ = order[active[order] < self.limit_active]
        ok[open_] = admissions(t[open_], kept)
        if kept:
            self.kept.update(([int(k) for k in kept],))
        yield pd.DataFrame({"event_id": event, "user_id": key[0], "n_active": active, "admitted": ok})

    def close(self) -> None:
        pass
