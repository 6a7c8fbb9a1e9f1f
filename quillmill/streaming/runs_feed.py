"""Progress of runs with state that knows time: late and repeated events, and runs that fall silent.

Each run's state holds its figures and the numbers of the events that it has seen lately. An event counts
once, however often it is sent and in whatever batch it comes, as long as it is no older than the watermark;
figures that depend on order (the latest cost, the planned pages) go by the events' own times, so a batch
that comes late changes them only if it tells something newer. A timer, moved on with every event, ends a
run that says nothing for `silence` seconds of event time: its last figures are put out as `expired` and its
state goes, as it does when the run says that it has finished. A finished run's state stays until its
timer, so that its events, sent again, don't begin it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FEED = "id string, run long, event string, page int, todo int, cost double, at timestamp"
PROGRESS = "run long, status string, done int, failed int, left_over int, cost double, per_page double, eta long"
_COLUMNS = [c.split()[0] for c in PROGRESS.split(", ")]
_FIGURES = "done int, failed int, todo int, todo_at double, cost double, cost_at double, first double, last double, finished boolean"
COUNTED = {"page_done": "done", "image_done": "done", "page_failed": "failed"}


class RunProgress(StatefulProcessor):
    def __init__(self, silence: float):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.figures = handle.getValueState("figures", _FIGURES)
        self.seen = handle.getMapState("seen", "id string", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = dict(zip((c.split()[0] for c in _FIGURES.split(", ")), self.figures.get(), strict=True)) if self.figures.exists() else {"done": 0, "failed": 0, "todo": 0, "todo_at": -1.0, "cost": 0.0, "cost_at": -1.0, "first": float("inf"), "last": -1.0, "finished": False}
        old = timerValues.getCurrentWatermarkInMs() / 1000
        fresh = 0
        for part in rows:
            for e in part.itertuples():
                at = e.at.timestamp()
                if at < old or self.seen.containsKey((e.id,)):
                    continue  # too late to be told from one that was counted, or counted already
                fresh += 1
                self.seen.updateValue((e.id,), (at,))
                if e.event in COUNTED:
                    f[COUNTED[e.event]] += 1
                if e.event == "start" and at >= f["todo_at"]:
                    f["todo"], f["todo_at"] = int(e.todo), at
                if e.cost == e.cost and e.cost is not None and at >= f["cost_at"]:
                    f["cost"], f["cost_at"] = float(e.cost), at
                f["finished"] = bool(f["finished"]) or e.event == "finished"
                f["first"], f["last"] = min(f["first"], at), max(f["last"], at)
        if not fresh:
            return
        self.figures.update(tuple(f.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(int((f["last"] + self.silence) * 1000))
        yield self._row(key, f, "finished" if f["finished"] else "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        f = dict(zip((c.split()[0] for c in _FIGURES.split(", ")), self.figures.get(), strict=True))
        self.figures.clear()
        self.seen.clear()
        if not f["finished"]:
            yield self._row(key, f, "expired")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, f: dict, status: str) -> pd.DataFrame:
        ended = f["done"] + f["failed"]
        rest = max(0, f["todo"] - ended)
        pace = (f["last"] - f["first"]) / ended if ended else None
        return pd.DataFrame([(key[0], status, f["done"], f["failed"], rest, f["cost"], pace, None if pace is None else round(rest * pace))], columns=_COLUMNS).astype({"eta": "Int64"})


def run_progress(feed: DataFrame, late: str = "10 minutes", silence: float = 1800.0) -> DataFrame:
    """run, status (running, finished, expired) and figures of each run, after every batch that tells
    anything new of it. feed: a stream of FEED rows; events older than `late` behind the newest are
    dropped. Rows without id, run or time are left out. Needs the session's state store to be RocksDB."""
    f = feed.filter(F.col("id").isNotNull() & F.col("run").isNotNull() & F.col("at").isNotNull())
    return f.withWatermark("at", late).groupBy("run").transformWithStateInPandas(RunProgress(silence), PROGRESS, "Update", "EventTime")
