"""Windows that nobody reported, told by timers: a scope that sends nothing is told of all the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilmesh import policies

SILENT = "scope_id string, window_start timestamp, window_end timestamp, quality string"
_COLUMNS = [c.split()[0] for c in SILENT.split(", ")]


class SilenceProcessor(StatefulProcessor):
    """One clock per scope. It stands at the first expected window not yet judged; a timer waits for that window to be due.

    Expected are the windows inside the scope's monitored ranges, or, for a scope without any, every window after its first
    known one. When the timer fires, each window that is due by then and unknown is emitted, once. State holds the
    ranges, the clock and the known windows ahead of it.
    """

    def __init__(self, live: bool, seconds: int, lateness: int):
        # A watermark already lags by the lateness; the clock on the wall does not.
        self.live, self.seconds, self.wait = live, seconds, lateness if live else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ranges = handle.getMapState("ranges", "monitored_from bigint", "monitored_through bigint")
        self.known = handle.getMapState("known", "window_start bigint", "reported boolean")
        self.clock = handle.getValueState("clock", "at bigint, judged boolean")

    def _ranges(self) -> list[tuple[int, int]]:
        return sorted((k[0], v[0]) for k, v in self.ranges.iterator()) if self.ranges.exists() else []

    def _next(self, at: int, ranges: list[tuple[int, int]]) -> int | None:
        """The first expected window from ``at`` on."""
        if not ranges:
            return at
        starts = [max(at, a) for a, b in ranges if max(at, a) + self.seconds <= b]
        return min(starts, default=None)

    def _wait_for(self, at: int, judged: bool, ranges: list[tuple[int, int]]) -> None:
        self.clock.update((at, judged))
        following = self._next(at, ranges)
        if following is not None:
            self.handle.registerTimer((following + self.seconds + self.wait) * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            if row.monitored_from < row.monitored_through:
                # Ranges from the same start: the longer one holds the other.
                known = self.ranges.getValue((row.monitored_from,)) if self.ranges.containsKey((row.monitored_from,)) else None
                self.ranges.updateValue((row.monitored_from,), (max(row.monitored_through, known[0] if known else 0),))
        ranges = self._ranges()
        if ranges:
            self._wait_for(ranges[0][0], False, ranges)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = sorted({int(s) for frame in rows for s in frame["start_s"].unique()})
        ranges = self._ranges()
        at, judged = self.clock.get() if self.clock.exists() else (None, False)
        if not ranges and not judged and (at is None or starts[0] < at):
            at = starts[0]
            self._wait_for(at, False, ranges)
        for start in starts:
            if at is not None and start >= at and (not ranges or any(a <= start < b for a, b in ranges)):
                self.known.updateValue((start,), (True,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        ranges, (at, _) = self._ranges(), self.clock.get()
        known = {k[0] for k in self.known.keys()} if self.known.exists() else set()
        silent, start = [], self._next(at, ranges)
        while start is not None and (start + self.seconds + self.wait) * 1000 <= now:
            if start not in known:
                silent.append(start)
            at = start + self.seconds
            start = self._next(at, ranges)
        for start in known:
            if start < at:
                self.known.removeKey((start,))
        self._wait_for(at, True, ranges)
        begin = pd.to_datetime(pd.Series(silent, dtype="int64"), unit="s")
        out = pd.DataFrame({"window_start": begin, "window_end": begin + pd.Timedelta(seconds=self.seconds)})
        yield out.assign(scope_id=key[0], quality="MISSING")[_COLUMNS]

    def close(self) -> None:
        pass


def silent_windows(
    receipts: DataFrame, ranges: DataFrame | None = None, live: bool = False,
    seconds: int = policies.MINUTE_SECONDS, lateness: int = policies.ALLOWED_LATENESS_SECONDS,
) -> DataFrame:
    """MISSING windows of a stream of receipts, each once, when it is due; the streamed ``windows.silent_windows``.

    ``ranges`` (scope_id, monitored_from, monitored_through) is read when the query starts for the first time. A window is due
    when the watermark passes its end: any scope's receipts move it, for all scopes. ``live``: when the wall clock passes the end by
    the allowed lateness, also if nothing is received at all; such a query needs a processing-time trigger. Receipts must
    carry a watermark on ``window_end`` unless live. Rows without a scope are ignored.
    """
    rows = receipts.where("scope_id IS NOT NULL").select("scope_id", F.unix_seconds("window_start").alias("start_s"), "window_end")
    declared = None
    if ranges is not None:
        declared = ranges.select(
            "scope_id", F.unix_seconds("monitored_from").alias("monitored_from"), F.unix_seconds("monitored_through").alias("monitored_through")
        ).groupBy("scope_id")
    return rows.groupBy("scope_id").transformWithStateInPandas(
        SilenceProcessor(live, seconds, lateness), SILENT, "Append", "ProcessingTime" if live else "EventTime", declared)
