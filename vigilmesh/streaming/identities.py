"""De-duplication of a stream of deliveries over two keys: the event id anywhere, and the natural key in its minute.

Two operators follow each other. The first is keyed by event id and says whether an earlier timely delivery of the id
belongs to another natural key. The second is keyed by scope and minute and settles each delivery in arrival order. Event time is the
receipt time, so that deliveries of windows long closed are judged as late and not lost to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilmesh.operators.ingest import NATURAL, is_late

#: How long after its window an event id is remembered, and how far deliveries may be out of receipt order.
REMEMBERED_SECONDS, DISORDER = 24 * 3600, "10 minutes"

DELIVERY = (
    "event_id string, scope_id string, window_start timestamp, window_end timestamp, source_id string, kind string, "
    "content_hash string, received_at timestamp, arrival bigint, late boolean"
)
MARKED = f"{DELIVERY}, elsewhere boolean"
OUTCOME = "event_id string, scope_id string, window_start timestamp, source_id string, kind string, content_hash string, arrival bigint, outcome string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class IdentityProcessor(StatefulProcessor):
    """Remembers the natural key of an event id's first timely delivery, until the id's time is over."""

    def __init__(self, remembered: int):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "natural string, arrival bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)  # a micro-batch's deliveries of one id
        natural = [f[NATURAL].astype(str).agg("|".join, axis=1) for f in frames]
        if self.first.exists():
            known, since = self.first.get()
        else:
            timely = [(int(a), n) for f, names in zip(frames, natural) for a, n, late in zip(f["arrival"], names, f["late"]) if not late]
            since, known = min(timely, default=(None, None))
            if known is not None:
                self.first.update((known, since))
        if known is not None:
            last = max(int(f["window_end"].max().timestamp()) for f in frames)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            floor = timerValues.getCurrentWatermarkInMs() // 1000
            self.handle.registerTimer((max(last, floor) + self.remembered) * 1000)
        for frame, names in zip(frames, natural):
            elsewhere = (names != known) & (frame["arrival"] > since) if known is not None else False
            yield frame.assign(event_id=key[0], elsewhere=elsewhere)[_names(MARKED)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


class MinuteProcessor(StatefulProcessor):
    """Accepts one delivery per natural key of a (scope, minute), in arrival order.

    Copies collapse as they are read: of a row only its place and the number of its content are kept, and winners are
    sought among distinct contents. State is what was accepted, and leaves when the minute's ids are forgotten.
    """

    def __init__(self, remembered: int):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "event_id string", "content_hash string, source_id string, kind string")
        self.natural = handle.getMapState("natural", "source_id string, kind string", "event_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        content = ["event_id", "source_id", "kind", "content_hash", "late", "elsewhere"]
        numbers: dict[tuple, int] = {}
        first: list[int] = []
        places, closes = [], 0
        for frame in rows:
            codes, distinct = pd.factorize(pd.MultiIndex.from_frame(frame[content]))
            arrivals = frame["arrival"].to_numpy(np.int64)
            earliest = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(earliest, codes, arrivals)
            own = np.empty(len(distinct), np.int64)
            for i, (values, arrival) in enumerate(zip(distinct, earliest)):
                own[i] = numbers.setdefault(tuple(values), len(first))
                if own[i] == len(first):
                    first.append(int(arrival))
                first[own[i]] = min(first[own[i]], int(arrival))
            places.append((own[codes], arrivals))
            closes = max(closes, int(frame["window_end"].iloc[0].timestamp()))
        groups = list(numbers)
        # Arrival of what was accepted for the id, whether it is the same, and arrival of what the natural key has; -1: an earlier batch.
        taken: dict[str, tuple] = {}
        held: dict[tuple, int] = {}
        for event_id, source_id, kind, *_ in groups:
            if event_id not in taken and self.ids.containsKey((event_id,)):
                taken[event_id] = (-1, tuple(self.ids.getValue((event_id,))))
            if (source_id, kind) not in held and self.natural.containsKey((source_id, kind)):
                held[source_id, kind] = -1
        for number in np.argsort(np.array(first), kind="stable"):
            event_id, source_id, kind, content_hash, late, elsewhere = groups[number]
            if not late and not elsewhere and event_id not in taken and (source_id, kind) not in held:
                taken[event_id] = (first[number], (content_hash, source_id, kind))
                held[source_id, kind] = first[number]
                self.ids.updateValue((event_id,), (content_hash, source_id, kind))
                self.natural.updateValue((source_id, kind), (event_id,))
        self.handle.registerTimer((max(closes, timerValues.getCurrentWatermarkInMs() // 1000) + self.remembered) * 1000)
        never = np.iinfo(np.int64).max
        by_id = np.array([taken[g[0]][0] if g[0] in taken else never for g in groups])
        same = np.array([g[0] in taken and taken[g[0]][1] == (g[3], g[1], g[2]) for g in groups])
        by_key = np.array([held.get((g[1], g[2]), never) for g in groups])
        elsewhere = np.array([g[5] for g in groups], bool)
        table = pd.DataFrame([g[:4] for g in groups], columns=content[:4])
        for number, arrivals in places:
            outcome = np.select(
                [
                    by_id[number] == arrivals,
                    elsewhere[number],
                    (by_id[number] < arrivals) & same[number],
                    by_id[number] < arrivals,
                    by_key[number] < arrivals,
                ],
                ["ACCEPTED", "EVENT_ID_CONFLICT", "DUPLICATE", "EVENT_ID_CONFLICT", "NATURAL_KEY_CONFLICT"], "LATE_OBSERVATION",
            )
            yield table.iloc[number].assign(scope_id=key[0], window_start=key[1], arrival=arrivals, outcome=outcome)[_names(OUTCOME)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ids.clear()
        self.natural.clear()
        return iter(())

    def close(self) -> None:
        pass


def outcomes(receipts: DataFrame, remembered: int = REMEMBERED_SECONDS) -> DataFrame:
    """Outcome of each streamed delivery, an event id reused in another minute, scope, source or kind included.

    Equals ``ingest.classify`` on the same deliveries while ids are remembered, with one exception: the batch operator frees an id whose first
    timely delivery lost its natural key to another id, and the stream does not, as that is settled under
    another key. A later delivery of such an id under a free natural key is EVENT_ID_CONFLICT here and ACCEPTED there.
    Expects ``content_hash`` and ``arrival``; null ids, scopes or minutes are invalid before this point and ignored.
    """
    rows = receipts.where("event_id IS NOT NULL AND scope_id IS NOT NULL AND window_start IS NOT NULL").withColumn("late", is_late())
    rows = rows.withWatermark("received_at", DISORDER).select(*_names(DELIVERY))
    marked = rows.groupBy("event_id").transformWithStateInPandas(
        IdentityProcessor(remembered), MARKED, "Append", "EventTime", eventTimeColumnName="received_at")
    return marked.groupBy("scope_id", "window_start").transformWithStateInPandas(MinuteProcessor(remembered), OUTCOME, "Append", "EventTime")
