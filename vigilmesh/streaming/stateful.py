"""Keyed streaming operators on ``transformWithStateInPandas``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilmesh import policies
from vigilmesh.streaming.machines import Episode, domain_step, service_step

EPISODE_STATE = (
    "end bigint, verdict string, run_start bigint, run bigint, active boolean, first bigint, sequence bigint, "
    "severity string, critical_run boolean"
)
TRANSITION = "window_start timestamp, phase string, sequence bigint, first_observed_at timestamp, severity string"


class EpisodeProcessor(StatefulProcessor):
    """One episode machine per identity. A micro-batch's windows of an identity are applied in event order."""

    def __init__(self, domain: bool = False, keys: tuple[str, ...] = ("scope_id",)):
        self.domain, self.keys = domain, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("episode", EPISODE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in fields(Episode)]
        known = self.store.get() if self.store.exists() else None
        state = Episode(**dict(zip(names, known))) if known else Episode()
        batch = pd.concat(list(rows)).sort_values("start_s")
        out = []
        for row in batch.itertuples(index=False):
            if self.domain:
                drained = None if pd.isna(row.drained) else bool(row.drained)
                step = domain_step(state, row.start_s, row.end_s, row.verdict, row.severity, bool(row.backlog_required), drained)
            else:
                step = service_step(state, row.start_s, row.end_s, row.verdict, row.severity)
            if step:
                phase, sequence, first, severity = step
                out.append((*key, pd.Timestamp(row.start_s, unit="s"), phase, sequence, pd.Timestamp(first, unit="s"), severity))
        self.store.update(astuple(state))
        columns = [c.split()[0] for c in TRANSITION.split(", ")]
        yield pd.DataFrame(out, columns=[*self.keys, *columns])

    def close(self) -> None:
        pass


def episodes(windows: DataFrame, domain: bool = False, keys: tuple[str, ...] = ("scope_id",)) -> DataFrame:
    """Transitions of a stream of judged windows (keys, window_start, window_end, verdict, severity…).

    ``keys`` is the whole identity of an episode: two domains, kinds or policies of one scope are two machines.
    """
    rows = windows.withColumn("start_s", F.unix_seconds("window_start")).withColumn("end_s", F.unix_seconds("window_end"))
    keep = [*keys, "start_s", "end_s", "verdict", "severity"] + (["backlog_required", "drained"] if domain else [])
    named = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keep).groupBy(*keys).transformWithStateInPandas(
        EpisodeProcessor(domain, tuple(keys)), f"{named}, {TRANSITION}", "Append", "None")


ADMITTED = (
    "outcome string, window_start timestamp, revision bigint, fingerprint string, phase string, sequence bigint, "
    "first_observed_at timestamp, severity string"
)
_ADMITTED = [c.split()[0] for c in ADMITTED.split(", ")]


class AdmissionProcessor(StatefulProcessor):
    """A domain machine per identity that knows what it has taken: replays yield nothing, changed content yields one conflict.

    A window that starts before the end of the last one taken is late and ignored. Fingerprints are kept per
    window and revision until the machine is ``remembered`` seconds further.
    """

    def __init__(self, keys: tuple[str, ...], remembered: int):
        self.keys, self.remembered = keys, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("episode", EPISODE_STATE)
        self.taken = handle.getMapState("taken", "window_start bigint, revision bigint", "fingerprint string, conflicts array<string>")
        self.swept = handle.getValueState("swept", "upto bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in fields(Episode)]
        known = self.store.get() if self.store.exists() else None
        state = Episode(**dict(zip(names, known))) if known else Episode()
        # A copy of a copy says nothing new: the earliest delivery of each content is enough.
        frames = [f.sort_values("arrival").drop_duplicates(["start_s", "revision", "fingerprint"]) for f in rows]
        offers = pd.concat(frames).sort_values("arrival").drop_duplicates(["start_s", "revision", "fingerprint"])
        out = []
        for row in offers.itertuples(index=False):
            at, start = (int(row.start_s), int(row.revision)), pd.Timestamp(row.start_s, unit="s")
            if self.taken.containsKey(at):
                fingerprint, conflicts = self.taken.getValue(at)
                conflicts = list(conflicts if conflicts is not None else [])
                if row.fingerprint != fingerprint and row.fingerprint not in conflicts:
                    self.taken.updateValue(at, (fingerprint, [*conflicts, row.fingerprint]))
                    out.append((*key, "CONFLICT", start, at[1], row.fingerprint, None, None, None, None))
                continue
            if state.end is not None and row.start_s < state.end:
                continue
            drained = None if pd.isna(row.drained) else bool(row.drained)
            step = domain_step(state, int(row.start_s), int(row.end_s), row.verdict, row.severity, bool(row.backlog_required), drained)
            self.taken.updateValue(at, (row.fingerprint, []))
            if step:
                phase, sequence, first, severity = step
                out.append((*key, "TRANSITION", start, at[1], row.fingerprint, phase, sequence, pd.Timestamp(first, unit="s"), severity))
        self.store.update(astuple(state))
        self._forget(state.end)
        frame = pd.DataFrame(out, columns=[*self.keys, *_ADMITTED])
        yield frame.astype({"window_start": "datetime64[ns]", "first_observed_at": "datetime64[ns]", "sequence": "Int64", "revision": "Int64"})

    def _forget(self, end: int | None) -> None:
        """Drops old fingerprints, a share of the time at once: each is looked at a few times only."""
        if end is None:
            return
        floor, swept = end - self.remembered, self.swept.get()[0] if self.swept.exists() else None
        if swept is None:
            self.swept.update((floor,))
        elif floor - swept >= self.remembered // 4:
            for at in [k for k in self.taken.keys() if k[0] < floor]:
                self.taken.removeKey(tuple(at))
            self.swept.update((floor,))

    def close(self) -> None:
        pass


def admitted_episodes(
    offers: DataFrame, keys: tuple[str, ...] = ("scope_id",), remembered: int = policies.FINGERPRINTS_REMEMBERED_SECONDS
) -> DataFrame:
    """Transitions and conflicts of a stream of delivered domain windows: the streamed ``episodes.admitted_lifecycle``.

    ``outcome`` is TRANSITION, with the phase and what belongs to it, or CONFLICT: a window and revision that was taken before came with
    another ``fingerprint``, told once per content. Offers are applied by ``arrival``.
    """
    rows = offers.withColumn("start_s", F.unix_seconds("window_start")).withColumn("end_s", F.unix_seconds("window_end"))
    keep = [*keys, "start_s", "end_s", "revision", "fingerprint", "arrival", "verdict", "severity", "backlog_required", "drained"]
    named = ", ".join(f"{k} {offers.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keep).groupBy(*keys).transformWithStateInPandas(
        AdmissionProcessor(tuple(keys), remembered), f"{named}, {ADMITTED}", "Append", "None")


LATENESS = f"{policies.ALLOWED_LATENESS_SECONDS} seconds"
