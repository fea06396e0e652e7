"""Sequential episode transitions for streams: the same machines as the batch window expressions."""

from __future__ import annotations

from dataclasses import dataclass

from vigilmesh import policies


@dataclass
class Episode:
    """State of one key. Times are epoch seconds."""

    end: int | None = None
    verdict: str | None = None
    run_start: int | None = None
    run: int = 0
    active: bool = False
    first: int | None = None
    sequence: int = 0
    severity: str | None = None
    critical_run: bool = False


@dataclass(frozen=True)
class Thresholds:
    open_after: int = policies.OPEN_AFTER_BREACHED
    recover_after: int = policies.RECOVER_AFTER_HEALTHY


def extend_run(state: Episode, start: int, verdict: str, joined: bool) -> None:
    if joined and verdict == state.verdict:
        state.run += 1
    else:
        state.run, state.run_start = 1, start
    state.verdict = verdict


def emit(state: Episode, phase: str) -> tuple[str, int]:
    if phase == "OPEN":
        state.active, state.first, state.sequence = True, state.run_start, 0
    if phase == "RECOVERY":
        state.active = False
    state.sequence += 1
    return phase, state.sequence


def phase_of(state: Episode, verdict: str, held: bool, limits: Thresholds) -> str | None:
    if not state.active:
        return "OPEN" if verdict == "BREACH" and state.run >= limits.open_after else None
    if held:
        return "UNKNOWN"
    return "RECOVERY" if verdict == "HEALTHY" and state.run >= limits.recover_after else "UPDATE"


def service_step(state: Episode, start: int, end: int, verdict: str, severity: str, limits: Thresholds = Thresholds()):
    """Advance the service machine; None when nothing is emitted or the window is late."""
    if state.end is not None and start < state.end:
        return None
    adjacent = state.end == start
    extend_run(state, start, verdict, adjacent)
    state.end = end
    phase = phase_of(state, verdict, not adjacent or verdict == "UNKNOWN", limits)
    if phase is None:
        return None
    if verdict == "BREACH" and phase != "UNKNOWN":
        state.severity = severity
    name, sequence = emit(state, phase)
    return name, sequence, state.first, state.severity


def domain_step(
    state: Episode, start: int, end: int, verdict: str, severity: str, required: bool, drained: bool | None,
    limits: Thresholds = Thresholds(),
):
    """Advance the domain machine: gaps count for nothing, backlog delays recovery, severity only rises."""
    if state.end is not None and start < state.end:
        return None
    gap = state.end is not None and state.end != start
    if gap:
        verdict = "UNKNOWN"
    elif verdict == "HEALTHY" and required and drained is not True:
        verdict = "UNKNOWN" if drained is None else "GRAY"
    extend_run(state, start, verdict, state.end is not None and not gap)
    state.end = end
    critical = verdict == "BREACH" and severity == "CRITICAL"
    state.critical_run = critical or (state.critical_run and state.run > 1)
    phase = phase_of(state, verdict, verdict == "UNKNOWN", limits)
    if phase is None:
        return None
    if phase == "OPEN":
        state.severity = "CRITICAL" if state.critical_run else "HIGH"
    elif critical:
        state.severity = "CRITICAL"
    name, sequence = emit(state, phase)
    return name, sequence, state.first, state.severity
