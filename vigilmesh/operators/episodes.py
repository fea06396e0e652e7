"""Episode lifecycles over verdict series, as window expressions.

The machines look sequential, but each part of their state is a function of runs: the breach and
healthy counters are lengths of the current run, and "active" is the last of two signals seen — open
(a breach run reached its threshold) or close (a healthy run reached its). So a whole lifecycle is a
few running aggregates over one sort, with no Python and no per-key state in a task.

Every input must have at most one row per key and window (``one_per_window`` guarantees it), which
bounds a key's series by the calendar and not by the traffic: a year of minutes is 525,600 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmesh import policies
from vigilmesh.functions.fingerprint import identity


def one_per_window(rows: DataFrame, keys: list[str], arrival: str, fingerprint: str | None = None) -> DataFrame:
    """First delivery per (key, window); ``conflict`` marks windows replayed with different content."""
    rest = [c for c in rows.columns if c not in (*keys, "window_start")]
    aggregates = [F.min_by(F.struct(*rest), arrival).alias("r")]
    if fingerprint:
        aggregates.append((F.min(fingerprint) != F.max(fingerprint)).alias("conflict"))
    grouped = rows.groupBy(*keys, "window_start").agg(*aggregates)
    extra = ["conflict"] if fingerprint else []
    return grouped.select(*keys, "window_start", "r.*", *extra)


def in_order(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Flag ``late``: the window starts before the end of one that arrived earlier for the key."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    committed = F.max("window_end").over(before)
    return rows.withColumn("late", F.coalesce(F.col("window_start") < committed, F.lit(False)))


def admitted(offers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct content of a delivered window, with ``outcome`` and ``copies``.

    In order of ``arrival`` a window is COMMITTED unless it starts before the end of one committed earlier. What comes later
    for the same window and ``revision`` is a replay if its ``fingerprint`` is equal (it only counts among the copies), and a CONFLICT
    otherwise; every other late window is LATE. Copies collapse before anything is ordered, so a key's series is as
    long as its calendar times the contents of a window.
    """
    same = [*keys, "window_start", "revision", "fingerprint"]
    rest = [c for c in offers.columns if c not in same]
    first = offers.groupBy(*same).agg(F.min_by(F.struct(*rest), "arrival").alias("r"), F.count("*").alias("copies"))
    marked = in_order(first.select(*same, "r.*", "copies"), keys, "arrival")
    taken = F.max(F.when(~F.col("late"), F.col("fingerprint"))).over(Window.partitionBy(*keys, "window_start", "revision"))
    outcome = F.when(~F.col("late"), "COMMITTED").when(taken.isNotNull(), "CONFLICT").otherwise("LATE")
    return marked.withColumn("outcome", outcome).drop("late")


def admitted_lifecycle(offers: DataFrame, keys: list[str]) -> DataFrame:
    """Transitions of the domain machine over what is committed, and the conflicts, each once."""
    judged = admitted(offers, keys)
    moved = domain_lifecycle(judged.where("outcome = 'COMMITTED'"), keys).select(
        *keys, F.lit("TRANSITION").alias("outcome"), "window_start", "revision", "fingerprint", "phase", "sequence",
        "first_observed_at", F.col("episode_severity").alias("severity"))
    conflicts = judged.where("outcome = 'CONFLICT'").select(*keys, "outcome", "window_start", "revision", "fingerprint")
    return moved.unionByName(conflicts, allowMissingColumns=True)


def _series(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("window_start")


def streaks(rows: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """``bad`` and ``healthy``: length of the run of adjacent equal verdicts that ends at each row."""
    order = _series(keys)
    adjacent = F.coalesce(F.lag("window_end").over(order) == F.col("window_start"), F.lit(False))
    same = adjacent & F.coalesce(F.lag(verdict).over(order) == F.col(verdict), F.lit(False))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select("*", adjacent.alias("adjacent"), same.alias("_same"), F.row_number().over(order).alias("_i"))
    started = F.max(F.when(~F.col("_same"), F.struct(F.col("_i"), F.col("window_start")))).over(upto)
    marked = marked.withColumn("_run", started)
    length = F.col("_i") - F.col("_run._i") + 1
    return (
        marked.withColumn("run_start", F.col("_run.window_start"))
        .withColumn("bad", F.when(F.col(verdict) == "BREACH", length).otherwise(0))
        .withColumn("healthy", F.when(F.col(verdict) == "HEALTHY", length).otherwise(0))
        .drop("_same", "_i", "_run")
    )


def _activity(rows: DataFrame, keys: list[str], open_after: int, recover_after: int, hold: Column) -> DataFrame:
    """Phases from run lengths. ``hold`` marks rows that are UNKNOWN inside an episode."""
    order = _series(keys)
    signal = F.when(F.col("bad") >= open_after, F.lit(True)).when(
        (F.col("healthy") >= recover_after) & ~hold, F.lit(False)
    )
    marked = rows.withColumn("_signal", signal)
    before = F.last("_signal", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_was", F.coalesce(before, F.lit(False)))
    phase = (
        F.when(~F.col("_was"), F.when(F.col("bad") >= open_after, F.lit("OPEN")))
        .when(hold, "UNKNOWN")
        .when(F.col("healthy") >= recover_after, "RECOVERY")
        .otherwise("UPDATE")
    )
    marked = marked.withColumn("phase", phase)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.count_if(F.col("phase") == "OPEN").over(upto)
    first = F.last(F.when(F.col("phase") == "OPEN", F.col("run_start")), ignorenulls=True).over(upto)
    return marked.withColumn("episode_no", opened).withColumn("first_observed_at", first).drop("_signal", "_was")


def _emitted(rows: DataFrame, keys: list[str], identity_parts: list[Column]) -> DataFrame:
    """Transitions only, with sequence, episode and detection identities and technical state."""
    order = Window.partitionBy(*keys, "episode_no").orderBy("window_start")
    out = rows.where(F.col("phase").isNotNull()).withColumn("sequence", F.row_number().over(order).cast("bigint"))
    episode = identity(*identity_parts, F.unix_seconds("first_observed_at"))
    out = out.withColumn("episode_id", episode)
    return out.withColumn(
        "detection_id", identity(F.col("episode_id"), F.col("sequence"), F.unix_seconds("window_start"), F.col("phase"))
    ).withColumn(
        "technical_state",
        F.when(F.col("phase") == "RECOVERY", "RECOVERED").when(F.col("phase") == "UNKNOWN", "UNKNOWN")
        .otherwise("ONGOING"),
    )


def service_lifecycle(
    rows: DataFrame,
    keys: list[str],
    open_after: int = policies.OPEN_AFTER_BREACHED,
    recover_after: int = policies.RECOVER_AFTER_HEALTHY,
) -> DataFrame:
    """Service machine: a gap resets both runs and then counts its own window; inside an episode the
    window after a gap, or an unknown verdict, is UNKNOWN. Severity follows the newest breach."""
    runs = streaks(rows, keys)
    hold = ~F.col("adjacent") | (F.col("verdict") == "UNKNOWN")
    active = _activity(runs, keys, open_after, recover_after, hold)
    taken = (F.col("verdict") == "BREACH") & F.col("phase").isin("OPEN", "UPDATE")
    upto = _series(keys).rowsBetween(Window.unboundedPreceding, 0)
    severe = F.last(F.when(taken, F.col("severity")), ignorenulls=True).over(upto)
    return _emitted(active.withColumn("episode_severity", severe), keys, [F.col(k) for k in keys])


def domain_verdict(verdict: Column, gap: Column, backlog_required: Column, drained: Column) -> Column:
    """A window after a gap counts for nothing; healthy waits until the backlog is known to be drained."""
    return (
        F.when(gap, "UNKNOWN")
        .when((verdict == "HEALTHY") & backlog_required & drained.isNull(), "UNKNOWN")
        .when((verdict == "HEALTHY") & backlog_required & ~drained, "GRAY")
        .otherwise(verdict)
    )


def domain_lifecycle(
    rows: DataFrame,
    keys: list[str],
    open_after: int = policies.OPEN_AFTER_BREACHED,
    recover_after: int = policies.RECOVER_AFTER_HEALTHY,
    from_candidate: bool = True,
) -> DataFrame:
    """Domain machine. ``rows`` also has ``backlog_required`` and ``drained``.

    Severity only rises within an episode. ``from_candidate`` counts the breaches that led to the
    opening; the minute variant starts from the opening window itself.

    The backlog gate may be applied outside episodes too: there it only turns healthy windows into
    others that do not count either.
    """
    order = _series(keys)
    last_end = F.lag("window_end").over(order)
    gap = last_end.isNotNull() & (last_end != F.col("window_start"))
    gated = domain_verdict(F.col("verdict"), gap, F.col("backlog_required"), F.col("drained"))
    runs = streaks(rows.withColumn("effective", gated), keys, "effective")
    active = _activity(runs, keys, open_after, recover_after, F.col("effective") == "UNKNOWN")
    critical = (F.col("effective") == "BREACH") & (F.col("severity") == "CRITICAL")
    if from_candidate:
        run = Window.partitionBy(*keys, "run_start").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
        own = F.when(F.col("phase") == "OPEN", F.max(critical).over(run)).otherwise(critical)
    else:
        own = critical
    active = active.withColumn("_critical", own)
    span = Window.partitionBy(*keys, "episode_no").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    raised = F.max(F.when(F.col("phase").isNotNull(), F.col("_critical"))).over(span)
    severe = F.when(raised, "CRITICAL").otherwise("HIGH")
    return _emitted(active.withColumn("episode_severity", severe), keys, [F.col(k) for k in keys]).drop("_critical")
