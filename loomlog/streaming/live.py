"""Live analysis: a movable range over growing lines, recomputed per trigger, and running counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.collection import fingerprint
from loomlog.operators.grouping import GROUP_KEYS, groupable
from loomlog.operators.parsing import classify_groups, group_facts, line_facts
from loomlog.operators.rules import DEFAULT_RULES, RuleSet
from loomlog.operators.summaries import summarize_actions
from loomlog.plans.analysis import Analysis, analyze_slice, party_view
from loomlog.schemas import as_log

MIN_REFRESH_MS, MAX_REFRESH_MS = 250, 1000
MIN_POLL_MS, MAX_POLL_MS, DEFAULT_POLL_MS = 250, 5000, 1000


def refresh_interval(milliseconds: int) -> str:
    """Trigger interval of the live view, kept within its limits."""
    return f"{min(max(milliseconds, MIN_REFRESH_MS), MAX_REFRESH_MS)} milliseconds"


def poll_interval(milliseconds: int = DEFAULT_POLL_MS) -> str:
    if not MIN_POLL_MS <= milliseconds <= MAX_POLL_MS:
        raise ValueError(f"the poll interval must be {MIN_POLL_MS} to {MAX_POLL_MS} ms")
    return f"{milliseconds} milliseconds"


@dataclass(frozen=True)
class LiveRange:
    """Bounds of the live range as line counts; ``end`` is None while it runs."""

    session_id: str
    start: int = 0
    end: int | None = None
    running: bool = False

    def begin(self, lines: int) -> "LiveRange":
        """Start at what is there now."""
        return replace(self, start=lines, end=None, running=True)

    def stop(self, lines: int) -> "LiveRange":
        """Freeze the end."""
        return replace(self, end=lines, running=False) if self.running else self

    def reset(self, lines: int) -> "LiveRange":
        """Move the start to now; a stopped range becomes empty."""
        return replace(self, start=lines, end=None if self.running else lines)

    def follow(self, session_id: str) -> "LiveRange":
        """A new session starts a new range."""
        return self if session_id == self.session_id else LiveRange(session_id, 0, None, self.running)


@dataclass(frozen=True)
class LiveUpdate:
    analysis: Analysis
    members: DataFrame
    totals: DataFrame
    mark: tuple


def live_update(
    log: DataFrame,
    bounds: LiveRange,
    members: Sequence[str] = (),
    rules: RuleSet = DEFAULT_RULES,
    previous: tuple | None = None,
) -> LiveUpdate | None:
    """Recompute the live range, or None when its lines have not changed since ``previous``."""
    own = as_log(log).filter(F.col("session_id") == F.lit(bounds.session_id))
    analysis = analyze_slice(own, bounds.start, bounds.end, rules)
    mark = tuple(fingerprint(analysis.range_lines).first())
    if mark == previous:
        return None
    rows, totals = party_view(analysis, members)
    return LiveUpdate(analysis, rows, totals, mark)


def live_analysis(
    changes: DataFrame,
    read_log: Callable[[], DataFrame],
    read_bounds: Callable[[], LiveRange],
    publish: Callable[[LiveUpdate], None],
    checkpoint: str,
    members: Sequence[str] = (),
    rules: RuleSet = DEFAULT_RULES,
    refresh_ms: int | None = None,
) -> StreamingQuery:
    """Publish a new result whenever changed lines arrive and the range has really changed.

    Micro-batches run one after the other, so a result is never stale; an unchanged range is
    recognised by its fingerprint and not recomputed.
    """
    last: dict[str, tuple | None] = {"mark": None}

    def run(_: DataFrame, __: int) -> None:
        update = live_update(read_log(), read_bounds(), members, rules, last["mark"])
        if update is not None:
            last["mark"] = update.mark
            publish(update)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    trigger = {"availableNow": True} if refresh_ms is None else {"processingTime": refresh_interval(refresh_ms)}
    return writer.trigger(**trigger).start()


def stream_groups(lines: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Group facts as a running aggregate over a stream of lines (update mode).

    State is a few fields per group, whatever the number of its lines. A group may grow at any time,
    so a changed group comes out again and replaces its earlier version.
    """
    return group_facts(line_facts(groupable(as_log(lines)), rules))


def live_actor_counts(
    lines: DataFrame, path: str, checkpoint: str, rules: RuleSet = DEFAULT_RULES, interval: str | None = None
) -> StreamingQuery:
    """Keep versions of classified groups under ``path``; read them with :func:`current_actions`."""

    def store(frame: DataFrame, batch: int) -> None:
        classify_groups(frame, rules).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream_groups(lines, rules).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(store)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current_actions(versions: DataFrame) -> DataFrame:
    """The latest version of every group (``versions`` has the ``batch`` column)."""
    fields = [n for n in versions.columns if n not in GROUP_KEYS]
    latest = F.max_by(F.struct(*fields), F.col("batch")).alias("_v")
    return versions.groupBy(*GROUP_KEYS).agg(latest).select(*GROUP_KEYS, "_v.*").drop("batch")


def current_action_summary(versions: DataFrame) -> DataFrame:
    return summarize_actions(current_actions(versions))
