"""A whole analysis as lazy tables, for stored logs and for the live view."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomlog.operators import exclusions as ex
from loomlog.operators.collection import combine_sessions
from loomlog.operators.incoming import incoming_results
from loomlog.operators.parsing import parse_groups
from loomlog.operators.party import party_metrics, party_totals, roster
from loomlog.operators.ranges import Selection, order_range, resolve_time, select_range, select_slice
from loomlog.operators.rules import DEFAULT_RULES, RuleSet
from loomlog.operators.summaries import summarize_actions, summarize_actors, summarize_points
from loomlog.operators.timeline import build_timeline
from loomlog.schemas import as_log
from loomlog.sources.sessions import blocked_sessions

RECORD_KEYS = "session_id STRING, canonical_record_id STRING"
GROUP_KEYS = "session_id STRING, event_group STRING"


@dataclass(frozen=True)
class Analysis:
    """Result tables. Nothing runs before one of them is read."""

    range_lines: DataFrame
    included: DataFrame
    excluded: DataFrame
    time: DataFrame
    actions: DataFrame
    action_summary: DataFrame
    actor_summary: DataFrame
    points: DataFrame
    timeline: DataFrame | None = None
    warnings: DataFrame | None = None

    @property
    def unparsed(self) -> DataFrame:
        return self.actions.filter(~F.col("parsed"))

    @property
    def exclusion_counts(self) -> DataFrame:
        return ex.exclusion_counts(self.excluded)

    @property
    def order_range(self) -> DataFrame:
        return order_range(self.range_lines)


def _summaries(included: DataFrame, time: DataFrame, rules: RuleSet):
    actions = parse_groups(included, rules)
    incoming = incoming_results(included, actions)
    return actions, summarize_actions(actions), summarize_actors(actions, incoming, time)


def analyze(
    log: DataFrame,
    selection: Selection = Selection(),
    excluded_records: DataFrame | None = None,
    excluded_groups: DataFrame | None = None,
    rules: RuleSet = DEFAULT_RULES,
    with_timeline: bool = True,
    accept_unbracketed: bool = False,
    exclusion_errors: DataFrame | None = None,
    combined: bool = False,
) -> Analysis:
    """Analyse one range. Time is settled on the whole range, sums on what is not excluded.

    The sessions of ``log`` are put into one order first, to which ``selection`` refers; ``combined`` says that this was
    done. Folders whose exclusions could not be read (``exclusion_errors``) must not be analysed.
    """
    spark = log.sparkSession
    if exclusion_errors is not None and not blocked_sessions(log, exclusion_errors).isEmpty():
        raise ValueError("the exclusions of some folders could not be read")
    lines = select_range(as_log(log if combined else combine_sessions(as_log(log))), selection)
    time = resolve_time(lines, selection, accept_unbracketed)
    if excluded_records is None and excluded_groups is None:
        included, excluded = lines, lines.filter(F.lit(False))
    else:
        records = excluded_records if excluded_records is not None else spark.createDataFrame([], RECORD_KEYS)
        groups = excluded_groups if excluded_groups is not None else spark.createDataFrame([], GROUP_KEYS)
        included, excluded = ex.apply_exclusions(lines, records, groups)
    actions, action_summary, actor_summary = _summaries(included, time, rules)
    timeline, warnings = build_timeline(included, lines, rules) if with_timeline else (None, None)
    return Analysis(
        lines, included, excluded, time, actions, action_summary, actor_summary,
        summarize_points(included, time), timeline, warnings,
    )


def analyze_slice(log: DataFrame, start: int, end: int | None = None, rules: RuleSet = DEFAULT_RULES) -> Analysis:
    """The live view: lines ``[start, end)`` of a dense log, area changes included, nothing excluded."""
    lines = select_slice(as_log(log), start, end)
    time = resolve_time(lines)
    actions, action_summary, actor_summary = _summaries(lines, time, rules)
    return Analysis(
        lines, lines, lines.filter(F.lit(False)), time, actions, action_summary, actor_summary,
        summarize_points(lines, time),
    )


def party_view(analysis: Analysis, members: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(member rows, totals) of the party overlay."""
    rows = party_metrics(analysis.actor_summary, roster(analysis.included.sparkSession, members))
    return rows, party_totals(rows)
