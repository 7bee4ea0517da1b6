"""The registered queries: every operator over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.functions.display import table_columns
from loomlog.functions.hashing import canonical_key
from loomlog.functions.numbers import effective_hint, flex_long, meta_number
from loomlog.functions.text import (
    alias_problem, area_name, detect_marker, normalize_alias, normalize_name, normalize_text, session_label,
)
from loomlog.functions.times import elapsed_text, extract_message_time, parse_message_time
from loomlog.operators import actors as who
from loomlog.operators import areas, collection, exclusions, grouping, incoming, parsing, party, ranges, report, rules
from loomlog.operators import search, summaries, timeline
from loomlog.operators.collection import RAW_KEYS
from loomlog.operators.scans import dense_order
from loomlog.plans.analysis import analyze_slice
from loomlog.plans.derived import RULES, derived_log, read_table
from loomlog.plans.derived_raw import derived_json_lines, derived_raw, derived_snapshots, put_files
from loomlog.sources.lines import canonical_documents, flatten_lines, read_canonical, replay
from loomlog.sources.session_store import write_store
from loomlog.sources.sessions import (
    alias_documents, filter_sessions, read_aliases, read_exclusions, read_sessions, save_exclusions, session_documents,
    session_rollup, with_labels,
)
from loomlog.session import checkpoint_folder
from loomlog.sources.snapshots import explode_snapshot_records, shape_snapshots, stream_rewritten
from loomlog.streaming.collect import read_state, upsert_batch
from loomlog.streaming.runs import RunTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- shared inputs -----------------------------------------------------------------------------

def _range(spark, sf_dir):
    """The whole log without markers and area changes."""
    return ranges.select_range(derived_log(spark, sf_dir))


def _actions(spark, sf_dir):
    return parsing.parse_groups(_range(spark, sf_dir), RULES)


def _actors(spark, sf_dir):
    lines = _range(spark, sf_dir)
    actions = parsing.parse_groups(lines, RULES)
    return summaries.summarize_actors(actions, incoming.incoming_results(lines, actions), ranges.resolve_time(lines))


def _registry(spark, sf_dir):
    """Forty actor names are registered as players; the monsters and seven of these names as others, which wins."""
    names = [f"{c}{d}ara" for c in "ABCD" for d in "abcdefghij"]
    return who.name_registry(spark, pc=names, npc=["goblin", "Orc grunt", *names[:7]])


def _timeline_lines(spark, sf_dir):
    return timeline.with_chain_section(timeline.declarations(_range(spark, sf_dir), RULES))


def _timeline(spark, sf_dir):
    lines = _range(spark, sf_dir)
    return timeline.build_timeline(lines, lines, RULES)[0]


def _selection(spark, sf_dir):
    """From the first marker to the last one."""
    found = ranges.markers(derived_log(spark, sf_dir))
    shape = ("order", "marker_keyword", "message_time_text", F.col("first_seen_at").cast("string").alias("seen"))
    ends = found.agg(F.min_by(F.struct(*shape), "order").alias("a"), F.max_by(F.struct(*shape), "order").alias("b")).first()
    return ranges.Selection(ranges.Endpoint.marker(*ends.a), ranges.Endpoint.marker(*ends.b))


def _exclusions(spark, sf_dir, log):
    """Labelled documents name what is excluded: toxic ones a group, poor ones a line."""
    labels = read_table(spark, sf_dir, "labels")
    toxic = labels.filter("toxic = 1").select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("event_group"))
    poor = labels.filter("quality = 0").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("canonical_record_id"))
    groups = log.join(toxic, "event_group").select("session_folder", "session_id", "event_group").distinct()
    records = log.join(poor, "canonical_record_id").select("session_folder", "session_id", "canonical_record_id").distinct()
    return records, groups


# --- groups and classification -----------------------------------------------------------------

@query
def action_groups(spark, sf_dir):
    return grouping.build_groups(derived_log(spark, sf_dir))


@query
def group_lines(spark, sf_dir):
    return grouping.group_lines(derived_log(spark, sf_dir)).select("session_id", "event_group", "group_pos", "order")


@query
def ungrouped_lines(spark, sf_dir):
    return grouping.ungrouped_count(derived_log(spark, sf_dir))


@query
def parsed_groups(spark, sf_dir):
    return _actions(spark, sf_dir).drop("reason")


@query
def unresolved_groups(spark, sf_dir):
    found = parsing.unresolved(_actions(spark, sf_dir))
    return found.select("session_id", "event_group", "actor", "action_name", "why")


@query
def line_damages(spark, sf_dir):
    log = derived_log(spark, sf_dir).withColumn("v", rules.damage_values(F.col("visible_text")))
    return log.filter(F.size("v") > 0).select(
        "order", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("damages")
    )


@query
def roll_totals(spark, sf_dir):
    text = F.col("visible_text")
    return derived_log(spark, sf_dir).select("order", rules.roll_total(text).alias("roll_total")).filter("roll_total IS NOT NULL")


# --- summaries ---------------------------------------------------------------------------------

@query
def action_summary(spark, sf_dir):
    return summaries.summarize_actions(_actions(spark, sf_dir))


@query
def actor_summary(spark, sf_dir):
    return _actors(spark, sf_dir).drop("average_damage", "incoming_average")


@query
def action_table(spark, sf_dir):
    """The action summary as it is exported."""
    shown = table_columns("actions")
    return summaries.summarize_actions(_actions(spark, sf_dir)).select(*[c.alias(n) for n, c in shown.items()])


@query
def actor_table(spark, sf_dir):
    """The actor summary as it is exported."""
    shown = table_columns("actors")
    return _actors(spark, sf_dir).select(*[c.alias(n) for n, c in shown.items()])


@query
def normal_attack_rates(spark, sf_dir):
    return summaries.normal_attack_summary(_actions(spark, sf_dir))


@query
def damage_stats(spark, sf_dir):
    actions = _actions(spark, sf_dir).filter("parsed")
    return actions.groupBy("action_type").agg(*summaries.damage_statistics()).withColumn(
        "average_damage", summaries.average_damage()
    )


@query
def incoming_results(spark, sf_dir):
    lines = _range(spark, sf_dir)
    return incoming.incoming_results(lines, parsing.parse_groups(lines, RULES)).drop("read_index")


@query
def incoming_summary(spark, sf_dir):
    lines = _range(spark, sf_dir)
    results = incoming.incoming_results(lines, parsing.parse_groups(lines, RULES))
    return incoming.summarize_incoming(results)


@query
def point_summary(spark, sf_dir):
    lines = _range(spark, sf_dir)
    return summaries.summarize_points(lines, ranges.resolve_time(lines)).drop("point_rank")


@query
def actors_with_actions(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    nested = summaries.actor_with_actions(
        summaries.normal_attack_summary(actions), summaries.summarize_actions(actions)
    )
    return nested.select(
        "actor",
        F.size("actions").cast("bigint").alias("action_count"),
        F.aggregate("actions", F.lit(0).cast("bigint"), lambda a, x: a + x.use_count).alias("use_count"),
        F.get("actions", 0).getField("action_name").alias("first_action"),
    )


# --- ranges and time ---------------------------------------------------------------------------

@query
def markers(spark, sf_dir):
    return ranges.markers(derived_log(spark, sf_dir)).select("session_id", "order", "marker_keyword", "message_time_text")


@query
def end_marker_candidates(spark, sf_dir):
    start = _selection(spark, sf_dir).after
    return ranges.end_markers(ranges.markers(derived_log(spark, sf_dir)), start).select("order", "marker_keyword")


@query
def range_between_markers(spark, sf_dir):
    lines = ranges.select_range(derived_log(spark, sf_dir), _selection(spark, sf_dir))
    return lines.select("order", "session_id", "visible_text")


@query
def range_order(spark, sf_dir):
    lines = ranges.select_range(derived_log(spark, sf_dir), _selection(spark, sf_dir))
    return ranges.order_range(lines).select("first_order", "last_order")


@query
def analysis_time(spark, sf_dir):
    log = derived_log(spark, sf_dir)
    whole = ranges.resolve_time(ranges.select_range(log))
    chosen = _selection(spark, sf_dir)
    marked = ranges.resolve_time(ranges.select_range(log, chosen), chosen)
    shape = lambda df, name: ranges.dps_state(df).select(
        F.lit(name).alias("range"), "confidence", "duration_seconds", "can_rate",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("end_time"),
    )
    return shape(whole, "whole").unionByName(shape(marked, "marked"))


@query
def live_slice_summary(spark, sf_dir):
    """The live view from the first to the last marker, by line counts."""
    chosen = _selection(spark, sf_dir)
    return analyze_slice(derived_log(spark, sf_dir), chosen.after, chosen.before, RULES).action_summary


@query
def marked_range_summary(spark, sf_dir):
    lines = ranges.select_range(derived_log(spark, sf_dir), _selection(spark, sf_dir))
    return summaries.summarize_actions(parsing.parse_groups(lines, RULES))


# --- areas -------------------------------------------------------------------------------------

@query
def area_changes(spark, sf_dir):
    return areas.area_changes(derived_log(spark, sf_dir)).select("sequence", "occurrence", "area_name", "order")


@query
def area_stays(spark, sf_dir):
    return areas.area_stays(derived_log(spark, sf_dir)).select(
        "stay", "area_name", "occurrence", "start_order", "end_order", "line_count", "first_time_text",
        "last_time_text", "elapsed_seconds", "elapsed_text",
    )


@query
def segment_assignment(spark, sf_dir):
    return areas.assign_stays(derived_log(spark, sf_dir)).select("order", "stay")


@query
def stay_previews(spark, sf_dir):
    return areas.stay_previews(derived_log(spark, sf_dir))


@query
def large_stays(spark, sf_dir):
    stays = areas.area_stays(derived_log(spark, sf_dir))
    return areas.filter_stays(stays, "area", areas.SMALL_STAY_LINES).select("stay", "area_name", "line_count")


# --- exclusions --------------------------------------------------------------------------------

@query
def excluded_counts(spark, sf_dir):
    lines = _range(spark, sf_dir)
    _, excluded = exclusions.apply_exclusions(lines, *_exclusions(spark, sf_dir, lines))
    return exclusions.exclusion_counts(excluded)


@query
def flagged_lines(spark, sf_dir):
    log = derived_log(spark, sf_dir)
    flagged = exclusions.flag_excluded(log, *_exclusions(spark, sf_dir, log))
    return flagged.select("order", "record_excluded", "group_excluded", "is_excluded")


@query
def included_summary(spark, sf_dir):
    lines = _range(spark, sf_dir)
    included, _ = exclusions.apply_exclusions(lines, *_exclusions(spark, sf_dir, lines))
    actions = parsing.parse_groups(included, RULES)
    time = ranges.resolve_time(lines)
    actors = summaries.summarize_actors(actions, incoming.incoming_results(included, actions), time)
    return actors.select("actor", "total_damage", "use_count", "dps", "incoming_total")


@query
def restored_groups(spark, sf_dir):
    """Restoring every excluded group whose lines mention a goblin also clears their row keys."""
    log = derived_log(spark, sf_dir)
    records, groups = exclusions_of = _exclusions(spark, sf_dir, log)
    flagged = exclusions.flag_excluded(log, *exclusions_of)
    selected = flagged.filter(F.col("group_excluded") & F.col("visible_text").contains("Goblin"))
    edit = exclusions.edit_exclusions("restore_groups", selected, records, groups, log)
    return _edited(edit)


def _edited(edit):
    records = edit.records.select(
        F.lit("record").alias("kind"), "session_folder", "session_id", F.col("canonical_record_id").alias("id")
    )
    return records.union(edit.groups.select(F.lit("group"), "session_folder", "session_id", "event_group"))


@query
def excluded_rows_added(spark, sf_dir):
    """Excluding every miss line whose group is not excluded already."""
    log = derived_log(spark, sf_dir)
    records, groups = _exclusions(spark, sf_dir, log)
    flagged = exclusions.flag_excluded(log, records, groups)
    selected = flagged.filter(~F.col("group_excluded") & F.col("visible_text").contains("ミス"))
    return _edited(exclusions.edit_exclusions("exclude_rows", selected, records, groups, log))


# --- search ------------------------------------------------------------------------------------

@query
def log_search(spark, sf_dir):
    return search.search_log(derived_log(spark, sf_dir), "goblin").select("order", "visible_text")


@query
def log_search_groups(spark, sf_dir):
    return search.search_log(derived_log(spark, sf_dir), "goblin", include_groups=True).select("order", "visible_text")


@query
def log_search_excluded(spark, sf_dir):
    log = derived_log(spark, sf_dir)
    flagged = exclusions.flag_excluded(log, *_exclusions(spark, sf_dir, log))
    return search.search_log(flagged, "goblin", True, True).select("order", "visible_text")


@query
def conversation_search(spark, sf_dir):
    found = search.search_log(_conversation_log(spark, sf_dir), "la", include_groups=True)
    return found.select("session_id", "event_group", "order")


@query
def context_rows(spark, sf_dir):
    """Ten lines before and after every marker, in its folder."""
    placed = search.positioned(derived_log(spark, sf_dir))
    around = search.context(placed, placed.filter("is_marker"))
    return around.select("session_folder", "hit_position", "position", "offset", "order")


@query
def neighbour_hits(spark, sf_dir):
    hits = ranges.markers(derived_log(spark, sf_dir))
    return search.neighbour_hits(hits, ["order"]).select("order", "hit_no", "previous_hit", "next_hit")


# --- actors ------------------------------------------------------------------------------------

@query
def actor_kinds(spark, sf_dir):
    return who.actor_kind(_actors(spark, sf_dir), _registry(spark, sf_dir)).select("actor", "kind")


@query
def visible_actor_summary(spark, sf_dir):
    actors = who.actor_kind(_actors(spark, sf_dir), _registry(spark, sf_dir))
    return who.restrict_actors(actors, who.visible_actors(actors, "pc_like")).select("actor", "kind", "total_damage")


@query
def filtered_actors(spark, sf_dir):
    actors = who.actor_kind(_actors(spark, sf_dir), _registry(spark, sf_dir))
    return who.filter_actors(actors, "ARA", ("registered_npc", "pc_candidate")).select("actor", "kind")


@query
def party_candidates(spark, sf_dir):
    return who.party_candidates(who.actor_kind(_actors(spark, sf_dir), _registry(spark, sf_dir)))


MEMBERS = ("aaara", "Baara", "Caara", "BAARA", "Nobody", "Deara", "Efara", "Fgara", "Ghara")


@query
def party_metrics(spark, sf_dir):
    members = party.roster(spark, MEMBERS)
    return party.party_metrics(_actors(spark, sf_dir), members).select(
        "roster_pos", "name", "actor", "dps", "normal_attack_hit_rate", "dps_share"
    )


@query
def party_totals(spark, sf_dir):
    totals = party.party_totals(party.party_metrics(_actors(spark, sf_dir), party.roster(spark, MEMBERS)))
    return totals.select(F.round("total_dps", 9).alias("total_dps"), "total_hit_rate")


# --- timeline ----------------------------------------------------------------------------------

@query
def line_declarations(spark, sf_dir):
    lines = timeline.declarations(_range(spark, sf_dir), RULES)
    return lines.select("order", "declared_type", "declared_actor", "declared_action", "is_start")


@query
def timeline_events(spark, sf_dir):
    return _timeline(spark, sf_dir).drop("order_min")


@query
def timeline_results(spark, sf_dir):
    lines = _timeline_lines(spark, sf_dir)
    return timeline.timeline_results(lines, timeline.timeline_events(timeline.timeline_groups(lines)))


@query
def resource_totals(spark, sf_dir):
    return timeline.resource_totals(timeline_results(spark, sf_dir))


@query
def timeline_warnings(spark, sf_dir):
    return timeline.timeline_warnings(
        _range(spark, sf_dir), timeline.timeline_groups(_timeline_lines(spark, sf_dir))
    )


@query
def reference_time_asof(spark, sf_dir):
    log = derived_log(spark, sf_dir)
    found = timeline.reference_time(ranges.markers(log).select("session_id", "order"), log)
    return found


@query
def numbered_timeline(spark, sf_dir):
    return timeline.number_events(_timeline(spark, sf_dir)).select("event_no", "session_id", "event_group")


@query
def layout_rows(spark, sf_dir):
    return report.layout_rows(timeline.number_events(_timeline(spark, sf_dir)))


@query
def layout_changes(spark, sf_dir):
    events = timeline.number_events(_timeline(spark, sf_dir))
    return report.mark_changes(events, report.layout_rows(events))


@query
def member_report(spark, sf_dir):
    actions = summaries.summarize_actions(_actions(spark, sf_dir))
    actors = who.actor_kind(_actors(spark, sf_dir), _registry(spark, sf_dir))
    members = who.visible_actors(actors, "pc_like")
    return report.member_report(_timeline(spark, sf_dir), actors, actions, members)


@query
def action_report(spark, sf_dir):
    return report.action_report(_timeline(spark, sf_dir))


@query
def event_source_lines(spark, sf_dir):
    events = timeline.number_events(_timeline(spark, sf_dir))
    return report.source_lines(events, _range(spark, sf_dir)).select("event_no", "order", "visible_text")


@query
def timeline_candidates(spark, sf_dir):
    actors = summaries.normal_attack_summary(_actions(spark, sf_dir))
    return who.timeline_candidates(actors, _timeline(spark, sf_dir), _registry(spark, sf_dir))


@query
def kept_members(spark, sf_dir):
    """Registered players that are still candidates."""
    candidates = timeline_candidates(spark, sf_dir)
    registered = _registry(spark, sf_dir).select(F.col("name").alias("actor"))
    return who.keep_selected(registered, candidates)


# --- sessions and collection -------------------------------------------------------------------

def _sessions(spark, sf_dir):
    """One session per day of the log."""
    return derived_log(spark, sf_dir).groupBy("session_folder", "session_id").agg(
        F.min("first_seen_at").alias("started_at"), F.max("last_seen_at").alias("ended_at")
    )


def _session_stats(spark, sf_dir):
    one = lambda test: F.count_if(test).cast("bigint")
    return derived_raw(spark, sf_dir).groupBy("session_id").agg(
        one(F.col("parse_status") == "error").alias("parse_errors"),
        F.lit(0).cast("bigint").alias("decode_errors"),
        F.lit(0).cast("bigint").alias("gap_warnings"),
    )


@query
def session_rollups(spark, sf_dir):
    rolled = session_rollup(_sessions(spark, sf_dir), _session_stats(spark, sf_dir), derived_log(spark, sf_dir))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rolled.select(
        "session_count", text("earliest_start"), text("latest_end"), "line_count", "marker_count", "gap_warnings",
        "parse_errors", "decode_errors",
    )


@query
def session_labels(spark, sf_dir):
    """Sessions named after their first marker, filtered by alias or id."""
    first = ranges.markers(derived_log(spark, sf_dir)).groupBy("session_id").agg(
        F.min_by("marker_keyword", "order").alias("alias")
    )
    named = _sessions(spark, sf_dir).join(first, "session_id", "left").withColumn("alias", F.coalesce("alias", F.lit("")))
    return filter_sessions(named, "LAP1").select("session_id", session_label("session_id", "alias").alias("label"))


def _stored_log(spark, sf_dir):
    """The log written as session folders and the folder it lies in: days with their manifests, counters and aliases."""
    root = f"{checkpoint_folder(spark)}/sessions-{uuid.uuid4().hex}"
    log = derived_log(spark, sf_dir).withColumn("session_folder", F.col("session_id"))
    begun = _sessions(spark, sf_dir).drop("session_folder").withColumns({
        "session_folder": F.col("session_id"), "status": F.when(F.col("session_id").endswith("5"), "Active").otherwise("completed"),
    })
    stats = _session_stats(spark, sf_dir).withColumn("session_folder", F.col("session_id"))
    aliases = log.filter("is_marker").groupBy("session_folder", "session_id").agg(
        F.min_by("marker_keyword", "order").alias("alias")
    )
    documents = session_documents(begun, stats).unionByName(alias_documents(aliases))
    write_store(documents.unionByName(canonical_documents(log)), root)
    return root


@query
def stored_action_summary(spark, sf_dir):
    """The action summary of a log that was written as session folders and read back."""
    log, _ = read_canonical(spark, _stored_log(spark, sf_dir))
    lines = ranges.select_range(log)
    return summaries.summarize_actions(parsing.parse_groups(lines, RULES))


@query
def stored_sessions(spark, sf_dir):
    """Stored sessions as they are listed: label, state, counters, and the keys excluded in each."""
    root = _stored_log(spark, sf_dir)
    last = derived_log(spark, sf_dir).filter("event_group IS NOT NULL").groupBy(F.col("session_id").alias("session_folder"), "session_id")
    groups = last.agg(F.max("event_group").alias("event_group"))
    records = last.agg(F.max("canonical_record_id").alias("canonical_record_id"))
    save_exclusions(records, groups, root)
    sessions, stats, issues = read_sessions(spark, root)
    labelled = with_labels(sessions, read_aliases(spark, root, sessions)[0])
    left_out, grouped, _ = read_exclusions(spark, root)
    unfinished = issues.filter("code = 'not_completed'").select("session_folder", F.lit(True).alias("unfinished"))
    return (
        labelled.join(stats.select("session_folder", "parse_errors"), "session_folder")
        .join(left_out.select("session_folder", "canonical_record_id"), "session_folder", "left")
        .join(grouped.select("session_folder", "event_group"), "session_folder", "left")
        .join(unfinished, "session_folder", "left")
        .select(
            "session_id", "label", "status", F.coalesce("unfinished", F.lit(False)).alias("unfinished"), "parse_errors",
            "canonical_record_id", "event_group", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ended_at"),
        )
    )


@query
def combined_order(spark, sf_dir):
    return collection.combine_sessions(derived_log(spark, sf_dir)).select("order", "session_id", "session_order")


@query
def raw_dedupe(spark, sf_dir):
    shown = ("session_id", "raw_record_id", "source_file", "record_index", "sequence_hint")
    return collection.dedupe_raw(derived_raw(spark, sf_dir).select(*shown, "file_mtime")).select(*shown)


@query
def canonicalize(spark, sf_dir):
    raw = collection.line_columns(derived_raw(spark, sf_dir))
    lines = collection.canonicalize(collection.dedupe_raw(raw))
    return lines.select(
        "session_id", "canonical_key", "event_group", "visible_text", "sequence_hint_min", "sequence_hint_max",
        "record_count", F.array_join(F.col("source_windows").cast("array<string>"), ",").alias("windows"),
        F.array_join("source_files", ",").alias("files"), "is_marker",
        F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
    )


@query
def canonicalize_in_batches(spark, sf_dir):
    """The stream's merging, fed with the records in three batches, each of which brings older records once more."""
    raw = derived_raw(spark, sf_dir)
    third = F.pmod(F.xxhash64("raw_record_id"), F.lit(3))
    # Hours since the session's day began, whatever day the record itself falls on: a sighting after midnight comes last.
    day = F.to_timestamp(F.substring("session_id", 2, 10), "yyyy-MM-dd")
    hour = (F.unix_seconds("first_seen_at") - F.unix_seconds(day)) / 3600
    path = f"{checkpoint_folder(spark)}/replay-{uuid.uuid4().hex}"
    batches = [hour < 8, (hour < 16) & ((hour >= 8) | (third == 0)), (hour >= 16) | (third == 1)]
    for batch, chosen in enumerate(batches):
        upsert_batch(raw.filter(chosen), batch, path)
    return read_state(
        spark, path,
        ("session_id", "canonical_key", "visible_text", "sequence_hint_min", "sequence_hint_max", "record_count", "order"),
    )


@query
def new_records_in_batches(spark, sf_dir):
    """The batch that first brought each raw record, by the stream's stored runs, which merge in pairs, then in fours.

    Five batches by time of day, each of which brings a third of everything before it once more.
    """
    raw = derived_raw(spark, sf_dir)
    again = F.pmod(F.xxhash64("raw_record_id"), F.lit(3))
    day = F.to_timestamp(F.substring("session_id", 2, 10), "yyyy-MM-dd")
    # Counted from the session's day on, so that a sighting after midnight is in the last batch.
    part = F.least(F.floor((F.unix_seconds("first_seen_at") - F.unix_seconds(day)) / 17_280), F.lit(4))
    path = f"{checkpoint_folder(spark)}/replay-{uuid.uuid4().hex}"
    first = lambda rows: rows.groupBy(*RAW_KEYS).agg(F.min("batch").alias("batch"))
    table = RunTable(path, tuple(RAW_KEYS), first, fanout=2)
    for batch in range(5):
        table.merge(spark, batch)
        # What a batch brings is worked out once, as the stream does.
        brought = raw.filter((part == batch) | ((part < batch) & (again == batch % 3))).select(*RAW_KEYS).distinct()
        brought = brought.persist(StorageLevel.MEMORY_AND_DISK)
        known = table.lookup(brought, batch)
        fresh = brought if known is None else brought.join(known, RAW_KEYS, "left_anti")
        table.write(fresh.withColumn("batch", F.lit(batch).cast("bigint")), batch, brought.count())
        brought.unpersist()
    return table.read(spark)


@query
def numbered_names_order(spark, sf_dir):
    """Places of names that hold numbers in the report's text order; zeros before a number count nothing."""
    name = F.concat_ws("-", "p_type", F.lpad(F.col("p_size").cast("string"), 4, "0"), F.col("p_partkey").cast("string"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("name"))
    return dense_order(parts.withColumn("key", report.text_order("name")), ["key"], name="place").drop("key")


@query
def canonical_order(spark, sf_dir):
    raw = collection.line_columns(derived_raw(spark, sf_dir))
    lines = collection.assign_order(collection.canonicalize(collection.dedupe_raw(raw)))
    return lines.select("session_id", "canonical_key", "order")


@query
def canonical_sources(spark, sf_dir):
    return collection.canonical_sources(collection.dedupe_raw(derived_raw(spark, sf_dir)))


@query
def collection_counters(spark, sf_dir):
    raw = derived_raw(spark, sf_dir)
    deduped = collection.dedupe_raw(raw)
    stats = collection.collection_stats(raw, raw, deduped, collection.canonicalize(deduped))
    return stats.withColumn("last_seen_at", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss"))


@query
def baseline_dropped(spark, sf_dir):
    """What is new after the first day: bodies seen on that day are left out."""
    raw = derived_raw(spark, sf_dir).withColumn("raw_record_hash", F.sha1(F.encode(F.col("visible_text"), "UTF-8")))
    first = raw.select(F.min("session_id")).scalar()
    left = collection.drop_baseline(raw.filter(F.col("session_id") != first), raw.filter(F.col("session_id") == first))
    return left.groupBy("session_id").agg(F.count(F.lit(1)).alias("records"))


@query
def snapshot_records(spark, sf_dir):
    """Binary snapshots made from the log, cut and decoded again."""
    records = explode_snapshot_records(shape_snapshots(derived_snapshots(spark, sf_dir)))
    raw = collection.project_raw(records, "s")
    return raw.select("event_group", "sequence_hint", "visible_text", "is_marker", "marker_keyword", "parse_status",
                      F.col("display.color_code").alias("color_code"), "message_time_text")


@query
def rewritten_snapshots(spark, sf_dir):
    """The snapshots as they rotate: each file is written over by a later one, and a stream reads it again.

    Two rounds of polls with one checkpoint; a third one finds nothing new.
    """
    place = f"{checkpoint_folder(spark)}/rotating-{uuid.uuid4().hex}"
    folder = F.split("path", "/")[2].cast("bigint")
    rotated = F.concat(F.floor(folder / 2).cast("string"), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    for turn in (0, 1, None):
        if turn is not None:
            # Only the files of this turn are made.
            files = derived_snapshots(spark, sf_dir, F.floor(F.col("file_no") / 20) % 2 == turn)
            put_files(files.withColumn("path", rotated), f"{place}/log")
        records = explode_snapshot_records(stream_rewritten(spark, f"{place}/log", listings=f"{place}/listings"))
        polls = records.writeStream.option("checkpointLocation", f"{place}/check").trigger(availableNow=True)
        polls.format("parquet").start(f"{place}/records").awaitTermination()
    raw = collection.project_raw(spark.read.parquet(f"{place}/records"), "s")
    return raw.select("window_id", "rotation_index", "record_index", "event_group", "sequence_hint", "visible_text")


@query
def log_fingerprint(spark, sf_dir):
    return collection.fingerprint(derived_log(spark, sf_dir))


# --- flat raw view -----------------------------------------------------------------------------

@query
def flat_records(spark, sf_dir):
    flat = flatten_lines(derived_json_lines(spark, sf_dir))
    return flat.select(
        F.col("__line_number").alias("line_number"), "session_id", "window_id", "meta1", "meta2", "meta3",
        F.col("`display.color_code`").alias("color_code"), "visible_text", "props", "parse_status", "raw_line",
    )


@query
def flat_filter(spark, sf_dir):
    flat = flatten_lines(derived_json_lines(spark, sf_dir))
    found = search.filter_columns(flat, {"meta2": "CLI", "window_id": "1", "display.color_code": "FF"})
    return found.select("session_id", "meta2")


@query
def replay_lines(spark, sf_dir):
    flat = flatten_lines(derived_json_lines(spark, sf_dir), extras=False)
    return replay(flat, 1).select("record_index", "text", "color")


@query
def flat_page(spark, sf_dir):
    """Page three of the flat table, 100 lines to a page."""
    flat = flatten_lines(derived_json_lines(spark, sf_dir), extras=False)
    shown = flat.withColumn("line_number", F.col("__line_number").cast("bigint"))
    return search.page(shown, 100, 2, ["line_number"]).select("line_number", "session_id")


# --- scalar functions over whole tables --------------------------------------------------------

def _conversation_log(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("session_id"),
        F.col("conv_id").cast("string").alias("event_group"),
        F.col("turn").alias("order"),
        F.col("text").alias("visible_text"),
    )


@query
def conversation_groups(spark, sf_dir):
    return grouping.build_groups(_conversation_log(spark, sf_dir))


@query
def normalized_documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", normalize_text("text").alias("text"))


@query
def document_keys(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents").withColumn("key", canonical_key("lang", normalize_text("text")))
    return documents.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query
def extracted_times(spark, sf_dir):
    found = derived_log(spark, sf_dir).withColumn("t", extract_message_time("visible_text")).filter("t IS NOT NULL")
    return found.select("order", F.col("t.text").alias("time_text"), F.col("t.precision").alias("time_precision"))


@query
def parsed_times(spark, sf_dir):
    log = derived_log(spark, sf_dir)
    strict, loose = parse_message_time("message_time_text"), parse_message_time("message_time_text", True)
    return log.select(
        "order", strict.getField("seconds").alias("seconds"), strict.getField("precision").alias("time_precision"),
        loose.getField("seconds").alias("loose_seconds"),
        elapsed_text(loose.getField("seconds")).alias("elapsed"),
    )


@query
def detected_markers(spark, sf_dir):
    log = derived_log(spark, sf_dir)
    return log.select("order", detect_marker("visible_text").alias("keyword"), area_name("visible_text").alias("area")).filter(
        "keyword IS NOT NULL OR area IS NOT NULL"
    )


@query
def document_markers(spark, sf_dir):
    """Any line prefix may mark: here the word 'license' in documents."""
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", detect_marker("text", "icense").alias("keyword")).filter("keyword IS NOT NULL")


@query
def coerced_numbers(spark, sf_dir):
    raw = derived_raw(spark, sf_dir)
    return raw.groupBy("sequence_hint").agg(F.count(F.lit(1)).alias("records")).select(
        "sequence_hint", "records",
        flex_long("sequence_hint").alias("flexible"),
        flex_long("sequence_hint", "decimal").alias("decimal_only"),
        meta_number("sequence_hint").alias("meta_number"),
        effective_hint(flex_long("sequence_hint") - 500).alias("effective"),
    )


@query
def normalized_names(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", normalize_name("c_name").alias("name"))


@query
def document_aliases(spark, sf_dir):
    """Documents judged as session aliases: most are too long or hold line breaks."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", alias_problem("text").alias("problem"), normalize_alias("text").alias("alias")
    )


FLAGSHIP = "action_summary"
