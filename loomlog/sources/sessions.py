"""Session folders: manifests, counters, exclusions, aliases, and the tables that go with them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import alias_problem, contains_ignoring_case, is_blank, normalize_alias, session_label
from loomlog.schemas import ALIAS_JSON, EXCLUSIONS_JSON, SESSION_JSON, STATS_JSON, ddl
from loomlog.sources.documents import as_json, merged, parse_document, spelled_document
from loomlog.sources.session_store import folder_in, read_store, write_store

REQUIRED_FILES = ("session.json", "canonical_records.jsonl", "stats.json")
OPTIONAL_FILES = ("raw_records.jsonl",)
FORMAT_VERSION = 1


def _read(spark: SparkSession, root: str, name: str, schema: dict[str, str]) -> DataFrame:
    """One small JSON document per folder; ``_bad`` keeps a document that does not parse."""
    files = read_store(spark, root, [name]).filter(F.col("file") == name)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json(F.to_json("_document"), ddl({**schema, "_bad": "STRING"}), options)
    read = files.withColumn("_document", parse_document("content")).select("session_folder", "content", parsed.alias("_d"))
    unread = F.when(F.col("_d").isNull(), F.col("content")).otherwise(F.col("_d._bad"))
    return read.select("session_folder", *[f"_d.{n}" for n in schema], unread.alias("_bad"))


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """Which of the known files each folder has. Contents are not read, and an empty log is a log."""
    return read_store(spark, root).groupBy("session_folder").agg(
        *[F.bool_or(F.col("file") == n).alias(n) for n in (*REQUIRED_FILES, *OPTIONAL_FILES)]
    ).filter(" OR ".join(f"`{n}`" for n in (*REQUIRED_FILES, *OPTIONAL_FILES)))


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Folders that hold a session manifest, in name order."""
    return session_files(spark, root).filter("`session.json`").select("session_folder").orderBy("session_folder")


def read_sessions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, stats, issues). A folder that lacks a required file is an issue, not a session."""
    present = session_files(spark, root).filter("`session.json`")
    complete = F.lit(True)
    for name in REQUIRED_FILES:
        complete = complete & F.col(f"`{name}`")
    usable = present.filter(complete).select("session_folder", F.col("`raw_records.jsonl`").alias("has_raw"))
    manifests = _read(spark, root, "session.json", SESSION_JSON).join(usable, "session_folder")
    status = F.lower("status")
    readable = F.col("_bad").isNull() & (status.isNull() | status.isin(*fixed.SESSION_STATUSES))
    sessions = manifests.filter(readable).drop("_bad").withColumn("status", F.coalesce(status, F.lit("unknown")))
    stats = _read(spark, root, "stats.json", STATS_JSON).join(usable.select("session_folder"), "session_folder", "left_semi")
    counters = [n for n in STATS_JSON if n != "last_seen_at"]
    missing = present.select(
        "session_folder",
        F.explode(F.filter(
            F.array(*[F.when(~F.col(f"`{n}`"), F.lit(n)) for n in REQUIRED_FILES]), lambda n: n.isNotNull()
        )).alias("detail"),
    ).select("session_folder", F.lit("missing_file").alias("code"), "detail")
    unreadable = manifests.filter(~readable).select(
        "session_folder", F.lit("unreadable_file").alias("code"), F.lit("session.json").alias("detail")
    ).unionByName(stats.filter(F.col("_bad").isNotNull()).select(
        "session_folder", F.lit("unreadable_file").alias("code"), F.lit("stats.json").alias("detail")
    ))
    unfinished = sessions.filter(F.col("status") != "completed").select(
        "session_folder", F.lit("not_completed").alias("code"), F.col("status").alias("detail")
    )
    filled = stats.filter(F.col("_bad").isNull()).drop("_bad").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in counters}
    )
    return sessions, filled, missing.unionByName(unreadable).unionByName(unfinished)


def read_exclusions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record keys, group keys, errors). A bad document blocks its folder: it gives an error and no keys."""
    files = _read(spark, root, "analysis_exclusions.json", EXCLUSIONS_JSON)
    # Keys left out of the document mean the defaults: version 1 and empty lists.
    version = F.coalesce(F.col("schema_version"), F.lit(FORMAT_VERSION))
    blank_record = F.exists("records", lambda k: k.isNull() | is_blank(k.session_id) | is_blank(k.canonical_record_id))
    blank_group = F.exists("groups", lambda k: k.isNull() | is_blank(k.session_id) | is_blank(k.event_group))
    good = (
        F.col("_bad").isNull()
        & (version == FORMAT_VERSION)
        & ~F.coalesce(blank_record, F.lit(False))
        & ~F.coalesce(blank_group, F.lit(False))
    )
    checked = files.withColumn("_good", good)
    usable = checked.filter("_good")
    records = usable.select("session_folder", F.explode("records").alias("k")).select("session_folder", "k.*").distinct()
    groups = usable.select("session_folder", F.explode("groups").alias("k")).select("session_folder", "k.*").distinct()
    errors = checked.filter(~F.col("_good")).select(
        "session_folder",
        F.when(F.col("_bad").isNotNull(), "unreadable_file")
        .when(version != FORMAT_VERSION, "wrong_version")
        .otherwise("blank_key").alias("code"),
    )
    return records, groups, errors


def blocked_sessions(log: DataFrame, errors: DataFrame) -> DataFrame:
    """Lines of folders whose exclusions could not be read: they must not be analysed."""
    return log.join(errors.select("session_folder").distinct(), "session_folder", "left_semi")


def write_exclusions(records: DataFrame, groups: DataFrame, path: str) -> None:
    """Replace the exclusion tables of one folder (``records`` and ``groups`` under ``path``)."""
    bad = records.filter(is_blank("session_id") | is_blank("canonical_record_id"))
    worse = groups.filter(is_blank("session_id") | is_blank("event_group"))
    if not bad.isEmpty() or not worse.isEmpty():
        raise ValueError("exclusion keys must not be blank")
    for name, keys in (("records", records), ("groups", groups)):
        keys.distinct().withColumn("schema_version", F.lit(FORMAT_VERSION)).write.mode("overwrite").json(f"{path}/{name}")


def read_exclusion_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_exclusions` wrote."""
    records = spark.read.schema("session_id STRING, canonical_record_id STRING").json(f"{path}/records")
    groups = spark.read.schema("session_id STRING, event_group STRING").json(f"{path}/groups")
    return records, groups


def exclusion_documents(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Exclusions as documents of a store, from keys with their ``session_folder``; blank keys are an error.

    A document is written line by line, one key a line, so that no folder's keys become one row.
    """
    parts = []
    for number, (keys, names) in enumerate(((records, ("session_id", "canonical_record_id")), (groups, ("session_id", "event_group")))):
        bad = F.lit(False)
        for name in names:
            bad = bad | F.col(name).isNull() | is_blank(name)
        if not keys.filter(bad).isEmpty():
            raise ValueError("exclusion keys must not be blank")
        nth = F.row_number().over(Window.partitionBy("session_folder").orderBy(*names))
        line = F.concat(F.when(F.col("nth") > 1, ",").otherwise(""), as_json(keys, names))
        listed = keys.select("session_folder", *names).distinct().withColumn("nth", nth)
        parts.append(listed.select("session_folder", (F.lit(number << 40) + F.col("nth")).alias("place"), line.alias("line")))
    frame = ((0, f'{{"schema_version":{FORMAT_VERSION},"records":['), (1 << 40, '],"groups":['), (1 << 41, "]}"))
    keys = parts[0].unionByName(parts[1])
    edges = keys.select("session_folder").distinct().select(
        "session_folder", F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("place"), F.lit(t).alias("line")) for p, t in frame])).alias("e")
    ).select("session_folder", "e.place", "e.line")
    return keys.unionByName(edges).select("session_folder", F.lit("analysis_exclusions.json").alias("file"), "place", "line")


def save_exclusions(records: DataFrame, groups: DataFrame, root: str) -> None:
    """Replace the exclusions of the folders that have keys; :func:`read_exclusions` reads them."""
    write_store(exclusion_documents(records, groups), root)


def _documents(rows: DataFrame, file: str, columns: dict[str, str] | list[str]) -> DataFrame:
    shown = [n for n in columns if n in rows.columns]
    return rows.select("session_folder", F.lit(file).alias("file"), F.lit(0).cast("bigint").alias("place"), as_json(rows, shown).alias("line"))


def session_documents(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Manifests and counters (each with ``session_folder``) as documents of a store."""
    return _documents(sessions, "session.json", SESSION_JSON).unionByName(_documents(stats, "stats.json", STATS_JSON))


def alias_documents(aliases: DataFrame) -> DataFrame:
    """Aliases (``session_folder``, ``session_id``, ``alias``) as documents of a store."""
    if not aliases.filter(alias_problem("alias").isNotNull()).isEmpty():
        raise ValueError("an alias holds a control character or is too long")
    named = aliases.withColumns({"alias": normalize_alias("alias"), "schema_version": F.lit(FORMAT_VERSION)})
    return _documents(named, "session_annotations.json", ALIAS_JSON)


def edit_manifest(
    spark: SparkSession, root: str, session_id: str, status: str, at: datetime, manual: bool = False
) -> None:
    """Close one stored session. Keys of its manifest that are not concerned stay, known or not.

    A completion by hand needs an active session and keeps its end time.
    """
    if status not in ("completed", "aborted"):
        raise ValueError("a session can be completed or aborted")
    if manual and status != "completed":
        raise ValueError("only an active session can be completed by hand")
    found = read_store(spark, root, ["session.json"]).filter(F.col("file") == "session.json")
    named = found.withColumn("_keys", parse_document("content"))
    text = lambda key: F.try_variant_get(F.col("_keys")[key], "$", "string")
    mine = named.filter(text("session_id") == session_id)
    if manual:
        mine = mine.filter(text("status") == "active")
    if mine.isEmpty():
        raise ValueError("only an active session can be completed by hand" if manual else f"no session {session_id}")
    stamp = F.date_format(F.lit(at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    changes = {"status": F.lit(status), "manually_completed_at" if manual else "ended_at": stamp}
    edited = mine.select(
        folder_in(root).alias("session_folder"), "file", F.lit(0).cast("bigint").alias("place"),
        merged(spelled_document("content"), changes).alias("line"),
    )
    write_store(edited, root)


def read_aliases(spark: SparkSession, root: str, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, errors). An alias counts only in version 1 and for the session of its folder."""
    files = _read(spark, root, "session_annotations.json", ALIAS_JSON)
    owner = sessions.select("session_folder", F.col("session_id").alias("_owner"))
    version = F.coalesce(F.col("schema_version"), F.lit(FORMAT_VERSION))
    code = (
        F.when(F.col("_bad").isNotNull(), "unreadable_file")
        .when(version != FORMAT_VERSION, "wrong_version")
        .when(~F.coalesce("session_id", F.lit("")).eqNullSafe(F.col("_owner")), "other_session")
        .otherwise(alias_problem("alias"))
    )
    judged = files.join(owner, "session_folder").withColumn("code", code)
    aliases = judged.filter(F.col("code").isNull()).select(
        "session_folder", "session_id", normalize_alias("alias").alias("alias")
    )
    return aliases, judged.filter(F.col("code").isNotNull()).select("session_folder", "code")


def write_aliases(aliases: DataFrame, path: str) -> None:
    if not aliases.filter(alias_problem("alias").isNotNull()).isEmpty():
        raise ValueError("an alias holds a control character or is too long")
    aliases.withColumns({"alias": normalize_alias("alias"), "schema_version": F.lit(FORMAT_VERSION)}).write.mode(
        "overwrite"
    ).json(path)


def session_id_for(started_at: datetime) -> str:
    return started_at.strftime("%Y%m%d-%H%M%S")


def new_manifest(spark: SparkSession, started_at: datetime, **facts) -> DataFrame:
    """The manifest row of a session that has just begun."""
    row = dict.fromkeys(SESSION_JSON) | {
        "schema_version": "1.0", "raw_schema_version": "1.0", "canonical_schema_version": "1.0",
        "session_id": session_id_for(started_at), "status": "active", "started_at": started_at,
        "encoding": fixed.TEXT_ENCODING, "timezone": "Asia/Tokyo", **facts,
    }
    return spark.createDataFrame([tuple(row[n] for n in SESSION_JSON)], ddl(SESSION_JSON))


def set_session_status(sessions: DataFrame, session_id: str, status: str, at: datetime, manual: bool = False) -> DataFrame:
    """Close one session. A manual completion needs an active session and keeps its end time."""
    if status not in ("completed", "aborted"):
        raise ValueError("a session can be completed or aborted")
    mine = F.col("session_id") == F.lit(session_id)
    if manual:
        if status != "completed" or sessions.filter(mine & (F.col("status") == "active")).isEmpty():
            raise ValueError("only an active session can be completed by hand")
        changed = {"status": status, "manually_completed_at": at}
    else:
        changed = {"status": status, "ended_at": at}
    return sessions.withColumns({n: F.when(mine, F.lit(v)).otherwise(F.col(n)) for n, v in changed.items()})


def write_manifest(sessions: DataFrame, path: str) -> None:
    sessions.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def filter_sessions(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions whose alias or id contains ``text`` (columns ``session_id`` and ``alias``)."""
    needle = text.strip()
    if not needle:
        return sessions
    alias = F.coalesce(F.col("alias"), F.lit(""))
    return sessions.filter(contains_ignoring_case(alias, needle) | contains_ignoring_case("session_id", needle))


def with_labels(sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    known = aliases.select("session_folder", "alias")
    joined = sessions.join(known, "session_folder", "left").withColumn("alias", F.coalesce("alias", F.lit("")))
    return joined.withColumn("label", session_label("session_id", "alias"))


def session_rollup(sessions: DataFrame, stats: DataFrame, log: DataFrame) -> DataFrame:
    """One row over the chosen sessions: counts, earliest start, latest end, error sums."""
    lines = log.agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if(F.col("is_marker")).alias("marker_count")
    )
    sums = stats.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("gap_warnings", "parse_errors", "decode_errors")])
    one = lambda df, name: df.select(name).scalar()
    return sessions.agg(
        F.count(F.lit(1)).alias("session_count"),
        F.min("started_at").alias("earliest_start"),
        F.max("ended_at").alias("latest_end"),
    ).withColumns(
        {
            "line_count": one(lines, "line_count"),
            "marker_count": one(lines, "marker_count"),
            **{n: one(sums, n) for n in ("gap_warnings", "parse_errors", "decode_errors")},
        }
    )
