"""A deterministic log derived from the ``events`` table.

The driver tables hold no battle log, so each event becomes up to three lines of one action group.
The expressions are plain SQL that Spark and DuckDB read alike, so a check query can start from the
same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.operators.rules import RuleSet
from loomlog.session import stored_bytes

CATALOG = ("レッドロータス", "サベッジブレード")
RULES = RuleSet(weapon_skills=CATALOG)


def _name(user: str) -> str:
    return (
        f"chr(CAST(65 + ({user}) % 26 AS INT))"
        f" || chr(CAST(97 + CAST(floor(({user}) / 26) AS BIGINT) % 26 AS INT))"
        f" || chr(CAST(97 + CAST(floor(({user}) / 676) AS BIGINT) % 26 AS INT)) || 'ra'"
    )


A = _name("user_id")
B = _name("user_id + 1")
V = "CAST(CAST(floor(value) AS BIGINT) AS STRING)"
MOB = "CASE event_id % 3 WHEN 0 THEN 'Goblin' WHEN 1 THEN 'Orc Grunt' ELSE '大亀' END"
CLOCK = (
    "lpad(CAST(hour(ts) AS STRING), 2, '0') || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0')"
)
SECONDS = "':' || lpad(CAST(second(ts) AS STRING), 2, '0')"

# The up to three lines of an event; null means no such line.
TEXTS = (
    f"""CASE event_type
WHEN 'click' THEN
  CASE WHEN event_id % 10 = 9 THEN ({MOB}) ELSE {A} END || 'の攻撃。'
  || CASE WHEN event_id % 5 = 0 THEN 'クリティカル！' ELSE '' END
WHEN 'view' THEN
  CASE event_id % 5 WHEN 0 THEN {A} || 'は、レッドロータスを実行。'
                    WHEN 1 THEN {A} || 'は、挑発を実行。'
                    WHEN 2 THEN {A} || 'のコルセアズロール→合計値が' || CAST(1 + event_id % 11 AS STRING) || 'になった！'
                    WHEN 3 THEN {A} || 'のバーサク！'
                    ELSE {A} || 'は、サベッジブレードを実行。' END
WHEN 'purchase' THEN
  CASE WHEN event_id % 6 IN (0, 1, 3) THEN {A} || 'は、' || ({MOB}) || 'にファイアを唱えた。'
       ELSE {A} || 'のファイアが発動。' END
WHEN 'signup' THEN
  CASE event_id % 4 WHEN 0 THEN '→' || {A} || 'は、' || {V} || '経験値を獲得した。'
                    WHEN 1 THEN {A} || 'は、' || CAST(event_id % 9 AS STRING) || 'チェーン！' || {V} || 'リミットポイントを獲得した。'
                    WHEN 2 THEN {A} || 'は、' || {V} || 'エクゼンプラーポイントを獲得した。'
                    ELSE {A} || 'は、ガリモーフリーを' || {V} || '得た、9999になった。' END
WHEN 'error' THEN
  CASE WHEN event_id % 50 < 5 THEN '=== Area' || CAST(event_id % 7 AS STRING) || ' ==='
       WHEN event_id % 50 < 10 THEN '### lap' || CAST(event_id % 3 AS STRING)
       WHEN event_id % 50 < 15 THEN ''
       ELSE '  [' || {CLOCK} || '] 意味のない　　行 ' || CAST(event_id AS STRING) END
END""",
    f"""CASE event_type
WHEN 'click' THEN
  CASE event_id % 7 WHEN 0 THEN '→' || ({MOB}) || 'に、ミス。'
                    WHEN 1 THEN {B} || 'は、攻撃を回避した。'
                    WHEN 2 THEN '→' || {B} || 'に、' || {V} || 'ダメージ。'
                    WHEN 3 THEN NULL
                    ELSE '→' || ({MOB}) || 'に、' || {V} || 'ダメージ。' END
WHEN 'view' THEN
  CASE event_id % 5 WHEN 0 THEN '→亀に、' || {V} || 'ダメージ。' || ({MOB}) || 'に、100ダメージ。'
                    WHEN 1 THEN '→' || ({MOB}) || 'は、挑発の効果。'
                    WHEN 2 THEN '→' || {B} || 'は、コルセアズロールの効果。'
                    WHEN 3 THEN '→' || ({MOB}) || 'から、' || {V} || 'TP吸収。'
                    ELSE '→' || ({MOB}) || 'に、' || {V} || 'ダメージ。' END
WHEN 'purchase' THEN
  CASE event_id % 6 WHEN 1 THEN {A} || 'のファイアが発動。'
                    WHEN 2 THEN '→' || {B} || 'のHPが、' || {V} || '回復。'
                    WHEN 3 THEN {A} || 'は、詠唱中断した。'
                    WHEN 4 THEN '→' || ({MOB}) || 'は、レジストされた。'
                    WHEN 5 THEN '→' || ({MOB}) || 'は、麻痺の状態になった！' END
END""",
    f"""CASE event_type
WHEN 'click' THEN CASE WHEN event_id % 11 = 0 THEN '連携：核熱。→' || ({MOB}) || 'に、77ダメージ。' END
WHEN 'view' THEN
  CASE WHEN event_id % 11 < 3 THEN '連携：湾曲。'
       WHEN event_id % 11 = 3 THEN '連携：光。→' || ({MOB}) || 'に、55ダメージ。'
       WHEN event_id % 11 = 4 THEN '→' || {B} || 'のHPが、' || {V} || '回復。' END
WHEN 'purchase' THEN
  CASE event_id % 6 WHEN 1 THEN '→' || ({MOB}) || 'に、' || {V} || 'ダメージ。'
                    WHEN 2 THEN '→' || ({MOB}) || 'から、' || {V} || 'HP吸収。' END
END""",
)

GROUP = """CASE WHEN event_type = 'error' AND event_id % 50 < 15 THEN NULL
WHEN event_id % 13 = 0 THEN 'g' || CAST(event_id - 1 AS STRING)
ELSE 'g' || CAST(event_id AS STRING) END"""

TIME_TEXT = f"""CASE WHEN event_id % 9 = 0 THEN NULL
WHEN event_id % 8 = 0 THEN '[' || {CLOCK} || ']'
WHEN event_id % 10 = 3 THEN {CLOCK}
ELSE '[' || {CLOCK} || {SECONDS} || ']' END"""

MARKER = "event_type = 'error' AND event_id % 50 >= 5 AND event_id % 50 < 10"

# Column name -> SQL over events and the line number n.
COLUMNS = {
    "session_id": "'s' || CAST(CAST(ts AS DATE) AS STRING)",
    "session_folder": "'folder-s' || CAST(CAST(ts AS DATE) AS STRING)",
    "canonical_record_id": "'r' || CAST(event_id * 3 + n AS STRING)",
    "event_group": GROUP,
    '"order"': "event_id * 3 + n + 1",
    "read_index": "event_id * 3 + n",
    "sequence_hint_min": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(n AS BIGINT) END",
    "visible_text": "visible_text",
    "message_time_text": TIME_TEXT,
    "first_seen_at": "ts",
    "last_seen_at": "ts",
    "is_marker": f"COALESCE({MARKER}, FALSE)",
    "marker_keyword": f"CASE WHEN {MARKER} THEN 'lap' || CAST(event_id % 3 AS STRING) END",
}

# The same lines for the check engine: a CTE named `log` over the `events` view.
SELECTED = ",\n".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())
LOG_CTE = f"""log AS MATERIALIZED (SELECT {SELECTED}
FROM (SELECT *, unnest([{", ".join(TEXTS)}]) AS visible_text, unnest([0, 1, 2]) AS n FROM events)
WHERE visible_text IS NOT NULL)"""


# Stored bytes of a table that one task begins with. What a task derives from them and sorts is some hundred times as large.
PART_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. If its files are fewer than the cores, or than its size asks for, it is spread over more tasks."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    parts = max(spark.sparkContext.defaultParallelism, -(-stored_bytes(spark, path) // PART_BYTES))
    return table.repartition(parts) if len(table.inputFiles()) < parts else table


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines of all events of one scale folder."""
    texts = [F.expr(sql).alias(f"text{n}") for n, sql in enumerate(TEXTS)]
    wide = read_table(spark, sf_dir, "events").select("*", *texts)
    lines = wide.select("*", F.posexplode(F.array("text0", "text1", "text2")).alias("n", "visible_text"))
    columns = {name.strip('"'): F.expr(sql) for name, sql in COLUMNS.items()}
    columns |= {n: columns[n].cast("timestamp") for n in ("first_seen_at", "last_seen_at")}
    return lines.filter(F.col("visible_text").isNotNull()).select(*[c.alias(n) for n, c in columns.items()])
