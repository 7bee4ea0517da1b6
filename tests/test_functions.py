from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomlog.functions import numbers as n
from loomlog.functions import text as t
from loomlog.functions import times as tm
from loomlog.functions.hashing import canonical_key, raw_record_id
from loomlog.sources.exports import export_name, safe_part


def values(spark, texts, expression):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i INT, x STRING")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_message_time_anywhere(spark):
    cases = {
        "[21:35] a": ("21:35", "minute"), "a [21:35:12]": ("21:35:12", "second"), "[9:05]": ("9:05", "minute"),
        "[24:00] text": None, "[12:60] text": None, "[12:30:60] text": None, "[1:5] text": None,
        "[25:00] [10:11] x": ("10:11", "minute"), "plain": None,
    }
    got = values(spark, list(cases), tm.extract_message_time)
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_message_time_whole_value(spark):
    cases = ["[21:35:10]", " [21:35] ", "", "21:35", "[24:00]", "[21:60]", "[21:35:60]", None]
    got = values(spark, cases, tm.parse_message_time)
    assert [tuple(g) if g else None for g in got] == [
        (77710, "second"), (77700, "minute"), None, None, None, None, None, None,
    ]
    assert values(spark, ["21:35"], lambda c: tm.parse_message_time(c, True))[0].seconds == 77700


def test_elapsed_text(spark):
    frame = spark.createDataFrame([(0, 2853), (1, 59), (2, 3661), (3, 0), (4, None)], "i INT, s BIGINT")
    got = [r.e for r in frame.select("i", tm.elapsed_text("s").alias("e")).orderBy("i").collect()]
    assert got == ["47分33秒", "59秒", "1時間1分1秒", "-", "-"]


def test_markers(spark):
    cases = {
        "/echo ###start:aminon": "start:aminon", "[21:35] ###end:aminon": "end:aminon", "/echo ### test": "test",
        "/echo ###　test": "test", "日本語 ###開始": "開始", "マーカーなし": None, "#": None, "#test": None, "": None,
    }
    assert values(spark, list(cases), t.detect_marker) == list(cases.values())
    assert values(spark, ["###a"], lambda c: t.detect_marker(c, "  ")) == [None]
    assert values(spark, ["x (+) go"], lambda c: t.detect_marker(c, "(+)")) == ["go"]


def test_text_and_names(spark):
    assert values(spark, ["a\u0000b　 \t c ", "　"], t.normalize_text) == ["ab c", ""]
    assert values(spark, [" xITRA ", "gurfurlur The", ""], t.normalize_name) == ["Xitra", "Gurfurlur the", ""]
    assert values(spark, ["=== Area A ===", "===　海　===", "=== ===", "== x =="], t.area_name) == ["Area A", "海", None, None]
    assert values(spark, ["80ff00aa", "00aaFF", "zz", None], t.css_color) == ["#ff00aa", "#00aaFF", "inherit", "inherit"]
    assert values(spark, [" a ", "a\nb", "x" * 101, None], t.alias_problem) == [None, "control_character", "too_long", None]
    assert values(spark, [" a ", "a b"], t.normalize_alias) == ["a", None]
    assert values(spark, ["x", ""], lambda c: t.session_label(F.lit("s1"), c)) == ["x（s1）", "s1"]


def test_numbers(spark):
    texts = ["12", "1F", "-5", "", "zz", "+7", "1.5", "FFFFFFFFFFFFFFFF", None]
    assert values(spark, texts, n.flex_long) == [12, 31, -5, None, None, 7, None, -1, None]
    assert values(spark, ["12", "1F"], lambda c: n.flex_long(c, "decimal")) == [12, None]
    meta = ["6A3B", "1700000000", "00000010", "0", "", "1g", None]
    assert values(spark, meta, n.meta_number) == [0x6A3B, 1700000000, 16, None, None, None, None]
    with pytest.raises(ValueError):
        n.flex_long("x", "octal")


def test_keys(spark):
    import hashlib

    assert values(spark, ["b"], lambda c: canonical_key(F.lit("a"), c)) == [hashlib.sha1(b"ab").hexdigest()]
    assert values(spark, ["b"], lambda c: canonical_key(F.lit(None).cast("string"), c)) == [hashlib.sha1(b"b").hexdigest()]
    got = values(spark, ["x"], lambda c: raw_record_id(F.lit("1_0.log"), F.lit(3), F.encode(c, "UTF-8")))
    assert got == [hashlib.sha1(b"1_0.log3x").hexdigest()]


def test_export_names():
    day, later, next_day = datetime(2026, 6, 23, 21, 35, 10), datetime(2026, 6, 23, 21, 35, 40), datetime(2026, 6, 24)
    assert export_name("a", day, later, None, "r", "p") == "p_a_20260623_213510-213540_r.csv"
    assert export_name("a", day, next_day, None, "r", "p") == "p_a_20260623-213510_20260624-000000_r.csv"
    assert export_name("a", None, later, None, "r", "p") == "p_a_20260623_213540_r.csv"
    assert export_name("a", None, None, day, "", "p") == "p_a_20260623_指定範囲.csv"
    assert safe_part(' a<b>:c. ', "f") == "a_b__c"
    assert safe_part("x" * 50, "f") == "x" * 40


def test_display(spark):
    from loomlog.functions import display as d
    from loomlog.functions import fixed_values as fixed

    frame = spark.createDataFrame([(0, 0.75, 3, 4, 1234.565), (1, 1 / 3, 1, 3, 12.125), (2, None, 0, 0, None)], "i INT, r DOUBLE, n INT, d INT, v DOUBLE")
    got = frame.select(
        "i", d.percent_with_counts("r", "n", "d").alias("a"), d.percent("r").alias("b"), d.grouped("v", 2).alias("c"), d.grouped("v").alias("e"),
    ).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("75％(3/4)", "75.0%", "1,234.57", "1,235"), ("33.3％(1/3)", "33.3%", "12.13", "12"), ("-(0/0)", "-", "-", "-"),
    ]
    assert values(spark, ["exact", "other"], lambda c: d.label(c, fixed.CONFIDENCE_LABELS)) == ["秒単位", "other"]
