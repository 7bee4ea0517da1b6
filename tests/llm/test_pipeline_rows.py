"""The pipeline's stages on tables with null and repeated ids: every row is decided by itself."""

import re
from collections import Counter

import pytest

import brute
import corpus_pipeline
from cases import EDGES, FIELDS, sentence
from loomlog.llm import langid

MORE = [
    (None, "98765 ??", "en", "c"),
    (None, "nobody's  text", "en", "e"),
    (None, sentence(7, 90), "en", "e"),
    (None, sentence(7, 90) + " end", "en", "a"),
    (21, sentence(8, 60), "de", "b"),
    (21, sentence(9, 60), "de", "b"),
    (21, "4711", "de", "b"),
]


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    rows = [(i, t, lang, source, len(t or ""), *["x"] * 7) for i, t, lang, source in [*EDGES, *MORE]]
    path = str(tmp_path_factory.mktemp("rows") / "documents")
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def last(i):
    return (i is None, i or 0)


def test_language_stage(spark, frame):
    texts = sorted({r.text or "" for r in frame.collect()})
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    by_text = {texts[r.doc_id]: r.rejected for r in langid.predict(numbered, langid.learn(frame)).collect()}
    want = Counter(p for p in pairs(frame).elements() if not by_text[p[1] or ""])
    found = pairs(corpus_pipeline.keep_languages(spark, frame, ""))
    assert found == want and (None, "98765 ??") not in found and (21, "4711") not in found


def test_exact_stage(spark, frame):
    groups = {}
    for i, t in pairs(frame).elements():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    found = pairs(corpus_pipeline.drop_copies(spark, frame, ""))
    shown = Counter((i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in found.elements())
    assert shown == Counter((min(ids, key=last), t) for t, ids in groups.items())


def test_near_stage(spark, frame):
    rows = list(pairs(frame).elements())
    groups = {}
    for n, _, component, _ in brute.near([(n, t) for n, (_, t) in enumerate(rows)], 5):
        groups.setdefault(component, []).append(rows[n][0])
    found = corpus_pipeline.drop_near_copies(spark, frame, "").collect()
    assert Counter(r.doc_id for r in found) == Counter(min(ids, key=last) for ids in groups.values())


def test_mix_stage(spark, frame):
    before = pairs(frame)
    found = corpus_pipeline.mix_sources(spark, frame, "")
    assert found.columns == frame.columns
    taken = pairs(found)
    assert all(n <= 2 * before[p] for p, n in taken.items())
    words = sum(len(brute.words(t)) for _, t in before.elements())
    assert sum(len(brute.words(t)) for _, t in taken.elements()) <= 2 * words


def test_all_stages(spark, frame):
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, frame, "")
        rows = after.collect()
        if number == len(corpus_pipeline.STAGES) - 1:
            assert len(rows) == frame.count()
            break
        assert after.columns == frame.columns
        if number in (1, 2):
            assert max(Counter((r.doc_id, r.text) for r in rows).values()) == 1
        frame = spark.createDataFrame(rows, frame.schema).coalesce(2)
