"""The registered corpus queries over whole tables, against their SQL or a plain version."""

import base64
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
import corpus_pipeline
from loomlog.llm.check_sql import CHECKS
from loomlog.llm.queries import QUERIES

SF_DIR = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def rows(found, *columns):
    return sorted(tuple(r[c] for c in columns) for r in found)


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = duck.execute(CHECKS[name])
    columns = [d[0] for d in found.description]
    theirs = sorted(found.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in run(spark, name)), key=str) == theirs


def test_op1(spark, docs):
    found = run(spark, "op1_language_id")
    named = {i: lang for i, _, lang, _ in docs}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in named if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == named[r.doc_id] for r in held) >= 0.95 * len(held) and len(found) == len(docs)


def test_op3(spark, docs):
    found = run(spark, "op3_source_mix")
    source = {i: s for i, _, _, s in docs}
    assert rows(found, "doc_id", "size") == sorted((i, len(brute.words(t))) for i, t, _, _ in docs)
    for name in set(source.values()):
        own = [r for r in found if source[r.doc_id] == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and sum(r["size"] for r in own) == own[0].source_size


def test_op4(spark, docs):
    found = run(spark, "op4_near_duplicates")
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near([d[:2] for d in docs]))


def test_op5(spark, docs):
    found = run(spark, "op5_media_fingerprints")
    assert rows(found, "doc_id", "n_bytes") == sorted((i, len((t or "").encode())) for i, t, _, _ in docs)
    assert all(re.fullmatch(r"\d+:\d+:[0-9a-f]{40}", r.feature) for r in found)


def test_op6(spark, docs):
    found = run(spark, "op6_repeated_passages")
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats([d[:2] for d in docs]))


def test_op7(spark, docs):
    found = run(spark, "op7_secret_links")
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert rows(found, *columns) == sorted(brute.secret_rows([d[:2] for d in docs]))


def test_op8(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [len(e.ids) for e in library.encode_batch([t or "" for _, t, _, _ in docs], add_special_tokens=False)]
    assert rows(run(spark, "op8_token_counts"), "doc_id", "n_tokens") == sorted((d[0], n) for d, n in zip(docs, counts))


def test_op9(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _, _ in docs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    assert rows(run(spark, "op9_bpe_round_trip"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_pipeline(spark, docs):
    """Every stage against a plain version of it on the rows that it got."""
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = frame.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in frame.collect()]
        after = stage(spark, frame, SF_DIR)
        if number == 4:
            assert len(after.collect()) == len(before)
            break
        assert after.columns == names
        frame = spark.createDataFrame(after.collect(), frame.schema).coalesce(2)
        kept = sorted(r.doc_id for r in frame.collect())
        if number == 0:
            assert kept == [i for i, t in sorted(before) if any(c.isalpha() for c in t or "")]
        elif number == 1:
            assert kept == sorted(i for i, _, _, k, _ in brute.exact(before) if k)
        elif number == 2:
            assert kept == sorted(i for i, _, _, k in brute.near(before, 5) if k)
        else:
            sizes = {i: len(brute.words(t)) for i, t in before}
            assert set(kept) <= set(sizes) and max(map(kept.count, kept)) <= 2
            total = sum(sizes[i] for i in kept)
            assert abs(total - 1.5 * sum(sizes.values())) <= 20 * max(sizes.values())
