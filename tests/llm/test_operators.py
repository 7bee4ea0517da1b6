"""Each corpus operator on edge cases and against a plain version of itself."""

import base64
import hashlib
import random
import time
import re
import wave
import zlib
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import brute
from cases import BASE, EDGES, edges, nothing, sentence, table  # noqa: F401
from loomlog.llm import bpe, common, components, exact, langid, media, minhash, mixing, pretokens, secrets, substring, token_counts, warc

DOCS = [(i, t) for i, t, _, _ in EDGES]


def text_pool(seed=3, count=600):
    rng = random.Random(seed)
    letters = "aaaeb thx \n\t!'s0129\x1c\x85éß漢字👍🏽дшไ "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(count)]


# --- shared helpers ----------------------------------------------------------------------------

def test_words_and_hashes():
    texts = ["", " a  bc\td ", "x", "A bC", "é e"]
    data = b"".join(t.encode() for t in texts)
    places = np.cumsum([0, *(len(t.encode()) for t in texts)])
    begins, ends, counts = common.word_places(np.frombuffer(data, np.uint8), places)
    found = [data[b:e].decode() for b, e in zip(begins, ends)]
    assert [found[a:b] for a, b in zip(counts, counts[1:])] == [brute.words(t) for t in texts]
    plain = common.word_hashes(np.frombuffer(data, np.uint8), begins, ends)
    folded = common.word_hashes(np.frombuffer(data, np.uint8), begins, ends, folded=True)
    assert len(set(plain.tolist())) == len(set(found))
    assert len(set(folded.tolist())) == len({w.lower() for w in found})


def test_a_word_hashes_alike_wherever_it_stands(monkeypatch):
    text = (sentence(9, 300) + " " + "long" * 50 + " " + sentence(9, 300)).encode()
    data = np.frombuffer(text, np.uint8)
    begins, ends, _ = common.word_places(data, np.array([0, len(data)]))
    whole = common.word_hashes(data, begins, ends)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    assert (common.word_hashes(data, begins, ends) == whole).all()
    assert (whole[:300] == whole[-300:]).all()


def test_steps_hold_whole_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 9, None, "b", "c" * 30, ""])], names=["doc_id", "text"])
    sizes = [s.num_rows for s in common.steps([batch, batch.slice(0, 0)], 10)]
    assert sum(sizes) == 5 and max(sizes) < 5


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(1000, 1040)]
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = dict(components.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect())
    assert found == {n: top(n) for n in parent if top(n) != n}
    assert not components.components(spark.createDataFrame([], "a LONG, b LONG")).collect()


# --- 1 language ID -----------------------------------------------------------------------------

def test_language_scores_follow_the_embeddings():
    texts = [t.encode() for t in (BASE, "A b", "", "12", "Straße", sentence(4, 900))]
    table_ = np.random.default_rng(1).integers(-9, 9, (langid.BUCKETS, 3)).astype(np.int32)
    data, places = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    total, number = langid.sums(table_, data, places)
    for n, text in enumerate(texts):
        runs = re.findall(rb"[a-zA-Z\x80-\xff]+", text)
        subwords = [
            w[k:k + size] for w in (b" " + r.lower() + b" " for r in runs) for size in langid.LENGTHS
            for k in range(len(w) - size + 1)
        ]
        assert number[n] == len(subwords)
        alone, _ = langid.sums(table_, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (alone[0] == total[n]).all()


def test_training_holds_its_subwords_in_two_arrays():
    texts = [sentence(n, 60 + n).encode() for n in range(40)] + [b"", b"12"]
    data, places = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    bags = langid._Bags(data, places)
    assert bags.buckets.itemsize + bags.counts.itemsize == 6
    for n, text in enumerate(texts):
        buckets, shares = bags[n]
        total, number = langid.sums(np.ones((langid.BUCKETS, 1), np.int32), np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert np.array_equal(np.unique(buckets), buckets)
        assert np.array_equal(np.rint(shares * number[0]).sum(), total[0, 0])


def test_language_sums_do_not_depend_on_pieces(monkeypatch):
    texts = [sentence(n, 40 * n).encode() for n in range(1, 8)] + [b"", b"x"]
    table_ = np.random.default_rng(1).integers(-9, 9, (langid.BUCKETS, 2)).astype(np.int32)
    data, places = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = langid.sums(table_, data, places)
    monkeypatch.setattr(langid, "PIECE", 37)
    for a, b in zip(whole, langid.sums(table_, data, places)):
        assert (a == b).all()


def test_language_edges(edges, nothing):
    found = langid.languages(edges).collect()
    assert len(found) == len(EDGES)
    for r in found:
        text = [t for i, t in DOCS if i == r.doc_id]
        lettered = any(c.isalpha() for c in text[0] or "")
        assert 0 <= r.score <= 1
        assert (r.lang_pred in ("en", "de") and r.score > 0) if lettered else (r.lang_pred, r.rejected) == ("und", True)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    assert not langid.languages(nothing).collect()
    unlabelled = langid.languages(edges.withColumn("lang", edges.lang.substr(9, 0)).filter("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_one_unlucky_text_does_not_end_rejection():
    assert langid.rejection_threshold(np.array([0.26] + [0.9] * 199)) == 0.5 * 0.999
    assert langid.rejection_threshold(np.array([0.4] * 50 + [0.9] * 150)) == 0.4 * 0.999
    assert langid.rejection_threshold(np.array([])) == 0.5 * 0.999


def language_text(lang, n):
    """Words of own letters per language."""
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}[lang]
    rng = random.Random(f"{lang}{n}")
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(40))


def test_junk_and_unlearned_languages_are_rejected(spark):
    langs = ("aa", "bb", "cc")
    rows = [(n, language_text(langs[n % 3], n), langs[n % 3]) for n in range(240)]
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choice("stuvwxyz") for _ in range(6)) for _ in range(40)), "漢字かな交じり文を読む" * 9, "Привет как дела " * 9]
    frame = spark.createDataFrame(rows + [(1000 + n, t, None) for n, t in enumerate(junk)], "doc_id LONG, text STRING, lang STRING")
    model = langid.learn(frame)
    found = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert all(found[n].lang_pred == lang and not found[n].rejected for n, _, lang in rows)
    assert all(found[1000 + n].rejected for n in range(len(junk)))
    assert sorted(r.doc_id for r in langid.accepted(frame, model).collect()) == [n for n, _, _ in rows]


def test_the_sample_is_bounded_and_takes_languages_in_turn(spark):
    # One language has most rows; one has long texts only; ids repeat, with other texts and with the same.
    taught = [n for n in range(4000) if zlib.crc32(str(n).encode()) % 5]
    rows = [(n, f"en text {n}", "en") for n in taught[:600]] + [(n, f"de text {n}", "de") for n in taught[600:620]]
    rows += [(n, "x" * (200 + n), "fr") for n in taught[620:650]] + [(taught[0], f"en other {n}", "en") for n in range(50)]
    rows += [(taught[1], "same again", "en")] * 70
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(5)
    sample = lambda count, chars: langid.sample(frame, count, chars).collect()
    found = sample(90, 100)
    by_lang = {lang: [r for r in found if r.lang == lang] for lang in ("en", "de", "fr")}
    assert len(found) <= 90 and len(by_lang["de"]) == 20 and len(set(map(tuple, found))) == len(found)
    # Long texts of a language come shortest first, up to all characters of the sample.
    lengths = sorted(len(r.text) for r in by_lang["fr"])
    assert lengths == sorted(200 + n for n in taught[620:650])[:len(lengths)] and sum(len(r.text) for r in found) <= 9000
    assert sorted(map(tuple, sample(90, 100))) == sorted(map(tuple, found))
    # Where nothing fits, each language's first row is taken.
    assert sorted(r.lang for r in sample(8, 1)) == ["de", "en", "fr"]
    long = spark.createDataFrame([(n, language_text("aa", n) * 200, "aa") for n in taught[:30]], "doc_id LONG, text STRING, lang STRING")
    assert {r.lang_pred for r in langid.languages(long).collect()} == {"aa"}


# --- 2 WARC ------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "<p>" + "ä" * 9000), (2, "http://a/2", "x"), (3, None, "x"), (4, "http://a/4\r\nX: y", None), (5, "u", ""),
    (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u", "<p>" + "ä" * 9000), (None, "u", "x"), (None, "u", "alone"), (9, "u", "z" * 70000),
]


@pytest.mark.parametrize("segment", [600, 1 << 20])
def test_warc_round_trip(spark, tmp_path, segment):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id LONG, url STRING, html STRING, record_type STRING")
    warc.write_archives(pages, str(tmp_path / "w"), segment)
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        refers = None if first is None or i == first else first
        want.append((i, len(payload), warc.payload_digest(payload), "response" if refers is None else "revisit", refers, True))
    assert table(warc.read_archives(spark, str(tmp_path / "w"))) == sorted(want, key=str)


def test_warc_records_are_complete_files():
    found = warc.records("x", 1, "u", b"q" * 5000, None, 700)
    packed = zlib.compressobj(wbits=31)
    data = packed.compress(b"".join(r + b"\n" for r in found)) + packed.flush()
    parts = list(warc.archive_records(data))
    assert [int(f["warc-segment-number"]) for f, _ in parts] == list(range(1, len(found) + 1))
    block = b"".join(b for _, b in parts)
    assert int(parts[-1][0]["warc-segment-total-length"]) == len(block)
    assert warc.http_payload(block) == b"q" * 5000
    assert len(list(warc.archive_records(data[:len(data) // 2]))) < len(found)


def test_warc_missing_segment_is_incomplete(spark):
    rows = [warc._row(*p) for p in warc.archive_records(_gzip(warc.records("x", 1, "u", b"q" * 5000, None, 700)))]
    whole = spark.createDataFrame(rows, warc.PARSED)
    assert warc.reassembled(whole).first().complete
    broken = warc.reassembled(whole.filter("segment <> 3")).first()
    assert (broken.complete, broken.payload_bytes, broken.page_id) == (False, None, 1)


def _gzip(parts):
    packed = zlib.compressobj(wbits=31)
    return packed.compress(b"".join(r + b"\n" for r in parts)) + packed.flush()


def test_chunked_framing():
    for payload in (b"", b"a", b"0\r\n\r\n" * 3000):
        assert warc.dechunked(warc.chunked(payload)) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n"):
        assert warc.dechunked(broken) is None


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id LONG, url STRING, html STRING")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert not warc.read_archives(spark, str(tmp_path / "w")).collect()


# --- 3 mixing ----------------------------------------------------------------------------------

def test_targets_and_quotas():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([], [], 0) == []
    assert mixing.targets([0, 10], [5, 1], 15) == [0, 15]
    assert sum(mixing.quotas([1 / 3] * 3)) == 1


def flow_cost(flow, supplies):
    return sum(max(0, sum(f.values()) - s) for f, s in zip(flow, supplies))


def test_flow_is_cheapest():
    rng = random.Random(8)
    for _ in range(200):
        sources = rng.randint(1, 3)
        members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(rng.randint(1, 3))]
        supplies = [rng.randint(0, 3) for _ in members]
        wanted = [rng.randint(0, 5) for _ in range(sources)]
        flow = mixing.cheapest_flow(supplies, members, wanted, 2)
        got = [sum(f.get(s, 0) for f in flow) for s in range(sources)]
        assert all(g <= w for g, w in zip(got, wanted))
        assert all(0 <= sum(f.values()) <= 2 * s and min(f.values()) >= 0 for f, s in zip(flow, supplies))
        best = best_flow(tuple(supplies), members, tuple(wanted))
        assert (sum(got), -flow_cost(flow, supplies)) == best


def best_flow(supplies, members, wanted):
    """The largest flow and, of these, the least use of second passes, by trying all amounts per pattern."""
    from functools import lru_cache
    from itertools import product

    @lru_cache(None)
    def search(pattern, left):
        if pattern == len(supplies):
            return (0, 0)
        found = (-1, 0)
        for given in product(*(range(min(left[s], 2 * supplies[pattern]) + 1) for s in members[pattern])):
            if sum(given) > 2 * supplies[pattern]:
                continue
            rest = list(left)
            for s, g in zip(members[pattern], given):
                rest[s] -= g
            total, cost = search(pattern + 1, tuple(rest))
            found = max(found, (total + sum(given), cost - max(0, sum(given) - supplies[pattern])))
        return found

    return search(0, wanted)


def test_mix_edges(edges, nothing):
    found = mixing.taken_words(edges).collect()
    assert table(mixing.taken_words(edges)) == sorted((tuple(r) for r in found), key=str)
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted((str(i), len(brute.words(t))) for i, t in DOCS)
    source = {}
    for (i, t, _, s) in EDGES:
        source[s] = source.get(s, 0) + len(brute.words(t))
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), amounts in taken.items():
        assert size in source.values() and abs(sum(amounts) - target) <= 1
    assert not mixing.taken_words(nothing).collect()


def plain_mix(rows, share=mixing.SHARE, repeats=mixing.REPEATS):
    """Words taken per document of one source each; ``rows``: doc_id, size, source, slice, rank."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[1] for r in rows if r[2] == name) for name in names]
    weights = [(5, 2, 1)[n % 3] for n in range(len(names))]
    left, open_, goal = share * sum(sizes), set(range(len(names))), {}
    while open_:
        each = left / sum(weights[n] for n in open_)
        full = {n for n in open_ if each * weights[n] > repeats * sizes[n]}
        goal |= {n: repeats * sizes[n] if full else each * weights[n] for n in full or open_}
        left -= sum(goal[n] for n in full)
        open_ = open_ - full if full else set()
    whole = {n: int(goal[n]) for n in goal}
    short = round(sum(goal[n] for n in range(len(names)))) - sum(whole.values())
    for n in sorted(goal, key=lambda n: whole[n] - goal[n])[:max(0, short)]:
        whole[n] += 1
    taken = []
    for n, name in enumerate(names):
        own = sorted((r for r in rows if r[2] == name), key=lambda r: (r[3], r[4], r[0], r[1]))
        passes, rest = divmod(min(whole[n], repeats * sizes[n]), sizes[n]) if sizes[n] else (0, 0)
        for r in own:
            more = min(r[1], rest)
            rest -= more
            taken.append((r[0], r[1], passes * r[1] + more))
    return sorted(taken)


def test_mix_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(n, " ".join(["w"] * rng.choice((0, 1, 7, 30))), rng.choice(("a", "a", "a", "a", "b", "c", "d", None))) for n in range(900)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    hashed = lambda seed: mixing.F.xxhash64(mixing.F.lit(seed), "doc_id")
    places = frame.select(
        "doc_id", mixing.n_words(), "source", mixing.F.pmod(hashed(mixing.SEED), mixing.F.lit(mixing.SLICES)), hashed(mixing.SEED + 1)
    ).collect()
    found = mixing.taken_words(frame.repartition(7)).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, found)) == plain_mix(list(map(tuple, places)))


def test_mix_of_overlapping_sources(spark):
    rows = [(n, 10, [["a"], ["a", "b"], ["b", "b"], [None], []][n % 5]) for n in range(500)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id LONG, size LONG, sources ARRAY<STRING>"))
    facts = {r.source: r for r in found.sources.collect()}
    amount = {}
    for r in found.documents.collect():
        amount[tuple(r.sources)] = amount.get(tuple(r.sources), 0) + r.taken
    assert amount[()] == 0 and abs(amount[(None,)] - facts[None].target) <= 1
    both = amount[("a",)] + amount[("a", "b")] + amount[("b",)]
    # The three patterns of a and b have 3,000 words, each of which can be taken twice.
    assert abs(both - min(6000, facts["a"].target + facts["b"].target)) <= 2


# --- 4 near duplicates -------------------------------------------------------------------------

def test_near_duplicates_on_edges(edges, nothing):
    named = sorted(brute.near([d for d in DOCS if d[0] is not None]), key=str)
    found = table(minhash.near_duplicates(edges))
    assert [r for r in found if r[0] is not None] == named
    # Of the rows without a number, one has the text of document 1, the other has a text of its own.
    assert sorted((r[1:] for r in found if r[0] is None), key=str) == [(1, None, True), (117, 1, False)]
    assert not minhash.near_duplicates(nothing).collect()


def test_near_duplicates_of_a_family(spark):
    rng = random.Random(5)
    base = [f"b{n}" for n in range(150)]
    docs = []
    for n in range(90):
        copy = list(base)
        for k in range(rng.randint(0, 14)):
            copy[rng.randrange(150)] = f"n{n}x{k}"
        docs.append((n, " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id LONG, text STRING"))
    assert table(found) == sorted(brute.near(docs), key=str)


def test_signatures_are_shifts_of_one_permutation():
    shingles = np.arange(40, dtype=np.uint64) * np.uint64(977)
    got = minhash.signatures(shingles, np.array([0, 15]), 6)
    scattered = minhash._permuted(shingles.astype(np.uint32), minhash._SCATTER)
    for k in range(6):
        read = minhash._permuted(scattered + np.uint32(k), minhash._READ)
        assert got[0, k] == read[:15].min() and got[1, k] == read[15:].min()
    every = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash._permuted(every, minhash._READ))) == 1 << 16


# --- 5 media -----------------------------------------------------------------------------------

def test_media_edges(edges, nothing):
    found = media.fingerprints(media.to_wav(edges)).collect()
    by_text = {}
    for r in found:
        text = [t for i, t in DOCS if i == r.doc_id and len((t or "").encode()) == r.n_bytes][0] or ""
        payload = media.padded(text.encode())
        assert len(payload) % 576 == 0 and payload and payload[:r.n_bytes] == text.encode() and set(payload[r.n_bytes:]) <= {255}
        stored = media.write_wav(payload)
        with wave.open(BytesIO(stored)) as file:
            assert file.readframes(file.getnframes()) == payload
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.n_frames == len(payload) // 288 - 1
        assert by_text.setdefault(text, (r.times, r.codes)) == (r.times, r.codes)
        assert len(r.times) == len(r.codes) and list(r.times) == sorted(r.times)
    assert len(found) == len(EDGES)
    assert not media.fingerprints(media.to_wav(nothing)).collect()


def test_fingerprints_follow_a_plain_transform(monkeypatch):
    payload = np.frombuffer(media.padded(sentence(6, 300).encode()), np.uint8)
    count, times, codes = media.fingerprint(payload)
    window = np.hanning(576)
    peaks = []
    last = None
    for frame in range(count):
        part = (payload[frame * 288:frame * 288 + 576].astype(float) - 128) * window
        power = np.abs(np.fft.rfft(part))[1:] ** 2
        own = [(b * 72 + int(power[b * 72:b * 72 + 72].argmax()), power[b * 72:b * 72 + 72]) for b in range(4)]
        strong = [p.max() for _, p in own]
        peaks.append([at + 1 for b, (at, p) in enumerate(own) if p.max() > 2 * p.mean() and (last is None or strong[b] > last[b])])
        last = strong
    want = sorted(
        (t, (x << 12 | y) << 3 | d) for t in range(count) for d in range(1, 4) if t + d < count for x in peaks[t] for y in peaks[t + d]
    )
    assert list(zip(times.tolist(), codes.tolist())) == want and want
    monkeypatch.setattr(media, "FRAMES", 5)
    again = media.fingerprint(payload)
    assert (again[1] == times).all() and (again[2] == codes).all()


# --- 6 repeated passages -----------------------------------------------------------------------

def test_repeats_on_edges(edges, nothing):
    assert table(substring.without_repeats(edges)) == sorted(brute.repeats(DOCS), key=str)
    assert not substring.without_repeats(nothing).collect()


def test_repeats_of_passages(spark):
    rng = random.Random(6)
    pool = [sentence(100 + n, rng.randint(45, 130)) for n in range(6)] + [" ".join(["la"] * 70), " ".join(["la", "li"] * 40)]
    docs = []
    for n in range(40):
        parts = [sentence(1000 * n + k, rng.randint(0, 40)) for k in range(3)]
        docs.append((rng.randrange(10**6), " ".join(x for p in parts for x in (p, rng.choice(pool)))))
    docs = list(dict(docs).items())
    found = substring.without_repeats(spark.createDataFrame(docs, "doc_id LONG, text STRING"))
    assert table(found) == sorted(brute.repeats(docs), key=str)


def test_every_passage_holds_a_mark():
    rng = np.random.default_rng(2)
    for hashes in (rng.integers(0, 2**63, 500).astype(np.uint64), np.full(300, 7, np.uint64), rng.integers(0, 3, 400).astype(np.uint64)):
        places, values = substring.marks(hashes)
        grams = common.run_hashes(hashes, substring.GRAM)
        covered = np.zeros(len(hashes), bool)
        for begin, end in substring._intervals(places, len(hashes)):
            covered[begin:end] = True
        assert covered.all()
        for start in range(len(hashes) - 49):
            least = grams[start:start + substring._REACH].min()
            reach = (places > start - substring._THIN) & (places < start + substring._REACH)
            assert least in values[reach]


# --- 7 secrets ---------------------------------------------------------------------------------

def test_secrets_on_edges(edges, nothing):
    found = table(secrets.secret_spans(edges))
    assert found == sorted(brute.secret_rows(DOCS), key=str)
    assert any("part:" in r[-1] and "endpoint:" in r[-1] for r in found)
    assert not secrets.secret_spans(nothing).collect()


def test_secret_parts_link_only_within_the_scope(spark):
    rng = random.Random(7)
    pieces = ["AKIA" + "Z" * 16, "k9" * 20, "https://x.example/p", "token: abcdef", "f" * 24, "API_KEY='Qq1234'", "AKIAshort", "passwd=abc"]
    docs = [
        (n, " ".join(x for _ in range(9) for x in (rng.choice(pieces), "é" * rng.choice([0, 1, 150, 390, 420])))) for n in range(60)
    ]
    found = secrets.secret_spans(spark.createDataFrame(docs, "doc_id LONG, text STRING"))
    assert table(found) == sorted(brute.secret_rows(docs), key=str)


# --- 8 and 9 tokens ----------------------------------------------------------------------------

def test_units_split_where_the_pattern_splits():
    import regex

    split = regex.compile(public_tokenizers.PATTERN).findall
    for text in text_pool():
        first, rest = pretokens.units(text)
        assert split(text) == [w for unit in (first, *(" " + r for r in rest)) for w in split(unit)]


def test_token_counts(edges, nothing):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    pool = text_pool() + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 3000]
    want = [len(e.ids) for e in library.encode_batch(pool, add_special_tokens=False)]
    assert token_counts.Counter(path).counts(pool) == want
    found = table(token_counts.token_counts(edges))
    plain = [
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in DOCS
    ]
    assert found == sorted(plain, key=str)
    assert not token_counts.token_counts(nothing).collect()


def test_counting_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    path = public_tokenizers.path(token_counts.TOKENIZER)
    counter, library = token_counts.Counter(path), Tokenizer.from_file(path)
    for text in text_pool(5, 40):
        assert counter.counts([text, text]) == 2 * [len(library.encode(text, add_special_tokens=False).ids)]


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path(bpe.TOKENIZER)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library(library, monkeypatch):
    encoder = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(9)
    tokens = [t.decode("utf-8", "ignore").strip() for t in list(encoder.words.ranks)[300:]]
    pool = text_pool() + ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["a" * 2000, "漢字" * 400]
    for size, settled in ((bpe.STATE_BYTES, bpe.SETTLED), (bpe.STATE_BYTES, 7), (10_000, 5)):
        monkeypatch.setattr(bpe, "STATE_BYTES", size)
        monkeypatch.setattr(bpe, "SETTLED", settled)
        for text in pool if settled > 7 else pool[::20] + ["a" * 2000, "漢字" * 400]:
            ids = encoder.encode(text)
            assert ids == library.encode_ordinary(text)
            stream = bpe.StreamDecoder(encoder.words)
            assert "".join(stream.feed([i])[1] for i in ids) + stream.finish() == text
        encoder.forget()


def test_a_word_is_transduced_once_whatever_stands_behind_it(library, monkeypatch):
    encoder, seen = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER)), []
    ids = encoder.transducer.ids
    monkeypatch.setattr(encoder.transducer, "ids", lambda data: seen.append(data) or ids(data))
    for text in ("a zqxvk!$ zqxvk?% zqxvk", "b \n zqxvk\n  zqxvk \n", "zqxvk  \n\n zqxvk!$"):
        assert encoder.encode(text) == library.encode_ordinary(text)
    assert seen.count(b" zqxvk") == 1
    # Places that no byte can go on from are not part of a state.
    nodes = {node for state in encoder.transducer.states for node in state[1::2]}
    assert nodes and all(any((node << 8) + byte in encoder.words.nodes for byte in range(256)) for node in nodes)


def test_idle_workers_give_back_their_tables(monkeypatch):
    path = public_tokenizers.path(bpe.TOKENIZER)
    monkeypatch.setattr(bpe, "IDLE", 0.2)
    with bpe._encoder(path) as first:
        first.encode("some text")
    with bpe._encoder(path) as second:
        assert second is first
        time.sleep(0.5)
    assert path in bpe._ENCODERS
    time.sleep(0.5)
    assert path not in bpe._ENCODERS


def test_decoder_state_machine():
    words = bpe.vocabulary(public_tokenizers.path(bpe.TOKENIZER))
    for data in ("é漢👍🏽a".encode(), b"\xff\xc3", b"\xe6\xbc", b"a\x80\xf0\x9f\x91", b"\xed\xa0\x80x"):
        stream = bpe.StreamDecoder(words)
        shown = "".join(stream.feed([words.ranks[bytes([b])]])[1] for b in data) + stream.finish()
        assert shown == data.decode("utf-8", "replace")


def test_round_trip_on_edges(edges, nothing, library):
    want = []
    for i, t in DOCS:
        ids = library.encode_ordinary(t or "")
        data = (t or "").encode()
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), hashlib.sha256(data).hexdigest(), len(data), len(t or "")))
    assert table(bpe.round_trip(edges)) == sorted(want, key=str)
    assert table(bpe.decoded(bpe.encoded(edges))) == sorted(((i, t or "") for i, t in DOCS), key=str)
    assert not bpe.round_trip(nothing).collect()


# --- 10 exact ----------------------------------------------------------------------------------

def test_exact_on_edges(edges, nothing):
    assert table(exact.exact_groups(edges)) == sorted(brute.exact(DOCS), key=str)
    assert not exact.exact_groups(nothing).collect()


def test_directory_splits_overfull_buckets(spark):
    rng = random.Random(3)
    keys = [(rng.getrandbits(64) - 2**63,) for _ in range(900)] + [((5 << 58) - 2**63 + n,) for n in range(40)]
    found = exact.directory(spark.createDataFrame(keys, "key LONG"), capacity=30).collect()
    held = {}
    for (key,) in keys:
        held.setdefault((key % 2**64) >> (64 - exact.DEPTH), []).append(key)
    assert {r.slot for r in found} == set(held)
    buckets = {}
    for r in found:
        assert r.bucket == r.slot >> (exact.DEPTH - r.depth) << (exact.DEPTH - r.depth)
        buckets.setdefault((r.bucket, r.depth), []).append(r.slot)
    for (bucket, depth), slots in buckets.items():
        width = 1 << (exact.DEPTH - depth)
        count = lambda start, size: sum(len(held.get(s, ())) for s in range(start, start + size))
        assert count(bucket, width) <= 30 or depth == exact.DEPTH
        if depth:
            assert count(bucket // (2 * width) * 2 * width, 2 * width) > 30


def test_colliding_keys_form_a_chain(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    docs = [(n, f"text {n % 4}") for n in range(12)]
    frame = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    assert table(exact.exact_groups(frame)) == sorted(brute.exact(docs), key=str)
    chained = exact.index(frame).orderBy("chain").collect()
    assert [(r.key, r.chain, r.keep_id) for r in chained] == [(7, n, n) for n in range(4)]


def test_rows_come_from_the_entries_of_their_bucket(edges, monkeypatch):
    want = sorted(brute.exact(DOCS), key=str)
    assert table(exact.exact_groups(edges, capacity=1)) == want
    assert len({r.bucket for r in exact.index(edges, capacity=1).collect()}) > 4
    whole = exact._directory_of
    # Without the part of the directory that holds a key, no row with that key finds its entry.
    lost = exact._keyed(edges).filter("doc_id = 4").select(exact._slot(exact.F.col("key"))).first()[0]
    monkeypatch.setattr(exact, "_directory_of", lambda rows, capacity: whole(rows, capacity).filter(f"slot <> {lost}"))
    assert table(exact.exact_groups(edges)) == [r for r in want if r[0] != 4]
