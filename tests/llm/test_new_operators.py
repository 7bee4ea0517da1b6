"""Phrases, the prefix trie and the URL filter against plain versions, on edges and with small budgets and slices."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import edges, nothing, table  # noqa: F401
from loomlog.llm import phrases, prefix_trie, urls
from loomlog.llm.phrases import collocations
from loomlog.llm.prefix_trie import prefix_trie as trie
from loomlog.llm.urls import Rule, judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(docs, least=10, top=2000, contained=50):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for phrase, c in f.items() if len(phrase) == 1)
        wanted = {phrase: a for phrase, a in f.items() if len(phrase) > 1 and a >= least}
        inside = {p[k:k + 2] for p, a in wanted.items() if len(p) == 3 for k in (0, 1) if 100 * a >= contained * f[p[k:k + 2]]}
        found = []
        for phrase, a in wanted.items():
            if phrase not in inside:
                cuts = [(1000000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def wordy():
    chance = random.Random(5)
    names = ["The", "of", "a", "straße", "x" * 70, "漢字", "B", "c1", "it's", "-"]
    docs = []
    for n in range(60):
        text = "".join(chance.choice(names) + chance.choice([" ", " ", " ", "\t ", ", ", ".", "\n", ";x "]) for _ in range(chance.randrange(120)))
        docs.append((text, chance.choice(["en", "de", None, "und"])))
    return docs + [(None, "en"), ("", "de"), (" \t", None), ("the of A " * 3000, "en"), ("the of A " * 3000, "en")]


@pytest.mark.parametrize("budget", [1 << 21, 2000, 40])
def test_phrases(spark, wordy, budget, monkeypatch):
    """The smaller budgets need prefixes of two and of three words, many runs, and parts of long texts."""
    if budget < 1 << 21:
        monkeypatch.setattr(phrases, "SORTED", 500)
        monkeypatch.setattr(phrases, "ROW", 7)
        monkeypatch.setattr(phrases, "COUNTED", 20)
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in wordy], "text STRING, lang STRING, word STRING, f LONG").repartition(5)
    assert table(collocations(docs, budget=budget)) == plain_phrases(wordy)
    assert table(collocations(docs, least=3, top=4, budget=budget)) == plain_phrases(wordy, 3, 4)


def test_phrases_of_nothing(nothing, edges):
    assert table(collocations(nothing)) == []
    assert table(collocations(edges)) == plain_phrases([(r.text, r.lang) for r in edges.collect()])


def test_words_that_share_an_id(spark):
    """With ids that all clash at first, other ids are taken."""
    docs = spark.createDataFrame([("ab cd ef gh " * 20, "en")], "text STRING, lang STRING").coalesce(1)
    words, table_ = phrases.vocabulary(docs, lambda seed: phrases.folded_table(seed) * (seed > 1))
    assert (table_ == phrases.folded_table(2)).all() and {r.f for r in words.collect()} == {20}


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(phrases, "PART", 10)
    text = b"ab cd. ef" + b"x" * 35 + b" gh; i. " + b"k" * 30
    parts = [bytes(data) for data, _ in phrases._parts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]
    assert b"".join(parts) == text and len(parts) > 2 and all(p.endswith((b".", b";")) for p in parts[:-1])


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(1 for q in members if q and q[:-1] == path), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(spark, rows):
    wide = "conv_id LONG, turn LONG, role STRING, text STRING, a LONG, block STRING, place STRING, depth LONG, q1 LONG"
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], wide).repartition(3)


@pytest.mark.parametrize("slice_", [4096, 16])
def test_trie(spark, slice_, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", slice_)
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    chance = random.Random(7)
    rows = []
    for c in range(60):
        for n in range(chance.choice([1, 2, 3, 7, 8, 9, 12])):
            rows.append((c, n * 3, chance.choice(["user", None, ""]), chance.choice(["hé", "", None, "漢"])))
    # Two long conversations that part late, one turn without a number, equal rows, and numbers that start below nought.
    rows += [(100 + 5 * k, n, "user", f"t{n if n < 65 else n * (k + 1)}") for k in (0, 1) for n in range(70)]
    rows += [(200, None, "a", "first"), (200, 0, "a", "b"), (200, 0, "a", "b"), (200, -1, "a", "c"), (None, 0, "user", "nobody's")]
    # Conversations without a base, one of them shorter than what it should have from there.
    rows += [(301, 0, "user", "x"), (302, 0, "user", "x"), (303, 0, "user", "x"), (304, 0, "user", "x")]
    assert table(trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert table(trie(conversations(spark, []))) == []
    assert table(trie(conversations(spark, [(None, 1, "user", "x")]))) == []
    alone = [(c, 0, "user", "x") for c in (301, 302, 303, 304)]
    assert table(trie(conversations(spark, alone))) == plain_trie(alone)


CASES = [
    ("https://a.example.net/x", "a.example.net", "/x", "net/", "block"),
    ("https://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("https://anexample.com/de/", "anexample.com", "/de/", None, "allow"),
    ("https://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("http://x.org/fr/?porn", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net?a=/b", "x.net", "", None, "allow"),
    ("http://x.net:80/", "x.net:80", "/", None, "allow"),
    ("a.b/c://h/p://q", "h", "/p://q", None, "allow"),
    ("://", "", "", None, "allow"),
    ("www.porn-site.com/a", "", "", None, "block"),
    ("https://essexxx.co/pornography", "essexxx.co", "/pornography", None, "allow"),
    ("https://x.co/casino/poker?casino", "x.co", "/casino/poker", None, "block"),
    ("https://x.co/casino/casino?CASINO", "x.co", "/casino/casino", None, "allow"),
    ("https://x.co/" + "a" * 100_000 + "#Xxx", "x.co", "/" + "a" * 100_000, None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls(spark):
    rows = [(n, url, None, "x", "y") for n, (url, *_) in enumerate(CASES)] + [(None, None, "", "x", "y"), (0, CASES[0][0], "", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, host STRING, rest STRING")
    found = judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
    want = [(n, *case[1:]) for n, case in enumerate(CASES)] + [(None, "", "", None, "allow"), (0, *CASES[0][1:])]
    assert table(found) == sorted(want, key=str)
    assert table(judge_urls(pages.filter("false"))) == []


def test_url_terms_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/one-two"), (2, "http://a.b/one"), (3, "http://c.b/bad")], "page_id LONG, url STRING")
    judge = lambda **more: [r.verdict for r in judge_urls(pages, **more).orderBy("page_id").collect()]
    assert judge(rules=(), strict=("bad",), soft=("one", "two", "bad")) == ["block", "allow", "block"]
    assert judge(rules=(), strict=("bad",), soft=("one", "two"), limit=3) == ["allow", "allow", "block"]
    assert judge(rules=(), strict=(), soft=()) == ["allow"] * 3
    assert judge(rules=(Rule("block", "b", "/"), Rule("allow", "a.b", "/one-")), strict=(), soft=()) == ["allow", "block", "block"]
    with pytest.raises(ValueError):
        urls.Rules((Rule("block", "b", "/"), Rule("allow", "b", "/")))
