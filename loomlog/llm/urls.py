"""URL filter: host and path rules first, then a weighted vocabulary found by one Aho-Corasick automaton.

A rule names a host and the beginning of a path; it fits the host itself and all hosts below it, and the longest rule
that fits decides. Where none fits, the vocabulary does: strict and soft terms are searched in the whole address, A-Z
lower-cased, and count only between boundaries (ends of the address, or any character but a-z and 0-9). Every distinct
term counts once. An address is blocked when the weights of its distinct terms reach ``LIMIT``: one strict term weighs
that much, a soft one weighs 1, so that several distinct soft terms are needed.

Nulls and addresses without ``://`` have an empty host and path, so that no rule fits them; their text is searched all
the same (null: nothing to search, allowed). Repeated rows each get a row, an empty table gives none, extra columns are
left out, addresses of any length are read whole. Rules and terms are parameters held by each task: lists, no tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2
JUDGED = (
    "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight int"
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
STRICT = ("porn", "porno", "xxx", "hentai", "milf", "blowjob", "camgirls", "sexcam", "escorts", "warez")
SOFT = (
    "adult", "babes", "bet", "bets", "betting", "bingo", "bonus", "casino", "cams", "cheap", "cialis", "crack", "dating",
    "erotic", "fetish", "free-spins", "gambling", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "nudes",
    "pharmacy", "pills", "poker", "replica", "sex", "sexy", "slots", "spins", "torrent", "torrents", "viagra", "xx",
)


class Vocabulary:
    """Strict and soft terms in one automaton."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str], limit: int = LIMIT):
        self.limit = limit
        self.strict = frozenset(strict)
        self.soft = frozenset(soft) - self.strict
        if not all(self.strict | self.soft):
            raise ValueError("a term is empty")
        self.automaton = ahocorasick.Automaton()
        for term in self.strict | self.soft:
            self.automaton.add_word(term, (term, len(term)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def terms(self, address: str) -> set[str]:
        """The distinct terms of an address (A-Z already lower-cased) that stand between boundaries."""
        found: set[str] = set()
        if not len(self.automaton):
            return found
        for last, (term, length) in self.automaton.iter(address):
            begin, end = last - length + 1, last + 1
            if term not in found and not _inside(address, begin - 1) and not _inside(address, end):
                found.add(term)
        return found

    def weigh(self, address: str) -> tuple[int, int, int]:
        """Distinct strict terms, distinct soft terms, and their weight."""
        found = self.terms(address)
        strict = len(found & self.strict)
        soft = len(found) - strict
        return strict, soft, strict * self.limit + soft


def _inside(address: str, at: int) -> bool:
    """Whether the character at a place goes on a word."""
    return 0 <= at < len(address) and address[at] in "abcdefghijklmnopqrstuvwxyz0123456789"


class Rules:
    """Rules by host; the longest one that fits decides, of equally long ones that with the longer host."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(set(rules), key=lambda r: -len(r.path)):
            known = self.by_host.setdefault(rule.host, [])
            if any(k.path == rule.path for k in known):
                raise ValueError(f"two verdicts for {rule.text}")
            known.append(rule)

    def decide(self, host: str, path: str) -> Rule | None:
        best, below = None, host
        while below:
            for rule in self.by_host.get(below, ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
            below = below.partition(".")[2]
        return best


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    limit: int = LIMIT,
) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``) its host and path, the rule that fits, the verdict, and what was counted."""
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    # What stands behind the first "://", if there is one: the host up to one of /?#, then the path up to ? or #.
    parts = r"\A([^/?#]*+)([^?#]*+)"
    cut = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), address.alias("address"))
        .withColumn("rest", F.expr("if(instr(address, '://') > 0, substring(address, instr(address, '://') + 3), '')"))
        .select(
            "page_id", F.translate("address", UPPER, LOWER).alias("address"),
            F.translate(F.regexp_extract("rest", parts, 1), UPPER, LOWER).alias("host"),
            F.regexp_extract("rest", parts, 2).alias("path"),
        )
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide, weigh = Rules(rules).decide, Vocabulary(strict, soft, limit).weigh
        for batch in batches:
            ids, addresses, hosts, paths = batch.columns
            rows = []
            for address, host, path in zip(addresses.to_pylist(), hosts.to_pylist(), paths.to_pylist()):
                rule = decide(host, path)
                counted = weigh(address)
                verdict = rule.verdict if rule else "block" if counted[2] >= limit else "allow"
                rows.append((rule.text if rule else None, verdict, *counted))
            named, verdicts, strictly, softly, weights = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    ids, hosts, paths, pa.array(named, pa.string()), pa.array(verdicts, pa.string()),
                    *(pa.array(values, pa.int32()) for values in (strictly, softly, weights)),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"],
            )

    return cut.mapInArrow(judge, JUDGED)
