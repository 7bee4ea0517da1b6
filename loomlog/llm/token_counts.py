"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one behind the other in one array of symbols. In every round each
pre-token looks up the ranks of its neighbouring pairs, takes its own lowest rank, and joins all pairs of that
rank at once (the left one first where they overlap). Pre-tokens without a known pair leave with as many tokens
as they have symbols.

Nulls and empty texts have no token. Repeated rows each get a row; a null ``doc_id`` stays null. A text of any
length is read whole: it is cut into pre-tokens, and only the pre-tokens of a bounded step are held as arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from loomlog.llm.common import steps, texts
from loomlog.llm.pretokens import units

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
# Units whose counts a Python worker remembers, and how long the longest of them may be.
REMEMBERED, REMEMBERED_LENGTH = 800_000, 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Merges(NamedTuple):
    """The pairs of a vocabulary as sorted numbers, with their ranks and what they join to."""

    keys: np.ndarray
    ranks: np.ndarray
    joined: np.ndarray
    by_byte: np.ndarray
    size: int
    special: regex.Pattern | None


def _letters() -> dict[str, int]:
    """The letters by which the file names bytes: visible Latin-1 characters stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """Read the merges of a byte-level BPE file. Pairs must join to symbols that no earlier pair needs."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary = content["model"]["vocab"]
    size = max(vocabulary.values()) + 1
    pairs = [p if isinstance(p, list) else p.split(" ") for p in content["model"]["merges"]]
    left, right, whole = (
        np.array([vocabulary[p] for p in parts], np.int64)
        for parts in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
    )
    made = {int(w): n for n, w in reversed(list(enumerate(whole)))}
    if any(made.get(int(x), -1) >= n for n, both in enumerate(zip(left, right)) for x in both):
        raise ValueError("a merge uses a symbol that only a later merge makes")
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    by_byte = np.zeros(256, np.int64)
    for letter, byte in _letters().items():
        by_byte[byte] = vocabulary[letter]
    special = [t["content"] for t in content["added_tokens"]]
    pattern = regex.compile("|".join(map(regex.escape, special))) if special else None
    return Merges(keys[order], order.astype(np.int64), whole[order], by_byte, size, pattern)


_NONE = np.iinfo(np.int64).max


def count_symbols(table: Merges, words: list[bytes]) -> np.ndarray:
    """How many tokens each of the pre-tokens has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = lengths.copy()
    live = np.flatnonzero(lengths > 1)
    symbols = table.by_byte[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
    lengths = lengths[live]
    while len(live):
        ends = np.cumsum(lengths)
        begins = ends - lengths
        # The pair at place i is (i, i + 1); the last place of a pre-token has none.
        keys = np.empty(len(symbols), np.int64)
        keys[:-1] = symbols[:-1] * table.size + symbols[1:]
        keys[ends - 1] = -1
        at = np.searchsorted(table.keys, keys)
        at[at == len(table.keys)] = 0
        known = table.keys[at] == keys
        ranks = np.where(known, table.ranks[at], _NONE)
        lowest = np.minimum.reduceat(ranks, begins)
        chosen = known & (ranks == np.repeat(lowest, lengths))
        # Of chosen places in a row (aaa), every second one joins, from the left.
        places = np.flatnonzero(chosen)
        if len(places):
            starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            nth = np.arange(len(places)) - np.repeat(starts, np.diff(starts, append=len(places)))
            places = places[nth % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = table.joined[at[places]]
            stays = np.ones(len(symbols), bool)
            stays[places + 1] = False
            gone = np.add.reduceat(~stays, begins, dtype=np.int64)
        else:
            stays, gone = np.ones(len(symbols), bool), np.zeros(len(live), np.int64)
        lengths = lengths - gone
        counts[live] = lengths
        goes_on = (lowest != _NONE) & (lengths > 1)
        symbols = symbols[stays]
        symbols = symbols[np.repeat(goes_on, lengths)]
        live, lengths = live[goes_on], lengths[goes_on]
    return counts


class Counter:
    """Counts the tokens of texts; remembers a bounded number of short units."""

    def __init__(self, path: str):
        self.table = merges(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = {}

    def _fresh(self, wanted: list[str], lead: str) -> dict[str, int]:
        """Counts of units, batched so that the arrays of a round stay small."""
        found: dict[str, int] = {}
        begin = 0
        while begin < len(wanted):
            words: list[str] = []
            places, end, size = [], begin, 0
            while end < len(wanted) and size < 1 << 19:
                places.append(len(words))
                words += self.split(lead + wanted[end])
                size += len(wanted[end])
                end += 1
            if words:
                totals = np.concatenate([[0], np.cumsum(count_symbols(self.table, [w.encode() for w in words]))])
                places.append(len(words))
                found.update(zip(wanted[begin:end], np.diff(totals[places]).tolist()))
            else:
                found.update(dict.fromkeys(wanted[begin:end], 0))
            begin = end
        return found

    def counts(self, values: list[str]) -> list[int]:
        special, totals = self.table.special, []
        firsts: list[tuple[int, str]] = []
        rests: list[tuple[int, list[str]]] = []
        for n, value in enumerate(values):
            found = special.findall(value) if special else []
            totals.append(len(found))
            for part in special.split(value) if found else [value]:
                first, rest = units(part)
                firsts.append((n, first))
                rests.append((n, rest))
        heads = self._fresh(list({first for _, first in firsts}), "")
        wanted = {word for _, rest in rests for word in rest}
        known = {word: self.known[word] for word in wanted & self.known.keys()}
        fresh = self._fresh(list(wanted - known.keys()), " ")
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
        self.known.update((word, n) for word, n in fresh.items() if len(word) <= REMEMBERED_LENGTH)
        known |= fresh
        for n, first in firsts:
            totals[n] += heads[first]
        for n, rest in rests:
            totals[n] += sum(map(known.__getitem__, rest))
        return totals


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document the bytes, the tokens, and whether there are more than ``limit`` tokens."""
    path = path or public_tokenizers.path(TOKENIZER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for step in steps(batches, 1 << 20):
            values = step.column(1).to_pylist()
            tokens = np.array(counter.counts(values), np.int64)
            sizes = np.fromiter((len(v.encode()) for v in values), np.int64, len(values))
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(count, SCHEMA)
