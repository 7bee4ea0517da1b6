"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

How a text up to some byte is cut into tokens ends in exactly one token, and a cut is the right one when each
token may follow the one before it: when the merges, run on the two alone, keep them apart. The transducer
reads byte by byte. Its state is the longest end of the input that begins some token, and for each place in that
end where a token may begin the token that leads there. A further byte settles the last token at the new place.
Going back from token to token, the ways from all places still open meet after a number of bytes that the vocabulary
bounds; the tokens before that are written. States and their steps are made when first needed, kept in a table of
bounded bytes, and dropped together when it is full. A worker that has nothing to do for a moment gives its tables back.

Nulls and empty texts give no ids. Repeated rows each get a row; a null ``doc_id`` stays null. Texts of any length
are read whole, pre-token by pre-token; a pre-token of any length needs time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, islice
from threading import Timer

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import steps, texts
from loomlog.llm.pretokens import units

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# About how many bytes of states, and of each of two generations of units, one Python worker keeps; the longest unit kept.
STATE_BYTES, UNIT_BYTES, REMEMBERED_LENGTH = 128 << 20, 24 << 20, 64
# Seconds without work after which a worker lets go of them.
IDLE = 1.0
# Bytes of a pre-token after which tokens are written that no further byte can change.
SETTLED = 4096
# Ids that the decoder takes at a time.
DECODED = 1 << 14
ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_chars long"

START = -1
# The token that ends at the last byte; then, for each earlier place where a token may begin, the last one first, the node of
# what was read since (see ``Vocabulary.nodes``) and the token that leads there.
State = tuple[int, ...]


class Vocabulary:
    """Token bytes and ranks of a rank file, and all beginnings of tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")

        # The last merge that makes each token that merges can make, and what two tokens join to in that way.
        self.splits: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        self.made = {rank for token, rank in self.ranks.items() if len(token) == 1}
        for rank, token in self.tokens.items():
            if len(token) > 1 and (split := self._last_merge(token)):
                self.splits[rank] = split
                self.joins[split] = rank
                self.made.add(rank)

        # Beginnings of tokens as nodes: by 256 times the node plus a byte the node behind it (0: nothing read yet); the
        # length of each, and the token that it is, if merges can make it.
        self.nodes: dict[int, int] = {}
        self.depths, self.ends = [0], [START]
        for token, rank in self.ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                key = (node << 8) + byte
                node = self.nodes.get(key)
                if node is None:
                    node = self.nodes[key] = len(self.ends)
                    self.depths.append(depth)
                    self.ends.append(START)
            if rank in self.made:
                self.ends[node] = rank
        # Nodes that more bytes may follow. Places of others need not be held open.
        self.inner = {key >> 8 for key in self.nodes}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """Run the merges on a token's bytes (lowest rank first, then leftmost) until two parts are left."""
        parts = [token[n:n + 1] for n in range(len(token))]
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 2:
            pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == none:
                return None
            n = pairs.index(best)
            parts[n:n + 2] = [parts[n] + parts[n + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges keep two tokens apart: undo them from the last on, and look for one across the border."""
        joins, splits = self.joins, self.splits
        limit = len(self.ranks)
        while True:
            across = joins.get((left, right))
            if across is not None and across < limit:
                return False
            of_left, of_right = splits.get(left), splits.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or of_left is not None and left > right:
                # Undo the left one; a merge across would have to come before it.
                limit, left = left, of_left[1]
            else:
                # Undo the right one; at the same rank the merge across is further left and comes first.
                limit, right = right + 1, of_right[0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """Reads the bytes of one pre-token and writes ids."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self._reset((START,))

    def _reset(self, first: State) -> int:
        self.size = 0
        self.states: list[State] = []
        self.numbers: dict[State, int] = {}
        # By 256 times the state plus the byte: 256 times the next state.
        self.moves: dict[int, int] = {}
        self._number((START,))
        return self._number(first)

    def _number(self, state: State) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states) << 8
            self.states.append(state)
            self.size += 220 + 8 * len(state)
        return number

    def _move(self, key: int) -> int:
        """Make the step from a state by one byte."""
        state, byte = self.states[key >> 8], key & 255
        words = self.words
        nodes, ends = words.nodes, words.ends
        # By place, the last one first: the token that would begin there and end here, and the one that leads there.
        node, last = nodes[byte], state[0]
        held, found = [START], [(ends[node], last)]
        if node in words.inner:
            held += node, last
        for at in range(1, len(state), 2):
            node = nodes.get((state[at] << 8) + byte)
            if node is not None:
                last = state[at + 1]
                if node in words.inner:
                    held += node, last
                if ends[node] != START:
                    found.append((ends[node], last))
        # The longest one that may follow what leads to its place is the right one.
        for token, last in reversed(found):
            if last == START or words.may_follow(last, token):
                break
        else:
            raise AssertionError("no token ends here")
        held[0] = token
        to = self.moves[key] = self._number(tuple(held))
        self.size += 110
        return to

    def _written(self, way: list[int], at: int) -> tuple[list[int], int]:
        """Tokens that no further byte can change, and how many bytes they have; ``way``: the state at each byte's end."""
        states, lengths, depths = self.states, self.words.lengths, self.words.depths
        ends = {len(way), *(len(way) - depths[node] for node in states[at >> 8][1::2])}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - lengths[states[way[far - 1] >> 8][0]])
        end = ends.pop()
        return self._back(way, end), end

    def _back(self, way: list[int], end: int) -> list[int]:
        states, lengths, out = self.states, self.words.lengths, []
        while end:
            token = states[way[end - 1] >> 8][0]
            out.append(token)
            end -= lengths[token]
        out.reverse()
        return out

    def ids(self, data: bytes) -> tuple[int, ...] | list[int]:
        known = self.words.ranks.get(data)
        if known is not None:
            return (known,)
        if self.size > STATE_BYTES:
            self._reset((START,))
        at, way, out = 0, [], []
        for begin in range(0, len(data), SETTLED):
            if begin:
                found, end = self._written(way, at)
                out += found
                del way[:end]
                if self.size > 2 * STATE_BYTES:
                    # A very long pre-token: keep the states alone that are still needed.
                    kept = [self.states[n >> 8] for n in way]
                    at = self._reset(self.states[at >> 8])
                    way = [self._number(state) for state in kept]
            moves = self.moves
            for byte in data[begin:begin + SETTLED]:
                key = at + byte
                at = moves[key] if key in moves else self._move(key)
                way.append(at)
        out += self._back(way, len(way))
        return out


# How many bytes follow a first byte: none (also for bytes that begin nothing), one, two or three.
_FOLLOWING = [1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0 for b in range(256)]


class StreamDecoder:
    """Ids to text piece by piece; bytes of a character that is not complete yet are held back."""

    def __init__(self, words: Vocabulary):
        self.tokens = words.tokens
        self.held = b""

    def feed(self, ids: Iterable[int]) -> tuple[bytes, str]:
        """The bytes of the ids, and the text that is complete with them. Unknown ids are errors."""
        data = b"".join(map(self.tokens.__getitem__, ids))
        whole = self.held + data
        cut = len(whole)
        for back in range(1, min(3, len(whole)) + 1):
            byte = whole[-back]
            if byte & 0xC0 == 0x80:
                continue
            if _FOLLOWING[byte] >= back:
                cut -= back
            break
        self.held = whole[cut:]
        return data, whole[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Encoder:
    """Texts to ids; remembers units up to a number of bytes."""

    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.transducer = Transducer(self.words)
        # What is remembered: of two generations, the younger one is filled and then becomes the older one.
        self.units: tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]] = ({}, {})
        self.size = 0

    def _unit(self, unit: str) -> tuple[int, ...]:
        words = self.split(unit)
        if len(words) == 1:
            return tuple(self.transducer.ids(unit.encode()))
        return tuple(chain.from_iterable(map(self._pretoken, words)))

    def _pretoken(self, word: str) -> tuple[int, ...]:
        # A space and a visible character begin a unit, which is known without the space; no unit begins like other keys.
        key = word[1:] if word[0] == " " and not word[1:2].isspace() else " " + word
        young, old = self.units
        ids = young.get(key)
        if ids is None:
            ids = old.get(key)
            if ids is None:
                ids = tuple(self.transducer.ids(word.encode()))
            self._remember(key, ids)
        return ids

    def _remember(self, key: str, ids: tuple[int, ...]) -> None:
        if len(key) <= REMEMBERED_LENGTH:
            young, old = self.units
            young[key] = ids
            self.size += 200 + len(key) + 8 * len(ids)
            if self.size > UNIT_BYTES:
                self.units, self.size = ({}, young), 0

    def encode(self, text: str) -> list[int]:
        first, rest = units(text)
        young, old = self.units
        found = list(self._unit(first))
        for unit in rest:
            ids = young.get(unit)
            if ids is None:
                ids = old.get(unit)
                if ids is None:
                    ids = self._unit(" " + unit)
                self._remember(unit, ids)
                young, old = self.units
            found += ids
        return found


_ENCODERS: dict[str, Encoder] = {}
_IDLE: dict[str, Timer] = {}


@contextmanager
def _encoder(path: str) -> Iterator[Encoder]:
    """A worker's encoder for one task. It goes on with the next task, unless none comes soon."""
    if path in _IDLE:
        _IDLE.pop(path).cancel()
    encoder = _ENCODERS.pop(path, None) or Encoder(path)
    try:
        yield encoder
    finally:
        _ENCODERS[path] = encoder
        timer = _IDLE[path] = Timer(IDLE, _ENCODERS.pop, (path, None))
        timer.daemon = True
        timer.start()


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document ``doc_id`` and ``ids``."""
    path = path or public_tokenizers.path(TOKENIZER)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(path) as encoder:
            for step in steps(batches, 1 << 20):
                ids = pa.array([encoder.encode(v) for v in step.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([step.column(0), ids], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Per row ``doc_id`` and the text of its ``ids``; null ids give an empty text."""
    path = path or public_tokenizers.path(TOKENIZER)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            found = []
            for values in batch.column(1).to_pylist():
                stream = StreamDecoder(words)
                found.append(stream.feed(values or ())[1] + stream.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text, decode its ids again, and give digests of both."""
    path = path or public_tokenizers.path(TOKENIZER)

    def digests(encoder: Encoder, decimals: dict[int, str], text: str) -> tuple[int, str, str, int, int]:
        ids = encoder.encode(text)
        listed = hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode())
        stream, back = StreamDecoder(encoder.words), hashlib.sha256()
        n_bytes = n_chars = 0
        rest = iter(ids)
        while part := list(islice(rest, DECODED)):
            data, shown = stream.feed(part)
            back.update(data)
            n_bytes += len(data)
            n_chars += len(shown)
        return len(ids), listed.hexdigest(), back.hexdigest(), n_bytes, n_chars + len(stream.finish())

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(path) as encoder:
            decimals = {n: str(n) for n in encoder.words.tokens}
            for step in steps(batches, 1 << 20):
                rows = [digests(encoder, decimals, text) for text in step.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [step.column(0), *map(pa.array, zip(*rows))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "n_chars"],
                )

    return texts(docs).mapInArrow(both, ROUND_TRIP)
