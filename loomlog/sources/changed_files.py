"""Watched files that are rewritten in place, as a stream: a file comes whenever its time or size differs from before.

The offset of the stream is what was known of each watched path (time in nanoseconds and size), so what changed between two
offsets follows from them alone, also after a restart from a checkpoint. A poll reads names and metadata; bytes are read on
executors, and only those of changed files. A path that is gone gives one row whose ``change`` is ``missing``; when it is
back, it counts as changed, even with its old time and size. Files that are touched without a new content come again with
the same ``file_hash``; the merging of records knows them by their ids.

Without a folder for listings, the listing and the offset are on the driver and grow with the watched paths, not with their
history: at most 40 rotating names in a folder. With one (:class:`ListedFilesReader`, for many folders), the offset names a
stored listing: the driver walks folder by folder and writes what it finds in blocks of bounded size, and executors compare the
blocks of two listings. The driver then holds the names of one folder, and a line for each block. A batch that is run again reads what the files hold then, since what they held before is
gone; the next poll brings them once more if they have changed in between. A file that can't be read fails the task, which
Spark runs again; a file that vanishes between poll and read is left to the next poll.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomlog.functions import fixed_values as fixed
from loomlog.sources.session_store import _children, opened_root

FORMAT = "loomlog_changed_files"
CHANGES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY, change STRING"
# A task takes files until it has this many, or this many bytes.
FILES_PER_TASK, BYTES_PER_TASK = 200, 64 << 20
# Files that a block of a stored listing has at most; it is also cut at the bytes of a task.
FILES_PER_BLOCK = 512
CHANGED, MISSING = "changed", "missing"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# What is known of each path: time in nanoseconds and size.
Known = dict[str, list[int]]


def changes(before: Known, now: Known) -> Iterator[tuple[str, str]]:
    """Paths that differ between two polls and how, in the order of time, name and path; missing ones last."""
    found = [p for p, state in now.items() if before.get(p) != state]
    for path in sorted(found, key=lambda p: (now[p][0], posixpath.basename(p), p)):
        yield path, CHANGED
    for path in sorted(before.keys() - now.keys()):
        yield path, MISSING


@dataclass
class Files(InputPartition):
    """Files for one task: path, and what happened to it."""

    files: list[tuple[str, str]]


class ChangedFilesReader(DataSourceStreamReader):
    def __init__(self, root: str, names: str):
        self.root, self.names = root, re.compile(names)

    def initialOffset(self) -> Known:
        return {}

    def latestOffset(self) -> Known:
        """The watched files as they are now, in the order of their paths, so that equal states have equal offsets."""
        system, root, _ = opened_root(self.root)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        watched = [i for i in listed if i.is_file and self.names.search(posixpath.basename(i.path))]
        return {i.path: [i.mtime_ns or 0, i.size or 0] for i in sorted(watched, key=lambda i: i.path)}

    def partitions(self, start: Known, end: Known) -> list[Files]:
        if "listing" in start:
            raise ValueError("the checkpoint needs its folder of listings")
        shares, held = [Files([])], 0
        for path, change in changes(start, end):
            size = end[path][1] if change == CHANGED else 0
            if shares[-1].files and (len(shares[-1].files) >= FILES_PER_TASK or held + size > BYTES_PER_TASK):
                shares.append(Files([]))
                held = 0
            shares[-1].files.append((path, change))
            held += size
        return [s for s in shares if s.files]

    def read(self, partition: Files) -> Iterator[Row]:
        return self._read(partition.files)

    def _read(self, files: list[tuple[str, str]]) -> Iterator[Row]:
        system, _, prefix = opened_root(self.root)
        for path, change in files:
            if change == MISSING:
                yield Row(prefix + path, None, None, None, MISSING)
                continue
            try:
                info = system.get_file_info(path)
                with system.open_input_stream(path) as stream:
                    content = stream.read()
            except FileNotFoundError:
                continue
            modified = _EPOCH + timedelta(microseconds=(info.mtime_ns or 0) // 1000)
            yield Row(prefix + path, modified, len(content), content, CHANGED)


Place = tuple[tuple[str, ...], str]


def place(path: str) -> Place:
    """Where a path comes in a listing: folders in the order of their parts, files of a folder before those below it."""
    folder, _, name = path.rpartition("/")
    return tuple(folder.split("/")) if folder else (), name


@dataclass
class Block:
    """A stretch of a stored listing: its first path, and the digest of its lines, by which it is stored."""

    first: str
    digest: str


@dataclass
class Stretch(InputPartition):
    """Paths from ``begin`` to before ``end`` (None: to the last), and the blocks that hold them in both listings."""

    begin: Place
    end: Place | None
    before: str | None
    now: str | None


def stretches(before: list[Block], now: list[Block]) -> Iterator[Stretch]:
    """What lies between the beginnings of blocks of either listing, where it can differ."""
    bounds = sorted({place(b.first) for b in (*before, *now)})
    sides = [([place(b.first) for b in side], side) for side in (before, now)]
    for n, begin in enumerate(bounds):
        held = []
        for firsts, side in sides:
            at = bisect_right(firsts, begin) - 1
            held.append(side[at].digest if at >= 0 else None)
        if held[0] != held[1]:
            yield Stretch(begin, bounds[n + 1] if n + 1 < len(bounds) else None, *held)


class ListedFilesReader(ChangedFilesReader):
    """The same with listings stored in a folder of this query's own, so that offsets have one size however many paths there are.

    ``blocks/<digest>`` has lines of relative path, time and size, in the order of places; ``<name>.index`` a line for each
    block of a listing. Equal states have equal names and share their blocks, so a poll that finds nothing new writes nothing.
    When Spark reports a batch as finished, what only earlier ones needed is deleted. Spark also polls to report progress, so
    the end of the next batch may be any poll since then.
    """

    def __init__(self, root: str, names: str, listings: str):
        super().__init__(root, names)
        self.listings = listings
        # Offsets that a batch may still need, in the order of their polls.
        self.needed: list[dict[str, str]] = []

    def latestOffset(self) -> dict[str, str]:
        blocks, offset = list(self._stored()), {}
        if blocks:
            lines = "".join(json.dumps([b.first, b.digest]) + "\n" for b in blocks).encode()
            offset = {"listing": hashlib.sha256(lines).hexdigest()}
            self._put(f"{offset['listing']}.index", lines)
        if self.needed[-1:] != [offset]:
            self.needed.append(offset)
        return offset

    def _walk(self) -> Iterator[tuple[str, int, int]]:
        """Watched files below the root, by place; one folder's names are held, and those of folders that wait."""
        system, root, _ = opened_root(self.root)
        waiting = [root]
        while waiting:
            found = sorted(_children(system, waiting.pop()), key=lambda i: posixpath.basename(i.path))
            for info in found:
                if info.is_file and self.names.search(posixpath.basename(info.path)):
                    yield info.path[len(root):].lstrip("/"), info.mtime_ns or 0, info.size or 0
            waiting += [i.path for i in reversed(found) if i.type == fs.FileType.Directory]

    def _stored(self) -> Iterator[Block]:
        """The blocks of a new listing, each stored unless it is there already."""
        entries: list[tuple[str, int, int]] = []
        held = 0
        for entry in self._walk():
            if entries and (len(entries) >= FILES_PER_BLOCK or held + entry[2] > BYTES_PER_TASK):
                yield self._block(entries)
                entries, held = [], 0
            entries.append(entry)
            held += entry[2]
        if entries:
            yield self._block(entries)

    def _block(self, entries: list[tuple[str, int, int]]) -> Block:
        lines = "".join(json.dumps(e) + "\n" for e in entries).encode()
        digest = hashlib.sha256(lines).hexdigest()
        self._put(f"blocks/{digest}", lines)
        return Block(entries[0][0], digest)

    def _put(self, name: str, lines: bytes) -> None:
        """Store what is named by its digest; a file is whole or not there."""
        system, folder, _ = opened_root(self.listings)
        path = f"{folder}/{name}"
        if system.get_file_info(path).is_file:
            return
        system.create_dir(posixpath.dirname(path), recursive=True)
        hidden = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden, compression="zstd") as stream:
            stream.write(lines)
        system.move(hidden, path)

    def _lines(self, name: str) -> list[list]:
        system, folder, _ = opened_root(self.listings)
        with system.open_input_stream(f"{folder}/{name}", compression="zstd") as stream:
            return [json.loads(line) for line in stream.read().splitlines()]

    def _index(self, offset: dict[str, str]) -> list[Block]:
        if not offset:
            return []
        if set(offset) != {"listing"}:
            raise ValueError("the checkpoint holds its paths in the offsets: go on without a folder of listings")
        return [Block(*line) for line in self._lines(f"{offset['listing']}.index")]

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Stretch]:
        if end not in self.needed:
            # A batch that another process planned: older than all polls of this one.
            self.needed.insert(0, end)
        return [] if start == end else list(stretches(self._index(start), self._index(end)))

    def read(self, partition: Stretch) -> Iterator[Row]:
        root = opened_root(self.root)[1]
        known = []
        for digest in (partition.before, partition.now):
            entries = self._lines(f"blocks/{digest}") if digest else []
            inside = lambda at: partition.begin <= at and (partition.end is None or at < partition.end)
            known.append({f"{root}/{path}": state for path, *state in entries if inside(place(path))})
        return self._read(list(changes(*known)))

    def commit(self, end: dict[str, str]) -> None:
        """Delete what only earlier batches needed. Before the first poll it is not known what a batch at hand needs."""
        if not self.needed:
            return
        if end in self.needed:
            self.needed = self.needed[self.needed.index(end):]
        system, folder, _ = opened_root(self.listings)
        offsets = [o for o in (end, *self.needed) if o]
        kept = {f"{o['listing']}.index" for o in offsets} | {b.digest for o in offsets for b in self._index(o)}
        for info in (*_children(system, folder), *_children(system, f"{folder}/blocks")):
            if info.is_file and posixpath.basename(info.path) not in kept:
                system.delete_file(info.path)


class ChangedFiles(DataSource):
    """``spark.readStream.format("loomlog_changed_files")``; options ``path`` and ``names``, a pattern of watched names.

    ``listings``: a folder of this query's own that driver and executors reach, where listings are stored.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangedFilesReader:
        path, names, listings = self.options["path"], self.options["names"], self.options.get("listings")
        return ListedFilesReader(path, names, listings) if listings else ChangedFilesReader(path, names)


# The watched names as Python spells groups.
WATCHED = fixed.SNAPSHOT_NAME.replace("(?<", "(?P<")


def stream_changes(spark: SparkSession, root: str, names: str = WATCHED, listings: str | None = None) -> DataFrame:
    """Changed and missing files under a folder, sub-folders included.

    With ``listings``, a folder of this query's own outside ``root``, what was known of the paths is stored there and not in
    the offsets. A checkpoint holds to one of the two ways.
    """
    spark.dataSource.register(ChangedFiles)
    changed = spark.readStream.format(FORMAT).option("names", names)
    return (changed.option("listings", listings) if listings else changed).load(root)
