"""Session folders as a Spark data source: listed and read on executors, written under their names in one commit.

A store is a root with one folder per session, which holds named files (``session.json``, ``canonical_records.jsonl`` ...).

*Reading* gives one row per file. Every task lists the root once and takes the folders whose names fall to it, so no list
of files passes through the driver. Small documents that are asked for come with their text; lines are read with Spark's
own text reader, which splits large files.

*Writing* takes lines (``session_folder``, ``file``, ``place``, ``line``). Each file is written by one task, in the
order of ``place``, under a hidden name beside its own. The commit renames the files, ``session.json`` last in its folder:
a session is there as a whole or not at all, and a job that breaks off leaves no session behind. Files that are not
written again stay as they are.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

FORMAT = "loomlog_sessions"
MANIFEST = "session.json"
FILES = "session_folder STRING, file STRING, size BIGINT, modified TIMESTAMP, content STRING"
LINES = "session_folder STRING, file STRING, place BIGINT, line STRING"
# Tasks that list a store.
LISTERS = 32


def opened_root(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a root, the root as it names it, and how Spark spells what is in front of that."""
    if "://" in root:
        system, path = fs.FileSystem.from_uri(root)
        prefix = "file:" if root.startswith("file:") else root[:len(root) - len(path.lstrip("/"))].rstrip("/") + "/"
        return system, path.rstrip("/"), prefix
    path = root.removeprefix("file:").rstrip("/")
    return fs.LocalFileSystem(), path, "file:"


def _children(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def _name(info: fs.FileInfo) -> str:
    return posixpath.basename(info.path)


@dataclass
class Share(InputPartition):
    """The folders below the root whose names fall to one of ``of`` tasks."""

    part: int
    of: int


class SessionReader(DataSourceReader):
    def __init__(self, root: str, documents: Sequence[str], listers: int):
        self.root, self.documents, self.listers = root, frozenset(documents), listers

    def partitions(self) -> list[Share]:
        return [Share(n, self.listers) for n in range(self.listers)]

    def read(self, partition: Share) -> Iterator[Row]:
        system, root, prefix = opened_root(self.root)
        top = _children(system, root)
        # Files that lie in the root itself make it a session folder; the first task takes them.
        waiting = [[i for i in top if i.is_file]] if partition.part == 0 else []
        folders = [i for i in top if not i.is_file and zlib.crc32(_name(i).encode()) % partition.of == partition.part]
        while waiting or folders:
            found = waiting.pop() if waiting else _children(system, folders.pop().path)
            for info in found:
                if not info.is_file:
                    folders.append(info)
                elif not _name(info).startswith((".", "_")):
                    yield self._row(system, prefix, info)

    def _row(self, system: fs.FileSystem, prefix: str, info: fs.FileInfo) -> Row:
        content = None
        if _name(info) in self.documents:
            with system.open_input_stream(info.path) as stream:
                content = stream.read().decode("utf-8-sig", "replace")
        modified = info.mtime or datetime.fromtimestamp(0, timezone.utc)
        return Row(prefix + posixpath.dirname(info.path), _name(info), info.size, modified, content)


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task wrote: the hidden path and the path it is for."""

    files: list[tuple[str, str]]


class SessionWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Write the rows of a task; a file's rows follow each other."""
        system, root, _ = opened_root(self.root)
        # A task that is run again, or twice at a time, writes under another name; only what it reports is committed.
        attempt = uuid.uuid4().hex
        files: list[tuple[str, str]] = []
        target, stream = None, None
        try:
            for row in iterator:
                if any(map(_outside, (row.session_folder or "").split("/"))) or _outside(row.file):
                    raise ValueError(f"no name of a folder or file: {row.session_folder!r}, {row.file!r}")
                wanted = f"{root}/{row.session_folder}/{row.file}"
                if wanted != target:
                    if stream is not None:
                        stream.close()
                    target = wanted
                    folder, name = posixpath.split(wanted)
                    system.create_dir(folder, recursive=True)
                    hidden = f"{folder}/.{name}.{self.job}.{attempt}"
                    files.append((hidden, wanted))
                    stream = system.open_output_stream(hidden)
                if row.line is not None:
                    stream.write(row.line.encode() + b"\n")
        finally:
            if stream is not None:
                stream.close()
        if len({wanted for _, wanted in files}) < len(files):
            raise ValueError("the rows of a file must follow each other: write with write_store")
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, _, _ = opened_root(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        for hidden, wanted in sorted(files, key=lambda f: posixpath.basename(f[1]) == MANIFEST):
            system.move(hidden, wanted)

    def abort(self, messages: list[Staged | None]) -> None:
        system, _, _ = opened_root(self.root)
        for message in messages:
            for hidden, _ in message.files if message is not None else ():
                if system.get_file_info(hidden).type != fs.FileType.NotFound:
                    system.delete_file(hidden)


def _outside(name: str | None) -> bool:
    """Whether a name of a folder or file would lead elsewhere or be hidden."""
    return not name or "/" in name or "\\" in name or name.startswith((".", "_"))


class SessionStore(DataSource):
    """``spark.read.format("loomlog_sessions")``; options ``path``, ``documents`` (JSON list of file names), ``listers``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> SessionReader:
        documents = json.loads(self.options.get("documents", "[]"))
        return SessionReader(self.options["path"], documents, int(self.options.get("listers", LISTERS)))

    def writer(self, schema, overwrite: bool) -> SessionWriter:
        return SessionWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SessionStore)
    return spark


def read_store(spark: SparkSession, root: str, documents: Sequence[str] = ()) -> DataFrame:
    """All files of a store: ``session_folder``, ``file``, ``size``, ``modified``, and ``content`` of the ``documents``."""
    reader = registered(spark).read.format(FORMAT).option("documents", json.dumps(list(documents)))
    return reader.option("listers", min(LISTERS, max(1, spark.sparkContext.defaultParallelism))).load(root)


def folder_in(root: str, folder: str = "session_folder") -> Column:
    """A folder as it is read, named from the root on, as it is written."""
    _, path, prefix = opened_root(root)
    return F.replace(F.col(folder), F.lit(f"{prefix}{path}/"), F.lit(""))


def write_store(lines: DataFrame, root: str) -> None:
    """Write ``lines`` (``session_folder``, ``file``, ``place``, ``line``) as files, in one commit.

    A file is written by one task, since it is one file; the sort before it spills, and no more than a line is held. A file
    without lines is made by one row whose ``line`` is null.
    """
    registered(lines.sparkSession)
    keys = ["session_folder", "file"]
    lines = lines.select(*keys, F.col("place").cast("bigint").alias("place"), "line")
    lines.repartition(*keys).sortWithinPartitions(*keys, "place").write.format(FORMAT).mode("append").save(root)
