"""Snapshot archives (``tar.gz`` holding one JSON document) as a Spark data source.

``spark.read.format("snapshot_archive").load(path)`` gives one partition per archive and one row per item of the
document, read as a stream from any file system that Arrow knows by its URI (``file:``, ``hdfs:``, ``s3:``, ``gs:`` and
so on); a path without a scheme is a local one. Items are those of a top-level array, of a ``reports`` array or object in a
top-level object, and of an object whose keys are all numbers. Any other document is one row.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import tarfile
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: base name of the document inside an archive.
MEMBER = "reports_piiremoved.json"
CHUNK = 1 << 20
#: Members of a container beside its items are kept up to this many characters; no app id or title is longer.
BESIDE = 1 << 16

_BLANK = re.compile(r"[^ \t\n\r]")
_BRACKET = re.compile(r'["{}\[\]]')
_IN_STRING = re.compile(r'["\\]')
_SCALAR_END = re.compile(r"[,\]} \t\n\r]")

#: Position, text, path id and the container's other members (JSON, or nothing) of an item.
Item = tuple[list[int], str, str, str | None]


class _Pull:
    """Values of a JSON text, one after the other, in one pass over its chunks; each character is looked at once."""

    def __init__(self, chunks: Iterator[str]) -> None:
        self.chunks, self.buffer, self.at = chunks, "", 0

    def _more(self) -> bool:
        """The next chunk in place of a used-up one."""
        for block in self.chunks:
            if block:
                self.buffer, self.at = block, 0
                return True
        self.buffer, self.at = "", 0
        return False

    def peek(self) -> str:
        """The next character that is no blank, which stays; empty at the end."""
        while True:
            found = _BLANK.search(self.buffer, self.at)
            if found:
                self.at = found.start()
                return self.buffer[self.at]
            if not self._more():
                return ""

    def take(self, wanted: str) -> None:
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"the document has {found or 'its end'!r} where one of {wanted!r} is due")
        self.at += 1

    def _pieces(self) -> Iterator[str]:
        """The next value's text."""
        if self.peek() not in '"{[':
            while True:
                found = _SCALAR_END.search(self.buffer, self.at)
                end = found.start() if found else len(self.buffer)
                yield self.buffer[self.at : end]
                self.at = end
                if found or not self._more():
                    return
        depth, quoted = 0, False
        while True:
            first = self.at
            while True:
                found = (_IN_STRING if quoted else _BRACKET).search(self.buffer, self.at)
                if found is None:
                    break
                self.at, mark = found.end(), found.group()
                if mark == "\\":
                    if self.at == len(self.buffer):
                        # what is escaped stands in the next chunk
                        yield self.buffer[first:]
                        if not self._more():
                            raise ValueError("the document ends inside a text")
                        first = 0
                    self.at += 1
                elif mark == '"':
                    quoted = not quoted
                else:
                    depth += 1 if mark in "{[" else -1
                if depth == 0 and not quoted:
                    yield self.buffer[first : self.at]
                    return
            yield self.buffer[first:]
            if not self._more():
                raise ValueError("the document ends inside a value")

    def value(self) -> str:
        """Text of the next value, which must be right JSON."""
        text = "".join(self._pieces())
        json.loads(text)
        return text

    def pass_over(self, most: int = 0) -> str | None:
        """Leave a value behind; its text if that has at most so many characters."""
        kept, size = [], 0
        for piece in self._pieces():
            size += len(piece)
            if size <= most:
                kept.append(piece)
            else:
                kept = []
        return "".join(kept) if size <= most else None

    def elements(self) -> Iterator[int]:
        """Stop before each element of an array."""
        self.take("[")
        if self.peek() == "]":
            self.take("]")
            return
        at = 0
        while True:
            yield at
            at += 1
            self.take(",]")
            if self.buffer[self.at - 1] == "]":
                return

    def members(self) -> Iterator[tuple[int, str]]:
        """Stop before the value of each member of an object."""
        self.take("{")
        if self.peek() == "}":
            self.take("}")
            return
        at = 0
        while True:
            if self.peek() != '"':
                raise ValueError("a member of an object has no name")
            key = json.loads(self.value())
            self.take(":")
            yield at, key
            at += 1
            self.take(",}")
            if self.buffer[self.at - 1] == "}":
                return

    def end(self) -> None:
        if self.peek():
            raise ValueError("something follows the document")


def _number(key: str) -> bool:
    return re.fullmatch(r"[+-]?\d+", key) is not None


def _survey(pull: _Pull) -> tuple[str, dict[str, str], bool]:
    """First character of an object's ``reports``, its other short members, and whether all keys are numbers."""
    reports, beside, numbers = "", {}, True
    for _, key in pull.members():
        numbers = numbers and _number(key)
        if key == "reports":
            reports = pull.peek()
            pull.pass_over()
        else:
            text = pull.pass_over(BESIDE)
            if text is not None and not numbers:
                beside[key] = text
    pull.end()
    return reports, beside, numbers


def _listed(pull: _Pull, outer: str | None) -> Iterator[Item]:
    """Items of an array or object of reports."""
    if pull.peek() == "[":
        for at in pull.elements():
            yield [at], pull.value(), str(at), outer
    else:
        for at, key in pull.members():
            yield [at], pull.value(), key, outer


def document_items(open_chunks: Callable[[], Iterator[str]]) -> Iterator[Item]:
    """Items of a document; one of them and one chunk is held at a time. An object is read once to see its shape, then again."""
    pull = _Pull(open_chunks())
    head = pull.peek()
    if head == "[":
        yield from _listed(pull, None)
        pull.end()
        return
    reports, beside, numbers = _survey(pull) if head == "{" else ("", {}, False)
    pull = _Pull(open_chunks())
    if reports and reports in "[{":
        outer = "{" + ",".join(f"{json.dumps(key)}:{text}" for key, text in beside.items()) + "}"
        for _, key in pull.members():
            if key == "reports":
                yield from _listed(pull, outer)
            else:
                pull.pass_over()
    elif head == "{" and numbers:
        for at, key in pull.members():
            outer = json.dumps({"appid": int(key)}) if abs(int(key)) < 1 << 31 else None
            if pull.peek() == "[":
                for inner in pull.elements():
                    yield [at, inner], pull.value(), f"{key}:{inner}", outer
            else:
                yield [at], pull.value(), key, outer
    else:
        text = "".join(open_chunks()).strip()
        json.loads(text)
        yield [], text, "", None


# --- archives -----------------------------------------------------------------------------------


def _file_system(uri: str):
    """Arrow's file system of a URI and the path within it."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)


def _chunks(stream) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    while block := stream.read(CHUNK):
        yield decoder.decode(block)
    yield decoder.decode(b"", final=True)


def _document(uri: str) -> Iterator[str]:
    """Text of the first regular member with the wanted base name."""
    files, path = _file_system(uri)
    with files.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|gz") as archive:
        for member in archive:
            if member.isreg() and os.path.basename(member.name) == MEMBER:
                yield from _chunks(archive.extractfile(member))
                return
    raise ValueError(f"{uri}: no {MEMBER} in the archive")


def archive_items(uri: str) -> Iterator[Item]:
    """Items of the document in an archive."""
    yield from document_items(lambda: _document(uri))


class _Archive(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _ArchiveReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        from pyarrow import fs

        files, path = _file_system(self.root)
        if files.get_file_info(path).type != fs.FileType.Directory:
            return [_Archive(self.root)]
        names = [info.base_name for info in files.get_file_info(fs.FileSelector(path))]
        return [_Archive(f"{self.root.rstrip('/')}/{name}") for name in sorted(names) if name.endswith(".tar.gz")]

    def read(self, partition):
        name = partition.uri.rstrip("/").rsplit("/", 1)[-1]
        for position, raw, path_id, outer in archive_items(partition.uri):
            yield name, position, raw, path_id, outer


class SnapshotArchive(DataSource):
    @classmethod
    def name(cls):
        return "snapshot_archive"

    def schema(self):
        return "archive STRING, position ARRAY<BIGINT>, raw STRING, id STRING, outer STRING"

    def reader(self, schema):
        return _ArchiveReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotArchive)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Items of an archive, or of all in a folder; a path without a scheme is one of the cluster's default file system."""
    register(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    return spark.read.format("snapshot_archive").load(full.toString())
