"""Files in ZIP archives and pages of PDF files as a source: tasks are planned from the archives' own directories."""

from __future__ import annotations

import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import page_number

#: Uncompressed bytes of members that one task reads, or one member.
SPLIT = 64 << 20

_SCHEMA = "archive string, member string, size long, content binary"


def local_path(path: str) -> str | None:
    """A path that Python can open: one without a scheme, or of the scheme file."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path if not parts.scheme else None


class _Members(InputPartition):
    def __init__(self, archive: str, names: list[str]):
        self.archive, self.names = archive, names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[_Members]:
        """Runs of members of about ``split`` bytes, from each archive's central directory alone."""
        here = local_path(self.path)
        if here is None:
            raise ValueError(f"{self.path}: archives in such a store are read by archive_files")
        files = sorted(os.path.join(d, n) for d, _, names in os.walk(here) for n in names if n.lower().endswith(".zip")) if os.path.isdir(here) else [here]
        out = []
        for file in files:
            with zipfile.ZipFile(file) as z:
                names, size = [], 0
                for info in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.header_offset):
                    if names and size + info.file_size > self.split:
                        out.append(_Members(file, names))
                        names, size = [], 0
                    names.append(info.filename)
                    size += info.file_size
                if names:
                    out.append(_Members(file, names))
        return out or [_Members("", [])]

    def read(self, partition: _Members) -> Iterator[tuple]:
        if partition.names:
            with zipfile.ZipFile(partition.archive) as z:
                for name in partition.names:
                    content = z.read(name)
                    yield os.path.basename(partition.archive), name, len(content), content


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(folder)``: a row for each file in the folder's archives, split over tasks within an archive."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def archive_files(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(archive, member, size, content) of all files in a folder's ZIP archives.

    Where Python can open the folder, tasks are planned from the central directories. In any other store Spark reads each
    archive whole, so an archive is one task there. Folders in archives are no files; an archive that cannot be read is an
    error; repeated names in an archive give the last one's content, once for each.
    """
    if local_path(path) is not None:
        spark.dataSource.register(ZipMembers)
        return spark.read.format("zip_members").option("split", str(split)).load(path)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,ZIP}").load(path)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            got = z.read(info.filename)
                            yield pa.RecordBatch.from_pydict({"archive": [name], "member": [info.filename], "size": [len(got)], "content": pa.array([got], pa.binary())})

    return whole.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(members, _SCHEMA)


def report_parts(files: DataFrame) -> DataFrame:
    """(archive, page_number, json, html, markdown): an archive's pages, one row for each with what it has in each form.

    Pages are numbered by their files' names; files of other kinds are left out. Of two files of a page and kind the one
    with the larger name counts.
    """
    kind = F.lower(F.regexp_extract("member", r"\.([A-Za-z]+)$", 1))
    form = F.when(kind == "json", "json").when(kind.isin("html", "htm"), "html").when(kind.isin("md", "markdown"), "markdown")
    number = page_number(F.element_at(F.split("member", "/"), -1))
    rows = files.select("archive", "member", form.alias("form"), number.alias("page_number"), F.decode("content", "UTF-8").alias("text")).where("form IS NOT NULL")
    last = {f: F.max_by(F.when(F.col("form") == f, F.col("text")), F.when(F.col("form") == f, F.col("member"))).alias(f) for f in ("json", "html", "markdown")}
    return rows.groupBy("archive", "page_number").agg(*last.values())


class Pdf:
    """What is needed of a PDF file to count its pages: its cross-reference tables or streams, and the objects they point to."""

    def __init__(self, data: bytes):
        self.data = data
        self.at: dict[int, int] = {}
        self.packed: dict[int, tuple[int, int]] = {}
        self.root: int | None = None
        starts = re.findall(rb"startxref\s+(\d+)", data)
        seen: set[int] = set()
        todo = [int(starts[-1])] if starts else []
        while todo:
            place = todo.pop()
            if place in seen or place >= len(data):
                continue
            seen.add(place)
            trailer = self._table(place) if data[place : place + 4] == b"xref" else self._stream(place)
            if self.root is None and (root := re.search(rb"/Root\s+(\d+)\s+\d+\s+R", trailer)):
                self.root = int(root[1])
            todo += [int(x) for x in re.findall(rb"/(?:Prev|XRefStm)\s+(\d+)", trailer)]

    def _table(self, place: int) -> bytes:
        end = self.data.find(b"trailer", place)
        if end < 0:
            return b""
        words = self.data[place + 4 : end].split()
        i = 0
        while i + 1 < len(words):
            first, n = int(words[i]), int(words[i + 1])
            for k in range(n):
                row = words[i + 2 + 3 * k : i + 5 + 3 * k]
                if len(row) == 3 and row[2] == b"n":
                    self.at.setdefault(first + k, int(row[0]))
            i += 2 + 3 * n
        return self.data[end : self.data.find(b"startxref", end) if b"startxref" in self.data[end:] else len(self.data)]

    def _unpacked(self, place: int) -> tuple[bytes, bytes]:
        """(dictionary, content) of the stream object at a place; only Flate streams are opened."""
        begin = self.data.find(b"stream", place)
        head = self.data[place:begin]
        begin += 6
        begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
        end = self.data.find(b"endstream", begin)
        body = self.data[begin:end]
        if b"/FlateDecode" in head:
            body = zlib.decompressobj().decompress(body)
        predictor, columns = (re.search(p, head) for p in (rb"/Predictor\s+(\d+)", rb"/Columns\s+(\d+)"))
        if predictor and int(predictor[1]) >= 10:
            width = int(columns[1]) if columns else 1
            rows, before = [], bytes(width)
            for i in range(0, len(body), width + 1):
                kind, row = body[i], bytearray(body[i + 1 : i + 1 + width])
                for j in range(len(row)):
                    left = row[j - 1] if j else 0
                    row[j] = (row[j] + {0: 0, 1: left, 2: before[j], 3: (left + before[j]) // 2}.get(kind, 0)) & 255
                before = bytes(row)
                rows.append(before)
            body = b"".join(rows)
        return head, body

    def _stream(self, place: int) -> bytes:
        head, body = self._unpacked(place)
        widths = re.search(rb"/W\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s*\]", head)
        if not widths:
            return b""
        w = [int(x) for x in widths.groups()]
        index = re.search(rb"/Index\s*\[([^\]]*)\]", head)
        size = re.search(rb"/Size\s+(\d+)", head)
        ranges = [int(x) for x in index[1].split()] if index else [0, int(size[1]) if size else 0]
        numbers = [n for a, b in zip(ranges[::2], ranges[1::2], strict=False) for n in range(a, a + b)]
        for i, number in enumerate(numbers):
            row = body[i * sum(w) : (i + 1) * sum(w)]
            kind, one, two = (int.from_bytes(row[sum(w[:j]) : sum(w[: j + 1])], "big") for j in range(3))
            kind = kind if w[0] else 1
            if kind == 1:
                self.at.setdefault(number, one)
            elif kind == 2 and number not in self.at:
                self.packed.setdefault(number, (one, two))
        return head

    def object(self, number: int) -> bytes:
        """An object's text, up to its end or its stream."""
        if number in self.at:
            place = self.at[number]
            ends = [x for x in (self.data.find(b"endobj", place), self.data.find(b"stream", place)) if x >= 0]
            return self.data[place : min(ends, default=len(self.data))]
        if number in self.packed:
            holder, i = self.packed[number]
            head, body = self._unpacked(self.at.get(holder, len(self.data)))
            first = int(re.search(rb"/First\s+(\d+)", head)[1])
            places = [int(x) for x in body[:first].split()]
            offsets = [*places[1::2], len(body) - first]
            return body[first + offsets[i] : first + offsets[i + 1]]
        return b""

    def pages(self) -> int | None:
        """The count of the root of the page tree; null where the file does not lead there."""
        if self.root is None:
            return None
        tree = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", self.object(self.root))
        count = re.search(rb"/Count\s+(\d+)", self.object(int(tree[1]))) if tree else None
        return int(count[1]) if count else None


def pdf_pages(content: bytes | None) -> int | None:
    """The pages of a PDF file by its cross-references; null for anything that is not such a file."""
    if not content or b"%PDF-" not in content[:1024]:
        return None
    try:
        return Pdf(content).pages()
    except (ValueError, IndexError, TypeError, zlib.error):
        return None


def page_counts(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` without their content but with ``total_pages`` of those that are PDF files, null for others."""
    at = files.columns.index(content_col)
    rest = [c for c in files.columns if c != content_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = pa.array([pdf_pages(c) for c in batch.column(at).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), pages], names=[*rest, "total_pages"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != content_col)
    return files.mapInArrow(count, f"{schema}, total_pages int")
