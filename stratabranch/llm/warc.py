"""Merkle fixity audit of WARC records.

Pages are laid out as WARC/1.1 response records in files, in order of page_id, each with its
offset and length. A leaf is the SHA-256 of a record; every FAN leaves, in order of offset, are
hashed with their range of offsets into a node, and so on up to a file's root. To audit a replica
the roots are compared, and only under roots that differ the children, level by level; at the
leaves that are reached, records are matched by key and named corrupt, missing, extra or moved.
Record bytes are hashed where they are read; what is shuffled are leaves. A missing or extra record moves
those behind it in its file, whose ranges then differ; files are FILE_RECORDS long at most.

WARC files of others are read too: any record id, headers in any case and folded, plain or compressed
by record (gzip members), records of all types, from a stream that holds one record at a time. A file
that ends within a record, or has no record where one should begin, is an error that names the offset.

Null html is an empty payload, a null url an empty target, a null page_id is written as `null`
and ordered first. Records with one page_id are ordered by digest; equal ones are told apart by
their rank only. Empty tables have no files. Other columns aren't read.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.llm.common import cut, tune

FILE_RECORDS = 2_000
FAN = 16
#: Bytes read at a time, a record's head at most, and a batch of records.
CHUNK, HEAD, BATCH_BYTES = 1 << 16, 1 << 20, 8 << 20
#: Of the drill: (modulus, remainder) of keys' numbers whose records are corrupt, or missing.
CORRUPT, MISSING = (251, 75), (16_001, 8_920)
DATE = "2026-01-01T00:00:00Z"


def key_number(column: str = "page_id") -> Column:
    """A number that deals keys evenly: 32 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """file, page_id, record (bytes) of every page."""
    files = max(1, -(-pages.count() // file_records))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col("url"), F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    file = F.pmod(key_number(), F.lit(files)).cast("int")
    return pages.select(file.alias("file"), F.col("page_id").cast("long").alias("page_id"), F.concat(head, body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


@dataclass
class Record:
    """A record of a WARC file: where it lies there (compressed, if the file is), headers by lower-case
    name, the block that it carries, and its bytes as they were before compression."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    raw: bytes

    @property
    def payload(self) -> bytes:
        """The block without the head of an HTTP message."""
        if self.headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            head, mark, body = self.block.partition(b"\r\n\r\n")
            return body if mark else self.block
        return self.block


class _Source:
    """Bytes of a stream, decompressed where it is gzip, and where in it they come from."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.plain, self.place = stream, b"", 0  # place: how much of plain is taken
        self.taken = self.made = self.read = 0  # plain bytes taken and made, packed bytes unpacked
        self.members: deque[tuple[int, int]] = deque()  # where members begin, in plain bytes and in the stream
        self.data, self.member = stream.read(CHUNK), None
        self.packed = self.data[:2] == b"\x1f\x8b"
        if not self.packed:
            self.plain, self.data = self.data, b""

    def has(self, n: int) -> bool:
        """Whether there are n bytes, which are then in plain from place on."""
        parts, held = [], len(self.plain) - self.place
        while held < n and (more := self._inflate() if self.packed else self.stream.read(max(CHUNK, n - held))):
            parts.append(more)
            held += len(more)
        if parts:
            self.plain, self.place = b"".join([self.plain[self.place :], *parts]), 0
        return held >= n

    def _inflate(self) -> bytes:
        """The next bytes of the members; empty at the end."""
        while True:
            if not self.data and not (chunk := self.stream.read(CHUNK)):
                if self.member is not None:
                    raise ValueError(f"the file ends within the compressed record at offset {self.members[-1][1]}")
                return b""
            self.data = self.data or chunk
            if self.member is None:
                self.member = zlib.decompressobj(31)
                self.members.append((self.made, self.read))
            had = len(self.data)
            try:
                out = self.member.decompress(self.data)
            except zlib.error as e:
                raise ValueError(f"no compressed record at offset {self.members[-1][1]}") from e
            self.data = self.member.unused_data
            self.read += had - len(self.data)
            self.made += len(out)
            if self.member.eof:
                self.member = None
            if out:
                return out

    def take(self, n: int) -> bytes:
        out = self.plain[self.place : self.place + n]
        self.place += len(out)
        self.taken += len(out)
        return out

    @property
    def at(self) -> int:
        """Offset of the next byte in the stream; of the member that has it, if compressed."""
        if not self.packed:
            return self.taken
        while len(self.members) > 1 and self.members[1][0] <= self.taken:
            self.members.popleft()
        return self.read if self.taken == self.made and self.member is None else self.members[0][1]


def parse(stream: BinaryIO | bytes) -> Iterator[Record]:
    """The records of a WARC file, one at a time. The offset of a compressed record is that of its member."""
    source = _Source(io.BytesIO(stream) if isinstance(stream, bytes) else stream)
    while True:
        while source.has(2) and source.plain.startswith(b"\r\n", source.place):  # between records
            source.take(2)
        start = source.at
        if not source.has(1):
            return
        n = 1024
        while True:
            more = source.has(n)
            if (end := source.plain.find(b"\r\n\r\n", source.place)) >= 0:
                break
            if not more or n > HEAD:
                raise ValueError(f"no record at offset {start}")
            n *= 2
        head = source.take(end + 4 - source.place)
        first, *lines = re.sub(rb"\r\n[ \t]+", b" ", head[:-4]).decode("utf-8", "replace").split("\r\n")
        if not re.fullmatch(r"WARC/\d+\.\d+", first.strip()):
            raise ValueError(f"no record at offset {start}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not size.isdigit():
            raise ValueError(f"a record without a length at offset {start}")
        if not source.has(int(size)):
            raise ValueError(f"the file ends within the record at offset {start}")
        block = source.take(int(size))
        tail = source.take(4) if source.has(4) and source.plain.startswith(b"\r\n\r\n", source.place) else b""
        yield Record(start, source.at - start, headers, block, head + block + tail)


#: Columns of records that were read.
READ = "file string, offset long, length long, record_id string, type string, url string, page_id long, html string, record binary"


def _rows(file: str, stream: BinaryIO | bytes) -> Iterator[pa.RecordBatch]:
    """Batches of records, a few megabytes each."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    rows, held = [], 0
    for r in parse(stream):
        key = r.headers.get("warc-record-id")
        page = re.fullmatch(r"<urn:page:(-?\d+)>", key or "")
        rows.append((file, r.offset, r.length, key, r.headers.get("warc-type"), r.headers.get("warc-target-uri"), int(page[1]) if page else None, r.payload.decode("utf-8", "replace"), r.raw))
        held += len(r.raw)
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_records(files: DataFrame) -> DataFrame:
    """READ of the records in WARC files whose bytes are in a table (file, content)."""
    tune(files.sparkSession, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _rows(file, data or b"")

    return files.select(F.col("file").cast("string").alias("file"), "content").mapInArrow(run, READ)


def read_paths(paths: DataFrame) -> DataFrame:
    """READ of the records in files that every machine reaches; paths: path (one that pyarrow opens). A
    file is read as a stream."""
    tune(paths.sparkSession, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with store.open_input_stream(place, compression=None) as stream:
                    yield from _rows(path, stream)

    return paths.select("path").mapInArrow(run, READ)


def leaves(found: DataFrame, key: str = "page_id") -> DataFrame:
    """file, node (the record's place in its file), the key, begin, end (offsets), digest."""
    order = Window.partitionBy("file").orderBy(F.col(key).asc_nulls_first(), "digest")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.select("file", key, F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
        .select("file", key, "length", "digest", (F.row_number().over(order) - 1).cast("long").alias("node"), end.alias("end"))
        .select("file", "node", key, (F.col("end") - F.col("length")).alias("begin"), "end", "digest")
    )


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level: nodes of fan children, hashed in order with their range of offsets."""
    children = F.sort_array(F.collect_list(F.struct("node", "digest")))
    return (
        nodes.groupBy("file", F.floor(F.col("node") / fan).cast("long").alias("node"))
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), children.alias("children"))
        .select(
            "file",
            "node",
            "begin",
            "end",
            F.sha2(F.concat_ws("|", F.col("begin").cast("string"), F.col("end").cast("string"), F.array_join(F.col("children.digest"), "")).cast("binary"), 256).alias("digest"),
        )
    )


def tree(found: DataFrame, height: int, fan: int = FAN) -> list[DataFrame]:
    """Levels from the leaves up; the last one has a root for each file."""
    levels = [found]
    for _ in range(height):
        levels.append(cut(parents(levels[-1], fan)))
    return levels


def _height(*sides: DataFrame, fan: int) -> int:
    most = max(int(x.agg(F.max("node")).first()[0] or 0) for x in sides)
    height = 1
    while fan**height <= most:
        height += 1
    return height


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, node where the two sides' nodes differ, or one has none."""
    l, r = (x.select("file", "node", "digest", "begin").alias(a) for x, a in ((left, "l"), (right, "r")))
    return l.join(r, ["file", "node"], "full").where(~(F.col("l.digest").eqNullSafe(F.col("r.digest")) & F.col("l.begin").eqNullSafe(F.col("r.begin")))).select("file", "node")


def descend(left: DataFrame, right: DataFrame, fan: int = FAN) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Level by level from the roots: the nodes that are compared, and those that differ. The last level
    is that of the leaves."""
    height = _height(left, right, fan=fan)
    a, b = tree(left, height, fan), tree(right, height, fan)
    suspects = cut(differing(a[-1], b[-1]))
    yield a[-1].select("file", "node").union(b[-1].select("file", "node")).distinct(), suspects
    parent = F.floor(F.col("node") / fan).cast("long")
    for below in range(height - 1, -1, -1):
        up = suspects.select("file", F.col("node").alias("up"))
        down = [x.withColumn("up", parent).join(up, ["file", "up"], "left_semi").drop("up") for x in (a[below], b[below])]
        suspects = cut(differing(*down))
        yield down[0].select("file", "node").union(down[1].select("file", "node")).distinct(), suspects


def audit(left: DataFrame, right: DataFrame, fan: int = FAN, key: str = "page_id") -> DataFrame:
    """file, the key, status and both sides' places of the records that differ. left and right:
    leaves of the original and of the replica."""
    left, right = cut(left), cut(right)
    *_, (_, last) = descend(left, right, fan)
    rank = F.row_number().over(Window.partitionBy("file", key).orderBy("digest", "node"))
    l, r = (x.join(last, ["file", "node"], "left_semi").withColumn("rank", rank).alias(n) for x, n in ((left, "l"), (right, "r")))
    status = (
        F.when(F.col("r.digest").isNull(), "missing").when(F.col("l.digest").isNull(), "extra").when(F.col("l.digest") != F.col("r.digest"), "corrupt").otherwise("moved")
    )
    return l.join(r, F.expr(f"l.file = r.file AND l.`{key}` <=> r.`{key}` AND l.rank = r.rank"), "full").select(
        F.coalesce("l.file", "r.file").alias("file"),
        F.coalesce(f"l.{key}", f"r.{key}").alias(key),
        status.alias("status"),
        F.col("l.node").alias("node"),
        F.col("l.begin").alias("begin"),
        F.col("r.begin").alias("replica_begin"),
    )


def damaged(found: DataFrame) -> DataFrame:
    """A replica for drills: in one record of 251 the byte in the middle is another one, one of 16,001 is gone."""
    number = key_number()
    middle = F.floor(F.octet_length("record") / 2).cast("int")
    other = F.when(F.substring(F.col("record"), middle, F.lit(1)) == F.lit("#").cast("binary"), F.lit("%").cast("binary")).otherwise(F.lit("#").cast("binary"))
    return found.where(number % MISSING[0] != MISSING[1]).withColumn("record", F.when(number % CORRUPT[0] == CORRUPT[1], F.overlay("record", other, middle, F.lit(1))).otherwise(F.col("record")))


def report(pages: DataFrame) -> DataFrame:
    """Every record of the drill: page_id, file, ordinal, offset, length, sha256, status."""
    original = records(pages)
    left = cut(leaves(original))
    found = cut(audit(left, leaves(damaged(original))))
    known = found.where("node IS NOT NULL").select("file", "node", "status")
    return left.join(known, ["file", "node"], "left").select(
        "page_id", "file", F.col("node").alias("ordinal"), F.col("begin").alias("offset"), (F.col("end") - F.col("begin")).alias("length"), F.col("digest").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status")
    )
