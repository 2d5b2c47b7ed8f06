"""Line dedup by a range-partitioned sort of line hashes.

Each line's key is hashed to 128 bits. (hash, doc_id, position) rows are range-partitioned and
sorted, so that a stream over a partition meets a key's holders in order of doc_id and position:
the first document of a run keeps its lines, those of later documents go. Because doc_id and
position are part of the range, a key that a third of all lines have is spread over many
partitions. A run that began in an earlier partition is settled by one row per partition edge:
only the first document of a partition's leading run waits for it. What comes back are
compressed keep bitmaps for each document, not text.

Null or empty text is one empty line. A document is a doc_id: rows that share one count as one
document, each row has its own bitmap by its text. A null doc_id sorts after all others, and all
rows that have it count as one document; so do the largest long and null. Other columns aren't touched. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import cut, over_batches, partitions, text_bytes, tune

MIN_CHARS = 10
#: Sorts after every doc_id and stands for null.
LAST = np.iinfo(np.int64).max


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hi, lo (the key's hash), doc_id, row (a hash of the whole text), pos of lines long enough."""
    names = ["hi", "lo", "doc_id", "row", "pos"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, pos, n = [], [], []
        digest = xxhash.xxh3_128_digest
        for text in batch.column(2).to_pylist():
            found = [(digest(k), i) for i, x in enumerate((text or b"").lower().split(b"\n")) if len(x) >= min_chars and _long_enough(k := x.strip(), min_chars)]
            hashes += [x[0] for x in found]
            pos += [x[1] for x in found]
            n.append(len(found))
        words = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (words[:, 0], words[:, 1], np.repeat(ids, n), np.repeat(rows, n), np.array(pos, np.int32))], names
        )

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("row"), text_bytes().alias("text")
    )
    return over_batches(rows, work, "hi long, lo long, doc_id long, row long, pos int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences along one sorted partition.

    kind 0: the line goes. kind 1: it goes if the run began before this partition with another
    document. kind 2: the first document of the partition's leading and of its last run.
    """
    names = ["kind", "hi", "lo", "doc_id", "row", "pos"]
    lead = last = None  # (hi, lo, first document)
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, row, pos = (batch.column(i).to_numpy() for i in range(5))
        starts = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
        first = doc[starts].copy()
        if last and last[:2] == (hi[0], lo[0]):
            first[0] = last[2]
        firsts = np.repeat(first, np.diff(np.append(starts, len(doc))))
        last = (hi[starts[-1]], lo[starts[-1]], first[-1])
        lead = lead or (hi[0], lo[0], first[0])
        kind = np.where(doc != firsts, 0, np.where((hi == lead[0]) & (lo == lead[1]), 1, 9)).astype(np.int8)
        some = kind != 9
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (kind, hi, lo, doc, row, pos)], names)
    if lead:
        edges = np.array([lead, last], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(2, 2, np.int8)), *(pa.array(edges[:, i]) for i in range(3)), pa.array(np.zeros(2, np.int64)), pa.array(np.zeros(2, np.int32))], names
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row, bitmap of the documents that lose lines.

    bitmap: zlib of packed bits, 1 for a line that stays; lines past its end stay. doc_id is LAST
    for null; row is xxhash64 of the text.
    """
    spark = tune(docs.sparkSession)
    order = ["hi", "lo", "doc_id", "pos"]
    lines = line_hashes(docs, min_chars)
    settled = cut(
        lines.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream, "kind byte, hi long, lo long, doc_id long, row long, pos int")
    )
    # Two rows at most for each partition, so this side may be broadcast.
    edges = settled.where("kind = 2").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"))
    waiting = settled.where("kind = 1").join(F.broadcast(edges), ["hi", "lo"]).where("doc_id <> first")
    gone = settled.where("kind = 0").select("doc_id", "row", "pos").unionByName(waiting.select("doc_id", "row", "pos"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        maps = []
        for x in batch.column(2).to_pylist():
            bits = np.ones(max(x) + 1, np.uint8)
            bits[x] = 0
            maps.append(zlib.compress(len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes(), 6))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc_id", "row", "bitmap"])

    return over_batches(
        gone.groupBy("doc_id", "row").agg(F.collect_list("pos").alias("pos")), pack, "doc_id long, row long, bitmap binary"
    )


def kept_lines(text: bytes | None, bitmap: bytes | None) -> tuple[int, list[bytes]]:
    """How many lines the text has, and those that its bitmap keeps."""
    lines = (text or b"").split(b"\n")
    if bitmap is None:
        return len(lines), lines
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[8:], np.uint8))[: int.from_bytes(raw[:8], "little")]
    return len(lines), [x for x, keep in zip(lines, bits) if keep] + lines[len(bits) :]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (bytes), bitmap of every row; the narrow side builds the hash table."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("row"), text_bytes().alias("text")
    )
    return rows.join(bitmaps.withColumnRenamed("doc_id", "_id").hint("shuffle_hash"), ["_id", "row"], "left").select("doc_id", "text", "bitmap")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text without the lines that went, n_lines, n_dropped."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [kept_lines(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = [batch.column(0), pa.array([b"\n".join(x) for _, x in done]).cast(pa.string()), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(x) for n, x in done], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped"])

    return over_batches(with_bitmaps(docs, keep_bitmaps(docs, min_chars)), work, "doc_id long, text string, n_lines long, n_dropped long")


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, bitmap (null: every line stays)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [kept_lines(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = [batch.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(x) for n, x in done], pa.int64()), pa.array([hashlib.sha256(b"\n".join(x)).hexdigest() for _, x in done], pa.string()), batch.column(2)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256", "bitmap"])

    return over_batches(with_bitmaps(docs, keep_bitmaps(docs, min_chars)), work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, bitmap binary")
