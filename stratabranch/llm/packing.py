"""Token ids packed into fixed rows by best fit decreasing.

Documents are tokenised where they are read, in batches; texts aren't shuffled. A document longer
than a row is split losslessly: full pieces are rows by themselves, the rest is packed. Pieces
wait in a buffer of bounded size, and each full buffer is packed: longest first, each into the
open row with the least room that still holds it, which a segment tree over capacities finds. Rows
that are left with room go back to the buffer, and what a task has left in the end is packed again together
with what the others have left, so that small tasks cost no room. Rows
that come out have the ids (little-endian, padded to the row's width), cumulative segment lengths,
the positions where position ids start again from 0, and for each segment its document (doc_keys, a key
of the input row, and doc_ids) and the offset in the document's ids, so that every row can be put
together again. write_matrices writes them to a folder as NumPy matrices.

Null text counts as empty; an empty document has its end token only (without an end token it has no
segment and doesn't come back). A null doc_id is carried as null. Repeated rows and ids are packed each,
under keys of their own. Rows and keys depend on how the input's files are split into tasks; documents put
together again don't. Other columns aren't read. No rows in, no rows out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import stored, tune

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that this vocabulary's words are split with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id after the vocabulary's last.
END = 50_256
WIDTH = 2_048
#: Ids that wait in a task's buffer before they are packed.
BUFFER_IDS = 8_000_000
#: Room up to which a row counts as full, as a share of its width.
SLACK = 1 / 128
#: Bits of a document's key that number the rows of a task.
KEY_BITS = 36
PACKED = "part int, row long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_keys array<long>, doc_ids array<long>, doc_offsets array<long>"


class Tokenizer:
    def __init__(self, vocabulary: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
        self.coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max(ranks.values()) + 1 < 1 << 16 else "<u4")

    def ids(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), self.dtype).tobytes()


@lru_cache(maxsize=1)
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


class Capacities:
    """A segment tree over room that is left: the least room of an open row that holds n."""

    def __init__(self, width: int):
        self.base = 1 << width.bit_length()
        self.some = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = self.base + room
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """The room and the row, which is no longer open; None if no open row holds n."""
        some, k = self.some, self.base + n
        if not some[k]:
            while k > 1 and not (k % 2 == 0 and some[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            some[k] = 0
            while k > 1 and not some[k ^ 1]:
                k >>= 1
                some[k] = 0
        return room, row


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of indexes. Every length must fit a row."""
    if max(lengths, default=0) > width:
        raise ValueError("a piece is longer than a row")
    rows: list[list[int]] = []
    tree = Capacities(width)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room, row = tree.take(n) or (width, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if room > n:
            tree.add(room - n, row)
    return rows


#: A piece of a document: key, doc_id, offset in ids, ids.
Piece = tuple[int, int | None, int, bytes]


class Buffer:
    """Pieces that wait to be packed, and the rows that they become."""

    def __init__(self, part: int, width: int, step: int):
        self.part, self.width, self.step = part, width, step
        self.waiting: list[Piece] = []
        self.held = self.done = 0

    def add(self, piece: Piece) -> None:
        self.waiting.append(piece)
        self.held += len(piece[3])

    def rows(self, groups: list[list[Piece]], left_open: bool = False) -> pa.RecordBatch:
        ids = [b"".join(x[3] for x in g) for g in groups]
        ends = [np.cumsum([0, *(len(x[3]) // self.step for x in g)]).tolist() for g in groups]
        longs = pa.list_(pa.int64())
        columns = {
            "part": pa.array([self.part] * len(groups), pa.int32()),
            "row": pa.array(range(self.done, self.done + len(groups)), pa.int64()),
            "input_ids": pa.array([x + bytes(self.width * self.step - len(x)) for x in ids], pa.binary()),
            "n_tokens": pa.array([len(x) // self.step for x in ids], pa.int32()),
            "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
            "position_resets": pa.array([x[:-1] for x in ends], pa.list_(pa.int32())),
            "doc_keys": pa.array([[x[0] for x in g] for g in groups], longs),
            "doc_ids": pa.array([[x[1] for x in g] for g in groups], longs),
            "doc_offsets": pa.array([[x[2] for x in g] for g in groups], longs),
            "left_open": pa.array([left_open] * len(groups), pa.bool_()),
        }
        self.done += len(groups)
        return pa.RecordBatch.from_pydict(columns)

    def flush(self, last: bool = False, hand_on: bool = False) -> Iterator[pa.RecordBatch]:
        """Pack what waits. Rows with room wait on, the emptiest first and half a buffer of them at most; in
        the end all come out, those with room marked as open if they are to be handed on."""
        groups = [[self.waiting[i] for i in g] for g in best_fit([len(x[3]) // self.step for x in self.waiting], self.width)]
        full, half = (self.width - int(self.width * SLACK)) * self.step, BUFFER_IDS * self.step // 2
        sizes = [sum(len(x[3]) for x in g) for g in groups]
        roomy, held = [], 0
        for k in sorted(range(len(groups)), key=lambda k: (sizes[k], k)):
            if sizes[k] >= full or not (last or held + sizes[k] <= half):
                break
            roomy.append(k)
            held += sizes[k]
        some = {*roomy}
        packed, roomy = [g for k, g in enumerate(groups) if k not in some], [groups[k] for k in sorted(some)]
        self.waiting, self.held = ([], 0) if last else ([x for g in roomy for x in g], held)
        for rows, left_open in ((packed, False), (roomy if last else [], hand_on)):
            for k in range(0, len(rows), 1000):
                yield self.rows(rows[k : k + 1000], left_open)


def pack(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY, end: int | None = END) -> DataFrame:
    """A row for each packed row; part and row number them (parts under 0 are of what tasks had left).
    width: ids in a row."""
    tune(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        step, last = coder.dtype.itemsize, np.array([] if end is None else [end], coder.dtype).tobytes()
        part, size = TaskContext.get().partitionId(), width * step
        buffer, key = Buffer(part, width, step), part << KEY_BITS
        for batch in batches:
            full = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.ids(text or "") + last
                cut = len(ids) // size * size
                full += [[(key, doc, k // step, ids[k : k + size])] for k in range(0, cut, size)]
                if len(ids) > cut:
                    buffer.add((key, doc, cut // step, ids[cut:]))
                key += 1
                while len(full) >= 1000:
                    yield buffer.rows(full[:1000])
                    del full[:1000]
            if full:
                yield buffer.rows(full)
            if buffer.held >= BUFFER_IDS * step:
                yield from buffer.flush()
        yield from buffer.flush(last=True, hand_on=True)

    # Written once, so that no text is tokenised again for the rows that are handed on.
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED + ", left_open boolean"))
    handed = rows.where("left_open").drop("left_open")
    ids = handed.agg(F.sum("n_tokens")).first()[0] or 0
    return rows.where("NOT left_open").drop("left_open").unionByName(pack_again(handed, width, max(1, -(-ids // BUFFER_IDS))))


def pack_again(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """The pieces of packed rows, packed together in so many tasks."""
    step = F.octet_length("input_ids") / F.lit(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = None
        for batch in batches:
            for n, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                ids, ends, *known = row
                buffer = buffer or Buffer(-1 - TaskContext.get().partitionId(), width, n)
                for a, b, key, doc, at in zip(ends, ends[1:], *known):
                    buffer.add((key, doc, at, ids[n * a : n * b]))
            if buffer and buffer.held >= BUFFER_IDS * buffer.step:
                yield from (x.drop_columns(["left_open"]) for x in buffer.flush())
        if buffer:
            yield from (x.drop_columns(["left_open"]) for x in buffer.flush(last=True))

    dealt = rows.select(step.cast("int").alias("step"), "input_ids", "cu_seqlens", "doc_keys", "doc_ids", "doc_offsets", "part", "row").repartition(parts, "part", "row").sortWithinPartitions("part", "row")
    return dealt.mapInArrow(run, PACKED)


def unpack(packed: DataFrame, width_bytes: int = 2) -> DataFrame:
    """doc_key, doc_id, ids (binary) of every input row, put together from its segments."""
    cut = "substring(input_ids, {w} * cu_seqlens[i] + 1, {w} * (cu_seqlens[i + 1] - cu_seqlens[i]))".format(w=width_bytes)
    pieces = packed.selectExpr(f"inline(transform(sequence(0, size(doc_keys) - 1), i -> struct(doc_keys[i] AS doc_key, doc_ids[i] AS doc_id, doc_offsets[i] AS at, {cut} AS ids)))")
    return pieces.groupBy("doc_key", "doc_id").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY at)").alias("ids"))


def matrix_blocks(packed: DataFrame, width: int = WIDTH, rows: int = 512, dtype: str = "<u2") -> DataFrame:
    """part, block, rows, ids (.npy bytes of a rows x width matrix), cu_seqlens (.npy, of all rows in
    turn), positions (.npy, position ids of the matrix): files' contents, for a binary sink."""
    import io

    def npy(x: np.ndarray) -> bytes:
        np.save(out := io.BytesIO(), x)
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                ids = np.stack([np.frombuffer(x, dtype) for x in part.column(1).to_pylist()])
                starts = part.column(2).to_pylist()
                positions = np.zeros((len(ids), width), np.int32)
                ends = [0]
                for r, cu in enumerate(starts):
                    for s, e in zip(cu[:-1], cu[1:]):
                        positions[r, s:e] = np.arange(e - s)
                    ends += [r * width + e for e in cu[1:]]
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "block": pa.array([k], pa.int32()), "rows": pa.array([len(ids)], pa.int32()), "ids": [npy(ids)], "cu_seqlens": [npy(np.array(ends, np.int64))], "positions": [npy(positions)]}
                )
                k += 1

    return packed.select("part", "input_ids", "cu_seqlens").mapInArrow(run, "part int, block int, rows int, ids binary, cu_seqlens binary, positions binary")


def write_matrices(packed: DataFrame, folder: str, width: int = WIDTH, rows: int = 512, dtype: str = "<u2") -> DataFrame:
    """Writes blocks of packed rows to a folder that every machine reaches (a path or URI that pyarrow
    opens), as NumPy files: ids (a rows x width matrix), cu_seqlens and positions. Returns a row for each file: path, rows,
    bytes, sha256. A file is written beside its place and then moved there, so that a task that is run
    again leaves whole files."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for part, block, n, *files in zip(*(batch.column(k).to_pylist() for k in range(6))):
                found = []
                for kind, data in zip(("ids", "cu_seqlens", "positions"), files):
                    path = f"{root}/part-{part:06d}-{block:06d}.{kind}.npy"
                    beside = f"{path}.{TaskContext.get().taskAttemptId()}"
                    with store.open_output_stream(beside) as out:
                        out.write(data)
                    store.move(beside, path)
                    found.append((path, n, len(data), hashlib.sha256(data).hexdigest()))
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()))], ["path", "rows", "bytes", "sha256"])

    found = matrix_blocks(packed, width, rows, dtype).mapInArrow(run, "path string, rows int, bytes long, sha256 string")
    return stored(found)
