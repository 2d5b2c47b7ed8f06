"""Exact dedup against a minimal perfect hash over historical distinct digests.

The history is reduced to distinct SHA-256 digests with a winner (the largest doc_id) and a
count. Digests are spread over shards by their leading bytes; each shard gets a minimal perfect
hash of cascading bit arrays: a key that is alone at its place on a level is settled there, the
others try the next level, and a key's slot is the rank of its bit. Slots hold the full digest,
the winner's locator and the count, so a lookup compares all 32 bytes: a nonmember that lands on
a taken slot is told apart. Members of a new batch join their slot's group; nonmembers form
groups of their own.

Null text counts as empty. A null doc_id never wins over another one; a group of null ids only
has a null keep_id and keeps all its rows. Rows that repeat a doc_id and a text all count; those
with the winning doc_id all stay. An empty table gives no rows. Columns other than doc_id and
text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import cut, over_batches, text_bytes, tune

#: Expected digests in a shard; a shard is what one task holds at a time.
SHARD_KEYS = 20_000
#: Room of a level for each key it is tried with.
ROOM = 2.0
LEVELS = 48
INDEX = "shard int, sizes array<long>, bits binary, rest binary, digests binary, winners binary, counts binary"
_NONE = np.iinfo(np.int64).min


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place of each key on a level, from two words of its digest."""
    x = words[:, 1] ^ (words[:, 2] * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, given as rows of four words."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def build(cls, words: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and each key's slot."""
        slots = np.full(len(words), -1, np.int64)
        left, sizes, levels, at = np.arange(len(words)), [], [], np.zeros(len(words), np.int64)
        start = 0
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(ROOM * len(left)))
            place = _places(words[left], len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            settled = alone[place]
            at[left[settled]] = start + place[settled]
            slots[left[settled]] = 0
            sizes.append(size)
            levels.append(alone)
            start += size
            left = left[~settled]
        found = cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool), words[left])
        placed = slots == 0
        slots[placed] = found.ranks[at[placed]]
        slots[left] = found.ranks[-1] + np.arange(len(left))
        return found, slots

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a nonmember, so the caller compares digests."""
        out, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            place = start + _places(words[left], level, size)
            hit = self.bits[place]
            out[left[hit]] = self.ranks[place[hit]]
            left = left[~hit]
            start += size
        for k, key in enumerate(self.rest):
            out[left[(words[left] == key).all(axis=1)]] = self.ranks[-1] + k
        return out


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each row's normalised text."""
    tune(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [hashlib.sha256((x or b"").lower()).digest() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return over_batches(rows, work, "doc_id long, digest binary")


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each digest; map-side sums keep a digest with many copies small."""
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return (
        rows.groupBy("digest")
        .agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))
        .select(shard.alias("shard"), "digest", "winner", "n")
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """A row for each shard that has digests. history: doc_id, digest."""

    def build(part: pa.Table) -> pa.Table:
        words = _words(part.column("digest"))
        table, slots = PerfectHash.build(words)
        order = np.argsort(slots)
        return pa.Table.from_pydict(
            {
                "shard": pa.array(part.column("shard")[:1].to_pylist(), pa.int32()),
                "sizes": pa.array([table.sizes], pa.list_(pa.int64())),
                "bits": [np.packbits(table.bits).tobytes()],
                "rest": [table.rest.astype(">u8").tobytes()],
                "digests": [words[order].astype(">u8").tobytes()],
                "winners": [_ids(part.column("winner"))[order].tobytes()],
                "counts": [part.column("n").to_numpy()[order].tobytes()],
            }
        )

    return _distinct(history, shards).groupBy("shard").applyInArrow(build, INDEX)


def merge(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, slot (null for nonmembers of the history), winner and n of all digests.

    Each distinct digest of the batch (doc_id, digest) is looked up once in its shard. Slots that
    no row of the batch hit come out as they are.
    """
    schema = pa.schema([("digest", pa.binary()), ("slot", pa.int64()), ("winner", pa.int64()), ("n", pa.int64())])

    def find(new: pa.Table, old: pa.Table) -> pa.Table:
        words, ids, n = _words(new.column("digest")), _ids(new.column("winner")), new.column("n").to_numpy()
        slots = np.full(len(words), -1, np.int64)
        kept = np.zeros((0, 4), np.uint64)
        winners = counts = np.zeros(0, np.int64)
        if old.num_rows:
            row = {c: old.column(c)[0].as_py() for c in old.column_names}
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
            rest = np.frombuffer(row["rest"], ">u8").astype(np.uint64).reshape(-1, 4)
            kept = np.frombuffer(row["digests"], ">u8").astype(np.uint64).reshape(-1, 4)
            winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
            slots = PerfectHash(row["sizes"], bits, rest).slots(words)
            hit = slots >= 0
            hit[hit] = (kept[slots[hit]] == words[hit]).all(axis=1)  # the byte check
            slots[~hit] = -1
            winners[slots[hit]] = np.maximum(winners[slots[hit]], ids[hit])
            counts[slots[hit]] += n[hit]
        new_ones = slots < 0
        keys = np.concatenate([kept, words[new_ones]]).astype(">u8").tobytes()
        slot = np.concatenate([np.arange(len(kept)), np.full(int(new_ones.sum()), -1)])
        winner = np.concatenate([winners, ids[new_ones]])
        return pa.Table.from_arrays(
            [
                pa.array([keys[i : i + 32] for i in range(0, len(keys), 32)], pa.binary()),
                pa.array(slot, pa.int64(), mask=slot < 0),
                pa.array(winner, pa.int64(), mask=winner == _NONE),
                pa.array(np.concatenate([counts, n[new_ones]]), pa.int64()),
            ],
            schema=schema,
        )

    return (
        _distinct(batch, shards)
        .groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInArrow(find, "digest binary, slot long, winner long, n long")
    )


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """A row for each row of docs and of history with the row that stays of its equal texts.

    doc_id, keep_id, group_size, kept, text_sha256, in_history (its text's digest was in the
    index), slot. history: the documents that the index is built of; none: an empty index.
    """
    rows = digests(docs).withColumn("old", F.lit(False))
    if history is not None:
        rows = rows.unionByName(digests(history).withColumn("old", F.lit(True)))
    return _against_history(rows, shard_keys)


def dedup_table(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """exact_dedup of one table, read once: the older half of the ids is the history, the rest (null
    ids too) the new batch."""
    low, high = docs.select(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(0 if low is None else (low + high) // 2), F.lit(False))
    return _against_history(digests(docs).withColumn("old", old), shard_keys)


def _against_history(rows: DataFrame, shard_keys: int) -> DataFrame:
    """rows: doc_id, digest, old (belongs to the history)."""
    rows = cut(rows)
    shards = max(1, -(-rows.count() // shard_keys))
    index = build_index(rows.where("old").drop("old"), shards)
    groups = merge(rows.where("NOT old").drop("old"), index, shards)
    return (
        rows.drop("old")
        .join(groups, "digest")
        .select(
            "doc_id",
            F.col("winner").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            F.col("slot").isNotNull().alias("in_history"),
            "slot",
        )
    )
