"""SimHash near-dedup with a Gray-order hierarchical index.

Upper nodes of the index are masked bit patterns: 64 bits are cut into four blocks, and each of
the six masks of two blocks factors the fingerprints that share its pattern into a node. Two
fingerprints that differ in at most two bits agree on two blocks, so they meet in a node. Nodes
with very many fingerprints are factored again by the same rule over the bits that are left, and
what remains there is bounded by 2^16. Inside a node, fingerprints are sorted by Gray rank and
groups of neighbours are factored into nodes of their own: the bits that all of a group share,
and their pattern. Two groups are compared by the shared bits in which their patterns differ; the
differences accumulate down the levels and whole groups are pruned once there are more than two.

Links join fingerprints, not documents: copies have one fingerprint. A task hands on a spanning
forest of the links that it finds, which has the same components, and these are found by hooking.

Null text has no words: its fingerprint is zero, linked like any other. A null doc_id gets the
component of its fingerprint and doesn't name one; a component of null ids only has a null name.
Rows that repeat are rows of one component. No rows in, no rows out. Other columns are kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import cut, free_name, over_batches, text_bytes, tune
from stratabranch.llm.graph import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 17
#: Fingerprints beyond which a node is factored again.
NODE = 4_096
#: Children of a group inside a node.
FAN = 8
_BLOCKS = 4


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle; of the whole sequence if there are fewer words, of nothing if none."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    one = xxhash.xxh64_intdigest
    return [one(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes."""
    out = np.zeros(len(texts), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def bits(hashes: np.ndarray) -> np.ndarray:
        return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            n = np.array([len(h) for _, h in held])
            sums = np.add.reduceat(bits(np.concatenate([h for _, h in held])), np.cumsum(n) - n, axis=0, dtype=np.int32)
            out[[k for k, _ in held]] = ((2 * sums > n[:, None]) * powers).sum(axis=1, dtype=np.uint64)
            held.clear()

    room = CHUNK
    for k, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), np.uint64)
        if len(hashes) > CHUNK:
            sums = sum(bits(hashes[i : i + CHUNK]).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), CHUNK))
            out[k] = ((2 * sums > len(hashes)) * powers).sum(dtype=np.uint64)
        elif len(hashes):
            if len(hashes) > room:
                flush()
                room = CHUNK
            held.append((k, hashes))
            room -= len(hashes)
    flush()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) of every row."""
    tune(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints_of([x or b"" for x in batch.column(1).to_pylist()]).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return over_batches(rows, work, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _masks(bits: list[int]) -> list[int]:
    """Masks of two of four blocks of the given bits."""
    blocks = [sum(1 << b for b in bits[i::_BLOCKS]) for i in range(_BLOCKS)]
    return [a | b for a, b in combinations(blocks, 2)]


MASKS = _masks(list(range(64)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_in_nodes(node: np.ndarray, codes: np.ndarray, most: int = DISTANCE) -> np.ndarray:
    """Pairs (indexes) of codes of one node that differ in at most most bits, each pair once.

    All nodes of a task are searched together, level by level: a level has groups of FAN groups of
    the level below, with the bits that they share beyond those shared above and their pattern.
    """
    order = np.lexsort((gray_rank(codes), node))
    node, x = node[order], codes[order]
    full = ~np.uint64(0)
    # Levels from the codes up: (first child, end, shared mask, pattern).
    level = [(np.arange(len(x)), np.arange(1, len(x) + 1), np.full(len(x), full), x, node)]
    while len(level[-1][0]) > len(np.unique(level[-1][4])):
        mask, pattern, own = level[-1][2:]
        edge = np.concatenate(([True], own[1:] != own[:-1]))
        first = np.flatnonzero(edge)
        place = np.arange(len(own)) - first[np.cumsum(edge) - 1]
        starts = np.flatnonzero(place % FAN == 0)
        ends = np.append(starts[1:], len(own))
        ones = np.bitwise_and.reduceat(mask & pattern, starts)
        zeros = np.bitwise_and.reduceat(mask & ~pattern, starts)
        level.append((starts, ends, ones | zeros, ones, own[starts]))
    level.reverse()
    a = b = np.arange(len(level[0][0]))
    above = np.zeros(len(a), np.uint64)  # bits compared so far, and their differences
    apart = np.zeros(len(a), np.int64)
    for top, below in zip(level, level[1:]):
        start, end = top[0], top[1]
        na, nb = end[a] - start[a], end[b] - start[b]
        which = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        ca, cb = start[a][which] + k // nb[which], start[b][which] + k % nb[which]
        go = ca <= cb
        which, ca, cb = which[go], ca[go], cb[go]
        both = below[2][ca] & below[2][cb]
        apart = apart[which] + np.bitwise_count((below[3][ca] ^ below[3][cb]) & both & ~above[which])
        go = apart <= most
        a, b, above, apart = ca[go], cb[go], both[go], apart[go]
    pairs = a < b
    return np.stack([order[a[pairs]], order[b[pairs]]], axis=1)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of pairs of labels, as (larger, smaller) rows: each label and its root."""
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    labels, flat = np.unique(pairs, return_inverse=True)
    ab = flat.reshape(-1, 2)
    root = np.arange(len(labels))
    while True:
        ra, rb = root[ab[:, 0]], root[ab[:, 1]]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    some = np.flatnonzero(root != np.arange(len(labels)))
    return np.stack([labels[some], labels[root[some]]], axis=1)


def links(codes: DataFrame, node: int = NODE) -> DataFrame:
    """a, b: links between distinct fingerprints (codes: fp), as forests that tasks hand on."""

    def keys(masks: list[int], lead) -> list:
        return [F.struct(F.lit(i).alias("m"), lead.bitwiseAND(F.lit(_signed(m))).alias("p")) for i, m in enumerate(masks)]

    first = cut(codes.select("fp", F.explode(F.array(*keys(MASKS, F.col("fp")))).alias("k")).select("fp", F.col("k.m").alias("m"), F.col("k.p").alias("p")))
    crowded = first.groupBy("m", "p").agg(F.count("*").alias("n")).where(F.col("n") > node).select("m", "p")
    marked = first.join(crowded.withColumn("many", F.lit(True)), ["m", "p"], "left")
    plain = marked.where("many IS NULL").select("fp", "m", "p")
    # The bits that a node's mask leaves are cut into four blocks again.
    again = F.lit(None)
    for i, mask in enumerate(MASKS):
        inner = _masks([b for b in range(64) if not mask >> b & 1])
        again = F.when(F.col("m") == i, F.array(*(F.struct(F.lit(6 + 6 * i + j).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask | x))).alias("p")) for j, x in enumerate(inner)))).otherwise(again)
    deeper = marked.where("many").select("fp", F.explode(again).alias("k")).select("fp", F.col("k.m").alias("m"), F.col("k.p").alias("p"))
    rows = plain.unionByName(deeper)

    def find(parts):
        """Nodes of a task, as many at a time as a batch holds; the rows of a node are together."""
        tail = None
        for part in parts:
            part = pa.Table.from_batches([part])
            if tail is not None:
                part = pa.concat_tables([tail, part])
            m, p = part.column("m").to_numpy(), part.column("p").to_numpy()
            edges = np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1])) + 1
            last = int(edges[-1]) if len(edges) else 0
            if last:
                yield from solve(part.slice(0, last))
            tail = part.slice(last)
        if tail is not None and tail.num_rows:
            yield from solve(tail)

    def solve(part: pa.Table):
        m, p, fp = (part.column(c).to_numpy() for c in ("m", "p", "fp"))
        own = np.cumsum(np.concatenate(([False], (m[1:] != m[:-1]) | (p[1:] != p[:-1]))))
        size = np.bincount(own)[own]
        some = size > 1
        found = links_in_nodes(own[some], fp[some].view(np.uint64))
        forest = _forest(fp[some][found])
        if len(forest):
            yield pa.RecordBatch.from_arrays([pa.array(forest[:, 0]), pa.array(forest[:, 1])], ["a", "b"])

    dealt = rows.repartition("m", "p").sortWithinPartitions("m", "p")
    return dealt.mapInArrow(find, "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint), component_id of every row."""
    rows = cut(fingerprints(docs))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut(components(links(least.select("fp"))))
    named = least.join(roots, least["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = cut(named.join(names, "root").select("fp", "root", "component_id"))
    return rows.join(by_code, "fp").select("doc_id", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    return near_dedup(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_codes(rows: DataFrame, code: str) -> DataFrame:
    """rows with a last column of their fingerprints."""
    rows = rows.withColumn(code, F.lit(None).cast("long"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        return batch.set_column(batch.num_columns - 1, code, pa.array(fingerprints_of([x or b"" for x in texts]).view(np.int64)))

    return over_batches(rows, work, rows.schema)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: a row of the doc_id that names it, with the smallest
    fingerprint in the component where that doc_id repeats; without any doc_id, a row with the
    smallest fingerprint."""
    found = cut(near_dedup(docs))
    code, keep, repeats = (free_name(docs, c) for c in ("fp", "keep_id", "repeats"))
    names = F.max(F.col("doc_id") == F.col("component_id")).alias("names")
    named = found.groupBy(F.col("doc_id").alias(keep)).agg((F.count("*") > 1).alias(repeats), names).where("names").drop("names")
    kept = docs.join(named.hint("shuffle_hash"), docs["doc_id"] == F.col(keep)).drop(keep)
    out = kept.where(~F.col(repeats)).drop(repeats)
    if named.where(repeats).limit(1).count():
        survivors = found.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias(code)).select("doc_id", code)
        own = _with_codes(kept.where(repeats).drop(repeats), code)
        out = out.unionByName(own.join(survivors, ["doc_id", code], "left_semi").dropDuplicates(["doc_id", code]).select(*docs.columns))
    nameless = found.where("component_id IS NULL").groupBy("root").agg(F.min("fp").alias(code)).select(code)
    if nameless.limit(1).count():
        own = _with_codes(docs.where("doc_id IS NULL"), code)
        out = out.unionByName(own.join(nameless, code, "left_semi").dropDuplicates([code]).drop(code))
    return out
