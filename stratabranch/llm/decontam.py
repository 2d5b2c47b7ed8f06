"""Benchmark decontamination with suffix arrays over the training text.

A batch of documents is a shard. Its words are numbered by the benchmark's vocabulary; runs of
known words too short for any window or reported match are set aside, since nothing in them can match. The
suffixes that are left are sorted by prefix doubling, together with the test suffixes, so that blocks of 1,
2, 4, ... words of both have comparable ranks. All test suffixes are binary-searched at once, a block at a
time: a suffix's range in the array narrows block by block, so its longest verbatim match takes as many
searches as the length has binary digits, and the range holds the locations. A document lies in one shard, so
nothing is shuffled; the benchmark is what every shard is searched with, in blocks of a bounded
number of words.

Reported are the windows that occur, and every maximal match of at least SHORTEST words with its place in
the document and in the item; of several items that match as far, the first by id, and of several places in it
the first. A match is maximal if none that begins before it reaches as far.

Words are runs of ASCII letters and digits and of anything beyond ASCII, after lower-casing A-Z.
They are compared by length and two 64-bit hashes. A window is 8 consecutive words of an item; an
item of fewer words, but not none, is one window. Null text has no words; an item without id is
left out; rows of one item_id are windows of one item. An empty benchmark hits nothing; an empty
document table gives no rows. Rows that repeat are judged each by itself. Other columns are
carried along, and clashing names are avoided.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import free_name, over_batches, text_bytes, tune

WINDOW = 8
#: Words of the shortest match that is reported.
SHORTEST = 4
#: Items whose windows occur in a document that is contaminated.
MIN_ITEMS = 2
#: Words of the benchmark that are held by the driver and sent to executors at a time.
BLOCK_WORDS = 500_000
#: Bytes of text in a shard; a longer document is a shard by itself.
SHARD_BYTES = 4_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IN_WORD = np.array([bool(WORD.match(bytes([b]))) for b in range(256)])
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _hash(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """A hash of each word, a byte of all words at a time."""
    out = lengths.astype(np.uint64)
    left = np.arange(len(starts))
    for k in range(int(lengths.max(initial=0))):
        if k:
            left = left[lengths[left] > k]
        out[left] = (out[left] + buffer[starts[left] + k]) * multiplier
    return out ^ (out >> np.uint64(29))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = _IN_WORD[buffer]
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1) - starts


@dataclass
class Block:
    """Test suffixes of some items, in the vocabulary's numbers."""

    keys: np.ndarray  # sorted hashes of the vocabulary
    seconds: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray  # the items' words, each item followed by a -1
    left: np.ndarray  # words up to the item's end, from each position
    window: np.ndarray  # length of the window that starts at a position, or 0
    item: np.ndarray  # index into items
    at: np.ndarray  # position in the item's row
    items: list[str]

    @classmethod
    def build(cls, rows: list[tuple[str, bytes]], width: int) -> Block:
        items = sorted({k for k, _ in rows})
        number = {k: i for i, k in enumerate(items)}
        found = [(number[k], WORD.findall(text.lower())) for k, text in rows]
        vocabulary = sorted({w for _, words in found for w in words})
        buffer = np.frombuffer(b"".join(vocabulary), np.uint8)
        lengths = np.array([len(w) for w in vocabulary], np.int64)
        starts = np.cumsum(lengths) - lengths
        first, second = (_hash(buffer, starts, lengths, m) for m in _MULTIPLIERS)
        order = np.argsort(first)
        number = {vocabulary[k]: i for i, k in enumerate(order)}
        tokens, left, window, item, at = [], [], [], [], []
        for i, words in found:
            n = len(words)
            w = min(width, n)
            tokens += [number[x] for x in words] + [-1]
            left += list(range(n, 0, -1)) + [0]
            window += [w] * (n - w + 1) + [0] * w if n else [0]
            item += [i] * (n + 1)
            at += range(n + 1)
        return cls(first[order], second[order], lengths[order], *(np.array(x, np.int64) for x in (tokens, left, window, item, at)), items)


class SuffixArray:
    """Suffixes of a text of word numbers (-1 ends a run), sorted, beside a test text that is searched in it.

    rank[k] numbers the distinct blocks of 2**k words of both texts in order. Doubling goes on up to the
    given width, and then as long as a block of the test text occurs in the text.
    """

    def __init__(self, text: np.ndarray, test: np.ndarray, left: np.ndarray, width: int):
        self.n, self.left = len(text), left
        both = np.concatenate((text + 2, [0], np.where(test < 0, 1, test + 2)))  # 0 and 1 match nothing
        both[: self.n][text < 0] = 0
        self.rank = [both]
        while True:
            k, r = len(self.rank) - 1, self.rank[-1]
            if 1 << k >= width:
                some = left >= 1 << k
                if not np.isin(r[self.n + 1 :][some], r[: self.n]).any():
                    break
            after = np.zeros_like(r)
            after[: -(1 << k)] = r[1 << k :] if 1 << k < len(r) else 0
            self.rank.append(np.unique(r * (r.max() + 1) + after, return_inverse=True)[1])
        self.order = np.argsort(self.rank[-1][: self.n], kind="stable")

    def narrow(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, k: int, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of ranges of a sorted array of places, which agree with suffixes up to depth, whose next
        2**k words do too. Places and suffixes are of both texts one after the other."""
        rank, end = self.rank[k], len(self.rank[k]) - 1
        block = rank[np.minimum(suffix + depth, end)]

        def search(strict: bool) -> np.ndarray:
            a, b = lo.copy(), hi.copy()
            for _ in range(int((hi - lo).max(initial=0)).bit_length()):
                mid = (a + b) // 2
                open_ = a < b
                here = rank[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, end)]
                right = open_ & ((here <= block) if strict else (here < block))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            return a

        return search(False), search(True)

    def ranges(self, order: np.ndarray, suffix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first words of suffixes occur: ranges of the sorted array, some empty."""
        lo, hi, depth = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order)), np.zeros(len(suffix), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            go = np.flatnonzero((length >> k & 1 == 1) & (lo < hi))
            lo[go], hi[go] = self.narrow(order, lo[go], hi[go], depth[go], k, suffix[go])
            depth[go] += 1 << k
        hi[length >> len(self.rank) > 0] = 0  # longer than anything that occurs
        return lo, np.maximum(lo, hi)

    def longest(self, order: np.ndarray, suffix: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes with a match of at least least words, its length, and its range. left: words up to the
        end of a suffix's run."""
        some = left >= least
        suffix, left = suffix[some], left[some]
        lo, hi = self.ranges(order, suffix, np.full(len(suffix), least))
        some = lo < hi
        suffix, left, lo, hi = suffix[some], left[some], lo[some], hi[some]
        depth = np.full(len(suffix), least)
        for k in range(len(self.rank) - 1, -1, -1):  # what it has over least, from the highest digit on
            go = np.flatnonzero(left >= depth + (1 << k))
            a, b = self.narrow(order, lo[go], hi[go], depth[go], k, suffix[go])
            on = a < b
            go = go[on]
            lo[go], hi[go], depth[go] = a[on], b[on], depth[go] + (1 << k)
        return suffix, depth, lo, hi


class Shard:
    """The documents of a shard, their words, and the array of those that may match."""

    def __init__(self, texts: list[bytes], block: Block, shortest: int):
        self.array = None
        buffer = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        starts, lengths = word_spans(buffer)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate(([0], np.searchsorted(starts, ends)))  # each document's first word
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        if not block.window.any() or not len(starts):
            return
        least = min(shortest, int(block.window[block.window > 0].min()))
        token = np.full(len(starts), -1, np.int64)
        fit = np.flatnonzero(lengths <= block.lengths.max())
        hashes = _hash(buffer, starts[fit], lengths[fit], _MULTIPLIERS[0])
        at = np.minimum(np.searchsorted(block.keys, hashes), len(block.keys) - 1)
        known = (block.keys[at] == hashes) & (block.lengths[at] == lengths[fit])
        token[fit[known]] = at[known]
        # Runs of known words inside a document.
        run_edge = np.concatenate(([True], (token[1:] < 0) | (token[:-1] < 0) | (self.doc[1:] != self.doc[:-1])))
        run = np.cumsum(run_edge) - 1
        kept = np.flatnonzero((np.bincount(run)[run] >= least) & (token >= 0))
        if len(kept):
            sure = _hash(buffer, starts[kept], lengths[kept], _MULTIPLIERS[1]) == block.seconds[token[kept]]
            token[kept[~sure]] = -1
            kept = kept[sure]
        if not len(kept):
            return
        # The shard's text: the runs that are left, each followed by a -1.
        gap = np.flatnonzero(np.diff(kept) != 1) + 1
        gap = np.union1d(gap, np.flatnonzero(np.diff(self.doc[kept])) + 1)
        text = np.insert(token[kept], gap, -1)
        self.place = np.insert(kept, gap, -1)  # of the text's words among the shard's
        self.array = SuffixArray(text, block.tokens, block.left, int(block.window.max()))

    def windows(self, block: Block) -> tuple[np.ndarray, list[set[int]]]:
        """Words that windows cover, and each document's items. Equal windows have one range, and a place is
        in one range of each length."""
        suffix = np.flatnonzero(block.window > 0)
        window = block.window[suffix]
        lo, hi = self.array.ranges(self.array.order, self.array.n + 1 + suffix, window)
        some = lo < hi
        which = np.unique(np.stack([lo[some], hi[some], window[some], block.item[suffix[some]]], axis=1), axis=0)
        distinct, at = np.unique(which[:, :3], axis=0, return_inverse=True)
        of_range = np.split(which[:, 3], np.flatnonzero(np.diff(at)) + 1) if len(which) else []
        cover, held = np.zeros(len(self.doc) + 1, np.int64), [set() for _ in self.n_words]
        for (a, b, w), items in zip(distinct.tolist(), of_range):
            where = self.place[self.array.order[a:b]]
            np.add.at(cover, where, 1)
            np.add.at(cover, where + w, -1)
            for d in np.unique(self.doc[where]).tolist():
                held[d].update(items.tolist())
        return np.flatnonzero(np.cumsum(cover[:-1]) > 0), held

    def matches(self, block: Block, shortest: int) -> list[tuple[int, int, int]]:
        """Maximal matches: word, length, place in the block."""
        array, n = self.array, self.array.n
        real = np.flatnonzero(self.place >= 0)
        edge = np.flatnonzero(np.diff(np.append(self.place, -1)) != 1)  # the last words of runs
        left = edge[np.searchsorted(edge, real)] - real + 1
        # Sorted test suffixes, in which what is left of the text is searched in turn.
        order = n + 1 + np.argsort(array.rank[-1][n + 1 :], kind="stable")
        k = shortest.bit_length() - 1
        some = np.isin(array.rank[k][real], array.rank[k][n + 1 :]) if k < len(array.rank) else np.zeros(len(real), bool)
        suffix, length, lo, hi = array.longest(order, real[some], left[some], shortest)
        if not len(suffix):
            return []
        # Of the test suffixes in a range, the first by item and place.
        wish = np.empty(len(block.tokens), np.int64)
        by = np.lexsort((block.at, block.item))
        wish[by] = np.arange(len(by))
        spans, at = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
        ranked = np.append(wish[order - n - 1], len(by))
        source = by[np.minimum.reduceat(ranked, spans.ravel())[::2][at]]
        word = self.place[suffix]
        before = np.where(np.diff(word, prepend=-2) == 1, np.concatenate(([0], length[:-1])), 0)
        same = np.concatenate(([False], self.doc[word[1:]] == self.doc[word[:-1]]))
        begins = np.flatnonzero(~same | (before <= length))
        return list(zip(word[begins].tolist(), length[begins].tolist(), source[begins].tolist()))


@dataclass
class Found:
    """What a document has of a block of the benchmark. matches: (position, length, item, position in the
    item), in order of position."""

    n_words: int
    hit: np.ndarray
    items: list[str]
    matches: list[tuple[int, int, str, int]]


def search_shard(texts: list[bytes], block: Block, shortest: int = SHORTEST) -> list[Found]:
    shard = Shard(texts, block, shortest)
    out = [Found(n, np.zeros(0, np.int64), [], []) for n in shard.n_words.tolist()]
    if shard.array is None:
        return out
    hit, held = shard.windows(block)
    cuts = np.searchsorted(hit, shard.first)
    for f, a, b, s, items in zip(out, cuts[:-1], cuts[1:], shard.first[:-1], held):
        f.hit, f.items = hit[a:b] - s, [block.items[i] for i in sorted(items)]
    for word, length, q in shard.matches(block, shortest):
        d = shard.doc[word]
        out[d].matches.append((word - int(shard.first[d]), length, block.items[block.item[q]], int(block.at[q])))
    return out


def shards(texts: list[bytes], limit: int = SHARD_BYTES) -> list[list[bytes]]:
    """Consecutive texts, up to limit bytes in each."""
    out, room = [], 0
    for t in texts:
        if not out or len(t) > room:
            out.append([])
            room = limit
        out[-1].append(t)
        room -= len(t)
    return out


def benchmark_blocks(benchmark: DataFrame, words: int = BLOCK_WORDS):
    """Items as (id, text) in lists of a bounded number of words."""
    rows, n = [], 0
    for r in benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), text_bytes()).toLocalIterator():
        text = bytes(r[1] or b"")
        more = len(WORD.findall(text.lower()))
        if rows and n + more > words:
            yield rows
            rows, n = [], 0
        rows.append((r[0], text))
        n += more
    if rows:
        yield rows


def _together(old: dict, new: dict) -> dict:
    """What two blocks of the benchmark found: of matches that begin at one place, the longer; a match within
    another is no maximal one."""
    best: dict[int, dict] = {}
    for m in old["matches"] + new["matches"]:
        have = best.get(m["at"])
        if have is None or (-m["length"], m["item_id"], m["item_at"]) < (-have["length"], have["item_id"], have["item_at"]):
            best[m["at"]] = m
    matches, end = [], 0
    for at in sorted(best):
        if at + best[at]["length"] > end:
            matches.append(best[at])
            end = at + best[at]["length"]
    return new | {"hit": sorted({*old["hit"], *new["hit"]}), "items": sorted({*old["items"], *new["items"]}), "matches": matches}


def search(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shortest: int = SHORTEST) -> tuple[DataFrame, str]:
    """docs with a struct column, whose name is returned: n_words, hit (word positions), items
    (sorted ids), matches (at, length, item_id, item_at)."""
    spark = tune(docs.sparkSession, 500)
    name = free_name(docs, "found")
    kind = "struct<n_words:long,hit:array<int>,items:array<string>,matches:array<struct<at:long,length:long,item_id:string,item_at:long>>>"
    blocks = list(benchmark_blocks(benchmark)) or [[]]
    out = docs.withColumn(name, F.lit(None).cast(kind)).withColumn(free_name(docs, "bytes_"), text_bytes())
    raw = out.columns[-1]
    for rows in blocks:
        shared = spark.sparkContext.broadcast(Block.build(rows, width))

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            block = shared.value
            at = batch.schema.get_field_index(name)
            found = []
            for texts in shards([x or b"" for x in batch.column(batch.schema.get_field_index(raw)).to_pylist()]):
                for f in search_shard(texts, block, shortest):
                    found.append({"n_words": f.n_words, "hit": f.hit.tolist(), "items": f.items, "matches": [dict(zip(("at", "length", "item_id", "item_at"), m)) for m in f.matches]})
            found = [_together(old, new) if old else new for new, old in zip(found, batch.column(at).to_pylist())]
            return batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

        out = over_batches(out, work, out.schema)
    return out.drop(raw), name


def longest(matches):
    """The longest of a document's matches, the first of several; null without any."""
    return F.array_max(F.transform(matches, lambda m: F.struct(m["length"].alias("length"), (-m["at"]).alias("back"), m.alias("m"))))["m"]


def item_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """item_id, item_at, length, places: of each place of an item, its longest verbatim match in any document
    if that has at least shortest words, and in how many places of the documents it stands."""
    spark = tune(docs.sparkSession, 500)
    out = None
    for rows in list(benchmark_blocks(benchmark)) or [[]]:
        shared = spark.sparkContext.broadcast(Block.build(rows, width))

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            block, found = shared.value, []
            for texts in shards([x or b"" for x in batch.column(0).to_pylist()]):
                array = Shard(texts, block, shortest).array
                if array is not None:
                    suffix = np.flatnonzero(block.left > 0)
                    q, length, lo, hi = array.longest(array.order, array.n + 1 + suffix, block.left[suffix], shortest)
                    q = q - array.n - 1
                    found += zip([block.items[i] for i in block.item[q].tolist()], block.at[q].tolist(), length.tolist(), (hi - lo).tolist())
            columns = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["item_id", "item_at", "length", "places"])

        one = over_batches(docs.select(text_bytes()), work, "item_id string, item_at long, length long, places long")
        out = one if out is None else out.unionByName(one)
    by_length = out.groupBy("item_id", "item_at", "length").agg(F.sum("places").alias("places"))
    return by_length.groupBy("item_id", "item_at").agg(F.max("length").alias("length"), F.max_by("places", "length").alias("places"))


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; the longest match (its length, 0 without
    one, and place) and all matches."""
    found, name = search(docs.select("doc_id", "text"), benchmark)
    f = F.col(name)
    n_items = F.size(f["items"]).cast("long")
    top = longest(f["matches"])
    return found.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        F.size(f["hit"]).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
        F.coalesce(top["length"], F.lit(0)).cast("long").alias("longest"),
        top["at"].alias("longest_at"),
        top["item_id"].alias("longest_item"),
        top["item_at"].alias("longest_item_at"),
        f["matches"].alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """docs without those that hold a full window of an item, which is a leak already, or windows of
    min_items items; items of fewer than WINDOW words count only towards these."""
    found, name = search(docs, benchmark)
    f = F.col(name)
    return found.where((F.coalesce(longest(f["matches"])["length"], F.lit(0)) < WINDOW) & (F.size(f["items"]) < min_items)).drop(name)
