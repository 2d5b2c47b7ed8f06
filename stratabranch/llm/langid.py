"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of 96 bytes in both directions, each from an empty state (read whole, texts get the
same languages: the tests hold one against the other), labels every position with probabilities
of the languages, and a document's probabilities are the mean over all its positions. It is
trained in numpy by backpropagation through time on windows from a bounded sample of labelled
documents; prediction covers every byte of every text. The sample, the order of training and the
first weights are fixed by hashes and a seed, so reruns agree.

A document with null text or without a letter is `und` with score 0; so is every document where
nothing can be learned. A null doc_id counts as not held out but is never learned from. Repeated
rows are predicted each. Other columns aren't read. No rows in, no rows out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import over_batches, text_bytes, tune

#: Documents learned from (those with the smallest hashes), windows of each, and of all.
TRAIN_DOCS = 4_000
WINDOWS = 8
TRAIN_WINDOWS = 8_000
#: Bytes of a window, and cells of each direction.
SPAN = 96
CELLS = 6
STEPS = 400
BATCH = 96
RATE = 0.01
SEED = 20
#: Windows that are read at a time.
SIDE_BY_SIDE = 1_024
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Network:
    """Gates are stacked as reset, update, candidate. table: what a byte adds to the gates of the
    two directions; state: recurrent weights; out: weights of the labels."""

    table: np.ndarray  # 2, 3 * cells, 257 (256: no byte)
    state: np.ndarray  # 2, 3 * cells, cells
    bias: np.ndarray  # 2, cells: of the candidate's recurrent part
    out: np.ndarray  # labels, 2 * cells
    out_bias: np.ndarray  # labels
    names: list[str]

    @classmethod
    def fresh(cls, names: list[str], cells: int = CELLS, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.4, 2, 3 * cells, 257), draw(cells**-0.5, 2, 3 * cells, cells), np.zeros((2, cells), np.float32), draw(0.3, len(names), 2 * cells), np.zeros(len(names), np.float32), names)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.state, self.bias, self.out, self.out_bias]

    def read(self, x: np.ndarray, way: int, keep: bool = False):
        """States after each position of windows x (positions, windows), along one direction."""
        n, cells = x.shape, self.bias.shape[1]
        h = np.zeros((cells, n[1]), np.float32)
        out = np.empty((n[0], cells, n[1]), np.float32)
        steps = []
        half = np.repeat(np.float32([0.5, 0.5, 1]), cells)[:, None]  # a logistic gate is a tanh of half
        table, u, b = self.table[way] * half, self.state[way] * half, self.bias[way][:, None]
        gates = np.empty((3 * cells, n[1]), np.float32)
        for t in range(n[0]) if way == 0 else range(n[0] - 1, -1, -1):
            if keep:
                gates = np.empty_like(gates)
            np.take(table, x[t], axis=1, out=gates, mode="clip")
            g = u @ h
            rz = gates[: 2 * cells]
            rz += g[: 2 * cells]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            r, z = rz[:cells], rz[cells:]
            c = g[2 * cells :]
            c += b
            before = c.copy() if keep else None
            c *= r
            c += gates[2 * cells :]
            np.tanh(c, out=c)
            new = np.subtract(h, c, out=out[t])
            new *= z
            new += c
            if keep:
                steps.append((t, h, r, z, c, before))
            h = new
        return (out, steps) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each label at each position: (positions, labels, windows)."""
        both = np.concatenate([self.read(x, 0), self.read(x, 1)], axis=1)
        p = np.matmul(self.out, both)
        p += self.out_bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean cross-entropy over positions that hold a byte."""
        cells = self.bias.shape[1]
        read = [self.read(x, way, keep=True) for way in (0, 1)]
        both = np.concatenate([r[0] for r in read], axis=1)
        p = np.matmul(self.out, both) + self.out_bias[:, None]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(x.shape[1])] -= 1
        p *= ((x < 256) * weight / max(1e-9, ((x < 256) * weight).sum()))[:, None, :]
        g_out, g_bias = np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))
        into = np.matmul(self.out.T, p)
        grads = [np.zeros_like(a) for a in (self.table, self.state, self.bias)]
        for way in (0, 1):
            u = self.state[way]
            flow = np.zeros((cells, x.shape[1]), np.float32)
            for t, h, r, z, c, before in reversed(read[way][1]):
                d = into[t, way * cells : (way + 1) * cells] + flow
                dc = d * (1 - z) * (1 - c * c)
                dz = d * (h - c) * z * (1 - z)
                dr = dc * before * r * (1 - r)
                inner = np.concatenate([dr, dz, dc * r])  # into the recurrent part
                flow = d * z + u.T @ inner
                grads[1][way] += inner @ h.T
                grads[2][way] += inner[2 * cells :].sum(axis=1)
                np.add.at(grads[0][way].T, x[t], np.concatenate([dr, dz, dc]).T)
        return [*grads, g_out, g_bias]


def train(windows: list[tuple[bytes, str]], steps: int = STEPS, seed: int = SEED) -> Network | None:
    """None if there is nothing to learn from. Languages weigh the same in the loss."""
    names = sorted({y for _, y in windows})
    if not names:
        return None
    net = Network.fresh(names)
    x = np.full((SPAN, len(windows)), 256, np.int64)
    for k, (text, _) in enumerate(windows):
        x[: len(text), k] = np.frombuffer(text[:SPAN], np.uint8)
    label = np.array([names.index(y) for _, y in windows])
    share = len(windows) / (len(names) * np.bincount(label, minlength=len(names)))
    mean, square, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    r = np.random.default_rng(seed)
    while step < steps:
        order = r.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            step += 1
            if step > steps:
                break
            grads = net.gradients(x[:, some], label[some], share[label[some]].astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - step / (steps + 1))
            for p, g, m, s in zip(net.params(), grads, mean, square):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def sample_windows(docs: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """Windows of the documents with the smallest hashes, from anywhere in their texts."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = known.select("doc_id", order.alias("h")).distinct().orderBy("h", "doc_id").limit(most).select("doc_id")

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not has_letter(text):
                continue
            for k in range(WINDOWS):
                at = zlib.crc32(b"%d %d" % (doc, k)) % max(1, len(text) - SPAN + 1)
                rows.append((zlib.crc32(b"%d:%d" % (k, doc)), doc, k, lang, text[at : at + SPAN]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()))], ["h", "doc", "k", "lang", "part"])

    rows = known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", text_bytes().alias("text"))
    parts = over_batches(rows, cut_out, "h long, doc long, k int, lang string, part binary")
    return [(bytes(r.part), r.lang) for r in parts.orderBy("h", "doc", "k", "lang", "part").limit(TRAIN_WINDOWS).collect()]


def spans_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of texts, SIDE_BY_SIDE at a time, and the index of each one's text. A window that a text
    ends in is filled up with 256."""
    parts, owners, held = [], [], 0
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        at, n = 0, -(-len(data) // SPAN)
        while at < n:
            take = min(n - at, SIDE_BY_SIDE - held)
            part = np.full(take * SPAN, 256, np.intp)
            piece = data[at * SPAN : (at + take) * SPAN]
            part[: len(piece)] = piece
            parts.append(part.reshape(-1, SPAN))
            owners.append(np.full(take, k))
            at, held = at + take, held + take
            if held == SIDE_BY_SIDE:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, held = [], [], 0
    if held:
        yield np.concatenate(parts), np.concatenate(owners)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text (not empty) over all its bytes; a slice of windows is held at a time."""
    sums = np.zeros((len(texts), len(net.names)))
    for x, owner in spans_of(texts):
        p = net.probabilities(x.T)
        p *= (x.T < 256)[:, None, :]
        np.add.at(sums, owner, p.sum(axis=0).T)
    return sums / np.array([len(t) for t in texts])[:, None]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = tune(docs.sparkSession, 500)
    shared = spark.sparkContext.broadcast(net)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        texts = batch.column(2).to_pylist()
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [k for k, t in enumerate(texts) if model and t and has_letter(t)]
        while at:
            some, size = [], 0
            while at and (not some or size + len(texts[at[-1]]) <= 4_000_000):
                some.append(at.pop())
                size += len(texts[some[-1]])
            for k, p in zip(some, pooled(model, [texts[k] for k in some])):
                names[k], scores[k] = model.names[int(p.argmax())], float(min(1.0, p.max()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("text"))
    return over_batches(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
