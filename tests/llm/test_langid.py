import math
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from stratabranch.llm import langid, queries


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], cells=4, seed=1)
    for k in ("table", "state", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x = r.integers(0, 257, (9, 5))
    label, weight = np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0, 1.0])

    def loss():
        p = net.probabilities(x)
        w = (x < 256) * weight
        return -(np.log(p[:, label, np.arange(5)]) * w).sum() / w.sum()

    grads = net.gradients(x, label, weight)
    for p, g in zip(net.params(), grads):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for i in [*np.argsort(-np.abs(gf))[:4], *r.integers(0, flat.size, 3)]:
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert gf[i] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4)


def test_pooling_reads_every_byte():
    net = langid.Network.fresh(["a", "b"])
    text = bytes(range(1, 250))
    own = langid.pooled(net, [text])[0]
    parts = [text[i : i + langid.SPAN] for i in range(0, len(text), langid.SPAN)]
    each = [langid.pooled(net, [p])[0] * len(p) for p in parts]
    assert own == pytest.approx(np.sum(each, axis=0) / len(text), rel=1e-4)
    assert own.sum() == pytest.approx(1, rel=1e-5)


def forward(net, text):
    """Mean probabilities by the definition: scalars, a byte and a cell at a time, both ways, in each window."""
    cells, sig = net.bias.shape[1], lambda v: 1 / (1 + math.exp(-v))
    total = [0.0] * len(net.names)
    for at in range(0, len(text), langid.SPAN):
        # The last window is filled up with the sign for no byte, which is read too but not pooled.
        span = [*text[at : at + langid.SPAN]]
        span += [256] * (langid.SPAN - len(span))
        states = []
        for way in (0, 1):
            h, seen = [0.0] * cells, {}
            table, u, b = net.table[way], net.state[way], net.bias[way]
            for t in range(len(span)) if way == 0 else reversed(range(len(span))):
                into = [sum(float(u[g, k]) * h[k] for k in range(cells)) for g in range(3 * cells)]
                r = [sig(table[g, span[t]] + into[g]) for g in range(cells)]
                z = [sig(table[cells + g, span[t]] + into[cells + g]) for g in range(cells)]
                c = [math.tanh(table[2 * cells + g, span[t]] + r[g] * (into[2 * cells + g] + b[g])) for g in range(cells)]
                h = [z[g] * h[g] + (1 - z[g]) * c[g] for g in range(cells)]
                seen[t] = h
            states.append(seen)
        for t, byte in enumerate(span):
            if byte < 256:
                both = states[0][t] + states[1][t]
                e = [math.exp(sum(float(w) * v for w, v in zip(row, both)) + o) for row, o in zip(net.out, net.out_bias)]
                total = [a + x / sum(e) for a, x in zip(total, e)]
    return [a / len(text) for a in total]


def test_forward_pass_matches_a_loop_over_bytes():
    net = langid.Network.fresh(["a", "b", "c"], seed=3)
    net.bias[:] = np.random.default_rng(1).normal(0, 0.5, net.bias.shape)
    texts = [b"x", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. ".encode() * 4, bytes(range(1, 97)), bytes(range(256)) * 2]
    for text, p in zip(texts, langid.pooled(net, texts)):
        assert p == pytest.approx(forward(net, text), abs=2e-5)


def test_memory_is_bounded(monkeypatch):
    """Slices cut texts anywhere without changing what is pooled; a long text is held in slices."""
    net = langid.Network.fresh(["a", "b"], seed=3)
    r = np.random.default_rng(2)
    texts = [r.integers(0, 256, n, np.uint8).tobytes() for n in (1, 96, 97, 5000, 12, 96 * 40)]
    whole = langid.pooled(net, texts)
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 7)
    assert langid.pooled(net, texts) == pytest.approx(whole, rel=1e-4)
    monkeypatch.undo()
    text = b"a" * 20_000_000
    tracemalloc.start()
    slices = sum(len(x) for x, _ in langid.spans_of([text]))
    assert slices == -(-20_000_000 // langid.SPAN) and tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()


def test_windows_tell_what_whole_texts_tell(spark, sf_dir, monkeypatch):
    """Reading 96 bytes at a time from an empty state loses nothing against reading each text through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.train(langid.sample_windows(docs))
    rows = [(r.lang, r.text.encode()[:20_000]) for r in docs.where(langid.held_out()).collect() if r.text]
    right = {}
    for span in (96, 20_000):
        monkeypatch.setattr(langid, "SPAN", span)
        monkeypatch.setattr(langid, "SIDE_BY_SIDE", 64)
        right[span] = np.mean([net.names[int(langid.pooled(net, [t])[0].argmax())] == lang for lang, t in rows])
    assert right[96] > 0.9 and right[96] >= right[20_000] - 0.02


def test_held_out_accuracy(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"]))
    got = queries.op9_langid(spark, sf_dir).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.9


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the word and the other", None), (None, "le mot et la chose", "fr"), (4, "the word " * 20_000, "en"), (5, "日本語", "ja"), (6, "der und die", "de"), (7, "the end of it", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS h")
    net = langid.train(langid.sample_windows(docs), steps=5)
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3}
    assert langid.train([]) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), net).count() == 0
