import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabranch.llm import mixing, queries


def targets(sizes):
    """source -> target by repeated sharing: (source, size) in code point order, null last."""
    weight = dict(zip(sizes, [3, 1, 2] * len(sizes)))
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def multiplier(sizes, target, most=2):
    """The dual of one source by bisection over all of its documents."""
    z = np.array(sizes) / np.mean([*sizes])
    lo, hi = -60 / z[z > 0].min(), 60 / z[z > 0].min()
    for _ in range(300):
        m = (lo + hi) / 2
        got = (np.array(sizes) * np.minimum(most, np.exp(np.minimum(m * z, 60)))).sum()
        lo, hi = (m, hi) if got < target else (lo, m)
    return m


def test_copies_follow_the_tilt(spark):
    """Multipliers are those of a dense dual, rates are the tilted ones, and copies are their rounding."""
    r = np.random.default_rng(2)
    rows = [(i, "w " * int(np.exp(r.uniform(0, 5))), s) for i, s in enumerate(r.choice(list("abcdef"), 4000, p=[0.25, 0.25, 0.2, 0.15, 0.1, 0.05]).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(docs).collect()
    by = {}
    for x in got:
        by.setdefault(x.source, []).append(x)
    hist = docs.select("source", mixing.words().alias("size")).groupBy("source", "size").agg(F.count("*").alias("n"))
    sids = {s: k for k, s in enumerate(sorted(by))}
    known = spark.createDataFrame([(s, sids[s], float(np.mean([x.size for x in by[s]])), sum(x.size for x in by[s]), by[s][0].target) for s in by], "source string, sid int, mean double, source_size long, target double")
    solved = {x.sid: x.multiplier for x in mixing.solve(hist.join(known, "source").withColumn("z", F.col("size") / F.col("mean"))).collect()}
    tilted = 0
    for s, own in by.items():
        sizes = [x.size for x in own]
        if own[0].target > 1.999 * sum(sizes):
            assert all(x.copies == 2 for x in own)
            continue
        tilted += 1
        m = multiplier(sizes, own[0].target)
        assert solved[sids[s]] == pytest.approx(m, rel=1e-5, abs=1e-6)
        owed = taken = 0.0
        for size in sorted(set(sizes), reverse=True):  # running totals by size stay within one document
            same = [x for x in own if x.size == size]
            owed += len(same) * size * min(2, np.exp(m * size / np.mean(sizes)))
            taken += sum(x.taken for x in same)
            assert abs(owed - taken) <= max(sizes)
            assert max(x.copies for x in same) - min(x.copies for x in same) <= 1
        assert abs(sum(x.taken for x in own) - own[0].target) <= 1 + min(sizes)
    assert tilted >= 2


def test_unsolved_sources_are_errors(spark):
    hist = spark.createDataFrame([(0, k + 1, 3, (k + 1) / 2.0, 18, 20.0) for k in range(3)], "sid int, size long, n long, z double, source_size long, target double")
    with pytest.raises(RuntimeError):
        mixing.solve(hist, steps=1)
    assert mixing.solve(hist).count() == 1


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op6_mixing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(dict(sorted(sizes.items())))
    for s, total in sizes.items():
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {total}
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= max(min(r.size for r in own if r.size), 0.03 * want[s])
    assert sorted(rows) == sorted(queries.op6_mixing(spark, sf_dir).collect())


def test_a_large_plan_is_not_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(mixing.report(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.report(docs).collect()) == want


def test_edges(spark):
    rows = [(i, "w " * (i % 7 + 1), "b") for i in range(60)] + [(100 + i, "one two", None) for i in range(9)] + [(200, None, "a"), (201, "", "a"), (202, "word " * 50_000, "long"), (None, "x y", "b"), (3, "w w w w", "b"), (3, "w w w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size_", "2 AS copies", "3 AS target")
    got = mixing.report(docs).withColumnsRenamed({"size": "n", "target": "t"}).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.n for r in x) for s, x in sorted(by.items(), key=lambda kv: (kv[0] is None, kv[0] or ""))}
    want = targets(sizes)
    for s, x in by.items():
        assert x[0].t == pytest.approx(want[s], abs=1e-6)
    assert sum(r.taken for r in by["b"]) == pytest.approx(want["b"], abs=8)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
