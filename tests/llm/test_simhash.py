import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from stratabranch.llm import graph, simhash


def brute(rows):
    """doc_id -> (fingerprint, component) straight from the definition."""
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def got(spark, rows, schema="doc_id long, text string"):
    out = simhash.report(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r[0], r[1], r[2]) for r in out), key=str)


def test_matches_brute_force_on_documents(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (2, ""), (9, " \t\n"), (7, "one"), (8, "ONE"), (3, "two words"), (None, "one"), (None, "alone here now and then"), (4, "é ß " * 2000), (4, "é ß " * 2000), (4, "other text of the same id")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_links_of_close_codes(spark):
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 40, dtype=np.int64)
    codes = np.unique(np.concatenate([base, *(base ^ (1 << r.integers(0, 62, 40)) ^ (1 << r.integers(0, 62, 40)) for _ in range(30))]))
    frame = spark.createDataFrame([(int(x),) for x in codes], "fp long")
    far = np.bitwise_count((codes[:, None] ^ codes[None, :]).view(np.uint64))
    label = np.arange(len(codes))
    while True:
        new = np.where(far <= 2, label[None, :], len(codes)).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = {int(c): int(codes[label == k].min()) for c, k in zip(codes, label)}
    for node in (simhash.NODE, 8):  # 8: nearly every node is factored again
        found = {r.v: r.root for r in graph.components(simhash.links(frame, node=node)).collect()}
        assert {c: found.get(c, c) for c in want} == want


def test_chain_and_hub_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    out = {r.v: r.root for r in graph.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


@pytest.mark.parametrize("repeat", [1, 2])
def test_one_of_each_group_stays(spark, repeat):
    rows = [(1, "a b c d", "x"), (2, "A B C D", "y"), (3, "quite another text", "z"), (None, "a b c d", "w"), (None, "nobody has this id", "v")] * repeat
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, keep_id string"))
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a b c d"), (3, "quite another text"), (None, "nobody has this id")]


def test_repeated_ids_keep_one_row_of_each_component(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    # 1 names two components and repeats in one; 3 names its own and is a copy in that of 2.
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (4, text(2)), (2, text(3)), (3, text(3)), (3, text(4)), (5, text(5)), (None, text(6)), (None, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp")
    got = simhash.drop_near_duplicates(docs)
    want = [(1, text(1)), (1, text(2)), (2, text(3)), (3, text(4)), (5, text(5)), (None, text(6))]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
