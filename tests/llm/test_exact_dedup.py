import hashlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from stratabranch.llm import exact_dedup

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(AZ)].append(d)
    out = []
    for d, t in rows:
        g = groups[(t or "").translate(AZ)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").translate(AZ).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


ROWS = [(1, "Same"), (9, "sAME"), (4, "é"), (5, "É"), (2, None), (3, ""), (None, "same"), (None, "no id"), (7, "x" * 200_000), (8, "X" * 200_000), (8, "X" * 200_000), (6, " same")]


def test_history_and_batch_match_brute_force(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'z' AS digest", "1 AS slot", "2 AS winner")
    history, batch = frame.where("doc_id < 5"), frame.where("doc_id >= 5 OR doc_id IS NULL")
    assert got(exact_dedup.exact_dedup(batch, history)) == brute(ROWS)
    assert got(exact_dedup.exact_dedup(frame)) == brute(ROWS)
    assert got(exact_dedup.dedup_table(frame)) == brute(ROWS)
    many = exact_dedup.exact_dedup(batch, history, shard_keys=2)
    assert got(many) == brute(ROWS)


def test_members_are_told_from_nonmembers(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "A"), (11, "c"), (12, "c")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.in_history, r.slot is not None) for r in exact_dedup.exact_dedup(new, old).collect()}
    assert found == {1: (10, True, True), 2: (2, True, True), 10: (10, True, True), 11: (12, False, False), 12: (12, False, False)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup_table(none).count() == 0


def test_documents(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    assert got(exact_dedup.dedup_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == brute(list(zip(t["doc_id"], t["text"])))


def test_hash_is_minimal_and_perfect():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 500, 20_000):
        words = r.integers(0, 2**64, (n, 4), dtype=np.uint64)
        table, slots = exact_dedup.PerfectHash.build(words)
        assert sorted(slots.tolist()) == list(range(n))
        assert (table.slots(words) == slots).all()


def test_keys_that_never_part_are_listed():
    words = np.tile(np.array([[1, 2, 3, 4]], np.uint64), (3, 1))
    words[:, 3] += np.arange(3, dtype=np.uint64)  # the hash doesn't read this word
    table, slots = exact_dedup.PerfectHash.build(words)
    assert sorted(slots.tolist()) == [0, 1, 2] and (table.slots(words) == slots).all()
