import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq

from stratabranch.llm import line_dedup

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(AZ)


def brute(rows, least=10):
    last = 1 << 70
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(last if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (last if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


ROWS = [
    (5, "shared line of text\nown five of them\n\nshared line of text"),
    (3, "  Shared Line Of Text\x0b\nnine char\nown of three, here"),
    (8, "nine char\nshared line of text\nshared line of text"),
    (None, "shared line of text\nonly without an id"),
    (2, None), (1, ""), (4, "ééééééééé\nüüüüüüüüüü"), (6, "ééééééééé\nüüüüüüüüüü"), (7, "ÜÜÜÜÜÜÜÜÜÜ"),
    (9, "\n".join(["again and again"] * 3000)), (10, "again and again"), (10, "again and again"), (10, "of the same id, again"),
]


def test_edges(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS hi", "2 AS bitmap", "3 AS pos")
    assert got(line_dedup.line_report(frame)) == brute(ROWS)
    assert line_dedup.line_report(frame.limit(0)).count() == 0


def test_a_key_spread_over_many_partitions(spark):
    rows = [(i, f"the line that all have\nline of document {i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert got(line_dedup.line_report(frame)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_come_out_without_the_lines(spark):
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(ROWS[:3], "doc_id long, text string")).collect()}
    assert out == {3: ROWS[1][1], 5: "own five of them\n", 8: "nine char"}


def test_documents(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    assert got(line_dedup.line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == brute(list(zip(t["doc_id"], t["text"])))
