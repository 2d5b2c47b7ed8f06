import gzip
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from stratabranch.llm import warc

ROWS = [(1, "http://a", "<p>x"), (2, None, None), (None, "u", "é"), (3, "u", "y" * 100_000), (3, "u", "other"), (3, "u", "other"), (4, "v", "z")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS file", "2 AS digest", "3 AS node")


def test_records_parse_back(spark):
    found = warc.records(pages(spark))
    order = warc.leaves(found).collect()
    blob = {}
    by = {}
    for r in found.collect():
        by.setdefault(r.page_id, []).append(bytes(r.record))
    for r in sorted(order, key=lambda r: (r.file, r.node)):
        body = next(x for x in by[r.page_id] if hashlib.sha256(x).hexdigest() == r.digest)
        assert len(blob.setdefault(r.file, b"")) == r.begin
        blob[r.file] += body
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in blob.items()], "file int, content binary")
    back = warc.read_records(files)
    assert sorted(((r.page_id, r.url, r.html) for r in back.collect()), key=str) == sorted(((a, b or "", c or "") for a, b, c in ROWS), key=str)
    assert {(r.file, r.offset) for r in back.collect()} == {(str(r.file), r.begin) for r in order}
    assert {hashlib.sha256(r.record).hexdigest() for r in back.collect()} == {r.digest for r in order}


def foreign(n=40):
    """Records as others write them: urns, cases, folded lines, an HTTP head, types of several kinds."""
    out = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"]
    for k in range(1, n):
        body = f"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>{k}\r\n\r\n{'é' * (k * 700)}".encode()
        out.append(b"WARC/1.1\r\nwarc-type:response\r\nWarc-Record-Id: <urn:uuid:%d>\r\nWARC-TARGET-URI: http://h/\r\n  %d\r\ncontent-length:   %d\r\nContent-Type: application/http; msgtype=response\r\n\r\n" % (k, k, len(body)) + body + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_files(spark, tmp_path, packed):
    parts = [gzip.compress(x) for x in foreign()] if packed else foreign()
    data, at = b"".join(parts), list(itertools.accumulate(map(len, parts), initial=0))
    got = list(warc.parse(data))
    assert [r.raw for r in got] == foreign() and [r.offset for r in got] == at[:-1] and [r.length for r in got] == list(map(len, parts))
    assert got[3].headers["warc-target-uri"] == "http://h/ 3" and got[3].payload == f"<p>3\r\n\r\n{'é' * 2100}".encode()
    (tmp_path / "a.warc").write_bytes(data)
    rows = warc.read_paths(spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string")).collect()
    assert [(r.offset, r.record_id, r.type) for r in rows] == [(a, f"<urn:uuid:{k}>", "response" if k else "warcinfo") for k, a in enumerate(at[:-1])]
    # Records of any id are audited by it.
    found = warc.read_paths(spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string")).where("type = 'response'")
    bad = found.where("record_id <> '<urn:uuid:7>'").withColumn("record", F.when(F.col("record_id") == "<urn:uuid:12>", F.lit(b"x")).otherwise(F.col("record")))
    status = {r.record_id: r.status for r in warc.audit(warc.leaves(found, "record_id"), warc.leaves(bad, "record_id"), 4, "record_id").collect() if r.status != "moved"}
    assert status == {"<urn:uuid:7>": "missing", "<urn:uuid:12>": "corrupt"}
    for cut in (at[5] + 30, at[-1] - 200):
        with pytest.raises(ValueError, match="offset"):
            list(warc.parse(data[:cut]))


def test_broken_files():
    for data in (b"nothing", b"WARC/1.0\r\nContent-Length: x\r\n\r\n", b"WARC/1.0\r\nA: b\r\n\r\n", b"HTTP/1.1 200\r\n\r\n", gzip.compress(foreign()[0]) + b"junk"):
        with pytest.raises(ValueError, match="offset"):
            list(warc.parse(data))
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"\r\n\r\n")) == []


def test_only_differing_branches_are_descended(spark):
    """Two damaged records in 2,700: a few nodes of every level are compared, not all."""
    found = warc.records(many(spark, 2700), file_records=1000)
    bad = found.withColumn("record", F.when(F.col("page_id").isin(5, 1600), F.overlay("record", F.lit(b"#"), F.lit(3), F.lit(1))).otherwise(F.col("record")))
    levels = [(a.count(), b.count()) for a, b in warc.descend(warc.leaves(found), warc.leaves(bad), fan=8)]
    files = found.select("file").distinct().count()
    assert levels[0][0] == files and levels[-1][1] == 2
    assert all(compared <= 2 * 8 for compared, _ in levels[1:]) and all(differ <= 2 for _, differ in levels)


def many(spark, n=700):
    return spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))


def test_damage_is_found(spark):
    found = warc.records(many(spark), file_records=300)
    bad = found.withColumn("record", F.when(F.col("page_id") == 17, F.lit(b"broken")).otherwise(F.col("record")))
    left = warc.leaves(found)
    got = {(r.page_id, r.status) for r in warc.audit(left, warc.leaves(bad), fan=4).collect()}
    assert (17, "corrupt") in got and {s for _, s in got} <= {"corrupt", "moved"}
    flipped = found.withColumn("record", F.when(F.col("page_id").isin(5, 600), F.overlay("record", F.lit(b"#"), F.lit(3), F.lit(1))).otherwise(F.col("record")))
    assert {(r.page_id, r.status) for r in warc.audit(left, warc.leaves(flipped), fan=4).collect()} == {(5, "corrupt"), (600, "corrupt")}
    gone = warc.audit(left, warc.leaves(found.where("page_id <> 44"))).collect()
    assert [(r.page_id, r.status) for r in gone if r.status != "moved"] == [(44, "missing")]
    extra = warc.audit(warc.leaves(found.where("page_id <> 44")), left).collect()
    assert [(r.page_id, r.status) for r in extra if r.status != "moved"] == [(44, "extra")]
    assert warc.audit(left, left).count() == 0


def test_report_matches_a_direct_comparison(spark, monkeypatch):
    monkeypatch.setattr(warc, "MISSING", (97, 5))
    p = many(spark)
    original = warc.records(p)
    replica = {r.page_id: bytes(r.record) for r in warc.damaged(original).collect()}
    first = {r.page_id: bytes(r.record) for r in original.collect()}
    got = {r.page_id: r.status for r in warc.report(p).collect()}
    assert len(got) == 700
    for k, s in got.items():
        assert (s == "missing") == (k not in replica)
        assert (s == "corrupt") == (k in replica and replica[k] != first[k])


def test_edges(spark):
    assert warc.report(pages(spark)).count() == len(ROWS)
    assert warc.report(pages(spark).limit(0)).count() == 0
