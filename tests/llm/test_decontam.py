import hashlib
import random
import re
import time

import pyarrow.parquet as pq

from stratabranch.llm import decontam, queries

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(docs, items):
    windows = {}
    for k, text in items:
        w = words(text)
        if k is not None and w:
            n = min(8, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    found |= x
                    hit |= {*range(i, i + n)}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def matches(docs, items, shortest=4):
    """Per row of docs, its maximal matches by comparing every place with every place."""
    rows = [(str(k), words(t)) for k, t in items if k is not None]
    out = []
    for d, text in docs:
        w, best = words(text), {}
        for p in range(len(w)):
            for k, x in rows:
                for q in range(len(x)):
                    n = 0
                    while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                        n += 1
                    if n >= shortest and (-n, k, q) < best.get(p, (0,)):
                        best[p] = (-n, k, q)
        out.append((d, [(p, -n, k, q) for p, (n, k, q) in sorted(best.items()) if p - 1 not in best or -best[p - 1][0] <= -n]))
    return sorted(out, key=str)


def got_matches(df):
    return sorted(((r.doc_id, [tuple(m) for m in r.matches]) for r in df.collect()), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_random_words_match_brute_force(spark):
    r = random.Random(5)
    some = lambda n: " ".join(r.choice(["a", "b", "É", "c1", "zz"]) for _ in range(n))
    items = [(i, some(r.randint(0, 14))) for i in range(25)] + [(3, some(12)), (None, some(9)), (40, None), (41, "?!")]
    docs = [(i, some(r.randint(0, 80))) for i in range(60)] + [(70, None), (71, ""), (None, items[1][1]), (72, "x " * 30_000 + (items[4][1] or ""))]
    docs += [docs[0], docs[0]]
    d, b = frames(spark, docs, items)
    assert got(decontam.report(d, b)) == brute(docs, items)
    small = [x for x in docs if x[0] != 72]
    assert got_matches(decontam.report(d.where("doc_id IS NULL OR doc_id <> 72"), b)) == matches(small, items)


def test_longest_match_of_every_test_suffix(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(n))
    items, docs = [(i, some(12)) for i in range(6)], [(i, some(30)) for i in range(20)] + [(9, None)]
    want = {}
    for k, text in items:
        x = words(text)
        for q in range(len(x)):
            n = [max((m for m in range(len(x) - q + 1) if w[p : p + m] == x[q : q + m]), default=0) for w in (words(t) for _, t in docs) for p in range(len(w))]
            if max(n) >= 4:
                want[str(k), q] = (max(n), n.count(max(n)))
    d, b = frames(spark, docs, items)
    got = {(x.item_id, x.item_at): (x.length, x.places) for x in decontam.item_matches(d.repartition(5), b).collect()}
    assert got == want


def test_blocks_of_the_benchmark_agree_with_the_whole(spark, monkeypatch):
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(12)]
    docs = [(1, " ".join(f"w{j}" for j in range(25))), (2, "w3 w4 w5"), (3, "W5 w6 w7 w8 w9 w10 w11 w12!")]
    d, b = frames(spark, docs, items)
    whole = got(decontam.report(d, b))
    assert whole == brute(docs, items)
    one = decontam.benchmark_blocks
    monkeypatch.setattr(decontam, "benchmark_blocks", lambda x: one(x, words=25))
    assert got(decontam.report(d, b)) == whole and got_matches(decontam.report(d, b)) == matches(docs, items)


def test_matches_shorter_than_a_window_and_very_long_ones():
    """Of any length, in time that grows with the item and not with its square."""
    block = decontam.Block.build([("1", b"one two three four five six seven eight nine ten"), ("2", b"four five six seven eight other words at all")], 8)
    (f,) = decontam.search_shard([b"x two three four five six seven eight y four five six seven"], block)
    assert f.matches == [(1, 7, "1", 1), (9, 4, "1", 3)] and not f.items and not len(f.hit)
    (f,) = decontam.search_shard([b"two three four"], block, shortest=2)
    assert f.matches == [(0, 3, "1", 1)]
    for n in (1000, 50_000):
        book = " ".join(f"w{k}" for k in range(n)).encode()
        began = time.process_time()
        (f,) = decontam.search_shard([b"before " + book + b" after"], decontam.Block.build([("9", book)], 8))
        assert f.matches == [(1, n, "9", 0)] and len(f.hit) == n
        assert time.process_time() - began < 10
    (f,) = decontam.search_shard([b"a " * 20_000], decontam.Block.build([("1", b"a " * 900)], 8))
    assert len(f.hit) == 20_000 and f.matches[0] == (0, 900, "1", 0)


def test_longest_match_and_removal(spark):
    d, b = frames(spark, [(1, "x y one two three four five six seven eight nine z"), (2, "one two three")], [(7, "zero one two three four five six seven eight nine ten")])
    r = {x.doc_id: x for x in decontam.report(d, b).collect()}
    assert (r[1].longest, r[1].longest_at, r[1].longest_item) == (9, 2, "7")
    out = decontam.decontaminate(d.selectExpr("*", "1 AS found"), b)
    assert out.columns == ["doc_id", "text", "found"] and [x.doc_id for x in out.collect()] == [2]


def test_short_items_count_only_towards_two(spark):
    full = "one two three four five six seven eight"
    docs = [(1, "the clean one"), (2, f"the {full}"), (3, full), (4, "the clean and whole one"), (5, "nothing of it"), (6, "two three four five six seven eight")]
    d, b = frames(spark, docs, [(1, "The"), (2, full + " nine"), (3, "clean and whole"), (1, "of it")])
    assert sorted(r.doc_id for r in decontam.decontaminate(d, b).collect()) == [1, 5, 6]


def test_empty_tables(spark):
    d, b = frames(spark, [], [(1, "a b")])
    assert decontam.report(d, b).count() == 0
    d, b = frames(spark, [(1, "a b")], [])
    assert got(decontam.report(d, b)) == brute([(1, "a b")], [])


def test_documents(spark, sf_dir):
    docs, items = (pq.read_table(f"{sf_dir}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    found = decontam.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert got(found) == brute(list(zip(docs["doc_id"], docs["text"])), list(zip(items["item_id"], items["text"])))


def test_the_query_agrees_with_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.op3_decontam(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op3_decontam']})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)
