import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabranch.llm import quality


def brute(rows, prior):
    """Posteriors and quality of rows (host, path, p) by the definition, one document at a time."""
    n, mean = len(rows), sum(r[2] for r in rows) / len(rows)

    def strength(groups, around):
        top = bottom = 0.0
        for key, ps in groups.items():
            if len(ps) > 1:
                own = sum(ps) / len(ps)
                noise = (sum(p * p for p in ps) / len(ps) - own * own) / (len(ps) - 1)
                top, bottom = top + len(ps) * ((own - around(key)) ** 2 - noise), bottom + len(ps)
        if not bottom:
            return 1e6
        return min(1e6, max(1.0, mean * (1 - mean) / max(top / bottom, 1e-12) - 1))

    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    k_host = strength(hosts, lambda h: mean)
    k_path = strength({k: v for k, v in paths.items() if len(hosts[k[0]]) > len(v)}, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]))
    out = []
    for h, q, p in rows:
        at_host = (k_host * mean + sum(hosts[h]) - p) / (k_host + len(hosts[h]) - 1)
        at_host = min(1 - 1e-6, max(1e-6, at_host))
        at_path = (k_path * at_host + sum(paths[h, q]) - p) / (k_path + len(paths[h, q]) - 1)
        at_path = min(1 - 1e-6, max(1e-6, at_path))
        odds = math.log(p / (1 - p)) - math.log(prior / (1 - prior)) + math.log(at_path / (1 - at_path))
        out.append((at_host, at_path, 1 / (1 + math.exp(-odds))))
    return out


def test_posteriors_match_brute_force_and_change_decisions(spark, sf_dir):
    """Labels with noise make texts doubtful, and sites sorted by the label's kind make theirs tell."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bad = labels.where("quality = 0").select("doc_id").withColumn("bad", F.lit(1))
    sited = docs.join(bad, "doc_id", "left").withColumn("source", F.when(F.col("bad") == 1, F.lit("low")).when(F.col("doc_id") % 3 == 0, F.lit("high")).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 9).cast("string")))).drop("bad")
    noisy = labels.withColumn("quality", F.when(F.xxhash64("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = quality.train(sited, noisy)
    rows = quality.report(sited, noisy).collect()
    want = brute([(r.host, r.path, r.p) for r in rows], model.prior)
    for r, (at_host, at_path, q) in zip(rows, want):
        assert (r.host_posterior, r.path_posterior, r.quality) == pytest.approx((at_host, at_path, q), rel=1e-6)
        assert r.kept == (r.quality >= 0.5)
    assert sum(r.kept != (r.p >= 0.5) for r in rows) > 5  # sites decide where texts are doubtful
    lows = [r.path_posterior for r in rows if r.host == "low"]
    assert max(lows) < min(r.path_posterior for r in rows if r.host == "high")


def test_held_out_labels(spark):
    """Learned from even ids, told on odd ones: of good quality, and toxic ones too."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in quality.report(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == docs.count()
    odd = labels.where("doc_id % 2 = 1").collect()
    good = [got[r.doc_id] for r in odd if r.quality and not r.toxic]
    bad = [got[r.doc_id] for r in odd if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    toxic = [got[r.doc_id] for r in odd if r.toxic and r.doc_id in english]
    assert np.mean(toxic) < 0.1


def test_lexicons_come_from_the_other_half(spark):
    texts = [(True, k % 2 == 0, f"plain words {k} nastyword".encode()) for k in range(20)] + [(False, k % 2 == 0, f"plain words {k}".encode()) for k in range(400)]
    texts += [(True, True, b"onlyhere again")] * 30  # equal texts count once
    found = quality.lexicons(spark.createDataFrame(texts, "toxic boolean, fold boolean, text binary"))
    assert all(b"nastyword" in x and b"nastyw" in x and b"plain" not in x and b"onlyhere" not in x for x in found.values())
    none = quality.lexicons(spark.createDataFrame(texts, "toxic boolean, fold boolean, text binary").where("NOT toxic"))
    assert set(none.values()) == {frozenset()}


def test_many_sites_are_joined_without_broadcast(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    key = lambda rows: sorted((r.doc_id, r.kept, round(r.quality, 9)) for r in rows)
    want = key(quality.report(docs, labels).collect())
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    assert key(quality.report(docs, labels).collect()) == want


def test_sparse_sites_shrink_more(spark):
    rows = [("a", "a/1", p) for p in np.linspace(0.8, 0.99, 40)] + [("b", "b/1", p) for p in np.linspace(0.1, 0.3, 40)] + [("c", "c/1", 0.1), ("c", "c/1", 0.2)]
    table, priors = quality.site_table(spark.createDataFrame([(h, p, float(x)) for h, p, x in rows], "host string, path string, p double"))
    assert {(r.path, r.n) for r in table.collect()} == {("a/1", 40), ("b/1", 40), ("c/1", 2)}
    assert priors["mean"] == pytest.approx(np.mean([x for *_, x in rows])) and 1 <= priors["host"] < 50


EDGES = [(1, None, "s", "en"), (2, "", None, None), (3, "word " * 60_000, "s", "en"), (None, "text", "s", "de"), (3, "again", "s", "en"), (3, "again", "s", "en")]


def test_edges_and_clashing_names(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS p", "2 AS kept", "3 AS host", "4 AS odds", "5 AS h", "6 AS good", "7 AS host_mean", "8 AS n")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (99, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.report(docs, labels).count() == len(EDGES)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = labels.limit(0)
    assert quality.keep_good(docs, none).count() == len(EDGES)
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == len(EDGES)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_sites_of_urls(spark):
    df = spark.createDataFrame([("http://A.example.com/x/y?q",), ("https://b.example.com",), ("not a url",), (None,)], "url string")
    host, path = quality.url_site()
    assert [tuple(r) for r in df.select(host, path).collect()] == [("a.example.com", "a.example.com/x"), ("b.example.com", "b.example.com/"), (None, ""), (None, "")]
