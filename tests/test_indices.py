import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabranch import simulate
from stratabranch.functions import fit, stats
from stratabranch.operators import beta, indices, posterior, rates, slicing, trees
from stratabranch.sources import newick, presence


def broom(spark, m):
    """m tips, each alone in its site, under one shared edge of length 1."""
    text = f"(({','.join(f's{i}:1' for i in range(m))}):1);"
    edges = newick.parse_trees(spark.createDataFrame([("t", text)], "tree_id string, newick string"))[0].drop("root_edge")
    present = spark.createDataFrame([(i, f"s{i}") for i in range(m)], "site_id int, species string")
    adj = spark.createDataFrame([(i, j) for i in range(m) for j in range(m)], "focal int, member int")
    return edges, present, adj


@pytest.mark.parametrize("m", [2, 5])
def test_broom(spark, m):
    edges, present, adj = broom(spark, m)
    assert {round(r.pb, 12) for r in beta.totals(edges, present, adj).collect()} == {round(m / (m + 2), 12)}
    assert {round(r.pb, 12) for r in beta.totals(edges, present, adj, domain="paired").collect()} == {0.5}


def edges_of(spark, *texts):
    return newick.parse_trees(spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(texts)], "tree_id string, newick string"))[0].drop("root_edge")


def test_gaps_are_pruned_everywhere(spark):
    """Tips that no site has, and species that no tip is, change nothing: totals, series, rates, profiles,
    sensitivity and bootstrap are those of the trees without them."""
    edges = edges_of(spark, "(((A:1,B:1):1,(C:1,(D:0.5,E:0.5):0.5):1):1,(X:2,Y:2):1);")
    whole = edges_of(spark, "((A:1,B:1):1,(C:1,(D:0.5):0.5):1);")
    rows = [(0, "A"), (0, "B"), (1, "B"), (1, "C"), (2, "C"), (2, "D"), (2, "nobody"), (3, "nothing")]
    gaps = spark.createDataFrame(rows, "site_id int, species string")
    clean = gaps.where("species NOT IN ('nobody', 'nothing')")
    adj = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "focal int, member int")
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop("tree_id", "edge_id", "residuals").collect()), key=str)
    for weighted in (False, True):
        assert plain(beta.totals(edges, gaps, adj, weighted=weighted)) == plain(beta.totals(whole, clean, adj, weighted=weighted))
    assert plain(beta.series(edges, gaps, adj, 4)) == plain(beta.series(whole, clean, adj, 4))
    assert plain(rates.cpb_rate(edges, gaps, adj, 4, weighted=True)) == plain(rates.cpb_rate(whole, clean, adj, 4, weighted=True))
    here = F.col("site_id") < 3
    for run in (rates.cpd_rate, rates.cpe_rate):
        got = run(edges, gaps, 4)
        assert plain(got.where(here)) == plain(run(whole, clean, 4))
        lost = got.where(~here).first()  # a site whose species are on no tree says so
        assert lost.reason == fit.EMPTY and not lost.converged and lost[2] is None
    for index in ("PE", "PB"):
        assert plain(rates.rate_profile(edges, gaps, 4, index, adj).where(here)) == plain(rates.rate_profile(whole, clean, 4, index, adj))
    assert {r.status for r in rates.rate_profile(edges, gaps, 4).where(~here).collect()} == {"empty_site"}
    assert plain(rates.sensitivity(edges, gaps, (3, 6)).where(here)) == plain(rates.sensitivity(whole, clean, (3, 6)))
    assert plain(posterior.bootstrap_sites(edges, clean, 6, n_slices=4)) == plain(posterior.bootstrap_sites(whole, clean, 6, n_slices=4))
    with pytest.raises(ValueError, match="without a species"):
        indices.matched(edges, gaps)
    assert indices.matched(edges, clean).count() == clean.count()


def test_trees_that_are_refused(spark):
    crooked, flat = "((A:1,B:1):1,C:1.5);", "(A:0,B:0);"
    present = spark.createDataFrame([(s, x) for s in range(2) for x in "ABC"], "site_id int, species string")
    edges = edges_of(spark, crooked)
    adj = spark.createDataFrame([(i, j) for i in range(2) for j in range(2)], "focal int, member int")
    for run in (
        lambda **o: rates.cpd_rate(edges, present, 3, **o),
        lambda **o: rates.cpe_rate(edges, present, 3, **o),
        lambda **o: rates.cpb_rate(edges, present, adj, 3, **o),
        lambda **o: rates.rate_profile(edges, present, 3, **o),
        lambda **o: rates.sensitivity(edges, present, (2, 3), **o),
        lambda **o: posterior.bootstrap_sites(edges, present, 2, n_slices=3, **o),
        lambda **o: slicing.rootward(edges, 1.0, **o),
        lambda **o: slicing.tipward(edges, 1.0, **o),
        lambda **o: slicing.interval(edges, 1.5, 0.5, **o),
    ):
        with pytest.raises(ValueError, match="ultrametric"):
            run()
        assert run(allow_non_ultrametric=True).count() > 0
    with pytest.raises(ValueError, match="depth or length"):
        slicing.windows(edges_of(spark, flat), 3, allow_non_ultrametric=True)
    # In a pool a bad draw costs itself; a pool of bad draws only is an error.
    pool = edges_of(spark, "((A:1,B:1):1,C:2);", crooked, flat)
    draws = spark.createDataFrame([(f"t{k}", k) for k in range(3)], "tree_id string, draw int")
    got = posterior.posterior_rate(pool, present, draws, n_slices=4)
    assert {(r.n_trees, r.n_ultrametric_draws) for r in got.collect()} == {(1, 1)}
    assert {(r.n_trees, r.n_ultrametric_draws) for r in posterior.posterior_rate(pool, present, draws, n_slices=4, allow_non_ultrametric=True).collect()} == {(2, 1)}
    with pytest.raises(RuntimeError):
        posterior.posterior_rate(edges_of(spark, flat), present, draws.where("draw = 0"), n_slices=4)


def test_links_with_cycles_end(spark):
    rows = [("tree", 9, 1, 1.0, None), ("tree", 1, 2, 2.0, "a"), ("tree", 1, 3, 0.5, "b"), ("tree", 5, 6, 1.0, None), ("tree", 6, 5, 1.0, None), ("tree", 6, 7, 1.0, "c"), ("ring", 1, 2, 1.0, None), ("ring", 2, 1, 1.0, None), ("self", 4, 4, 1.0, None)]
    links = spark.createDataFrame(rows, "tree_id string, parent int, child int, length double, label string")
    assert {(r.tree_id, r.node, r.depth) for r in trees.node_depths(links).collect()} == {("tree", 9, 0.0), ("tree", 1, 1.0), ("tree", 2, 3.0), ("tree", 3, 1.5)}
    assert {r.node for r in trees.reachable(links).collect()} == {9, 1, 2, 3}
    found = {(r.tree_id, r.problem) for r in trees.problems(links).collect()}
    assert {t for t, p in found if p == "not reachable from a root"} == {"tree", "ring", "self"}
    assert ("ring", "no root") in found and ("tree", "no root") not in found
    assert trees.node_depths(links.limit(0)).count() == 0


def test_solver_finds_the_lowest_valley():
    r = np.random.default_rng(3)
    ages = np.linspace(10, 0.1, 60)
    profiles = r.random((200, 60)) ** 3 * np.exp(r.normal(0, 2.5, (200, 60)))
    for cumulative in (False, True):
        x = np.cumsum(profiles, axis=1) * 0.3 / profiles.sum(axis=1, keepdims=True) if cumulative else profiles
        out = fit.solve(x, ages, cumulative=cumulative)
        c = x if cumulative else np.cumsum(x, axis=1) / x.sum(axis=1, keepdims=True)
        scan = np.exp(np.linspace(np.log(1e-6), np.log(50), 20_001))
        least = np.min([((c - np.exp(-q * ages)) ** 2).sum(axis=1) for q in scan], axis=0)
        mine = ((c - np.exp(-out.rate.to_numpy(float)[:, None] * ages)) ** 2).sum(axis=1)
        assert (mine <= least * (1 + 1e-9)).all()
        assert (out.converged | out.at_lower_bound | out.at_upper_bound).all()
        assert out.r_squared.to_numpy(float) == pytest.approx(1 - mine / ((c - c.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))
    one = fit.solve(profiles[:1], ages, nodes=5).iloc[0]
    assert one.n_iter > 0 and 1e-6 <= one.start_used <= 50


def test_against_path_sets(spark):
    """PD and PE of sites, and Sorensen of pairs, from sets of edges."""
    text = simulate.yule(9, seed=3)
    tree = newick.parse(text)
    edges = newick.parse_trees(spark.createDataFrame([("t", text)], "tree_id string, newick string"))[0].drop("root_edge")
    r = np.random.default_rng(1)
    sites = {s: [x for x in tree.labels if r.random() < 0.5] or tree.labels[:1] for s in range(4)}
    present = spark.createDataFrame([(s, x) for s, xs in sites.items() for x in xs], "site_id int, species string")
    rows = tree.rows()
    own = {s: {k for k, *_, lo, hi, _, _ in ((x[0], *x[1:6], x[6], x[7], x[8], x[9]) for x in rows) if any(lo <= tree.labels.index(t) < hi for t in xs)} for s, xs in sites.items()}
    length = {x[0]: x[3] for x in rows}
    n = {k: sum(k in o for o in own.values()) for k in length}
    got = {x.site_id: (x.pd, x.pe) for x in indices.totals(edges, present).collect()}
    for s, o in own.items():
        assert got[s] == (pytest.approx(sum(length[k] for k in o)), pytest.approx(sum(length[k] / n[k] for k in o)))
    adj = spark.createDataFrame([(f, m) for f, m in [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)]], "focal int, member int")
    found = {x.focal: (x.pb, x.status) for x in beta.totals(edges, present, adj, approach="pairwise").collect()}
    size = lambda ks: sum(length[k] for k in ks)
    assert found[0][0] == pytest.approx(size(own[0] ^ own[1]) / (size(own[0]) + size(own[1])))
    assert found[1] == (None, "fewer_than_two_sites")
    whole = rates.site_profiles(edges, present, 5).groupBy("site_id").sum("pd").collect()
    assert {x[0]: pytest.approx(x[1]) for x in whole} == {s: got[s][0] for s in sites}
    w = slicing.windows(edges, 5)
    c = slicing.contribution(edges, w)
    for component in beta.COMPONENTS:
        rows_ = [x for x in beta.per_slice(edges, present, adj, c, w, component).collect() if x.status == "ok"]
        for f in {x.focal for x in rows_}:
            assert sum(x.value for x in rows_ if x.focal == f) == pytest.approx(1)
            if component == "sorensen":
                assert {x.normalisation for x in rows_ if x.focal == f} == {"full_tree"}


def test_alignment(spark):
    edges = newick.parse_trees(spark.createDataFrame([("t", "((A:1,B:1):1,(C:1,D:1):1);"), ("u", "(X:1,Y:1);")], "tree_id string, newick string"))[0].drop("root_edge")
    present = spark.createDataFrame([(1, "A"), (1, "B"), (2, "Z")], "site_id int, species string")
    pruned, kept, report = indices.align(edges, present)
    assert {r.label for r in pruned.where("is_tip").collect()} == {"A", "B"} and kept.count() == 2
    assert {(r.tree_id, r.action): r.n for r in report.collect()} == {("t", "pruned_tips"): 2, ("t", "dropped_species"): 1, ("t", "shared"): 2, ("t", "rejected"): 0, ("u", "pruned_tips"): 2, ("u", "dropped_species"): 3, ("u", "shared"): 0, ("u", "rejected"): 1}
    assert {(r.tree_id, r.missing, r.extra) for r in indices.unmatched(edges, present).collect()} == {("t", 2, 1), ("u", 2, 3)}


def test_solver():
    ages = np.linspace(1, 0.02, 50)
    for rate in (0.5, 3.0, 20.0):
        curve = np.exp(-rate * ages)
        r = fit.solve(curve[None, :], ages, cumulative=True).iloc[0]
        assert r.rate == pytest.approx(rate, rel=1e-6) and r.converged and r.reason == ""
    late = np.r_[np.zeros(49), 1.0]
    out = fit.solve(np.array([np.zeros(50), late, np.full(50, np.nan), np.r_[1.0, np.zeros(49)]]), ages, bounds=(1e-6, 5.0))
    assert list(out.reason[[0, 2]]) == [fit.EMPTY, fit.NOT_FINITE]
    assert out.at_upper_bound[1] and out.at_lower_bound[3] and not out.converged.any() and out.rate[3] == pytest.approx(1e-6)
    assert fit.solve(np.ones((1, 1)), np.ones(1)).reason[0] == fit.TOO_SHORT
    assert fit.bounds_for(np.array([2.0]), "auto") == (5e-7, 25.0)


def test_stats(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 2.0, 10.0]), (2, []), (3, [5.0]), (4, [float(i % 4) for i in range(40)])], "k int, x array<double>")
    got = {r.k: (r.h, r.e) for r in df.select("k", stats.hdi(df.x, 0.75).alias("h"), stats.ess_proxy(df.x).alias("e")).collect()}
    assert tuple(got[1][0]) == (1.0, 3.0) and got[2] == (None, 0.0) and tuple(got[3][0]) == (5.0, 5.0) and got[1][1] == 4.0
    assert got[4][1] == 40.0  # the first autocorrelation is under 0.05


def test_pool_and_bootstrap(spark):
    pool = simulate.tree_pool(spark, 4, 8)
    edges, rejects = newick.parse_trees(pool)
    assert rejects.count() == 0
    present, _ = simulate.communities(spark, [f"sp_{i + 1}" for i in range(8)], 3, "clustered")
    assert present.select("species").distinct().count() == 8
    out = posterior.posterior_rate(edges.drop("root_edge"), present, pool.select("tree_id", "draw"), n_slices=8).collect()
    assert {r.n_trees for r in out} == {4} and all(r.hdi_low <= r.rate_median <= r.hdi_high for r in out)
    one = edges.where("tree_id = 'tree_0'").drop("root_edge")
    rows = rates.site_profiles(one, present, 8)
    sites = rows.select("site_id").distinct()
    at = spark.createDataFrame([(r.site_id, i) for i, r in enumerate(sorted(sites.collect()))], "site_id string, site_pos long")
    boot = posterior.bootstrap(rows.join(at, "site_id"), posterior.seeded_draws(sites, 5))
    assert boot.count() == 5 and boot.where("rate > 0").count() == 5
    for text in (simulate.birth_death(12, seed=2), simulate.yule(12, age=3.0)):
        tree = newick.parse(text)
        tips = [x[5] for x in tree.rows() if x[8]]
        assert len(tips) == 12 and max(tips) - min(tips) < 1e-9 * max(tips)


def test_presence_forms(spark, tmp_path):
    wide = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, -1.0)], "site string, x double, y double")
    assert {tuple(r) for r in presence.from_wide(wide).collect()} == {("a", "x"), ("b", "x")}
    back = presence.to_wide(presence.from_wide(wide), ["x", "y"])
    assert {tuple(r) for r in back.collect()} == {("a", 1, 0), ("b", 1, 0)}
    (tmp_path / "adj.csv").write_text('"",s1,s2\na,1,0\nb,1,1\n')
    assert {tuple(r) for r in presence.read_adjacency(spark, str(tmp_path / "adj.csv")).collect()} == {(0, 0), (1, 0), (1, 1)}


def test_dataset(spark):
    d = simulate.grid_dataset(spark, trees=2, tips=10, side=3)
    assert d["trees"].count() == 2 and d["bounds"].count() == d["coords"].count() == 9
    assert d["adj"].where("focal = 4").count() == 9 and d["presence"].select("species").distinct().count() == 10


def test_pool_plans_send_no_edges_through_the_driver(spark, monkeypatch):
    """A pool of which plans think little, as of few rows of which each makes many."""
    n = 100_000
    few = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    name = F.concat(F.lit("x"), F.col("i").cast("string"))
    pool = few.select(F.lit("t").alias("tree_id"), name.alias("edge_id"), F.lit("root").alias("parent"), name.alias("child"), F.lit(1.0).alias("length"), F.lit(0.0).alias("b"), F.lit(1.0).alias("d"), F.col("i").cast("long").alias("tip_lo"), (F.col("i") + 1).cast("long").alias("tip_hi"), F.lit(True).alias("is_tip"), name.alias("label"))
    present = spark.range(n).select(F.lit(1).alias("site_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("species"))
    plans = []

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(indices, "settle", settle)
    pruned = indices.align(pool, present)[0]
    assert "SortMergeJoin [label" in plans[0] and "BroadcastHashJoin [label" not in plans[0]
    assert pruned.count() == n


def test_membership_is_the_closure(spark):
    """Also where tips hang from nodes of one child, and rows of presence repeat."""
    ladder = "(" * 20 + "x0:1" + "".join(f",x{k}:{k}):1" for k in range(1, 21)) + ";"
    texts = [simulate.yule(30, seed=1), ladder, "((((a:1,b:1):1):1,c:3):1);", "((a:1):1,(b:0,e:1,f:1):2,((c:1,d:1):0):1);"]
    edges = newick.parse_trees(spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "tree_id string, newick string"))[0]
    labels = edges.where("is_tip").select(F.col("label").alias("species")).distinct()
    present = labels.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("site_id"), "species").where("pmod(xxhash64(site_id, species), 3) = 0 OR site_id = 3")
    want = trees.closure(edges).join(present.withColumnRenamed("species", "label"), "label").select("tree_id", "site_id", "edge_id").distinct()
    keyed = edges.where("is_tip").select("tree_id", F.col("label").alias("species")).join(present, "species")
    for given in (present.union(present), keyed):
        got = indices.membership(edges, given)
        assert got.count() == want.count() == got.intersect(want).count()


def test_a_pool_goes_once_through_its_joins(spark, monkeypatch):
    """Only tips' numbers meet species, and of the tips of a node, one is enough to tell which edges are above."""
    text = "((" + ",".join(f"a{k}:1" for k in range(40)) + "):1,(" + ",".join(f"b{k}:1" for k in range(40)) + ",(d:0.5,e:0.5):0.5):1,c:2);"
    pool = newick.parse_trees(spark.createDataFrame([("t", text), ("u", text)], "tree_id string, newick string"))[0].localCheckpoint()
    present = pool.where("tree_id = 't' AND is_tip AND label NOT IN ('a0', 'e')").select(F.pmod("tip_lo", F.lit(3)).alias("site_id"), F.col("label").alias("species")).localCheckpoint()
    settled, walked = [], []
    settle, heavy_paths = indices.settle, trees.heavy_paths
    monkeypatch.setattr(indices, "settle", lambda df: settled.append(df.columns) or settle(df))
    monkeypatch.setattr(trees, "heavy_paths", lambda e, **k: walked.append(e) or heavy_paths(e, **k))
    pruned = indices.align(pool, present)[0]
    assert settled[0] == ["tree_id", "tip_lo"]
    assert pruned.where("is_tip").count() == 2 * 81
    got = indices.membership(pruned, present)
    assert walked[0].count() == 2 * (3 + 4)  # inner edges, and nodes that have tips
    want = trees.closure(pruned).join(present.withColumnRenamed("species", "label"), "label").select("tree_id", "site_id", "edge_id").distinct()
    assert got.count() == want.count() == got.intersect(want).count()
