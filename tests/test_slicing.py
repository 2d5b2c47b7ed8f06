import pytest
from pyspark.sql import functions as F

from stratabranch import compat, simulate
from stratabranch.operators import slicing, trees
from stratabranch.sources import newick

CATERPILLAR = "(A:4,(B:3,(C:2,(D:1,E:1):1):1):1);"
BUSHY = "(((A:2,B:2):1,C:3,D:3,E:3):1,(F:4,G:4):0);"


def edges(spark, *texts):
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "tree_id string, newick string")
    return newick.parse_trees(frame)[0].drop("root_edge").cache()


def pd(df, *keys):
    keys = keys or ("tree_id",)
    return {tuple(r[k] for k in keys): pytest.approx(r.pd) for r in trees.slice_pd(df, keys).collect()}


def test_slices_make_the_whole(spark):
    e = edges(spark, CATERPILLAR, BUSHY)
    w = slicing.windows(e, 7)
    c = slicing.contribution(e, w).groupBy("tree_id", "edge_id").agg(F.sum("c").alias("c")).join(e, ["tree_id", "edge_id"])
    assert c.where("abs(c - length) > 1e-9").count() == 0 and c.count() == e.where("length > 0").count()
    assert pd(slicing.slices(e, slicing.windows(e, 4, criterion="pd")), "tree_id", "j") == {(t, j): x / 4 for t, x in (("0", 14), ("1", 23)) for j in range(4)}


def test_sides_of_a_cut(spark):
    e = edges(spark, CATERPILLAR)
    assert pd(slicing.rootward(e, 1.0)) == {("0",): 5} and pd(slicing.tipward(e, 1.0)) == {("0",): 9}
    assert pd(slicing.rootward(e, 9.0, "pd")) == {("0",): 5} and pd(slicing.tipward(e, 9.0, "pd")) == {("0",): 9}
    assert pd(slicing.rootward(e, 0.0)) == {("0",): 0} and pd(slicing.rootward(e, 4.0)) == {("0",): 14}
    assert pd(slicing.interval(e, 3.0, 1.0)) == {("0",): 7}
    assert pd(slicing.interval(e, 3.0, 1.0, invert=True), "side") == {("older",): 2, ("younger",): 5}
    younger, older = compat.squeeze_int(e, 3.0, 1.0, invert=True)
    assert pd(younger) == {("0",): 5} and pd(older) == {("0",): 2}
    with pytest.raises(ValueError):
        slicing.interval(e, 1.0, 3.0)
    with pytest.raises(Exception, match="outside"):
        slicing.rootward(e, 9.0).collect()


@pytest.mark.parametrize("total, width, n", [(1.0, 1 / 7.3, 7), (1.0, 1 / 7.8, 8), (1.0, 1 / 7.5, 8), (10.0, 10.0, 1), (10.0, 9.0, 2)])
def test_widths(total, width, n):
    assert slicing.pieces(total, width)[0] == n


def test_curve_counts_every_branch(spark):
    rows = {r.depth: (r.active, r.pd_hi) for r in slicing.pd_curve(edges(spark, BUSHY)).collect()}
    assert rows == {0.0: (3, 3.0), 1.0: (6, 9.0), 2.0: (7, 23.0)}


def test_prune_and_collapse(spark):
    e = edges(spark, CATERPILLAR)
    keep = spark.createDataFrame([("0", "D"), ("0", "C")], "tree_id string, label string")
    out = {(r.label, r.b, r.d, r.tip_lo, r.tip_hi) for r in trees.prune(e, keep).collect()}
    assert out == {("C", 0.0, 2.0, 0, 1), (None, 0.0, 1.0, 1, 2), ("D", 1.0, 2.0, 1, 2)}
    one = spark.createDataFrame([("0", "D")], "tree_id string, label string")
    assert trees.prune(e, one).count() == 0
    flat = trees.collapse(slicing.rootward(e, 1.0))
    assert {r.parent for r in flat.where("label IN ('C', 'D', 'E')").collect()} == {5} or flat.where("label = 'D'").first().parent == flat.where("label = 'A'").first().parent
    assert {r.label for r in slicing.prune_tips(e, threshold=3.0).where("is_tip").collect()} == {"A", "B"}
    assert {r.label for r in compat.prune_tips(e, 2.0, method=2).where("is_tip").collect()} == {"D", "E"}


def test_depths_summary_and_problems(spark):
    e = edges(spark, CATERPILLAR, "(A:1,B:2);")
    depth = {(r.tree_id, r.node): r.depth for r in trees.node_depths(e.select("tree_id", "parent", "child", "length")).collect()}
    assert all(depth[r.tree_id, r.child] == r.d for r in e.collect())
    assert [r.ultrametric for r in trees.summary(e).orderBy("tree_id").collect()] == [True, False]
    links = spark.createDataFrame([("x", 1, 2, 1.0, "a"), ("x", 2, 1, 1.0, None), ("y", 0, 1, float("nan"), "a"), ("y", 0, 2, -1.0, "a")], "tree_id string, parent long, child long, length double, label string")
    found = {(r.tree_id, r.problem) for r in trees.problems(links).collect()}
    assert found >= {("x", "no root"), ("y", "length not finite"), ("y", "negative length"), ("y", "labels not unique")}


def test_curve_in_bands(spark, monkeypatch):
    """The same curve in one band and in many, and as a sweep over all borders has it."""
    text = simulate.birth_death(40, seed=5)
    tree = newick.parse(text)
    edges = newick.parse_trees(spark.createDataFrame([("t", text)], "tree_id string, newick string"))[0]
    rows = tree.rows()
    got = {}
    for bands in (1, 7, 256):
        monkeypatch.setattr(slicing, "BANDS", bands)
        got[bands] = sorted((r.depth, r.next_depth, r.active, r.pd_hi) for r in slicing.pd_curve(edges).collect())
    for bands in (7, 256):
        assert len(got[bands]) == len(got[1])
        for a, b in zip(got[bands], got[1]):
            assert a == pytest.approx(b, rel=1e-9)
    for depth, nxt, active, pd_hi in got[256]:
        middle = (depth + nxt) / 2
        if nxt - depth < 1e-9:  # tips whose depths were rounded differently in the text
            continue
        assert active == sum(x[4] <= middle < x[5] for x in rows)
        assert pd_hi == pytest.approx(sum(max(0, min(nxt, x[5]) - x[4]) for x in rows))
    total = sum(x[3] for x in rows)
    cuts = slicing.windows(edges, 6, criterion="pd").orderBy("j").collect()
    assert [sum(max(0, min(x[5], w.hi) - max(x[4], w.lo)) for x in rows) for w in cuts] == pytest.approx([total / 6] * 6)


def test_heavy_paths_are_the_closure(spark):
    ladder = "(" * 40 + "x0:1" + "".join(f",x{k}:{k}):1" for k in range(1, 41)) + ";"
    texts = [simulate.yule(30, seed=1), simulate.birth_death(25, seed=2), ladder, "((((a:1,b:1):1):1,c:3):1);", "((a:1):1,(b:0):2,((c:1,d:1):0):1);"]
    edges = newick.parse_trees(spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "tree_id string, newick string"))[0]
    paths, below = trees.heavy_paths(edges)
    p, b = paths.alias("p"), below.alias("b")
    got = b.join(p, F.expr("b.tree_id = p.tree_id AND b.path <=> p.path AND p.size >= b.reach")).select("b.tree_id", "b.tip", "b.label", "p.edge_id")
    want = trees.closure(edges)
    assert got.count() == want.count() == want.intersect(got).count()
    most = below.groupBy("tree_id", "tip").count().groupBy("tree_id").agg(F.max("count").alias("n")).collect()
    assert {r.tree_id: r.n for r in most}["2"] <= 3  # of a ladder's tips, none is below many paths


def test_pruning_in_stretches(spark, monkeypatch):
    edges = newick.parse_trees(spark.createDataFrame([("t", simulate.yule(50, seed=3)), ("u", "((A:1,B:1):1,C:2);")], "tree_id string, newick string"))[0]
    keep = edges.where("is_tip AND (tip_lo % 3 = 1 OR tree_id = 'u')").select("tree_id", "label")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    want = plain(trees.prune(edges, keep))
    for size in (1, 4, 7):
        monkeypatch.setattr(trees, "STRETCH", size)
        assert plain(trees.prune(edges, keep)) == want
