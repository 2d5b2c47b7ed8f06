import pytest

from stratabranch.sources import adapters, newick
from stratabranch.sources.newick import TreeError, parse, render, split_records

BALANCED = "((A:1,B:1):1,(C:1,D:1):1);"
CATERPILLAR = "(A:4,(B:3,(C:2,(D:1,E:1):1):1):1);"


def test_rows_of_hand_trees():
    rows = parse(BALANCED).rows()
    assert [(r[4], r[5], r[6], r[7], r[9]) for r in rows] == [(0, 1, 0, 2, None), (1, 2, 0, 1, "A"), (1, 2, 1, 2, "B"), (0, 1, 2, 4, None), (1, 2, 2, 3, "C"), (1, 2, 3, 4, "D")]
    assert sum(r[3] for r in parse(CATERPILLAR).rows()) == 14
    assert max(r[5] for r in parse(CATERPILLAR).rows()) == 4


@pytest.mark.parametrize("text", [BALANCED, CATERPILLAR, "('it''s':1,(x:2,y z:0)inner:1):0.5;".replace("y z", "'y z'"), "(a,b,c);", "((a:1e-3,b:2E2):0,c:1);"])
def test_round_trip(text):
    one = parse(text)
    two = parse(render(one))
    assert (one.labels, one.rows(), one.root_edge) == (two.labels, two.rows(), two.root_edge)


@pytest.mark.parametrize("text", ["(A:1,B:1)", "(A,A);", "(A);", "(A:1,B:-1);", "((A,B);", "(A,B));", "(A:x,B);", "A;", "(A,B);x", "('a,B);", "(A:inf,B:1);", ";", "(A,B),C;", "((A,B)(C,D));"])
def test_malformed(text):
    with pytest.raises(TreeError):
        parse(text)


def test_comments_labels_and_records():
    assert parse("[one](A[two]:1,'[kept]':2)[;]r;").labels == ["A", "[kept]"]
    assert parse("(:1,:1);").labels == ["tip_1", "tip_2"] and parse("(:1,:1);", "t").labels == ["t1", "t2"]
    assert newick.strip_comments("(a[b,c);") == "(a[b,c);"
    assert split_records("(A,B);[;]('x;y',C); ;\n(D,E)") == ["(A,B);", "[;]('x;y',C);", "(D,E);"]
    with pytest.raises(TreeError):
        split_records("('open,B);")


def test_nexus():
    text = newick.render_nexus([BALANCED, CATERPILLAR])
    assert newick.nexus_trees(text) == [("tree_1", BALANCED), ("tree_2", CATERPILLAR)]
    assert newick.nexus_trees("#NEXUS\nBegin trees;\n tree x = [&R]\n (A,\n B);\nend;") == [("x", "(A, B);")]
    with pytest.raises(TreeError):
        newick.nexus_trees("#NEXUS\n")


def test_ten_thousand_tips_deep():
    n = 10_000
    tree = parse("(" * n + "A:1" + "".join(f",t{i}:1):1" for i in range(n))[:-2] + ";")
    assert len(tree.labels) == n + 1 and len(parse(render(tree)).labels) == n + 1


def test_a_bad_draw_costs_itself(spark):
    texts = spark.createDataFrame([("a", BALANCED), ("b", "(A,A);"), ("c", None)], "tree_id string, newick string")
    edges, rejects = newick.parse_trees(texts)
    assert {r.tree_id for r in edges.collect()} == {"a"} and {r.tree_id for r in rejects.collect()} == {"b", "c"}


def test_pool_and_source_read_files(spark, tmp_path):
    (tmp_path / "b.tre").write_text(CATERPILLAR + "\n" + BALANCED)
    (tmp_path / "a.nex").write_text(newick.render_nexus([BALANCED]))
    (tmp_path / "skip.txt").write_text("nothing")
    pool = newick.read_pool(spark, str(tmp_path)).orderBy("draw").collect()
    assert [r.newick for r in pool] == [BALANCED, CATERPILLAR, BALANCED] and [r.draw for r in pool] == [0, 1, 2]
    newick.register(spark)
    assert spark.read.format("newick").load(str(tmp_path / "b.tre")).count() == 8 + 6


class Node:
    """Quacks like the nodes of two libraries."""

    def __init__(self, name=None, branch_length=None, clades=()):
        self.name = self.label = name
        self.taxon, self.branch_length, self.clades = None, branch_length, list(clades)
        self.edge = type("Edge", (), {"length": branch_length})
        self.root = self.seed_node = self

    def child_nodes(self):
        return self.clades


def test_adapters():
    tree = Node(clades=[Node(branch_length=1, clades=[Node("A", 1), Node(None, 2.5)]), Node("C", 3)])
    assert adapters.from_biopython(tree) == adapters.from_dendropy(tree) == "((A:1,tip_2:2.5):1,C:3);"


def test_equal_trees(spark):
    frame = lambda *t: newick.parse_trees(spark.createDataFrame(list(t), "tree_id string, newick string"))[0]
    a, b = frame(("x", BALANCED), ("y", CATERPILLAR)), frame(("x", BALANCED), ("y", BALANCED), ("z", BALANCED))
    assert {r.tree_id: r.equal for r in newick.equal_trees(a, b).collect()} == {"x": True, "y": False, "z": False}


def test_one_tree_and_files(spark, tmp_path):
    (tmp_path / "a.tre").write_text("(A:1,B:1); (C:1,D:1);")
    assert [r.label for r in newick.read_newick(spark, str(tmp_path / "a.tre")).where("is_tip").orderBy("edge_id").collect()] == ["A", "B"]
    assert newick.read_newick(spark, "((x:1,y:1):1,z:2);").where("is_tip").count() == 3
    for bad, error in ((str(tmp_path / "none.tre"), FileNotFoundError), ("#NEXUS (a,b);", newick.TreeError), ("(a,a);", newick.TreeError)):
        with pytest.raises(error):
            newick.read_newick(spark, bad)
    texts = spark.createDataFrame([("t 1", "('it''s':1,B:1);", "x"), ("t2", "(A:1,B:2);", "x"), ("t3", "(A:3,B:4);", "y")], "tree_id string, newick string, g string")
    found = {r.g: newick.nexus_trees(r.nexus) for r in newick.nexus(texts, ("g",)).collect()}
    assert found == {"x": [("t 1", "('it''s':1,B:1);"), ("t2", "(A:1,B:2);")], "y": [("t3", "(A:3,B:4);")]}
    folder = str(tmp_path / "out")
    assert newick.write_newick(texts.where("g = 'y'").drop("g"), folder) == 1
    with pytest.raises(FileExistsError):
        newick.write_newick(texts.drop("g"), folder)
    assert open(f"{folder}/t3.tre").read() == "(A:3,B:4);\n"


def test_a_bad_tree_costs_itself(spark, tmp_path):
    (tmp_path / "a.tre").write_text("(A:1,B:1);\n(A:1,A:1);\n(C:1,D:2);")
    spark.dataSource.register(newick.NewickSource)
    rows = spark.read.format("newick").load(str(tmp_path)).collect()
    assert {r.label for r in rows} == set("ABCD") and {r.tree_id[-1] for r in rows} == {"0", "2"}
    with pytest.raises(Exception, match="not unique"):
        spark.read.format("newick").option("mode", "failfast").load(str(tmp_path)).collect()


def test_pool_numbers_follow_files(spark, tmp_path):
    (tmp_path / "b.tre").write_text("(A:1,B:1);")
    (tmp_path / "a.nex").write_text("#NEXUS\nBEGIN TREES;\nTREE x = (A:1,B:1);\nTREE y = (A:2,B:2);\nEND;\n")
    (tmp_path / "c.tre").write_text("(A:3,B:3);(A:4,B:4);")
    found = newick.read_pool(spark, str(tmp_path)).orderBy("draw").collect()
    assert [(r.draw, r.tree_id.rsplit("/", 1)[1]) for r in found] == [(0, "a.nex#0"), (1, "a.nex#1"), (2, "b.tre#0"), (3, "c.tre#0"), (4, "c.tre#1")]
