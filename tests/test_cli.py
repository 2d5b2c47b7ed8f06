import json

import pytest

from stratabranch import cli, simulate
from stratabranch.operators import trees
from stratabranch.sources import manifest, newick
from stratabranch.streaming import pool


def files(tmp_path, n=8):
    tree = tmp_path / "in.tre"
    tree.write_text(simulate.yule(n, seed=1))
    mat = tmp_path / "mat.csv"
    rows = [[int((i * j + i) % 3 == 0 or j == i) for j in range(n)] for i in range(4)]
    mat.write_text("," + ",".join(f"sp_{j + 1}" for j in range(n)) + "\n" + "".join(f"s{i}," + ",".join(map(str, r)) + "\n" for i, r in enumerate(rows)))
    return str(tree), str(mat)


def test_rates_and_validation(spark, tmp_path, capsys, monkeypatch):
    tree, mat = files(tmp_path)
    out, log = str(tmp_path / "out"), str(tmp_path / "log.json")
    args = ["rates", "--tree", tree, "--mat", mat, "--n", "10", "--out", out, "--log", log]
    assert cli.main(args, spark) == 0
    told = json.load(open(log))
    assert (told["command"], told["exit_code"], told["n_sites"], told["n_converged"]) == ("rates", 0, 4, 4) and told["median_rate"] > 0
    assert cli.main(args, spark) == 2 and json.load(open(log))["exit_code"] == 2  # the folder is there
    assert cli.main([*args, "--force", "--percentile", "0.5"], spark) == 0
    half = spark.read.option("header", True).csv(out).first()
    assert cli.main([*args, "--force"], spark) == 0
    assert float(spark.read.option("header", True).csv(out).where(f"site_id = '{half.site_id}'").first().pDO) > float(half.pDO)
    part = next((tmp_path / "out").glob("part*.csv"))
    register = tmp_path / "manifest.txt"
    fields = {"rate_column": "CpD"}

    def write(path=part, header=None, **more):
        register.write_text(manifest.render(header or {}, {"want": manifest.record(spark, str(path), **fields | more)}))

    write()
    check = ["validate", "--tree", tree, "--mat", mat, "--n", "10", "--expected", str(part), "--manifest", str(register), "--name", "want", "--log", log]
    assert cli.main(check, spark) == 0
    told = json.load(open(log))
    assert told["equivalence_rate"] == 1 and told["reference_column"] == "CpD" and told["max_relative_error"] < 1e-9
    assert cli.main([*check, "--rate-column", "CpD"], spark) == 0
    assert cli.main([*check, "--rate-column", "CpE"], spark) == 2
    assert cli.main([*check, "--name", "other"], spark) == 2
    for more in ({"rate_column": "CpB"}, {"orientation": "slice-by-site"}, {"columns_pattern": "slice_[0-9]+"}, {"rows": "5"}, {"cols": "3"}, {"sha256": "0"}, {"header": {"n_slices": "50"}}, {"rate_column": "CpDx"}, {"rate_column": ""}):
        write(**more)
        assert cli.main(check, spark) == 2, more
    write(header={"n_slices": "10"}, columns_pattern="[A-Za-z_]+")
    assert cli.main(check, spark) == 0
    changed = tmp_path / "changed.csv"
    changed.write_text(part.read_text().replace("s0,", "s0,9"))
    write(changed)
    check[8] = str(changed)
    assert cli.main(check, spark) == 1
    assert cli.main([*check, "--no-strict"], spark) == 0
    # Without a place given, the manifest beside the file, or the one that the variable names.
    bare = [x for x in check if x not in ("--manifest", str(register))]
    assert cli.main(bare, spark) == 1
    register.rename(tmp_path / "elsewhere.txt")
    assert cli.main(bare, spark) == 2 and "no manifest" in capsys.readouterr().err
    monkeypatch.setenv(manifest.VARIABLE, str(tmp_path / "elsewhere.txt"))
    assert cli.main(bare, spark) == 1


def test_manifest_text():
    header, found = manifest.parse("# about\nformat = any-reference-manifest/1\nnotes =\n# of several\n#  lines\n\n# not this\n[file a.csv]\nsha256 = 1\n  rows = 2\n[file b c.csv]\nsha256=3\n")
    assert header == {"format": "any-reference-manifest/1", "notes": "of several lines not this"} and found == {"a.csv": {"sha256": "1", "rows": "2"}, "b c.csv": {"sha256": "3"}}
    again = {"made": "here", "notes": "one\ntwo"}
    assert manifest.parse(manifest.render(again, found)) == ({"format": manifest.FORMAT, "made": "here", "notes": "one two"}, found)
    for bad in ("made = here\n", "format = other/2\n", "format = reference-manifest/1\nwhat\n", "format = reference-manifest/1\n[file a]\n[file a]\n"):
        with pytest.raises(manifest.ProvenanceError):
            manifest.parse(bad)


def test_slices_and_refusals(spark, tmp_path):
    tree, mat = files(tmp_path)
    out = tmp_path / "s"
    assert cli.main(["slice", "--tree", tree, "--n", "3", "--out", str(out)], spark) == 0
    names = lambda: sorted(p.name for p in out.iterdir() if not p.name.startswith("."))
    assert names() == ["slice_0001.tre", "slice_0002.tre", "slice_0003.tre"]
    assert cli.main(["slice", "--tree", tree, "--n", "2", "--out", str(out)], spark) == 2
    assert cli.main(["slice", "--tree", tree, "--n", "2", "--out", str(out), "--force"], spark) == 0
    assert names() == ["slice_0001.tre", "slice_0002.tre"]
    pool = newick.read_pool(spark, str(out))  # which can be read back
    assert [r.draw for r in pool.orderBy("draw").collect()] == [0, 1]
    parts = sum(r.total_pd for r in trees.summary(newick.parse_trees(pool)[0]).collect())
    whole = newick.parse(open(tree).read())
    assert parts == pytest.approx(sum(x for *_, x in whole.edges), rel=1e-9)
    age = max(whole.depth.values())
    sides = []
    for side in ("--rootward", "--tipward"):
        one = str(tmp_path / f"{side[2:]}.tre")
        assert cli.main(["slice", "--tree", tree, side, str(age / 3), "--out", one], spark) == 0
        sides.append(sum(x for *_, x in newick.parse(open(one).read()).edges))
        assert cli.main(["slice", "--tree", tree, side, str(age / 3), "--out", one], spark) == 2
    assert sum(sides) == pytest.approx(parts, rel=1e-9)
    assert cli.main(["slice", "--tree", tree, "--rootward", "1", "--n", "2", "--out", str(tmp_path / "x")], spark) == 2
    crooked = tmp_path / "crooked.tre"
    crooked.write_text("(A:1,B:2);")
    assert cli.main(["slice", "--tree", str(crooked), "--n", "3", "--out", str(tmp_path / "c")], spark) == 2
    assert cli.main(["slice", "--tree", str(crooked), "--n", "3", "--out", str(tmp_path / "c"), "--allow-non-ultrametric"], spark) == 0


def test_beta_rates_and_posterior(spark, tmp_path):
    tree, mat = files(tmp_path)
    (tmp_path / "adj.csv").write_text(",s0,s1,s2,s3\n" + "".join(f"s{i}," + ",".join(str(int(abs(i - j) < 2)) for j in range(4)) + "\n" for i in range(4)))
    args = ["rates", "--tree", tree, "--mat", mat, "--n", "5", "--rate", "cpb", "--out", str(tmp_path / "b")]
    assert cli.main(args, spark) == 2
    assert cli.main([*args, "--adj", str(tmp_path / "adj.csv"), "--adj-header"], spark) == 0
    assert [r.site_id for r in spark.read.option("header", True).csv(str(tmp_path / "b")).orderBy("site_id").collect()] == ["s0", "s1", "s2", "s3"]
    (tmp_path / "pool").mkdir()
    for k in range(3):
        (tmp_path / "pool" / f"t{k}.tre").write_text(simulate.yule(8, seed=k))
    log = tmp_path / "log.json"
    assert cli.main(["posterior", "--trees", str(tmp_path / "pool"), "--mat", mat, "--n", "5", "--out", str(tmp_path / "p"), "--log", str(log)], spark) == 0
    assert json.load(open(log))["n_trees"] == 3


def test_stream_of_trees(spark, tmp_path):
    (tmp_path / "in").mkdir()
    present = spark.createDataFrame([(s, f"sp_{i}") for s in ("a", "b") for i in range(1, 7) if s == "a" or i < 4], "site_id string, species string")
    run = lambda: pool.watch(spark, str(tmp_path / "in"), present, str(tmp_path / "out"), str(tmp_path / "state"), n_slices=6).awaitTermination()
    for k in range(2):
        (tmp_path / "in" / f"t{k}.tre").write_text(simulate.yule(6, seed=k))
        run()
    (tmp_path / "in" / "bad.tre").write_text("(A,A);")
    run()
    assert {(r.site_id, r.n_trees) for r in pool.summary(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 2)}
