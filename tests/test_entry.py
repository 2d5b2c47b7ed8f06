"""Every registered query of the tree engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from stratabranch.plans import catalog

#: Those that take longest are compared once at the larger tables by the driver.
SLOW = {n for n in catalog.QUERIES if n.startswith(("cpb_", "pb_slice", "posterior", "sensitivity"))} - {"cpb_sorensen_multisite"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("nation", "part", "supplier", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return [one(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(want)
    for a, b in zip(plain(got), plain(want)):
        assert a == pytest.approx(b, rel=1e-5, abs=2e-6) if not any(isinstance(x, (list, str, type(None))) for x in a) else [x if not isinstance(x, float) else pytest.approx(x, rel=1e-5, abs=2e-6) for x in a] == list(b)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_edge_problems_checks_a_tree_for_every_part(spark, sf_dir, duck, monkeypatch):
    seen, problems = [], catalog.trees.problems
    monkeypatch.setattr(catalog.trees, "problems", lambda links: seen.append(links) or problems(links))
    catalog.QUERIES["edge_problems"](spark, sf_dir)
    assert seen[0].select("tree_id").distinct().count() == duck.execute("SELECT count(*) FROM part").fetchone()[0]
