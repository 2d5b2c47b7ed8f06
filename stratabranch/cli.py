"""Command line: slice, rates, posterior, validate. Exit codes: 0 done, 1 mismatch or failure, 2 refused."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabranch import __version__
from stratabranch.operators import posterior, rates, slicing, trees
from stratabranch.session import local_session, reachable, settle
from stratabranch.sources import files, manifest, newick, presence


class Refused(Exception):
    """Input or output that is not taken."""


def _pool(spark: SparkSession, path: str, first: bool = False) -> tuple[DataFrame, DataFrame]:
    """edges, draws of the trees at a path; bad records are named on stderr."""
    texts = newick.read_pool(spark, path)
    texts = texts.where("draw = 0") if first else texts
    edges, rejects = newick.parse_trees(texts)
    for r in rejects.limit(20).collect():
        print(f"skipped {r.tree_id}: {r.reason}", file=sys.stderr)
    draws = texts.join(edges.select("tree_id").distinct(), "tree_id", "left_semi").select("tree_id", "draw")
    if not draws.limit(1).count():
        raise Refused(f"no usable tree at {path}")
    return edges, draws


def _write(df: DataFrame, path: str, force: bool) -> None:
    """A folder of CSV parts, whose rows are sorted across them."""
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def _log(path: str | None, command: str, began: float, **extra) -> None:
    if path:
        with open(path, "w") as f:
            json.dump({"version": __version__, "command": command, "elapsed_s": round(time.time() - began, 3), "at": time.strftime("%Y-%m-%dT%H:%M:%S%z"), **extra}, f, indent=1)


def cmd_slice(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One file of what lies on a side of a time, or a folder of slices, slice_0001.tre and so on."""
    wanted = [x for x in (a.rootward, a.tipward, a.n, a.width) if x is not None]
    if len(wanted) != 1:
        raise Refused("give one of --rootward, --tipward, --n and --width")
    edges, _ = _pool(spark, a.tree, first=True)
    if a.rootward is not None or a.tipward is not None:
        run = slicing.rootward if a.rootward is not None else slicing.tipward
        found = run(edges, wanted[0], a.criterion, a.allow_non_ultrametric)
        found = trees.collapse(found) if a.collapse else found
        files.write_text(spark, a.out, newick.render_trees(found).first().newick + "\n", a.force)
        return {"n_slices": 1}
    w = slicing.windows(edges, n=a.n, width=a.width, criterion=a.criterion, allow_non_ultrametric=a.allow_non_ultrametric)
    found = slicing.slices(edges, w)
    found = trees.collapse(found, ("tree_id", "j")) if a.collapse else found
    texts = newick.render_trees(found.withColumn("tree_id", F.format_string("slice_%04d", F.col("j") + 1)))
    return {"n_slices": newick.write_newick(texts, a.out, a.force)}


def _summary(frame: DataFrame, rate: str) -> dict:
    return rates.run_summary(frame, rate).first().asDict()


def cmd_rates(spark: SparkSession, a: argparse.Namespace) -> dict:
    edges, _ = _pool(spark, a.tree, first=True)
    present = presence.read_csv(spark, a.mat)
    options = {"criterion": a.criterion, "percentile": a.percentile, "allow_non_ultrametric": a.allow_non_ultrametric}
    if a.rate in ("cpd", "cpe"):
        run, name = (rates.cpd_rate, "CpD") if a.rate == "cpd" else (rates.cpe_rate, "CpE")
        found = run(edges, present, a.n, **options)
    else:
        if not a.adj:
            raise Refused("beta rates need --adj")
        adj = presence.named(presence.read_adjacency(spark, a.adj, a.adj_header), presence.site_order(spark, a.mat))
        name = "CpB_RW" if a.rate == "cpb_rw" else "CpB"
        found = rates.cpb_rate(edges, present, adj, a.n, a.component, a.approach, a.rate == "cpb_rw", **options)
    found = settle(found.drop("tree_id").orderBy("site_id"))
    _write(found, a.out, a.force)
    return _summary(found, name)


def cmd_posterior(spark: SparkSession, a: argparse.Namespace) -> dict:
    edges, draws = _pool(spark, a.trees)
    found = settle(posterior.posterior_rate(edges, presence.read_csv(spark, a.mat), draws, a.rate, a.n, a.hdi, allow_non_ultrametric=a.allow_non_ultrametric).orderBy("site_id"))
    _write(found, a.out, a.force)
    r = found.agg(F.count("*").alias("n_sites"), F.max("n_trees").alias("n_trees"), F.median("rate_median").alias("median_rate")).first()
    return r.asDict()


def cmd_validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Compare rates with a registered file, value by value; both missing agree, one missing doesn't."""
    name = a.name or a.expected.rsplit("/", 1)[-1]
    header, registered = manifest.load(a.expected, a.manifest)
    record = manifest.verify(spark, a.expected, name, registered, ("rate_column",))
    column = record["rate_column"]
    kind = column[:3]
    if record["orientation"] != "site-by-index":
        raise Refused(f"{name} is registered as {record['orientation']}, and not a row for each site")
    if a.rate_column and a.rate_column != column:
        raise Refused(f"{name} is registered with the rate {column}, and not {a.rate_column}")
    if kind not in ("CpD", "CpE") or column.startswith("CpD_RW"):
        raise Refused(f"{name} holds {column}; CpD and CpE can be compared")
    if header.get("n_slices") and int(header["n_slices"]) != a.n:
        raise Refused(f"{name} was made with {header['n_slices']} slices, and not {a.n}")
    expected = spark.read.option("header", True).csv(a.expected)
    if column not in expected.columns:
        raise Refused(f"{name} has no column {column}")
    edges, _ = _pool(spark, a.tree, first=True)
    run = rates.cpd_rate if kind == "CpD" else rates.cpe_rate
    have = run(edges, presence.read_csv(spark, a.mat), a.n, allow_non_ultrametric=a.allow_non_ultrametric).select("site_id", F.col(kind).alias("have"))
    want = expected.select(F.col(f"`{expected.columns[0]}`").cast("string").alias("site_id"), F.expr(f"try_cast(`{column}` AS double)").alias("want"))
    both = have.join(want, "site_id", "full")
    size = F.abs("want")
    gap = F.when(size <= 1e-12, F.abs("have")).otherwise(F.abs(F.col("have") - F.col("want")) / size)
    lone = F.col("have").isNull() != F.col("want").isNull()
    agrees = F.when(F.col("have").isNull() & F.col("want").isNull(), True).when(lone, False).otherwise(gap <= a.tolerance)
    both = settle(both.withColumn("relative_error", gap).withColumn("agrees", agrees))
    r = both.agg(F.count("*").alias("n"), F.count_if("agrees").alias("ok"), F.max("relative_error").alias("worst"), F.count_if(lone).alias("lone")).first()
    print(f"{r.ok} of {r.n} sites agree; the largest difference is {r.worst}")
    if a.out:
        _write(both.orderBy("site_id"), a.out, a.force)
    return {"exit_code": 1 if r.ok < r.n and a.strict else 0, "n_sites": r.n, "equivalence_rate": r.ok / r.n if r.n else None, "max_relative_error": r.worst, "n_one_sided": r.lone, "tolerance": a.tolerance, "n_slices": a.n, "reference": name, "reference_column": column, "reference_sha256": record["sha256"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("stratabranch", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, handler, tree: str = "--tree") -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.add_argument(tree, required=True)
        s.add_argument("--out", required=name != "validate")
        s.add_argument("--force", action="store_true")
        s.add_argument("--log")
        s.add_argument("--allow-non-ultrametric", action="store_true")
        s.set_defaults(handler=handler)
        return s

    s = add("slice", cmd_slice)
    s.add_argument("--rootward", type=float, help="what is younger than a time, or below a first part of the diversity")
    s.add_argument("--tipward", type=float, help="what is older")
    s.add_argument("--n", "--n-slices", type=int)
    s.add_argument("--width", type=float)
    s.add_argument("--criterion", choices=("time", "pd"), default="time")
    s.add_argument("--collapse", action="store_true")
    s = add("rates", cmd_rates)
    s.add_argument("--mat", required=True)
    s.add_argument("--rate", choices=("cpd", "cpe", "cpb", "cpb_rw"), default="cpd")
    s.add_argument("--adj")
    s.add_argument("--adj-header", action="store_true")
    s.add_argument("--component", choices=("sorensen", "turnover", "nestedness"), default="sorensen")
    s.add_argument("--approach", choices=("multisite", "pairwise"), default="multisite")
    s.add_argument("--criterion", choices=("time", "pd"), default="time")
    s.add_argument("--percentile", type=float, default=0.95)
    s.add_argument("--n", "--n-slices", type=int, default=100)
    s = add("posterior", cmd_posterior, "--trees")
    s.add_argument("--mat", required=True)
    s.add_argument("--rate", choices=("cpd", "cpe"), default="cpd")
    s.add_argument("--n", "--n-slices", type=int, default=100)
    s.add_argument("--hdi", type=float, default=0.95)
    s = add("validate", cmd_validate)
    s.add_argument("--mat", required=True)
    s.add_argument("--expected", required=True)
    s.add_argument("--manifest", help="else $STRATABRANCH_MANIFEST, the file's folder, or validation/reference above it")
    s.add_argument("--name", help="of the file in the manifest, if it isn't its own")
    s.add_argument("--rate-column", help="must be what the manifest names")
    s.add_argument("--no-strict", dest="strict", action="store_false", help="a mismatch is no failure")
    s.add_argument("--n", "--n-slices", type=int, default=100)
    s.add_argument("--tolerance", type=float, default=1e-4)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = reachable(spark or SparkSession.getActiveSession() or local_session("*"))
    began, code, found = time.time(), 0, {}
    try:
        found = a.handler(spark, a)
        code = found.pop("exit_code", 0)
    except (Refused, ValueError, FileExistsError, FileNotFoundError) as e:
        print(f"refused: {e}", file=sys.stderr)
        code, found = 2, {"error": str(e)}
    except Exception as e:  # noqa: BLE001
        there = "ALREADY_EXISTS" in str(e) or "already exists" in str(e)
        print(f"refused: {a.out} exists; --force replaces it" if there else f"failed: {e}", file=sys.stderr)
        code, found = (2, {"error": f"{a.out} exists"}) if there else (1, {"error": str(e)})
    _log(a.log, a.command, began, exit_code=code, **found)
    return code


if __name__ == "__main__":
    sys.exit(main())
