"""Diversity of sites: membership, totals, and profiles over slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.operators import slicing, trees
from stratabranch.session import settle


def align(edges: DataFrame, presence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees and presence (site_id, species) over the species that both have, and a report
    (tree_id, action, n). Presence comes back keyed by tree_id. Trees of under two shared species are
    reported as rejected and don't come out. The trees come back checkpointed: they are read
    several times.

    Of a pool that was made from few rows, a plan thinks too little, and would send all its edges through the
    driver; the hint holds for the next join of whatever comes from them.
    """
    edges = edges.hint("merge")
    species = presence.select(F.col("species").alias("label")).distinct()
    marked = edges.where("is_tip").select("tree_id", "label").join(species.withColumn("_hit", F.lit(1)), "label", "left")
    n_species = species.agg(F.count("*").alias("n_species"))  # one row
    counts = marked.groupBy("tree_id").agg(F.count("*").alias("n_tips"), F.count("_hit").alias("n")).join(F.broadcast(n_species))
    actions = (("pruned_tips", F.col("n_tips") - F.col("n")), ("dropped_species", F.col("n_species") - F.col("n")), ("shared", F.col("n")), ("rejected", (F.col("n") < 2).cast("int")))
    report = counts.select("tree_id", F.inline(F.array(*(F.struct(F.lit(a).alias("action"), x.cast("long").alias("n")) for a, x in actions))))
    pruned = settle(trees.prune(edges, settle(trees.kept_tips(edges, species)), leave_whole=True))
    kept = pruned.where("is_tip").select("tree_id", F.col("label").alias("species")).join(presence, "species").select("tree_id", "site_id", "species")
    return pruned, kept, report


def matched(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """presence over the tips of the trees, without pruning: tips without a species count as absent, species
    without a tip go. Where both are left over, names don't fit, and that is an error."""
    bad = unmatched(edges, presence).where("missing > 0 AND extra > 0").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.tree_id}: {r.missing} tips without a species and {r.extra} species without a tip" for r in bad))
    tips = edges.where("is_tip").select(F.col("label").alias("species")).distinct()
    return presence.join(tips, "species", "left_semi")


def unmatched(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """tree_id, missing (tips without a species), extra (species without a tip): where both are over
    0, matching columns to the tree is refused."""
    species = presence.select(F.col("species").alias("label")).distinct()
    tips = edges.where("is_tip").select("tree_id", "label")
    both = tips.join(species, "label", "left_semi").groupBy("tree_id").agg(F.count("*").alias("n"))
    return tips.groupBy("tree_id").agg(F.count("*").alias("n_tips")).join(both, "tree_id", "left").join(F.broadcast(species.agg(F.count("*").alias("n_species")))).select("tree_id", (F.col("n_tips") - F.coalesce("n", F.lit(0))).alias("missing"), (F.col("n_species") - F.coalesce("n", F.lit(0))).alias("extra"))


def membership(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """tree_id, site_id, edge_id, each once: a site's tips, and above them, how far they reach down each heavy
    path says which of its edges the site has. Tips of one node are below the same edges, so that one of them will
    do for all sites. presence may be keyed by tree_id."""
    return members(edges, presence)


def members(edges: DataFrame, presence: DataFrame, *more: str) -> DataFrame:
    """membership, with more columns of the edges."""
    on = ["tree_id", "label"] if "tree_id" in presence.columns else ["label"]
    tips = edges.where("is_tip").select("tree_id", "edge_id", "parent", "label", *more)
    own = tips.join(presence.select(*on[:-1], "site_id", F.col("species").alias("label")).distinct(), on)
    lean = trees.lean(edges)
    paths, below = trees.heavy_paths(lean, inner=True)
    nodes = own.select("tree_id", "site_id", "parent").distinct().alias("o")
    first = lean.where("is_tip").select("tree_id", "parent", F.col("tip_lo").alias("tip")).alias("t")
    found = nodes.join(first, F.expr("o.tree_id = t.tree_id AND o.parent <=> t.parent")).select("o.tree_id", "site_id", "tip").join(below.drop("label"), ["tree_id", "tip"])
    reached = found.groupBy("tree_id", "site_id", "path").agg(F.min("reach").alias("reach")).alias("r")
    inner = paths.join(lean.where("NOT is_tip").select("tree_id", "edge_id", *more), ["tree_id", "edge_id"]).alias("p")
    above = reached.join(inner, F.expr("r.tree_id = p.tree_id AND r.path <=> p.path AND p.size >= r.reach")).select("r.tree_id", "r.site_id", "p.edge_id", *more)
    return own.select("tree_id", "site_id", "edge_id", *more).unionByName(above)


def edge_ranges(member: DataFrame) -> DataFrame:
    """tree_id, edge_id, n: how many sites an edge is found in."""
    return member.groupBy("tree_id", "edge_id").agg(F.count("*").alias("n"))


def totals(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """tree_id, site_id, pd, pe: lengths of a site's edges, whole and divided by their ranges."""
    member = membership(edges, presence)
    weighed = edges.select("tree_id", "edge_id", "length").join(edge_ranges(member), ["tree_id", "edge_id"])
    return member.join(weighed, ["tree_id", "edge_id"]).groupBy("tree_id", "site_id").agg(F.sum("length").alias("pd"), F.sum(F.col("length") / F.col("n")).alias("pe"))


def weighted_contribution(contributions: DataFrame, member: DataFrame) -> DataFrame:
    """contributions divided by the ranges of their edges; edges of no site stay as they are."""
    return contributions.join(edge_ranges(member), ["tree_id", "edge_id"], "left").withColumn("c", F.col("c") / F.coalesce("n", F.lit(1))).drop("n")


def profile(member: DataFrame, contributions: DataFrame, *keys: str) -> DataFrame:
    """tree_id, site_id, j, pd, pe of every site and slice that a site has anything in."""
    weighed = contributions.join(edge_ranges(member), ["tree_id", "edge_id"])
    return member.join(weighed, ["tree_id", "edge_id"]).groupBy("tree_id", *keys, "site_id", "j").agg(F.sum("c").alias("pd"), F.sum(F.col("c") / F.col("n")).alias("pe"))


def profile_pd(edges: DataFrame, presence: DataFrame, window_table: DataFrame, *keys: str) -> DataFrame:
    """tree_id, site_id, j, pd: profile without pe, for which edges needn't know their ranges. Edges meet windows
    where sites have them, and are summed there and then; window_table is a small one."""
    own = members(edges, presence, "b", "d").join(F.broadcast(window_table.drop("age")), "tree_id").where("d > lo AND b < hi")
    return own.groupBy("tree_id", *keys, "site_id", "j").agg(F.sum(slicing.overlap()).alias("pd"))


def filled(sites: DataFrame, window_table: DataFrame, profiles: DataFrame, *keys: str) -> DataFrame:
    """profiles with zeros where a site (site_id) has nothing in a window, and its age. Every site meets
    every window because the dense profile is the result."""
    grid = window_table.select("tree_id", *keys, "j", "age").crossJoin(sites.select("site_id").distinct())
    values = [c for c in profiles.columns if c not in ("tree_id", *keys, "site_id", "j")]
    return grid.join(profiles, ["tree_id", *keys, "site_id", "j"], "left").fillna(0.0, values)


def normalised(profiles: DataFrame, value: str, *keys: str) -> DataFrame:
    """profiles with share (of the site's total), cumulative and status; an empty site has nulls."""
    site = Window.partitionBy("tree_id", *keys, "site_id")
    total = F.sum(value).over(site)
    running = F.sum(value).over(site.orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    return profiles.withColumn("share", F.try_divide(F.col(value), total)).withColumn("cumulative", F.try_divide(running, total)).withColumn("status", F.when(total > 0, "ok").otherwise("empty_site"))
