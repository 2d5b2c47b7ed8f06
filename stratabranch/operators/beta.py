"""Beta diversity of neighbourhoods: Sorensen, turnover and nestedness, whole and per slice.

A pair's shared length doesn't depend on the neighbourhood that asks for it, so every unordered
pair of sites that meet in some neighbourhood is computed once and then joined to its focal sites.
adj: focal, member (site ids; the focal site is a member of its own). Totals and series prune trees
and presence to the species that both have; what is below them takes such input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabranch.operators import indices, slicing
from stratabranch.session import settle

COMPONENTS = ("sorensen", "turnover", "nestedness")
APPROACHES = ("multisite", "pairwise")


def focal_pairs(adj: DataFrame) -> DataFrame:
    """focal, i, j of members i < j."""
    a = adj.select("focal", F.col("member").alias("i"))
    return a.join(adj.select("focal", F.col("member").alias("j")), "focal").where("i < j")


def pair_edges(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """tree_id, i, j, edge_id of the edges that both sites of a pair (i, j) have."""
    one = member.select("tree_id", F.col("site_id").alias("i"), "edge_id").join(pairs, "i")
    return one.join(member.select("tree_id", F.col("site_id").alias("j"), "edge_id"), ["tree_id", "j", "edge_id"]).select("tree_id", "i", "j", "edge_id")


def _with_pairs(pairs: DataFrame, shared: DataFrame, own: DataFrame, *keys: str) -> DataFrame:
    """pairs with a (shared), bc (in one of the two only) and mn (the smaller of these)."""
    on = ["tree_id", *keys]
    i = own.select(*on, F.col("site_id").alias("i"), F.col("x").alias("xi"))
    j = own.select(*on, F.col("site_id").alias("j"), F.col("x").alias("xj"))
    both = i.join(pairs, "i").join(j, [*on, "j"]).join(shared, [*on, "i", "j"], "left")
    a = F.coalesce("a", F.lit(0.0))
    return both.select(*on, "i", "j", a.alias("a"), (F.col("xi") + F.col("xj") - 2 * a).alias("bc"), (F.least("xi", "xj") - a).alias("mn"))


def _formula(component: str, approach: str, a: str, bc: str, mn: str, num_bc: str, num_mn: str) -> Column:
    sorensen = F.try_divide(F.col(num_bc), 2 * F.col(a) + F.col(bc))
    turnover = F.try_divide(F.col(num_mn), F.col(a) + F.col(mn))
    return {"sorensen": sorensen, "turnover": turnover, "nestedness": sorensen - turnover}[component]


def neighbourhoods(edges: DataFrame, presence: DataFrame, adj: DataFrame, weighted: bool = False):
    """What every variant starts from: membership, lengths (divided by ranges if weighted), each site's
    total, pairs, and focal rows with status."""
    member = settle(indices.membership(edges, presence))
    lengths = edges.select("tree_id", "edge_id", "length")
    if weighted:
        lengths = indices.weighted_contribution(lengths.withColumnRenamed("length", "c"), member).withColumnRenamed("c", "length")
    sites = adj.select(F.col("member").alias("site_id")).distinct()
    tree_ids = edges.select("tree_id").distinct()
    everyone = tree_ids.crossJoin(sites)
    own = everyone.join(member.join(lengths, ["tree_id", "edge_id"]).groupBy("tree_id", "site_id").agg(F.sum("length").alias("x")), ["tree_id", "site_id"], "left").fillna(0.0, ["x"])
    local = member.join(adj.select("focal", F.col("member").alias("site_id")), "site_id")
    united = local.select("tree_id", "focal", "edge_id").distinct().join(lengths, ["tree_id", "edge_id"]).groupBy("tree_id", "focal").agg(F.sum("length").alias("united"))
    held = local.groupBy("tree_id", "focal").agg(F.count("*").alias("held"))
    n_edges = edges.groupBy("tree_id").agg(F.count("*").alias("n_edges"), F.count_if("is_tip").alias("n_tips"))
    n_members = adj.groupBy("focal").agg(F.count("*").alias("m"))
    sums = adj.select("focal", F.col("member").alias("site_id")).join(own, "site_id").groupBy("tree_id", "focal").agg(F.sum("x").alias("sum_x"))
    status = (
        F.when(F.col("m") < 2, "fewer_than_two_sites")
        .when((F.coalesce("held", F.lit(0)) == 0) | (F.col("held") == F.col("m") * F.col("n_edges")), "degenerate_neighbourhood")
        .when(F.col("n_tips") < 2, "fewer_than_two_species")
        .otherwise("ok")
    )
    focal = tree_ids.crossJoin(n_members).join(n_edges, "tree_id").join(held, ["tree_id", "focal"], "left").join(united, ["tree_id", "focal"], "left").join(sums, ["tree_id", "focal"], "left").select("tree_id", "focal", status.alias("status"), (F.col("sum_x") - F.coalesce("united", F.lit(0.0))).alias("mixed"))
    groups = focal_pairs(adj)
    pairs = groups.select("i", "j").distinct()
    shared_edges = pair_edges(member, pairs)
    shared = shared_edges.join(lengths, ["tree_id", "edge_id"]).groupBy("tree_id", "i", "j").agg(F.sum("length").alias("a"))
    return member, focal, groups, pairs, shared_edges, settle(_with_pairs(pairs, shared, own))


def _domain(name: str) -> str:
    if name not in ("mixed", "reference", "paired"):
        raise ValueError("the domain of the shared term is 'mixed' (or 'reference') or 'paired'")
    return "paired" if name == "paired" else "mixed"


def totals(edges: DataFrame, presence: DataFrame, adj: DataFrame, component: str = "sorensen", approach: str = "multisite", weighted: bool = False, domain: str = "mixed") -> DataFrame:
    """tree_id, focal, pb, status of every neighbourhood."""
    edges, presence, _ = indices.align(edges, presence)
    _, focal, groups, _, _, pairs = neighbourhoods(edges, presence, adj, weighted)
    found = _totals(focal, groups, pairs, component, approach, domain)
    ok = F.col("status") == "ok"
    return found.select("tree_id", "focal", F.when(ok, F.col("pb")).alias("pb"), F.when(ok & F.col("pb").isNull(), "zero_denominator").otherwise(F.col("status")).alias("status"))


def _totals(focal: DataFrame, groups: DataFrame, pairs: DataFrame, component: str, approach: str, domain: str) -> DataFrame:
    domain = _domain(domain)
    local = groups.join(pairs, ["i", "j"])
    if approach == "multisite":
        sums = local.groupBy("tree_id", "focal").agg(*(F.sum(c).alias(c) for c in ("a", "bc", "mn")))
        joined = focal.join(sums, ["tree_id", "focal"], "left").withColumn("shared", F.col("a") if domain == "paired" else F.col("mixed"))
        return joined.withColumn("pb", _formula(component, approach, "shared", "bc", "mn", "bc", "mn"))
    if approach != "pairwise":
        raise ValueError("the approach is 'multisite' or 'pairwise'")
    means = local.groupBy("tree_id", "focal").agg(F.avg(_formula("sorensen", approach, "a", "bc", "mn", "bc", "mn")).alias("sorensen"), F.avg(_formula("turnover", approach, "a", "bc", "mn", "bc", "mn")).alias("turnover"), *(F.sum(c).alias(c) for c in ("a", "bc", "mn")))
    value = F.col("sorensen") - F.col("turnover") if component == "nestedness" else F.col(component)
    return focal.join(means, ["tree_id", "focal"], "left").withColumn("shared", F.col("a")).withColumn("pb", value)


def series(edges: DataFrame, presence: DataFrame, adj: DataFrame, n_slices: int = 100, component: str = "sorensen", approach: str = "multisite", weighted: bool = False, domain: str = "mixed", criterion: str = "time", allow_non_ultrametric: bool = False) -> DataFrame:
    """per_slice of trees and presence as they come."""
    edges, presence, _ = indices.align(edges, presence)
    w = slicing.windows(edges, n=n_slices, criterion=criterion, allow_non_ultrametric=allow_non_ultrametric)
    return per_slice(edges, presence, adj, slicing.contribution(edges, w), w, component, approach, weighted, domain)


def per_slice(edges: DataFrame, presence: DataFrame, adj: DataFrame, contributions: DataFrame, window_table: DataFrame, component: str = "sorensen", approach: str = "multisite", weighted: bool = False, domain: str = "mixed", keys: tuple[str, ...] = ()) -> DataFrame:
    """tree_id, focal, j, series, value (series over its sum), compatible (series over the total), total,
    status, normalisation. Numerators are a slice's, denominators the whole tree's. The input is aligned."""
    member, focal, groups, pairs, shared_edges, whole = neighbourhoods(edges, presence, adj, weighted)
    c = indices.weighted_contribution(contributions, member) if weighted else contributions
    on = ["tree_id", *keys, "j"]
    sites = adj.select(F.col("member").alias("site_id")).distinct()
    own = window_table.select(*on).crossJoin(sites).join(member.join(c, ["tree_id", "edge_id"]).groupBy(*on, "site_id").agg(F.sum("c").alias("x")), [*on, "site_id"], "left").fillna(0.0, ["x"])
    # The pair's second site is called j as well as the slice: keep them apart.
    se = shared_edges.select("tree_id", "i", F.col("j").alias("k"), "edge_id")
    sliced = se.join(c, ["tree_id", "edge_id"]).groupBy(*on, "i", "k").agg(F.sum("c").alias("a"))
    kp = pairs.select("i", F.col("j").alias("k"))
    first, second = own.select(*on, F.col("site_id").alias("i"), F.col("x").alias("xi")), own.select(*on, F.col("site_id").alias("k"), F.col("x").alias("xk"))
    a = F.coalesce("a", F.lit(0.0))
    parts = first.join(kp, "i").join(second, [*on, "k"]).join(sliced, [*on, "i", "k"], "left").select(*on, "i", "k", (F.col("xi") + F.col("xk") - 2 * a).alias("bc_s"), (F.least("xi", "xk") - a).alias("mn_s"))
    total = _totals(focal, groups, whole, component, approach, domain).select("tree_id", "focal", "status", "shared", "bc", "mn", "pb")
    local = groups.select("focal", "i", F.col("j").alias("k")).join(parts, ["i", "k"])
    if approach == "multisite":
        sums = local.groupBy(*on, "focal").agg(F.sum("bc_s").alias("bc_s"), F.sum("mn_s").alias("mn_s")).join(total, ["tree_id", "focal"])
        series = sums.withColumn("series", _formula(component, approach, "shared", "bc", "mn", "bc_s", "mn_s"))
    else:
        w = whole.select("tree_id", "i", F.col("j").alias("k"), "a", "bc", "mn")
        each = local.join(w, ["tree_id", "i", "k"]).withColumn("v", _formula(component, approach, "a", "bc", "mn", "bc_s", "mn_s"))
        # A pair without a value leaves its slice without one.
        means = each.groupBy(*on, "focal").agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.avg("v")).alias("series"))
        series = means.join(total, ["tree_id", "focal"])
    series = settle(series.select(*on, "focal", "series"))
    row = series.groupBy("tree_id", *keys, "focal").agg(F.when(F.count_if(F.col("series").isNull()) == 0, F.sum("series")).alias("row_sum"))
    frame = focal.select("tree_id", "focal").join(window_table.select(*on), "tree_id").join(series.select(*on, "focal", "series"), [*on, "focal"], "left").join(row, ["tree_id", *keys, "focal"], "left").join(total.select("tree_id", "focal", "status", "pb"), ["tree_id", "focal"])
    bad = F.col("row_sum").isNull() | F.col("pb").isNull() | (F.col("pb") == 0) | (F.col("row_sum") == 0)
    status = F.when(F.col("status") != "ok", F.col("status")).when(bad, "degenerate_neighbourhood").otherwise("ok")
    ok = F.col("status") == "ok"
    full = F.abs(F.col("row_sum") - F.col("pb")) <= F.lit(1e-12) * F.abs("pb")
    return frame.withColumn("status", status).select(
        "tree_id", *keys, "focal", "j",
        F.when(ok, F.col("series")).alias("series"),
        F.when(ok, F.try_divide("series", "row_sum")).alias("value"),
        F.when(ok, F.try_divide("series", "pb")).alias("compatible"),
        F.when(ok, F.col("pb")).alias("total"),
        "status",
        F.when(ok, F.when(full, "full_tree").otherwise("profile")).alias("normalisation"),
    )
