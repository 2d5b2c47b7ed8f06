"""Rates over pools of trees: summaries of draws, and the bootstrap over sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.functions import fit, stats
from stratabranch.operators import indices, rates, trees
from stratabranch.session import settle


def _samples(value: str):
    """Values in draw order; draws without one are left out."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("draw", F.col(value).alias("v"))))), lambda x: x["v"])


def draw_rates(edges: DataFrame, presence: DataFrame, draws: DataFrame, rate: str, n_slices: int, allow_non_ultrametric: bool = False, **options) -> DataFrame:
    """The rate frames of all draws that can be used, with their place. Draws that aren't ultrametric (unless that
    is allowed), or degenerate over the shared species, don't count; without any left, that is an error."""
    pruned, _, _ = indices.align(edges, presence)
    # A row for each tree, read several times. Presence needn't be keyed by tree: the tips say what a tree has.
    table = settle(trees.summary(pruned))
    fine = table.where("NOT degenerate" if allow_non_ultrametric else "NOT degenerate AND ultrametric")
    n, of = fine.count(), table.count()
    if not n:
        raise RuntimeError("no draw of the pool can be used")
    left = pruned if n == of else pruned.join(F.broadcast(fine.select("tree_id")), "tree_id", "left_semi")
    index = {"cpd": "pd", "cpe": "pe"}[rate]
    return rates.fitted(left, presence, presence.select("site_id").distinct(), n_slices, index, table=fine, n_trees=n, **options).join(draws.select("tree_id", "draw"), "tree_id")


def posterior_rate(edges: DataFrame, presence: DataFrame, draws: DataFrame, rate: str = "cpd", n_slices: int = 100, level: float = 0.95, **options) -> DataFrame:
    """site_id, rate_mean, rate_median, hdi_low, hdi_high, ess_proxy, ess_proxy_caveat, n_trees,
    n_converged, n_ultrametric_draws, origin_within_tree. draws: tree_id, draw (the order)."""
    name = {"cpd": "CpD", "cpe": "CpE"}[rate]
    frame = draw_rates(edges, presence, draws, rate, n_slices, **options)
    x = F.col("x")
    return (
        frame.groupBy("site_id")
        .agg(_samples(name).alias("x"), F.avg(name).alias("rate_mean"), F.median(name).alias("rate_median"), F.count("*").alias("n_trees"), F.count(name).alias("n_converged"), F.count_if("ultrametric").alias("n_ultrametric_draws"), F.bool_and("origin_within_tree").alias("origin_within_tree"))
        .withColumn("h", stats.hdi(x, level))
        .select("site_id", "rate_mean", "rate_median", F.col("h.low").alias("hdi_low"), F.col("h.high").alias("hdi_high"), stats.ess_proxy(x).alias("ess_proxy"), F.lit(stats.ESS_CAVEAT).alias("ess_proxy_caveat"), "n_trees", "n_converged", "n_ultrametric_draws", "origin_within_tree")
    )


def posterior_origin(edges: DataFrame, presence: DataFrame, draws: DataFrame, rate: str = "cpd", n_slices: int = 100, level: float = 0.95, **options) -> DataFrame:
    """site_id, origin_median, hdi_low, hdi_high, n_trees, origin_within_tree."""
    name = {"cpd": "pDO", "cpe": "pEO"}[rate]
    frame = draw_rates(edges, presence, draws, rate, n_slices, **options)
    return (
        frame.groupBy("site_id")
        .agg(_samples(name).alias("x"), F.median(name).alias("origin_median"), F.count("*").alias("n_trees"), F.bool_and("origin_within_tree").alias("origin_within_tree"))
        .withColumn("h", stats.hdi(F.col("x"), level))
        .select("site_id", "origin_median", F.col("h.low").alias("hdi_low"), F.col("h.high").alias("hdi_high"), "n_trees", "origin_within_tree")
    )


def seeded_draws(sites: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """replicate, site_pos: as many draws with replacement as there are sites (site_pos from 0), for
    each replicate, by hashing."""
    spark = sites.sparkSession
    n = sites.count()
    return spark.range(n_boot).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "i"), F.lit(n)).alias("site_pos"))


def bootstrap(profiles: DataFrame, drawn: DataFrame, value: str = "pd", bounds=fit.BOUNDS) -> DataFrame:
    """replicate, rate, converged of pooled profiles. profiles: site_pos, j, age, value; drawn: replicate,
    site_pos. Sites that are drawn twice count twice."""
    pooled = drawn.groupBy("replicate", "site_pos").agg(F.count("*").alias("times")).join(profiles, "site_pos").groupBy("replicate", "j", "age").agg(F.sum(F.col("times") * F.col(value)).alias("v"))
    return fit.fit_profiles(pooled, ["replicate"], "v", bounds).select("replicate", "rate", "converged")


def bootstrap_sites(edges: DataFrame, presence: DataFrame, n_boot: int = 1000, rate: str = "cpd", n_slices: int = 100, seed: int = 0, bounds=fit.BOUNDS, allow_non_ultrametric: bool = False) -> DataFrame:
    """replicate, rate, converged: rates of the pooled profiles of sites drawn with replacement."""
    edges, kept, sites = rates.prepared(edges, presence, allow_non_ultrametric)
    profiles = rates.site_profiles(edges, kept, n_slices, sites=sites)
    # A place for each site, by the order of a hash: sites are a small table beside profiles.
    order = Window.orderBy(F.xxhash64("site_id"), "site_id")
    at = sites.withColumn("site_pos", (F.row_number().over(order) - 1).cast("long"))
    return bootstrap(profiles.join(at, "site_id"), seeded_draws(sites, n_boot, seed), {"cpd": "pd", "cpe": "pe"}[rate], bounds)
