"""Accumulation rates of sites and neighbourhoods, and how they depend on the slice count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.functions import fit
from stratabranch.operators import beta, indices, slicing, trees
from stratabranch.session import settle

BEYOND = "origin extrapolated beyond root"
#: Windows of all trees up to which they go to every task whole.
FEW = 100_000


def frame(fits: DataFrame, table: DataFrame, names: tuple[str, str, str], percentile: float = 0.95, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """The rate frame: tree_id, site_id, rate, total, origin (under the given names), diagnostics. An
    origin older than the root is marked, not clipped."""
    rate, total, origin = names
    at = fit.origin_time(F.col("rate"), percentile)
    beyond = F.coalesce(at > F.col("root_age"), F.lit(False))
    reason = F.when(beyond, F.when(F.col("reason") == "", F.lit(BEYOND)).otherwise(F.concat_ws("; ", "reason", F.lit(BEYOND)))).otherwise(F.col("reason"))
    return fits.join(table.select("tree_id", "root_age", "ultrametric"), "tree_id").select(
        "tree_id", *keys, F.col("rate").alias(rate), F.col("total").alias(total), at.alias(origin), "converged", "r_squared", reason.alias("reason"), "at_lower_bound", "at_upper_bound", "ultrametric", (~beyond).alias("origin_within_tree")
    )


def prepared(edges: DataFrame, presence: DataFrame, allow_non_ultrametric: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees and presence over the species that both have, looked at, and all sites, those without any such
    species too."""
    sites = presence.select("site_id").distinct()
    edges, kept, _ = indices.align(edges, presence)
    return trees.require(edges, allow_non_ultrametric), kept, sites


def site_profiles(edges: DataFrame, presence: DataFrame, n_slices: int, criterion: str = "time", window_table: DataFrame | None = None, keys: tuple[str, ...] = (), sites: DataFrame | None = None) -> DataFrame:
    """tree_id, site_id, j, age, pd, pe of every site (those that presence names, if not given), zeros too."""
    w = slicing.windows(edges, n=n_slices, criterion=criterion) if window_table is None else window_table
    found = indices.profile(settle(indices.membership(edges, presence)), slicing.contribution(edges, w), *keys)
    return indices.filled(presence.select("site_id") if sites is None else sites, w, found, *keys)


def site_rate(edges: DataFrame, presence: DataFrame, n_slices: int = 100, index: str = "pd", criterion: str = "time", percentile: float = 0.95, bounds=fit.BOUNDS, allow_non_ultrametric: bool = False) -> DataFrame:
    """CpD (index pd) or CpE (pe) of every site."""
    return fitted(*prepared(edges, presence, allow_non_ultrametric), n_slices, index, criterion, percentile, bounds)


def fitted(edges: DataFrame, presence: DataFrame, sites: DataFrame, n_slices: int = 100, index: str = "pd", criterion: str = "time", percentile: float = 0.95, bounds=fit.BOUNDS, table: DataFrame | None = None, n_trees: int | None = None) -> DataFrame:
    """The rate frame of trees and presence that have been prepared. table: the trees' summary, and n_trees how
    many there are, if known."""
    table = trees.summary(edges) if table is None else table
    if index == "pd" and n_trees is not None and n_trees * n_slices <= FEW:
        w = slicing.equal_time(table.select("tree_id", "root_age"), n_slices) if criterion == "time" else slicing.windows(edges, n=n_slices, criterion=criterion)
        profiles = indices.filled(sites, w, indices.profile_pd(edges, presence, w))
    else:
        profiles = site_profiles(edges, presence, n_slices, criterion, sites=sites)
    fits = fit.fit_profiles(profiles, ["tree_id", "site_id"], index, bounds)
    names = ("CpD", "PD", "pDO") if index == "pd" else ("CpE", "PE", "pEO")
    return frame(fits, table, names, percentile)


def cpd_rate(edges: DataFrame, presence: DataFrame, n_slices: int = 100, **options) -> DataFrame:
    return site_rate(edges, presence, n_slices, "pd", **options)


def cpe_rate(edges: DataFrame, presence: DataFrame, n_slices: int = 100, **options) -> DataFrame:
    return site_rate(edges, presence, n_slices, "pe", **options)


def cpb_rate(edges: DataFrame, presence: DataFrame, adj: DataFrame, n_slices: int = 100, component: str = "sorensen", approach: str = "multisite", weighted: bool = False, criterion: str = "time", percentile: float = 0.95, bounds=fit.BOUNDS, domain: str = "mixed", compatible: bool = False, allow_non_ultrametric: bool = False) -> DataFrame:
    """CpB or CpB_RW of every neighbourhood; skipped ones have their status as the reason.

    compatible: fit running sums of the series over the total, which need not end in 1.
    """
    edges, presence, _ = prepared(edges, presence, allow_non_ultrametric)
    w = slicing.windows(edges, n=n_slices, criterion=criterion)
    rows = settle(beta.per_slice(edges, presence, adj, slicing.contribution(edges, w), w, component, approach, weighted, domain).join(w.select("tree_id", "j", "age"), ["tree_id", "j"]))
    ok = rows.where("status = 'ok'")
    value = "value"
    if compatible:
        ok = ok.withColumn("running", F.sum("compatible").over(Window.partitionBy("tree_id", "focal").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
        value = "running"
    fits = fit.fit_profiles(ok, ["tree_id", "focal"], value, bounds, cumulative=compatible).drop("total")
    state = rows.groupBy("tree_id", "focal").agg(F.first("status").alias("status"), F.first("total").alias("total"))
    all_fits = state.join(fits, ["tree_id", "focal"], "left").withColumn("reason", F.coalesce("reason", F.col("status"))).fillna(False, ["converged", "at_lower_bound", "at_upper_bound"]).withColumnRenamed("focal", "site_id")
    names = ("CpB_RW", "PB_RW", "pBO") if weighted else ("CpB", "PB", "pBO")
    return frame(all_fits, trees.summary(edges), names, percentile)


def rate_profile(edges: DataFrame, presence: DataFrame, n_slices: int, index: str = "PD", adj: DataFrame | None = None, criterion: str = "time", normalize: bool = True, domain: str = "mixed", allow_non_ultrametric: bool = False) -> DataFrame:
    """tree_id, site_id, j, age, value, status without a fit; index: PD, PE, PB, PB_RW."""
    edges, presence, sites = prepared(edges, presence, allow_non_ultrametric)
    if index in ("PD", "PE"):
        rows = indices.normalised(site_profiles(edges, presence, n_slices, criterion, sites=sites), index.lower())
        return rows.select("tree_id", "site_id", "j", "age", F.col("share" if normalize else index.lower()).alias("value"), "status")
    w = slicing.windows(edges, n=n_slices, criterion=criterion)
    rows = beta.per_slice(edges, presence, adj, slicing.contribution(edges, w), w, weighted=index == "PB_RW", domain=domain)
    return rows.join(w.select("tree_id", "j", "age"), ["tree_id", "j"]).select("tree_id", F.col("focal").alias("site_id"), "j", "age", F.col("value" if normalize else "compatible").alias("value"), "status")


def sensitivity(edges: DataFrame, presence: DataFrame, grid: tuple[int, ...] = (10, 25, 50, 100, 200, 400), rate: str = "cpd", adj: DataFrame | None = None, component: str = "sorensen", approach: str = "multisite", sample_sites: int | None = None, seed: int = 0, bounds=fit.BOUNDS, domain: str = "mixed", allow_non_ultrametric: bool = False) -> DataFrame:
    """tree_id, site_id, n_slices, rate, converged, bounds' flags, suggested_slices: the first count
    whose rate is within 5 % of the next one's. The slice count is a key of one job."""
    edges, presence, sites = prepared(edges, presence, allow_non_ultrametric)
    counts = trees.summary(edges).select("tree_id", "root_age").withColumn("n_slices", F.explode(F.array(*map(F.lit, grid))))
    w = slicing.equal_time(counts, F.col("n_slices"))
    if rate in ("cpd", "cpe"):
        rows = site_profiles(edges, presence, 0, window_table=w, keys=("n_slices",), sites=sites).withColumn("v", F.col("pd" if rate == "cpd" else "pe"))
    else:
        rows = beta.per_slice(edges, presence, adj, slicing.contribution(edges, w), w, component, approach, rate == "cpb_rw", domain, keys=("n_slices",)).withColumnRenamed("focal", "site_id").withColumn("v", F.col("value")).join(w.select("tree_id", "n_slices", "j", "age"), ["tree_id", "n_slices", "j"])
    if sample_sites is not None:
        some = rows.select("site_id").distinct().orderBy(F.xxhash64(F.lit(seed), "site_id")).limit(sample_sites)
        rows = rows.join(some, "site_id", "left_semi")
    fits = fit.fit_profiles(rows, ["tree_id", "site_id", "n_slices"], "v", bounds)
    order = Window.partitionBy("tree_id", "site_id").orderBy("n_slices")
    nxt = F.lead("rate").over(order)
    near = F.abs(F.col("rate") - nxt) <= F.lit(0.05) * F.greatest(F.abs(nxt), F.lit(1e-12))
    marked = fits.withColumn("_pick", F.when(near, F.col("n_slices")))
    suggested = F.min("_pick").over(Window.partitionBy("tree_id", "site_id"))
    return marked.select("tree_id", "site_id", "n_slices", "rate", "converged", "at_lower_bound", "at_upper_bound", suggested.alias("suggested_slices"))


def run_summary(frame: DataFrame, rate: str) -> DataFrame:
    """One row: n_sites, n_converged, median_rate of a rate frame."""
    return frame.agg(F.count("*").alias("n_sites"), F.count_if("converged").alias("n_converged"), F.median(rate).alias("median_rate"))
