"""Cutting trees into windows of depth: windows by time or by diversity, and what falls into them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.operators import trees

#: Breakpoints of a curve closer than this, relative to the tree's age, are one.
MERGE = 1e-12
#: Bands of depth that a tree's curve is summed in.
BANDS = 256


def pieces(total: float, width: float) -> tuple[int, float]:
    """How many slices a wanted width gives, and their width: the count whose width is nearer, the
    larger count on a tie, never one slice unless the width is the whole."""
    if not 0 < width <= total:
        raise ValueError("the width must be positive and at most the total")
    if width == total:
        return 1, float(total)
    less, more = math.floor(total / width), math.ceil(total / width)
    n = less if abs(width - total / less) < abs(width - total / more) and less != 1 else more
    return n, total / n


def piece_count(total: Column, width: Column) -> Column:
    """`pieces` as a column: null where the width isn't positive or over the total."""
    less, more = F.floor(total / width), F.ceil(total / width)
    n = F.when((F.abs(width - total / less) < F.abs(width - total / more)) & (less != 1), less).otherwise(more)
    return F.when((width > 0) & (width <= total), F.when(width == total, F.lit(1)).otherwise(n).cast("long"))


def equal_time(tree_table: DataFrame, n: int | Column) -> DataFrame:
    """tree_id, j (from 0, root first), lo, hi, age (of the older edge) from (tree_id, root_age)."""
    n = F.lit(n) if isinstance(n, int) else n
    j = F.col("j")
    return tree_table.withColumn("_n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        *[c for c in tree_table.columns if c not in ("root_age",)],
        "j",
        (F.col("root_age") * j / F.col("_n")).alias("lo"),
        (F.col("root_age") * (j + 1) / F.col("_n")).alias("hi"),
        (F.col("root_age") - F.col("root_age") * j / F.col("_n")).alias("age"),
    )


def pd_curve(edges: DataFrame) -> DataFrame:
    """tree_id, depth, next_depth, active, pd_lo, pd_hi: the diversity above each depth, in pieces that
    are straight. A sweep: every edge adds one branch at its upper end and takes it off at its lower.
    Running sums go within bands of depth, to which what the bands before hold is added, so that a
    tree isn't one task. Depths that differ by rounding only are one."""
    events = edges.where("d > b").select("tree_id", F.explode(F.array(F.struct(F.col("b").alias("depth"), F.lit(1).alias("step")), F.struct(F.col("d").alias("depth"), F.lit(-1).alias("step")))).alias("e")).select("tree_id", "e.*")
    ages = edges.groupBy("tree_id").agg(F.max("d").alias("_age"))
    near = F.round(F.col("depth") / (F.lit(MERGE) * F.col("_age"))).cast("long")
    points = events.join(ages, "tree_id").groupBy("tree_id", near.alias("_at")).agg(F.min("depth").alias("depth"), F.sum("step").alias("step")).withColumn("_band", (F.col("_at") * F.lit(MERGE * BANDS)).cast("int"))
    band = Window.partitionBy("tree_id", "_band").orderBy("_at")
    upto = band.rowsBetween(Window.unboundedPreceding, 0)
    bands = Window.partitionBy("tree_id").orderBy("_band")
    earlier = bands.rowsBetween(Window.unboundedPreceding, -1)
    steps = points.groupBy("tree_id", "_band").agg(F.sum("step").alias("_s"), F.min("depth").alias("_first")).select("tree_id", "_band", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"), F.lead("_first").over(bands).alias("_next"))
    wide = points.join(steps, ["tree_id", "_band"]).withColumn("active", F.col("_before") + F.sum("step").over(upto)).withColumn("next_depth", F.coalesce(F.lead("depth").over(band), "_next")).where("next_depth IS NOT NULL")
    wide = wide.withColumn("_area", F.col("active") * (F.col("next_depth") - F.col("depth"))).select("tree_id", "_band", "_at", "depth", "next_depth", "active", "_area")
    areas = wide.groupBy("tree_id", "_band").agg(F.sum("_area").alias("_s")).select("tree_id", "_band", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_before"))
    return wide.join(areas, ["tree_id", "_band"]).withColumn("pd_hi", F.col("_before") + F.sum("_area").over(upto)).select("tree_id", "depth", "next_depth", "active", (F.col("pd_hi") - F.col("_area")).alias("pd_lo"), "pd_hi")


def depth_for_pd(curve: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (tree_id, pd, ...) with the depth above which that much diversity lies."""
    c = curve.select("tree_id", "depth", "next_depth", "active", "pd_lo", "pd_hi")
    last = c.groupBy("tree_id").agg(F.max("pd_hi").alias("_total"))
    t = targets.join(last, "tree_id").withColumn("_pd", F.when(F.abs(F.col("pd") - F.col("_total")) <= F.lit(1e-9) * F.col("_total"), F.col("_total")).otherwise(F.col("pd")))
    return (
        t.join(c, "tree_id")
        # Borders of pieces may differ by rounding; a target between two, or in both, has one depth.
        .where("(pd_lo - 1e-12 * _total < _pd AND _pd <= pd_hi + 1e-12 * _total)")
        .dropDuplicates(targets.columns)
        .select(*targets.columns, F.when(F.col("_pd") >= F.col("pd_hi"), F.col("next_depth")).otherwise(F.col("depth") + F.greatest(F.lit(0.0), F.col("_pd") - F.col("pd_lo")) / F.col("active")).alias("depth"))
    )


def equal_pd(edges: DataFrame, n: int | Column) -> DataFrame:
    """tree_id, j, lo, hi, age of windows of equal diversity. n: a number, or a column of trees' summaries."""
    table = trees.summary(edges).withColumn("_n", (F.lit(n) if isinstance(n, int) else n).cast("int"))
    targets = table.select("tree_id", "root_age", "_n", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("j"), "total_pd").withColumn("pd", F.col("total_pd") * F.col("j") / F.col("_n"))
    cuts = depth_for_pd(pd_curve(edges), targets).select("tree_id", "root_age", "j", F.when(F.col("j") == 0, 0.0).when(F.col("j") == F.col("_n"), F.col("root_age")).otherwise(F.col("depth")).alias("lo"))
    hi = F.lead("lo").over(Window.partitionBy("tree_id").orderBy("j"))
    return cuts.withColumn("hi", hi).where("hi IS NOT NULL").select("tree_id", "j", "lo", "hi", (F.col("root_age") - F.col("lo")).alias("age"))


def windows(edges: DataFrame, n: int | None = None, width: float | None = None, criterion: str = "time", allow_non_ultrametric: bool | None = None) -> DataFrame:
    """n windows of each tree, or as many as a width in time or diversity gives; a width that is over a tree's
    total is an error.
    allow_non_ultrametric: None where the trees have been looked at already."""
    if (n is None) == (width is None):
        raise ValueError("give either the number of slices or their width")
    if allow_non_ultrametric is not None:
        trees.require(edges, allow_non_ultrametric)
    if criterion not in ("time", "pd"):
        raise ValueError("the criterion is 'time' or 'pd'")
    if width is not None:
        total = F.col("root_age" if criterion == "time" else "total_pd")
        n = F.coalesce(piece_count(total, F.lit(float(width))), F.raise_error(F.lit("the width must be positive and at most the total")).cast("long")).cast("int")
    if criterion == "time":
        table = trees.summary(edges)
        return equal_time(table.select("tree_id", "root_age") if isinstance(n, int) else table.select("tree_id", "root_age", n.alias("_count")), n if isinstance(n, int) else F.col("_count")).drop("_count")
    if criterion == "pd":
        return equal_pd(edges, n)
    raise ValueError("the criterion is 'time' or 'pd'")


def overlap(lo: str | Column = "lo", hi: str | Column = "hi") -> Column:
    """How much of an edge's (b, d) lies in a window."""
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (lo, hi))
    return F.greatest(F.lit(0.0), F.least(F.col("d"), hi) - F.greatest(F.col("b"), lo))


def contribution(edges: DataFrame, window_table: DataFrame) -> DataFrame:
    """tree_id, edge_id, j, c (and the other keys of window_table): what every edge gives to every
    window that it reaches into; zeros aren't stored."""
    keys = [c for c in window_table.columns if c not in ("lo", "hi", "age")]
    return edges.select("tree_id", "edge_id", "b", "d").join(window_table, "tree_id").where("d > lo AND b < hi").select(*keys, "edge_id", overlap().alias("c"))


def _depth(edges: DataFrame, value: float, criterion: str) -> DataFrame:
    """tree_id, at: the depth of a threshold, which is an age, or a diversity from the root."""
    table = trees.summary(edges)
    if criterion == "time":
        at = F.when((F.lit(float(value)) >= 0) & (F.lit(float(value)) <= F.col("root_age")), F.col("root_age") - F.lit(float(value)))
        return table.select("tree_id", F.coalesce(at, F.raise_error(F.lit("the time is outside the tree"))).alias("at"))
    if criterion != "pd":
        raise ValueError("the criterion is 'time' or 'pd'")
    wanted = table.select("tree_id", F.when((F.lit(float(value)) >= 0) & (F.lit(float(value)) <= F.col("total_pd")), F.lit(float(value))).otherwise(F.raise_error(F.lit("the diversity is outside the tree")).cast("double")).alias("pd"))
    return depth_for_pd(pd_curve(edges), wanted).select("tree_id", F.col("depth").alias("at"))


def rootward(edges: DataFrame, value: float, criterion: str = "time", allow_non_ultrametric: bool = False) -> DataFrame:
    """The part of trees younger than a time, or below the first value of diversity."""
    trees.require(edges, allow_non_ultrametric)
    return edges.join(_depth(edges, value, criterion), "tree_id").withColumn("length", overlap("at", F.lit(float("inf")))).select(*edges.columns)


def tipward(edges: DataFrame, value: float, criterion: str = "time", allow_non_ultrametric: bool = False) -> DataFrame:
    """The part of trees older than a time, or the first value of diversity."""
    trees.require(edges, allow_non_ultrametric)
    return edges.join(_depth(edges, value, criterion), "tree_id").withColumn("length", overlap(F.lit(0.0), "at")).select(*edges.columns)


def interval(edges: DataFrame, start: float, stop: float, criterion: str = "time", invert: bool = False, allow_non_ultrametric: bool = False) -> DataFrame:
    """The part between two thresholds, older first; invert: what lies outside, as (side, edges)."""
    trees.require(edges, allow_non_ultrametric)
    if (start <= stop) if criterion == "time" else (start >= stop):
        raise ValueError("the interval is empty or reversed")
    lo, hi = _depth(edges, start, criterion).withColumnRenamed("at", "lo"), _depth(edges, stop, criterion).withColumnRenamed("at", "hi")
    both = edges.join(lo, "tree_id").join(hi, "tree_id")
    if not invert:
        return both.withColumn("length", overlap()).select(*edges.columns)
    older = both.withColumn("length", overlap(F.lit(0.0), "lo")).withColumn("side", F.lit("older"))
    younger = both.withColumn("length", overlap("hi", F.lit(float("inf")))).withColumn("side", F.lit("younger"))
    return older.unionByName(younger).select("side", *edges.columns)


def slices(edges: DataFrame, window_table: DataFrame) -> DataFrame:
    """edges of every slice, keyed by j as well; edges outside it have length 0."""
    return edges.join(window_table.select("tree_id", "j", "lo", "hi"), "tree_id").withColumn("length", overlap()).select("j", *edges.columns)


def subset_contribution(edges: DataFrame, window_table: DataFrame, keep: DataFrame) -> DataFrame:
    """tree_id, j, c summed over edges above any tip in keep (tree_id, label)."""
    some = trees.closure(edges).join(keep.select("tree_id", "label").distinct(), ["tree_id", "label"], "left_semi").select("tree_id", "edge_id").distinct()
    return contribution(edges.join(some, ["tree_id", "edge_id"], "left_semi"), window_table).groupBy("tree_id", "j").agg(F.sum("c").alias("c"))


def prune_tips(edges: DataFrame, threshold: float | None = None, quantile: float | None = None, side: str = "after") -> DataFrame:
    """Trees without tips by the length of their own branch: `after` keeps those of at least the
    threshold, `before` those under it. quantile: the threshold is a quantile of the tree's tip branches."""
    if (threshold is None) == (quantile is None) or side not in ("after", "before"):
        raise ValueError("give a threshold or a quantile, and a side")
    tips = edges.where("is_tip").select("tree_id", "label", "length")
    if quantile is None:
        tips = tips.withColumn("at", F.lit(float(threshold)))
    else:
        tips = tips.join(tips.groupBy("tree_id").agg(F.percentile("length", quantile).alias("at")), "tree_id")
    return trees.prune(edges, tips.where("length >= at" if side == "after" else "length < at"))
